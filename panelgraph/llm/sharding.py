"""Sharding: a reproducible shuffle whose shard and slot can be computed for any row number.

Law "rows": the rows get gapless global row numbers 0..n-1, a Feistel permutation with cycle
walking moves number i to p(i), and the row goes to shard p(i) mod k, slot p(i) div k. Shard
sizes differ by one row at most. The row numbers follow the content (a hash bucket of the id,
the id, then the tie columns), never the files or partitions, so reruns agree.

Scale: numbering needs no global sort. Rows are dealt to hash buckets by id and tie columns, counted
per bucket (one narrow scan), the bucket counts become offsets, and row_number() runs inside each
bucket. There is a bucket for each ROWS rows, MOST at most, which bounds the counts on the driver and
what is broadcast. Only rows that are equal in the id and all tie columns (size and crc of the text) share
a bucket for certain, so null ids and ids that many texts have are dealt out too. Carried columns
follow the sort of their bucket and take no other part.

Defined cases: a null id takes part as the text ''; a null text has size 1 and the crc of ''.
Repeated rows get slots of their own, in any order among indistinguishable ones. An empty table
gives an empty result. Very long texts are hashed in place. Columns of the input other than those
named are carried or left out as `carry` says; a carried column with the name of a result column goes on
as NAME_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.llm.common import hash_long
from panelgraph.llm.feistel import permute_below, sides

#: Rows a bucket, and buckets at most.
ROWS, MOST = 20_000, 1 << 18


def bucket_of(parts: list[Column], seed: str, buckets: int) -> Column:
    return hash_long(seed, "bucket", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]) % buckets


def numbered(df: DataFrame, id_col: str, ties: list[str], seed: str) -> tuple[DataFrame, int]:
    """df with row_no_, the gapless global row numbers, and the count of rows."""
    spark = df.sparkSession
    buckets = max(64, min(MOST, -(-df.count() // ROWS)))
    bucket = bucket_of([F.col(c) for c in (id_col, *ties)], seed, buckets)
    counts = df.select(bucket.alias("bucket_")).groupBy("bucket_").count().collect()  # a row a bucket
    start, offsets = 0, []
    for b, n in sorted((r[0], r[1]) for r in counts):
        offsets.append((b, start))
        start += n
    small = spark.createDataFrame(offsets, "bucket_ long, offset_ long")
    order = Window.partitionBy("bucket_").orderBy(id_col, *ties)
    out = (
        df.withColumn("bucket_", bucket)
        .withColumn("within_", F.row_number().over(order))
        .join(F.broadcast(small), "bucket_")  # one row a bucket
        .withColumn("row_no_", F.col("within_") - 1 + F.col("offset_"))
        .drop("bucket_", "within_", "offset_")
    )
    return out, start


def shard_rows(
    docs: DataFrame,
    shards: int,
    seed: str = "shard",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, carried columns, size, text_crc32, law, shard, slot, grown_shard."""
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep: dict[str, str] = {}
    for c in (c for c in carry or [] if c != id_col):
        name = c
        while name in [id_col, *own, *keep.values()] or name != c and name in carry:
            name += "_in"
        keep[c] = name
    base = docs.select(
        F.col(id_col),
        F.struct(*keep).alias("row_") if keep else F.lit(None).alias("row_"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows, n = numbered(base, id_col, ["text_crc32", "size"], seed)
    a, b = sides(n)
    place = permute_below(F.col("row_no_").cast("long"), F.lit(n), F.lit(a).cast("long"), F.lit(b).cast("long"), seed)
    return rows.withColumn("place_", place).select(
        id_col,
        *[F.col(f"row_.`{c}`").alias(name) for c, name in keep.items()],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place_") % shards).cast("int").alias("shard"),
        ((F.col("place_") - F.col("place_") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
