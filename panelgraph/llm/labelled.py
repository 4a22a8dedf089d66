"""The labelled documents a classifier may learn from: a bounded, reproducible sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgraph.llm.common import hash_long, is_held_out

#: Labelled documents of each class that a classifier is fitted on, and characters of them in all (an equal share a class).
PER_CLASS = 1000
MAX_CHARS = 20_000_000


def known_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of the labelled ids outside the held-out fold; of several labels the largest counts."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))


def chosen(labels: DataFrame, label: str, per_class: int = PER_CLASS, id_col: str = "doc_id") -> DataFrame:
    """(id, y, h) of up to per_class ids of either class: those with the smallest hashes, so reruns agree."""
    known = known_labels(labels, label, id_col).withColumn("h", hash_long("sample", F.col("id")))
    picks = [known.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    return picks[0].unionByName(picks[1])


def share_of_ones(labels: DataFrame, label: str, id_col: str = "doc_id") -> float | None:
    """The share of label 1 among all ids that may be learnt from."""
    return known_labels(labels, label, id_col).agg(F.avg(F.col("y").cast("double"))).first()[0]


def whole_texts(rows: DataFrame, group: str) -> pd.DataFrame:
    """rows (id, text, h, group, ...) on the driver, in the order of h, one an id, as many whole texts as MAX_CHARS holds.

    Every group has an equal share of MAX_CHARS. A text that does not fit into what is left of its
    group's share is passed over, and the next ones are tried. The caller bounds the number of ids; rows
    that repeat an id are reduced to the least text on the cluster, and sizes are looked at before any
    text is fetched.
    """
    rows = rows.groupBy(*[c for c in rows.columns if c != "text"]).agg(F.min("text").alias("text"))
    sizes = rows.select("id", "h", group, F.length("text").alias("n")).toPandas().sort_values(["h", "id"])
    left = dict.fromkeys(sizes[group], MAX_CHARS // max(1, sizes[group].nunique()))
    fits = []
    for key, g, n in zip(sizes.id.tolist(), sizes[group], sizes.n.tolist(), strict=True):
        if n <= left[g]:
            left[g] -= n
            fits.append(key)
    if len(fits) < len(sizes):
        rows = rows.where(F.col("id").isin(fits))
    return rows.toPandas().sort_values(["h", "id"]).reset_index(drop=True)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """(id, y, h, text) of the chosen ids; at most 2 * per_class ids are broadcast to the documents."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return whole_texts(texts.join(F.broadcast(chosen(labels, label, per_class, id_col)), "id"), "y")
