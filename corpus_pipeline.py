"""A corpus preparation pipeline: each stage works on what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgraph.llm.common import materialize, table
from panelgraph.llm.queries import SHARDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores stays below one half; all columns stay, whatever their names.

    Null and empty texts score 0 and stay; rows that repeat an id are judged each by its text; an
    empty table stays empty.
    """
    from panelgraph.llm.toxicity import learn, score_documents

    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")), docs.columns)
    return scored.where("score_ < 0.5").select("row_.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the smallest id; others stay as they are.

    Null and empty texts and null ids link with nothing and stay; rows that repeat an id are one document, of
    which all rows stay or go.
    """
    from panelgraph.llm.ngram_jaccard import jaccard_components

    found = jaccard_components(docs)
    dropped = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the error budget; null and empty texts hold none."""
    from panelgraph.llm.decontamination import clean

    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; its columns stay, whatever their names.

    Documents without words are taken once at most; a null source is a source of its own.
    """
    from panelgraph.llm.mixing import mix

    taken = mix(docs, carry=docs.columns).where("copies > 0")
    return taken.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row_.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; a column that is named like one of the results goes on as NAME_in."""
    from panelgraph.llm.sharding import shard_rows

    return shard_rows(docs, SHARDS, carry=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Toxicity, decontamination and mixing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
