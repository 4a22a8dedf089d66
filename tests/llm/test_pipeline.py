from pyspark.sql import functions as F

import corpus_pipeline
from panelgraph.llm.ngram_jaccard import jaccard_components
from panelgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_take_effect_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF).cache()
        assert kept.columns == columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
        if name == "ngram_jaccard":
            assert jaccard_components(kept).where("component_id <> doc_id").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() and last.select("shard", "slot").distinct().count() == kept.count()


def test_stages_take_empty_tables_nulls_repeats_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, None), (2, ""), (None, "no id here at all, really none"), (3, "one two three"), (3, "one two three"), (4, "word " * 40_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0).cast(docs.schema["n_chars"].dataType))
    odd = odd.select(*docs.columns)
    for c in ("size", "taken", "row_", "score_", "shard", "component_id", "place_", "id", "copies"):
        odd = odd.withColumn(c, F.lit("777"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name != "sharding":
            assert got.columns == odd.columns and {r.size for r in got.collect()} == {"777"}
        else:
            assert {r.size_in for r in got.collect()} == {r.shard_in for r in got.collect()} == {"777"} and got.count() == len(rows)
        if name in ("toxicity", "decontamination"):
            assert got.count() == len(rows)
        if name == "mixing":
            kept = [r.doc_id for r in got.collect()]
            assert set(kept) <= {None, 1, 2, 3, 4} and kept.count(1) <= 1 and kept.count(2) <= 1
