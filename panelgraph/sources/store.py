"""Named tables of a run as parquet, JSON records, and the manifest of what a run wrote."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgraph.errors import MissingArtifactError
from panelgraph.sources.klines import typed

#: Which step writes a table, for the message when it is missing.
WRITER = {
    "klines": "download", "returns": "graphs", "corr": "graphs", "edges": "graphs", "topology": "topology",
    "event_study": "topology", "predictions": "forecast", "summary": "forecast", "dm": "forecast", "backtest": "backtest", "curves": "backtest",
}


class Store:
    """Tables under one root; writes replace what was there, so steps can be run again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def save(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        """Replaces the table; one that is partitioned only in the partitions that df has."""
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
        (w.partitionBy(*by) if by else w).parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise MissingArtifactError(f"{self.path(name)} is missing; run the step '{WRITER.get(name, name)}' first") from e
            raise

    def cached_klines(self, symbols: list[str], start: str, end: str, fetch, force: bool = False) -> DataFrame:
        """Typed candles of the range; fetch(symbols) refills the symbols that the cache does not cover, or all by force.

        Other cached symbols stay as they are.
        """
        covered: set[str] = set()
        if not force:
            try:
                have = self.load("klines").where(F.col("symbol").isin(symbols))
                ends = have.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
                covered = {r["symbol"] for r in ends.where(F.col("a") <= F.lit(start).cast("date")).where(F.col("b") >= F.lit(end).cast("date")).collect()}  # a row a symbol asked for
            except MissingArtifactError:
                pass
        if lacking := sorted(set(symbols) - covered):
            self.save("klines", typed(fetch(lacking)), by=["symbol"])
        return self.load("klines").where(F.col("symbol").isin(symbols) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def save_json(path: str, record: dict[str, Any]) -> None:
    """UTF-8, sorted keys, LF: equal records are equal bytes."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(record, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")


def load_json(path: str) -> dict[str, Any]:
    if not os.path.exists(path):
        raise MissingArtifactError(f"{path} is missing")
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def manifest(root: str, settings_hash: str) -> dict[str, Any]:
    """SHA-256 of every file of a local run folder, with the settings' hash."""
    files = {}
    for folder, _, names in sorted(os.walk(root)):
        for name in sorted(names):
            with open(os.path.join(folder, name), "rb") as f:
                files[os.path.relpath(os.path.join(folder, name), root)] = hashlib.file_digest(f, "sha256").hexdigest()
    return {"config_sha1": settings_hash, "artifacts": files}
