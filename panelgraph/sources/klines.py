"""A paginated candle feed as a Spark data source, with an injected page provider.

`spark.dataSource.register(KlineSource)` then `spark.read.format("klines")` with the options
symbols (comma-separated), start_ms, end_ms, interval, and provider ("module:function"). The
provider gets (symbol, interval, start_ms, limit) and returns lists of twelve fields whose numbers
may be strings. One partition a symbol; pages are read until one is empty or reaches the end.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = (
    "symbol string, open_time long, open string, high string, low string, close string, volume string, close_time long, "
    "quote_volume string, trades long, taker_buy_base string, taker_buy_quote string, ignore string"
)
LIMIT = 1000


def http_page(symbol: str, interval: str, start_ms: int, limit: int, base: str) -> list[list]:
    """One page of a REST feed; an HTTP error raises."""
    query = urllib.parse.urlencode({"symbol": symbol, "interval": interval, "startTime": start_ms, "limit": limit})
    with urllib.request.urlopen(f"{base}?{query}", timeout=30) as r:
        return json.load(r)


def pages(provider: Callable, symbol: str, interval: str, start_ms: int, end_ms: int, limit: int = LIMIT) -> Iterator[list]:
    """All records of a closed time range, page by page."""
    at = start_ms
    while page := provider(symbol, interval, at, limit):
        yield from (r for r in page if r[0] <= end_ms)
        if page[-1][0] >= end_ms:
            return
        at = page[-1][0] + 1


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class KlineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.options["symbols"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["provider"].split(":")
        provider = getattr(importlib.import_module(module), name)
        o = self.options
        for r in pages(provider, partition.symbol, o.get("interval", "1d"), int(o["start_ms"]), int(o["end_ms"])):
            text = [None if x is None else str(x) for x in r]
            yield (partition.symbol, int(r[0]), *text[1:6], int(r[6]), text[7], int(r[8]), *text[9:12])


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> KlineReader:
        return KlineReader(dict(self.options))


def typed(raw: DataFrame) -> DataFrame:
    """(symbol, date, close, volume, quote_volume, trades) of raw records."""
    day = F.to_date(F.timestamp_millis("open_time"))
    return raw.select("symbol", day.alias("date"), F.col("close").cast("double"), F.col("volume").cast("double"), F.col("quote_volume").cast("double"), F.col("trades").cast("long"))
