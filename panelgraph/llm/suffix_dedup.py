"""Exact removal of repeated byte strings with suffix arrays over shards of candidate text.

Every byte that lies in a 100-byte string which also starts earlier (in a smaller document id,
or earlier in the same document) is removed.

1. Each string of 100 bytes has one key: the least hash among its 32-byte pieces. Equal strings
   have equal keys, so they can only meet inside a key. A run of consecutive starts with one key
   is a segment; there is about one per 35 bytes. A scan emits (key, document, start, hash of the
   segment's bytes), never the bytes.
2. Inside a key, equal segments are one: its first occurrence owns it and all starts of the others
   are repeats. A segment is settled if its key has no other one and does not recur inside it.
3. The bytes of the other owners are cut from the texts, dealt by key, and streamed in key order
   into shards of about `SHARD` bytes. A shard's suffix array is induced, permuted common
   prefixes of 100 or more bytes mark the classes of equal strings, and in each class all starts
   but the earliest are repeats.
4. A key with more bytes than a shard is cut into several. Each of them also emits its classes'
   earliest starts with a 128-bit digest of the string, and the earliest of a digest over all
   shards wins. So no suffix array grows with a key; the segments of one key (five longs each) do meet
   in one task, sorted and streamed, when its equal ones are found and when its bytes are read.
5. Repeats are gathered per document and its bytes are cut.

Defined cases: a null or empty text has no byte; texts under 100 bytes lose nothing; a null id
counts as smaller than any other. Rows that repeat both id and text are the same document (neither
is earlier, each gets the same result); texts of one id that differ are ordered by their hash; an empty
table gives an empty result. A very long text is hashed whole in one task, at some 40 bytes of memory a byte.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.llm.bitmap import bitmap, rows_where
from panelgraph.llm.common import materialize
from panelgraph.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 100
PIECE = 32
#: Bits of the bitmap of documents whose text has to travel.
ID_BITS = 23
SHARD = 1 << 20
#: Starts in a segment at most; longer runs are cut, which changes no key.
RUN = 1 << 14
NO_ID = -(1 << 63)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ORDER = ("id", "th", "at")


def _pieces(data: bytes) -> np.ndarray:
    """The hash of the 32 bytes at each position that has them."""
    n = len(data) - PIECE + 1
    word = np.ndarray((n + PIECE - 8,), "<u8", data, 0, (1,))
    h = word[:n] * _P1
    for k in range(8, PIECE, 8):
        h ^= h >> np.uint64(29)
        h += word[k : n + k] * _P2
    h ^= h >> np.uint64(32)
    h *= _P1
    h ^= h >> np.uint64(29)
    return h


def segments(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, bool]]:
    """(key, first start, number of starts, whether the key recurs inside) of each segment."""
    if len(data) < length:
        return []
    h = _pieces(data)
    width, least, have = length - PIECE + 1, h, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(h) - width + 1], least[width - have :])
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    begin = np.concatenate([[0], cut])
    count = np.diff(np.append(begin, len(least)))
    key = least[begin]
    if count.max() > RUN:
        parts = -(-count // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        key, begin, count = (np.repeat(x, parts) for x in (key, begin, count))
        begin, count = begin + nth * RUN, np.minimum(count - nth * RUN, RUN)
    # Whether the key's piece occurs twice within a segment of two or more starts.
    more = np.flatnonzero(count > 1)
    spans = count[more] + width - 1
    at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(begin[more], spans)
    hits = np.concatenate([[0], np.cumsum(h[at] == np.repeat(key[more], spans))])
    inner = np.zeros(len(key), bool)
    inner[more] = np.diff(hits[np.concatenate([[0], np.cumsum(spans)])]) > 1
    return list(zip(key.view(np.int64).tolist(), begin.tolist(), count.tolist(), inner.tolist(), strict=True))


#: A segment's place in one long: its first start, whether it may hold its key twice, its number of starts.
_N = 1 << 15
_SCAN = pa.schema([(c, pa.int64()) for c in ("key", "id", "th", "place", "seg")])
SCAN = "key long, id long, th long, place long, seg long"


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            cols: list[list] = [[] for _ in _SCAN]
            for i, th, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                data = _bytes(text.as_py())
                view = memoryview(data)
                for key, at, n, inner in segments(data):
                    for col, x in zip(cols, (key, i, th, (at * 2 + inner) * _N + n, _long(xxhash.xxh3_64_intdigest(view[at : at + n + LENGTH - 1]))), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCAN, strict=True)], schema=_SCAN)


_CUT = pa.schema([(c, pa.int64()) for c in ("key", "id", "th", "at", "n")] + [("bytes", pa.binary())])
CUT = "key long, id long, th long, at long, n long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            cols: list[list] = [[] for _ in _CUT]
            for i, th, text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = _bytes(text)
                for w in wanted:
                    at, n = w["at"], w["n"]
                    for col, x in zip(cols, (w["key"], i, th, at, n, data[at : at + n + LENGTH - 1]), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CUT, strict=True)], schema=_CUT)


def repeats(parts: list[tuple[int, int, int, int, bytes]], length: int = LENGTH, open_: bool = False):
    """Of segments (id, th, at, n, bytes): the repeated starts (segment, start), and if open the classes' first ones."""
    sizes = np.array([len(p[4]) + 1 for p in parts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = np.frombuffer(b"\0".join(p[4] for p in parts) + b"\0", np.uint8).astype(np.uint16) + 2
    joined[base[1:] - 1] = 1
    joined[-1] = 0  # separators are 1 and the end is 0, so no byte equals either
    sa = suffix_array(joined, 258)
    lcp = common_prefixes(joined, sa, length)[sa]
    seg = np.repeat(np.arange(len(parts)), sizes)
    off = np.arange(len(joined)) - base[seg]
    n = np.array([p[3] for p in parts])
    # Suffixes in order; a class is a maximal run with common prefixes of `length` or more.
    cls = np.cumsum(lcp < length)
    valid = off[sa] < n[seg[sa]]
    at, cls = sa[valid], cls[valid]
    # Starts are compared by document, then by position, whatever segment they are in.
    who = np.lexsort([np.array([p[k] for p in parts]) for k in (1, 0)])
    doc_of = np.empty(len(parts), np.int64)
    doc_of[who] = np.cumsum([0] + [parts[x][:2] != parts[y][:2] for x, y in zip(who[1:], who[:-1], strict=True)])
    place = np.array([p[2] for p in parts])[seg[at]] + off[at]
    order = np.lexsort([place, doc_of[seg[at]], cls])
    at, cls, place, d = at[order], cls[order], place[order], doc_of[seg[at]][order]
    head = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    first = np.repeat(head, np.diff(np.append(head, len(cls))))
    repeat = (d != d[first]) | (place != place[first])
    out = seg[at[repeat]], off[at[repeat]]
    return (*out, seg[at[~repeat]], off[at[~repeat]]) if open_ else out


_MARK = pa.schema([(c, pa.int64()) for c in ("id", "th", "at", "n", "d1", "d2")])
MARK = "id long, th long, at long, n long, d1 long, d2 long"


def _runs(seg: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Consecutive starts of a segment as (segment, first, count)."""
    if len(seg):
        order = np.lexsort([off, seg])
        seg, off = seg[order], off[order]
        head = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1)))
        yield from zip(seg[head].tolist(), off[head].tolist(), np.diff(np.append(head, len(seg))).tolist(), strict=True)


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in key order to repeated starts (d1 null), and of split keys the open classes' first starts (d1, d2)."""

    def settle(parts: list, open_: bool) -> pa.RecordBatch:
        rows: list[tuple] = []
        seg, off, *first = repeats(parts, LENGTH, open_)
        for k, o, n in _runs(seg, off):
            rows.append((*parts[k][:2], parts[k][2] + o, n, None, None))
        if open_:
            for k, o in zip(first[0].tolist(), first[1].tolist(), strict=True):
                d = hashlib.blake2b(parts[k][4][o : o + LENGTH], digest_size=16).digest()
                rows.append((*parts[k][:2], parts[k][2] + o, 1, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        cols = zip(*rows, strict=True) if rows else [[]] * len(_MARK)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], schema=_MARK)

    # done: segments of whole keys; key: those of the key being read; open_: whether some of it has gone.
    done: list = []
    key: list = []
    size = key_size = 0
    now, open_ = None, False
    for batch in batches:
        for k, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != now:
                if open_:
                    yield settle(key, True)
                else:
                    done += key
                    size += key_size
                key, key_size, now, open_ = [], 0, k, False
                if size >= SHARD:
                    yield settle(done, False)
                    done, size = [], 0
            key.append(tuple(part))
            key_size += len(part[4]) + 1
            if key_size >= 2 * SHARD:
                yield settle(key, True)
                key, key_size, open_ = [], 0, True
    if open_ and key:
        yield settle(key, True)
    elif key:
        done += key
    if done:
        yield settle(done, False)


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, marks) to the counts, the digest and the spans (start, end, start, end, ...)."""
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            cols: list[list] = [[] for _ in _OUT]
            for i, text, marks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = _bytes(text)
                spans: list[int] = []
                for at, end in sorted((m["at"], m["at"] + m["n"] + LENGTH - 1) for m in marks or ()):
                    if spans and at <= spans[-1]:
                        spans[-1] = max(spans[-1], end)
                    else:
                        spans += [at, end]
                edges = [0, *spans, len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = i, len(data), len(data) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    # Where ids are unique, as they should be, no hash is needed to tell documents apart.
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    hashed = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.select("id", hashed.alias("th"), "text")
    scan = rows.mapInArrow(_scan, SCAN)
    key, same = Window.partitionBy("key"), Window.partitionBy("key", "seg")
    # Equal documents (id and text) own a segment together, hence the comparison by value.
    scan = scan.withColumn("first", F.min(F.struct("id", "th", "place")).over(same)).withColumn("lo", F.min("seg").over(key)).withColumn("hi", F.max("seg").over(key))
    inner = F.shiftright("place", 15).bitwiseAND(1) == 1
    scan = scan.withColumn("copy", F.struct("id", "th", "place") != F.col("first"))
    scan = scan.where(F.col("copy") | (F.col("lo") != F.col("hi")) | inner)
    place = [F.shiftright("place", 16).alias("at"), F.col("place").bitwiseAND(_N - 1).alias("n")]
    scan = materialize(scan.select("key", "id", "th", *place, "copy"), "segments")
    wanted = scan.where("not copy").groupBy("id", "th").agg(F.collect_set(F.struct("key", "at", "n")).alias("wanted"))
    texts = rows_where(rows, "id", _ids(scan.where("not copy")), True)
    cut = texts.join(wanted, ["id", "th"]).select("id", "th", "text", "wanted").mapInArrow(_cut, CUT)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = materialize(cut.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sort_shards, MARK), "marks")
    over = Window.partitionBy("d1", "d2")
    later = marks.where("d1 is not null").withColumn("first", F.min(F.struct(*_ORDER)).over(over)).where(F.struct(*_ORDER) != F.col("first"))
    parts = [scan.where("copy"), marks.where("d1 is null"), later]
    ranges = parts[0].select("id", "th", "at", "n")
    for p in parts[1:]:
        ranges = ranges.unionByName(p.select("id", "th", "at", "n"))
    touched = _ids(parts[0].select("id").unionByName(marks.select("id")))
    ranges = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    out = rows_where(rows, "id", touched, True).join(ranges, ["id", "th"], "left").select("id", "text", "marks").mapInArrow(_remove, OUT)
    whole = rows_where(rows, "id", touched, False).select("id", "text", F.expr("cast(null as array<struct<at:bigint,n:bigint>>)").alias("marks"))
    out = out.unionByName(whole.mapInArrow(_remove, OUT))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), *out.columns[1:])


def _ids(rows: DataFrame):
    """A broadcast bitmap, of fixed size, of the ids in rows."""
    return rows.sparkSession.sparkContext.broadcast(bitmap(rows.select(F.col("id").alias("h")), ID_BITS))
