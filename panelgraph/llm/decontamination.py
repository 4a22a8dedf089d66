"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, runs of anything but letters and digits become
one space). An item of m characters may differ by up to e = floor(ERRORS * m) edits. It is cut
into e + HITS pieces: any text part within e edits of the item holds at least HITS pieces exactly,
each shifted by e characters at most. All pieces go into one Aho-Corasick automaton that passes
once over every whole text. Where enough pieces of an item lie within such shifts, Myers'
bit-parallel algorithm finds the least edit distance of the item to any part of that window.

The test set is a stated query set: it goes to the executors in blocks whose text is at most
BLOCK characters, and every block meets all documents. With few blocks (the usual case) that is
one scan; nothing is shuffled.

Defined cases: null or empty texts match nothing, and neither does an item without a letter or digit;
items with fewer than SHORT normalised characters are searched whole and without error, between
spaces or ends of the normalised text; equal items are searched each under their own id, and rows that
repeat both id and text once; a null id is one of its own. An empty benchmark finds nothing, an empty
table of documents gives an empty result, and equal documents each get their rows. Very long texts are
searched whole, one at a time. Other columns of the documents are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgraph.llm.common import tidy

ERRORS = 0.1
#: Items with fewer normalised characters must be found exactly.
SHORT = 40
BLOCK = 4_000_000
#: Pieces beyond the error budget, and so exact pieces that every match must hold.
HITS = 3
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into errors + HITS parts of about equal length."""
    k = errors + HITS
    cuts = [i * len(item) // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(item: str, masks: dict[str, int], text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the part of text closest to item, if within limit; Myers 1999, one column a character."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best: tuple[int, int] | None = None
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may start anywhere, so no carry enters
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = score, j + 1
            if score == 0:
                break
    return best


class Index:
    """The automaton over the pieces of a block of items (id, text)."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS, short: int = SHORT) -> None:
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            t = normalise(text)
            if not t:
                continue
            if len(t) < short:
                at.setdefault(t, []).append((len(self.items), -1))
                self.items.append((key, t, 0, {}))
                continue
            e = int(errors * len(t))
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            for off, p in pieces(t, e):
                at.setdefault(p, []).append((len(self.items), off))
            self.items.append((key, t, e, masks))
        self.automaton = ahocorasick.Automaton()
        for p, where in at.items():
            self.automaton.add_word(p, (len(p), where))
        if at:
            self.automaton.make_automaton()

    def _windows(self, k: int, hits: list[tuple[int, int]], length: int) -> list[list[int]]:
        """Where HITS pieces of item k have starts (start, piece) within 2 e of each other; windows are joined."""
        _, item, e, _ = self.items[k]
        hits.sort()
        out: list[list[int]] = []
        held: dict[int, int] = {}
        first = 0
        for start, piece in hits:
            held[piece] = held.get(piece, 0) + 1
            while hits[first][0] < start - 2 * e:
                old = hits[first][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                first += 1
            if len(held) >= HITS:
                a, b = max(0, hits[first][0] - e), min(length, start + len(item) + e)
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                else:
                    out.append([a, b])
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start of the window, end of the match) of the items found, in normalised characters."""
        t = normalise(text)
        if not self.items or len(t) < 1:
            return []
        starts: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, tuple[int, int, int, int]] = {}
        for end, (n, where) in self.automaton.iter(t):
            for k, off in where:
                if off >= 0:
                    starts.setdefault(k, []).append((end + 1 - n - off, off))
                elif k not in whole and t[end - n : end - n + 1] in ("", " ") and t[end + 1 : end + 2] in ("", " "):
                    whole[k] = self.items[k][0], 0, end + 1 - n, end + 1
        windows = {k: w for k, hits in starts.items() if len(hits) >= HITS and (w := self._windows(k, hits, len(t)))}
        out = list(whole.values())
        for k, spans in windows.items():
            key, item, e, masks = self.items[k]
            found = None
            for a, b in spans:
                hit = least_distance(item, masks, t[a:b], e)
                if hit and (found is None or hit[0] < found[1]):
                    found = key, hit[0], a, a + hit[1]
                    if not hit[0]:
                        break
            if found:
                out.append(found)
        return sorted(out, key=lambda x: (x[0] is not None, x))


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK characters; one block is on the driver at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col).distinct().orderBy(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", errors: float = ERRORS) -> DataFrame:
    """One row per document and item found in it: id_col, item_col, distance, window_start, match_end."""
    out = None
    names = [id_col, item_col, "distance", "window_start", "match_end"]
    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names[1:], ("long", "int", "int", "int"), strict=True))
    schema = T.StructType(docs.select(id_col).schema.fields + T.StructType.fromDDL(added).fields)
    for block in blocks(benchmark, item_col, "text"):

        def run(batches: Iterator[pa.RecordBatch], items=block) -> Iterator[pa.RecordBatch]:
            index = Index(items, errors)
            for batch in batches:
                at, rows = [], []
                for i, t in enumerate(batch.column(1)):
                    for hit in index.search(t.as_py()):
                        at.append(i)
                        rows.append(hit)
                cols = zip(*rows, strict=True) if rows else [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

        part = docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], items=block) -> Iterator[pa.RecordBatch]:
            index = Index(items, errors)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
