"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its words' subwords (the word and its pieces of 2 to 4
bytes, with marks at both ends), hashed to BUCKETS rows. A linear softmax reads the average.
Both are trained by stochastic gradient descent in numpy on a bounded sample: up to PER_LANG
documents of each language outside the held-out fold (those with the smallest hashes of their
id), each as a whole and as a few short cuts. One tenth of them calibrates: a temperature on the
logits, and the score below which a prediction is marked as rejected.

Since reading is linear, embedding and softmax fold into one table of BUCKETS x languages, and
scoring is one map over the documents that sums word rows; whole texts are scored, words of any
length and very long texts part by part.

Defined cases: a null text or one without letters is `und` with score 0; so is every text if
there is nothing to learn from. Ties go to the language that sorts first. Null languages are not
learnt from; of rows that repeat an id and a language the least text is; every row is predicted by its own text; an
empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.llm.common import hash_long, is_held_out, materialize
from panelgraph.llm.labelled import whole_texts

PER_LANG = 500
#: Documents of all languages together; with very many languages each has fewer.
SAMPLE = 50_000
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 4
RATE = 0.5
CUTS = 3
REJECT = 0.01
#: Words that are summed at a time.
PART = 50_000
#: Longer words (runs of letters of unspaced text) are summed piece by piece, PIECE places at a time, and not remembered.
LONG = 40
PIECE = 5_000
_WORD = re.compile(r"[^\W\d_]+")


def pieces(word: str) -> Iterator[list[int]]:
    """The buckets of a word's subwords, the word itself included, PIECE places of it at a time."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    crc, mask = zlib.crc32, BUCKETS - 1
    yield [crc(w) & mask]
    for at in range(0, len(w), PIECE):
        yield [crc(w[i : i + n]) & mask for n in (2, 3, 4) if n < len(w) for i in range(at, min(at + PIECE, len(w) - n + 1))]


def subwords(word: str) -> list[int]:
    return [b for part in pieces(word) for b in part]


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    total, part = np.zeros(BUCKETS, np.int64), []
    for b in (b for w in words for b in pieces(w)):
        part += b
        if len(part) > 20 * PIECE:
            total += np.bincount(part, minlength=BUCKETS)
            part = []
    total += np.bincount(np.array(part, np.int64), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids] / total.sum()


class _Rows(dict):
    """A word's row in the table of summed subwords; forgets all when it has grown large."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table
        self.most = min(400_000, 16_000_000 // (table.shape[1] + 1))
        self.sums = np.empty((self.most + PART, table.shape[1] + 1), np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        b = subwords(word)
        self.sums[at, :-1] = self.table[b].sum(axis=0)
        self.sums[at, -1] = len(b)
        return at


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, reject: float) -> None:
        self.langs, self.table, self.reject = langs, table.astype(np.float32), reject
        self._rows: _Rows | None = None

    def __getstate__(self):
        return {"langs": self.langs, "table": self.table, "reject": self.reject, "_rows": None}

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs) + 1)
        for i in range(0, len(words), PART):  # the table of sums has room for as many new words
            if self._rows is None or len(self._rows) > self._rows.most:
                self._rows = _Rows(self.table)
            part = words[i : i + PART]
            for w in (w for w in part if len(w) > LONG):
                for b in pieces(w):
                    total[:-1] += self.table[b].sum(axis=0, dtype=np.float64)
                    total[-1] += len(b)
            part = [w for w in part if len(w) <= LONG]
            total += self._rows.sums[np.fromiter(map(self._rows.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        z = total[:-1] / total[-1]
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), 0.0)
    rng = np.random.default_rng(seed)
    items: list[tuple[np.ndarray, np.ndarray, int]] = []
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        words = _WORD.findall(t.lower())
        if words:
            to = held if k % 10 == 9 else items
            to.append((*bag(words), names.index(lang)))
            for _ in range(CUTS):
                n = int(rng.integers(3, 25))
                i = int(rng.integers(0, max(1, len(words) - n)))
                to.append((*bag(words[i : i + n]), names.index(lang)))
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w, b = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    total, done = EPOCHS * max(1, len(items)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(items)):
            ids, c, y = items[k]
            rate = RATE * (1 - done / total)
            done += 1
            h = c @ e[ids]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= rate * p
            e[ids] -= rate * len(ids) ** 0.5 * np.outer(c, back)
    table = e @ w + b
    return _calibrated(names, table, held or items)


def _calibrated(names: list[str], table: np.ndarray, held: list) -> Model:
    """The temperature with the best likelihood on held, and the score that all but REJECT of it reach."""
    if not held:
        return Model(names, table, 0.0)
    z = np.stack([c @ table[ids] for ids, c, _ in held])
    y = np.array([k for *_, k in held])

    def logp(t: float) -> np.ndarray:
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    heat = max(np.geomspace(0.1, 10, 41), key=lambda t: logp(t)[np.arange(len(y)), y].mean())
    return Model(names, table * heat, float(np.quantile(np.exp(logp(heat).max(axis=1)), REJECT)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of up to PER_LANG documents of each language (SAMPLE in all, one a language at least), see labelled.whole_texts.

    Of a language with over a thousandth of the rows only ids below a hash that twice as many as needed are
    expected to pass are ranked, so that no task ranks more, however many there are.
    """
    known = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(F.col(id_col))
    rows = docs.where(known).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(rows.groupBy("lang").count(), "langs")
    n, total = counts.agg(F.count("*"), F.sum("count")).first()
    most = max(1, min(PER_LANG, SAMPLE // max(1, n)))
    top = (1 << 60) * (2.0 * most + 100)
    hot = counts.where(F.col("count") > max((total or 0) / 1000, 4 * most)).select("lang", (F.lit(top) / F.col("count")).alias("cut"))  # 1000 rows at most
    ids = rows.select("id", "lang", hash_long("lang", F.col("id")).alias("h")).join(F.broadcast(hot), "lang", "left").where("cut is null or h < cut")
    order = Window.partitionBy("lang").orderBy("h", "id")  # a rank limit, applied before the shuffle too
    picks = ids.drop("cut").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    found: pd.DataFrame = whole_texts(rows.join(F.broadcast(picks.select("id", "lang", "h")), ["id", "lang"]), "lang")  # SAMPLE ids
    return fit(found.text.tolist(), found.lang.tolist())


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected (below the calibrated score)."""
    model = model or learn(docs, id_col, text_col, lang_col)
    schema = docs.select(id_col).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column(1)]
            lang, score = pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())
            low = pa.array([p < model.reject for _, p in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, score, low], names=[id_col, "lang_pred", "score", "rejected"])

    out = docs.select(id_col, text_col).mapInArrow(run, schema)
    return out.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "rejected")
