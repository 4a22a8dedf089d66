"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence scores p = sigmoid(bias + sum of its words' weights) and a document 1 - prod(1 - p), the
noisy-or of its sentences: it is toxic if at least one of them is. Only documents are labelled;
the gradient of the noisy-or hands each label to the sentences that explain it, so the weights
can point at the offending sentences afterwards.

Inputs are words (lower-cased runs of letters) and their beginnings; one counts if it occurs in
at least MIN_DOCS documents of the fitting sample (a bounded sample of labelled rows, see labelled.py).
Weights are fitted by full-batch Adam with an L1 proximal step; the bias stays negative, so that
a sentence without any known word is clean.

Scoring is one map over the documents with the weights sent along (at most MAX_WORDS of them).
Whole texts are scored, very long ones sentence by sentence. Defined cases: null and empty texts, which
have no sentence, score 0; sentences without any input count once per document; if no label can be
learnt from, every score is about 0. Repeated rows get equal scores; rows that repeat an id are scored each by
its text; an empty table gives an empty result. Other columns are carried only where the caller asks,
whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgraph.llm.common import is_held_out, tidy
from panelgraph.llm.labelled import sample

MIN_DOCS = 3
MAX_WORDS = 50_000
STEPS = 200
RATE = 0.1
L1 = 2e-4
PREFIXES = (4, 5, 6, 7)
_SENTENCE = re.compile(r"[^.!?\n。！？]+(?:[.!?。！？]+|\n|$)")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in characters."""
    return [m.span() for m in _SENTENCE.finditer(text or "")]


def features(word: str) -> list[str]:
    """A word and its beginnings, which inflected and compounded forms share."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


class _Weights(dict):
    """The sum of the weights of a word's features, None if the model has none of them; forgets all when it has grown large."""

    def __init__(self, of: dict[str, float]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> float | None:
        if len(self) > 200_000:
            self.clear()
        known = [self.of[f] for f in features(word) if f in self.of]
        x = self[word] = sum(known) if known else None
        return x

    def __reduce__(self):
        return _Weights, (self.of,)


class Model:
    """Feature weights and a bias."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words = _Weights(weights)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of the sentences above one half."""
        clean, found = 0.0, []
        base = np.logaddexp(0.0, self.bias)
        of = self.words
        text = text or ""
        low = text.lower()
        same = len(low) == len(text)  # a few letters become longer, so then each sentence is lowered by itself
        unknown = False
        for m in _SENTENCE.finditer(low if same else text):
            z, known = self.bias, False
            for w in _WORD.findall(m.group() if same else m.group().lower()):
                if (x := of[w]) is not None:
                    z += x
                    known = True
            if not known:
                unknown = True
                continue
            clean += (max(z, 0.0) + log1p(exp(-abs(z)))) if z > -30 else exp(z)
            if z > 0:
                found.append((*m.span(), 1 / (1 + exp(-z))))
        return float(-np.expm1(-(clean + (base if unknown else 0.0)))), found


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Weights from document labels. Sentences without any input count once per document, as in scoring."""
    docs: Counter = Counter()
    for t in texts:  # one text's features at a time
        docs.update({f for w in set(_WORD.findall(t.lower())) for f in features(w)})
    vocab = sorted((w for w, n in docs.items() if n >= MIN_DOCS), key=lambda w: (-docs[w], w))[:MAX_WORDS]
    del docs
    if not vocab or y.min(initial=1) == y.max(initial=0):
        return Model({}, -30.0)
    index = {w: k for k, w in enumerate(vocab)}
    # Sentences hold words and words hold features, so the sums below run over words, of which there are far fewer.
    number: dict[str, int] = {}
    of_word, of_feature = array("i"), array("i")

    def numbered(word: str) -> int:
        """The number of a word with a feature in index, -1 of any other."""
        if word not in number:
            known = [index[f] for f in features(word) if f in index]
            number[word] = numbered.next if known else -1
            if known:
                of_word.extend([numbered.next] * len(known))
                of_feature.extend(known)
                numbered.next += 1
        return number[word]

    numbered.next = 0
    row, col, val, doc = array("i"), array("i"), array("f"), array("i")
    n = 0
    for d, t in enumerate(texts):
        unknown = False
        for a, b in sentences(t):
            known = Counter(map(numbered, _WORD.findall(t[a:b].lower())))
            known.pop(-1, None)
            if not known and unknown:
                continue
            unknown = unknown or not known
            row.extend([n] * len(known))
            col.extend(known)
            val.extend(known.values())
            doc.append(d)
            n += 1
    n_words = numbered.next
    del number
    row, col, val, doc, of_word, of_feature = (np.array(x) for x in (row, col, val, doc, of_word, of_feature))
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # either class counts alike
    w, bias = np.zeros(len(vocab)), -4.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, val * np.bincount(of_word, w[of_feature], n_words)[col], n)
        clean = np.bincount(doc, np.logaddexp(0.0, z), len(texts))  # -log of the noisy-or's product
        # d loss / d clean: 1 for label 0, -1 / (exp(clean) - 1) for label 1.
        g = np.where(y == 1, -1.0 / np.maximum(np.expm1(np.minimum(clean, 50.0)), 1e-6), 1.0) * weight / len(texts)
        gz = g[doc] / (1.0 + np.exp(np.minimum(-z, 50.0)))
        gw, gb = np.bincount(of_feature, np.bincount(col, gz[row] * val, n_words)[of_word], len(w)), gz.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        size = RATE / (np.sqrt(m2 / c2) + 1e-8)
        w = w - size * m1 / c1
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(size * L1, 0.5), 0.0)
        bias = min(bias - RATE * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-8), -2.0)
    return Model(dict(zip(vocab, w.tolist(), strict=True)), float(bias))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels, "toxic")
    return fit(rows.text.tolist(), rows.y.to_numpy())


def score_documents(docs: DataFrame, model: Model, carry: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_ (a struct of the carried columns), score_, and offending_: an array of (start, end, score) of sentences."""
    added = T.StructType.fromDDL("score_ double, offending_ array<struct<start:int,end:int,score:double>>")
    at = carry.index(text_col) if text_col in carry else None  # a text that is carried travels once
    body = docs.select(F.struct(*carry).alias("row_"), *([F.col(text_col).alias("text_")] if at is None else []))
    schema = T.StructType([body.schema["row_"], *added.fields])
    found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(1) if at is None else batch.column(0).field(at):
                s, f = model.score(t.as_py())
                scores.append(s)
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in f])
            cols = [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, found)]
            yield pa.RecordBatch.from_arrays(cols, names=["row_", "score_", "offending_"])

    return body.mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, offending."""
    out = score_documents(docs, learn(docs, labels), [id_col], id_col, text_col)
    return out.select(
        f"row_.{id_col}",
        is_held_out(F.col(f"row_.{id_col}")).alias("held_out"),
        F.col("score_").alias("score"),
        (F.col("score_") >= 0.5).cast("int").alias("predicted"),
        F.col("offending_").alias("offending"),
    )
