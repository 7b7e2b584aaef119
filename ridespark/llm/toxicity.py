"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, letters that look like Latin ones, digits and
signs that stand for letters. The lexicon holds words and beginnings of words with the log odds
of a labelled document having them. A phrase of a lexicon entry and the word before or after it
that occurs in harmless documents is an exception: that occurrence does not count. The weight
found, plain and in relation to the text's length, goes through a logistic curve.

Everything is learned from at most SAMPLE documents of each label, the first by a hash of their id.
In the curve each of them stands for as many labelled documents as its label has for one in the
sample, so that a score is a probability at the share of the label among all documents, however
large the table is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .language import fold
from .tables import refuse, written
from .words import slices

SAMPLE = 15_000
LEXICON = 5_000
SUPPORT = 5
LEAST_WEIGHT = 3.0
#: What an entry needs before its harmless phrases are known, and how many of those are kept.
FIRST_WEIGHT = 0.0
PHRASES = 50_000
BEGINNINGS = (4, 5, 6, 7, 8)
_SLICE = 1 << 20

# What looks like a Latin letter, and what stands for one.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ս": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "​‌‍⁠﻿­"

# l and i are one letter here, as 1 stands for either
_TABLE = str.maketrans(LOOKALIKES | DIGITS | {"l": "i", "ӏ": "i", "ⅼ": "i"} | dict.fromkeys(INVISIBLE))
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_GAP = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """The words of `text` after folding, a space before, between and after them."""
    text = unicodedata.normalize("NFKC", (text or "")).lower()
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text).translate(_TABLE)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: set[str] = field(default_factory=set)  # "word word"
    curve: np.ndarray | None = None
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self._automaton.add_word(term, (term, w))
            self._automaton.make_automaton()
        return self._automaton

    def found(self, text: str) -> dict[int, list[tuple[str, float]]]:
        """Entries at every word (by the place of the space before it) that no exception covers."""
        at: dict[int, list[tuple[str, float]]] = {}
        if self.weights:
            for end, (term, w) in self.automaton().iter(text):
                at.setdefault(end - len(term) + 1, []).append((term, w))
            if self.exceptions:
                at = {i: x for i, x in at.items() if not self.exceptions.intersection(self.phrases(text, i))}
        return at

    def phrases(self, text: str, start: int) -> list[str]:
        end = text.index(" ", start + 1)
        before = text.rfind(" ", 0, start) if start else -1
        after = text.find(" ", end + 1)
        word = text[start + 1 : end]
        return ([f"{text[before + 1 : start]} {word}"] if start else []) + ([f"{word} {text[end + 1 : after]}"] if after > 0 else [])

    def features(self, text: str | None) -> list[float]:
        text = folded(text)
        total = sum(max(w for _, w in x) for x in self.found(text).values())
        n = text.count(" ") - 1
        return [1.0, math.log1p(total), total / math.sqrt(n + 1), total / (n + 10)]


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc_id, text, toxic, stands_for of at most `size` documents of each label. Of several labels the greatest counts.

    `stands_for` is the number of labelled documents of that label for one of the sample.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = written(known.where("toxic = 1").orderBy(*order).limit(size).union(known.where("toxic = 0").orderBy(*order).limit(size)), "label-sample")
    # two rows
    stands = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("_all")).join(F.broadcast(pick.groupBy("toxic").agg(F.count(F.lit(1)).alias("_picked"))), "toxic")
    stands = stands.select("toxic", (F.col("_all") / F.col("_picked")).alias("stands_for"))
    # at most 2 * size rows of three numbers
    return written(docs.select("doc_id", "text").join(F.broadcast(pick.join(F.broadcast(stands), "toxic")), "doc_id"), "labelled")


def _counted(sample: DataFrame, terms, spec: str = "term string, toxic long, harmless long") -> DataFrame:
    """In how many documents of each label `terms(text)` gives a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[0 if toxic else 1].update(terms(text))
        names = sorted(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[t] for t in part], pa.int64()) for s in seen)], names=["term", "toxic", "harmless"])

    counted = sample.select("text", "toxic").mapInArrow(run, spec)
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless"))


def _terms(text: str | None) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def learn(sample: DataFrame, *, lexicon: int = LEXICON, support: int = SUPPORT, least_weight: float = LEAST_WEIGHT) -> Model:
    """A model from doc_id, text, toxic (0 or 1), stands_for of a bounded number of documents.

    Weights of entries compare rates inside each label, which its share among all documents does not move;
    the curve weights documents by `stands_for`.
    Without documents of both labels the model is empty and scores 0.
    """
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("harmless") + 0.5) / (n[0] + 1))
    weight = F.round(weight, 6)

    def best(terms, least: float) -> dict[str, float]:
        rows = _counted(sample, terms).where(F.col("toxic") >= support).withColumn("weight", weight).where(F.col("weight") >= least)
        return {r["term"]: r["weight"] for r in rows.orderBy(F.desc(F.col("weight") * F.log("toxic")), "term").limit(lexicon).collect()}

    share = sample.sparkSession.sparkContext.broadcast
    first = share(Model(best(_terms, FIRST_WEIGHT)))

    def phrases(text: str | None) -> set[str]:
        text = folded(text)
        return {p for at in first.value.found(text) for p in first.value.phrases(text, at)}

    harmless = _counted(sample, phrases).where((F.col("harmless") >= support) & (weight < 0)).orderBy(F.desc("harmless"), "term").limit(PHRASES)
    second = share(Model(first.value.weights, {r["term"] for r in harmless.collect()}))
    # entries again, where they stand outside those phrases
    all_ = best(lambda text: {t for x in second.value.found(folded(text)).values() for t, _ in x}, least_weight)
    # an entry is needless if a beginning of it says about as much
    weights = {t: w for t, w in all_.items() if not any(all_.get(t[:k], -1.0) >= w - 0.7 for k in range(2, len(t)))}
    model = Model(weights, second.value.exceptions)
    shared = share(model)

    def measure(batches):
        for batch in batches:
            rows = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32()), batch.column("stands_for")], names=["x", "y", "w"])

    found = sample.orderBy("doc_id").select("text", "toxic", "stands_for").mapInArrow(measure, "x array<double>, y int, w double").toPandas()
    # to an average of one, so that the penalty keeps its size
    w = found["w"].to_numpy(float)
    model.curve = logistic(np.array(found["x"].tolist()), found["y"].to_numpy(float), w / w.mean())
    return model


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients under row weights `w` by Newton's method, halving steps that do not lower the loss."""
    b = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return w @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty * len(y) * (b[1:] @ b[1:])

    ridge = penalty * len(y) * np.diag([1e-9, *np.ones(len(b) - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(b)), x.T @ (w * (y - p)) - ridge @ b)
        rate = 1.0
        while loss(b + rate * step) > loss(b) and rate > 1e-4:
            rate /= 2
        b = b + rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the probability of the label 1; a null text is an empty one."""
    refuse(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon, bounded by its parameter
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text, _SLICE):
                p = np.zeros(batch.num_rows)
                if m.curve is not None:
                    x = np.array([m.features(t) for t in batch.column(text).to_pylist()])
                    p = 1 / (1 + np.exp(-np.clip(x @ m.curve, -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are never read."""
    known = labels.where(fold(F.col("doc_id"), 5) != 0)
    model = learn(labelled_sample(docs, known, sample))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
