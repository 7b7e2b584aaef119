"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. An n-gram's vector binds
its letters' vectors, each rotated by its place. A text's vector bundles (sums) those of its
n-grams, a language's prototype those of its texts. A text gets the language whose prototype has
the greatest cosine with it.

Texts are lower-cased; a run of anything but letters is one space, and a space stands before and
after every text. Bundles of integers are exact sums, so neither partitions nor their order
change a prototype.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import refuse, unused
from .words import mix, slices

DIMENSIONS = 1024
ORDER = 3
UNKNOWN = "und"
MAX_LANGUAGES = 10_000
#: The cosine of unrelated texts is spread by 1 / sqrt(dimensions); so many spreads are more than chance.
NOISE = 4.0
#: Clean texts with fewer letters than this may have no more than a chance cosine.
ENOUGH_LETTERS = 50
_SLICE = 256 << 10
_CODES = 0x110000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(_CODES)), bool, _CODES))
    return _letters[0]


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for every code point; 0 stands for the space."""
    with np.errstate(over="ignore"):
        blocks = np.arange(dimensions // 64, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        words = mix(mix(codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))[:, None] ^ blocks)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def gram_counts(texts: list[str | None], owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners, n-grams and counts of all texts; the code points behind the n-grams; letters of each text.

    `owner` has the row that each text counts for. An n-gram is a number in the base of the
    number of code points.
    """
    texts = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    letter = _is_letter()[codes]
    n_letters = np.bincount(of[letter], minlength=len(texts))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (of[1:] != of[:-1])
    codes, of = np.where(letter, codes, 0)[keep], of[keep]
    there = np.zeros(_CODES, bool)
    there[codes] = True
    alphabet = np.flatnonzero(there)
    place = np.zeros(_CODES, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    codes = place[codes]
    n = len(codes) - order + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, alphabet, n_letters
    gram = np.zeros(n, np.int64)
    for k in range(order):
        gram = gram * len(alphabet) + codes[k : k + n]
    whole = of[:n] == of[order - 1 :]
    most = len(alphabet) ** order
    key = owner[of[:n][whole]] * most + gram[whole]
    if len(owner) and (int(owner.max()) + 1) * most < 2**31:
        key = key.astype(np.int32)
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(key)])))
    return key[first] // most, key[first] % most, counts, alphabet, n_letters


def bundle(texts: list[str | None], owner: np.ndarray, n_owners: int, order: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of every owner, and the letters of every text."""
    who, grams, counts, alphabet, n_letters = gram_counts(texts, owner, order)
    out = np.zeros((n_owners, dimensions), np.float64)
    if not len(grams):
        return out, n_letters
    distinct, at = np.unique(grams, return_inverse=True)
    letters = letter_vectors(alphabet, dimensions)
    rolled = [np.roll(letters, k, axis=1) for k in range(order)]
    for lo in range(0, len(distinct), 8192):
        part = distinct[lo : lo + 8192].astype(np.int64)
        vector = np.ones((len(part), dimensions), np.int8)
        for k in range(order):
            vector *= rolled[k][part % len(alphabet)]
            part //= len(alphabet)
        mine = (at >= lo) & (at < lo + 8192)
        matrix = np.zeros((n_owners, len(part)), np.float32)
        matrix[who[mine], at[mine] - lo] = counts[mine]
        out += matrix @ vector.astype(np.float32)
    return out, n_letters


def prototypes(docs: DataFrame, *, text: str = "text", lang: str = "lang", order: int = ORDER, dimensions: int = DIMENSIONS) -> DataFrame:
    """lang, at, value: the bundles of all texts with a language. A task sends one vector per language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", 4 * _SLICE):
                coded = batch.column("lang").dictionary_encode()
                names = coded.dictionary.to_pylist()
                vectors, _ = bundle(batch.column("text").to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names), order, dimensions)
                for name, v in zip(names, vectors, strict=True):
                    total[name] = total.get(name, 0) + v.astype(np.int64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "at", "value"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return labelled.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))


def profile(docs: DataFrame, *, dimensions: int = DIMENSIONS, **options) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their prototypes at length one: one vector per language on the driver."""
    found = prototypes(docs, dimensions=dimensions, **options)
    table = found.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("v"))
    rows = table.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is this the language column?")
    rows = sorted((r for r in rows if any(r["v"])), key=lambda r: r["lang"])
    matrix = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dimensions)
    return [r["lang"] for r in rows], matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", letters_out: str | None = None, order: int = ORDER) -> DataFrame:
    """`docs` with the predicted language and (1 + cosine) / 2, and the number of letters if `letters_out` names it.

    A null text, one without a letter, and any text under an empty model is `und` with score 0.
    Of languages with equal cosines the first by code point wins.
    """
    more = [letters_out] if letters_out else []
    refuse(docs, lang_out, score_out, *more)
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # one vector per language
    schema = docs.withColumn(lang_out, F.lit("")).withColumn(score_out, F.lit(0.0)).withColumns({c: F.lit(0).cast("long") for c in more}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, text, _SLICE):
                n = batch.num_rows
                best, score, letters = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
                if names:
                    vectors, letters = bundle(batch.column(text).to_pylist(), np.arange(n), n, order, known.shape[1])
                    size = np.linalg.norm(vectors, axis=1)
                    cosine = np.round(vectors @ known.T / np.where(size > 0, size, 1)[:, None], 9)
                    at = np.argmax(cosine, axis=1)
                    ok = (letters > 0) & (size > 0)
                    score = np.where(ok, np.clip((1 + cosine[np.arange(n), at]) / 2, 0, 1), 0.0)
                    best = [names[a] if o else UNKNOWN for a, o in zip(at, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score), *(pa.array(letters, pa.int64()) for _ in more)], names=[*batch.schema.names, lang_out, score_out, *more])

    return docs.mapInArrow(run, schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out.

    A null id is not held out. Repeated rows are learned from and predicted as often as they occur.
    """
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = profile(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, *, least: float = 0.5, noise: float = NOISE, enough: int = ENOUGH_LETTERS, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` without the texts that have no letters or are unlike every language of the table.

    Prototypes come from all rows with a language. A text needs a score of `least`, that of a
    cosine of 0, and from `enough` letters on a cosine of `noise` spreads of unrelated texts, too.
    A shorter text cannot be told from chance and stays.
    """
    name, score, letters = unused("lang_pred", docs.columns), unused("lang_score", docs.columns), unused("n_letters", docs.columns)
    model = profile(docs, text=text, lang=lang)
    found = identify(docs, model, text=text, lang_out=name, score_out=score, letters_out=letters)
    clear = (1 + noise / np.sqrt(model[1].shape[1])) / 2
    needed = F.when(F.col(letters) >= enough, F.lit(max(least, float(clear)))).otherwise(F.lit(least))
    return found.where((F.col(name) != UNKNOWN) & (F.col(score) >= needed)).drop(name, score, letters)
