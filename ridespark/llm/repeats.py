"""Substring deduplication: seeds that recur are extended to the length threshold and beyond.

A seed is `SEED` consecutive words. Winnowing keeps the least seed hash of every `WINDOW`
words, so two equal windows keep an equal anchor. Documents meet on anchors that occur more than
once; around each, every window of `WINDOW` words that the anchor stands for is an extension of it to
both sides, and two windows are equal if their 128-bit hashes are. The first place of every such
window is found by one aggregation. All others are repeats; overlapping ones join into the
maximal repeat, whose words are removed.

No list of the places of an anchor or window is ever formed: a passage in a third of all
documents costs one row per place.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .keys import KEYS, doc_id, keyed, placed
from .tables import written
from .words import NOT_SPACE, SLICE_BYTES, inside, slices, text_buffers, windows, words_of

WINDOW = 20
#: WINDOW - SEED + 1 seeds in a window: a power of two, for the running minimum.
SEED = 5


def _least(seeds: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` (a power of two) consecutive values."""
    step = 1
    while step < width:
        seeds = np.minimum(seeds[:-step], seeds[step:]) if len(seeds) > step else seeds[:0]
        step *= 2
    return seeds


def _anchors(w, hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (first words) that lie in one text, and the anchor of each."""
    ok = np.flatnonzero(inside(w, size))
    return ok, _least(windows(hashes, seed, 2), size - seed + 1)[ok].view(np.int64)


def anchors(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """anchor, row: the anchors of every text; twice if the text has it at two places."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(*text_buffers(batch.column("text")), NOT_SPACE)
                h = w.hashes()
                first, anchor = _anchors(w, h, size, seed)
                of = w.text_of()[first]
                new = np.ones(len(first), bool)  # a run of windows with the same anchor starts
                new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
                start = np.flatnonzero(new)
                value, length = anchor[start], np.diff(np.concatenate((start, [len(first)])))
                seeds, width = windows(h, seed, 2).view(np.int64), size - seed + 1
                places = np.zeros(len(start), np.int64)
                for j in range(2 * width - 1):
                    near = j < length + width - 1
                    places[near] += seeds[first[start[near]] + j] == value[near]
                times = 1 + ((places > 1) | (length > width))
                row = batch.column("_row").to_numpy(zero_copy_only=False)[of[start]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(value, times)), pa.array(np.repeat(row, times))], names=["anchor", "_row"])

    return rows.select("_row", "text").mapInArrow(scan, "anchor long, _row long")


def _repeated(batch: pa.RecordBatch, w, hashes, size: int, seed: int) -> np.ndarray:
    """First words of the windows whose anchor is among those listed for their text."""
    first, anchor = _anchors(w, hashes, size, seed)
    of = w.text_of()[first]
    listed = batch.column("_anchors")
    counts = np.array(pc.list_value_length(listed), np.int64)
    values = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(values):
        return first[:0]
    # one sorted set for all texts of the batch would let a text's anchor pass for another's
    owner = np.repeat(np.arange(len(counts)), counts)
    spread = values.view(np.uint64) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mine = anchor.view(np.uint64) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first[np.isin(mine, spread)]


def extensions(joined: DataFrame, size: int, seed: int) -> DataFrame:
    """h1, h2, at: the windows around repeated anchors, and their place in the table."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            w = words_of(*text_buffers(batch.column("text")), NOT_SPACE)
            h = w.hashes()
            at = _repeated(batch, w, h, size, seed)
            of = w.text_of()[at]
            base = batch.column("_base").to_numpy(zero_copy_only=False)[of]
            columns = [windows(h, size, s)[at].view(np.int64) for s in (3, 4)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(base + (at - w.first[of]))], names=["h1", "h2", "at"])

    return joined.where(F.size("_anchors") > 0).select("_z", "_anchors", "_base").mapInArrow(scan, "h1 long, h2 long, at long")


def removal(docs: DataFrame, *, size: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: `_no`, `_id`, `_h`, text, n_words, n_removed, kept (the words left, joined by one space).

    A null text has no words. Texts of fewer than `size` words lose none. Of equal rows all but one lose
    every word; a null id comes after all others.
    """
    width = size - seed + 1
    if width < 1 or width & (width - 1):
        raise ValueError("size - seed + 1 must be a power of two")
    rows = keyed(docs, key=key, text=text).withColumn("_row", F.xxhash64(*KEYS))
    places = placed(rows.withColumn("_most", F.octet_length("text")), _most=F.max("_most"))
    # a place is one number: the document's, and the word's in bits enough for the longest text
    bits = max(1, math.ceil(math.log2((places.agg(F.max("_most")).first()[0] or 0) + 2)))
    places = places.select(*KEYS, F.shiftleft("_g", bits).alias("_base"))

    found = anchors(rows, size, seed)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    lists = written(found.join(often, "anchor", "left_semi").groupBy("_row").agg(F.collect_set("anchor").alias("_anchors")), "anchors")
    places = places.withColumn("_row", F.xxhash64(*KEYS))
    around = places.join(lists, "_row", "left").withColumn("_anchors", F.coalesce("_anchors", F.array().cast("array<long>")))
    around = written(around, "around")
    # texts are dealt out once, for both uses below
    joined = _packed(rows).join(around, ["_row", *KEYS])
    firsts = extensions(joined, size, seed).groupBy("h1", "h2").agg(F.min("at").alias("at"))
    firsts = firsts.select(F.shiftleft(F.shiftright("at", bits), bits).alias("_base"), F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("at"))
    firsts = firsts.groupBy("_base").agg(F.collect_list("at").alias("_firsts"))
    back = firsts.join(places, "_base").select("_row", *KEYS, "_firsts")
    keep = joined.withColumn("_k", F.row_number().over(W.partitionBy("_row", *KEYS).orderBy("_base")))
    return _removed(keep.join(back, ["_row", *KEYS], "left"), size, seed)


def _packed(rows: DataFrame) -> DataFrame:
    """`rows` with the text compressed, column `_z`: it is most of what is shuffled."""
    import zstandard

    def pack(batches):
        coder = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole, "text"):
                z = [coder.compress(t.encode()) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(z, pa.binary())], names=[*kept, "_z"])

    kept = ["_row", *KEYS]
    kind = dict(rows.dtypes)["_id"]
    return rows.select(*kept, "text").mapInArrow(pack, f"_row long, _no boolean, _id {kind}, _h long, _z binary")


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with `text` for `_z`."""
    import zstandard

    coder = zstandard.ZstdDecompressor()
    for whole in batches:
        z = whole.column("_z")
        rest = whole.select([c for c in whole.schema.names if c != "_z"])
        i = 0
        while i < whole.num_rows:
            j, size, texts = i, 0, []
            while j < whole.num_rows and size < SLICE_BYTES:
                texts.append(coder.decompress(z[j].as_py()).decode())
                size += len(texts[-1])
                j += 1
            part = rest.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])
            i = j


def _removed(df: DataFrame, size: int, seed: int) -> DataFrame:
    kinds = dict(df.dtypes)
    spec = f"_no boolean, _id {kinds['_id']}, _h long, text string, n_words long, n_removed long, kept string"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            w = words_of(*text_buffers(batch.column("text")), NOT_SPACE)
            again = np.zeros(len(w) + 1, bool)
            again[_repeated(batch, w, w.hashes(), size, seed)] = True
            copies = batch.column("_k").to_pylist()
            lists = batch.column("_firsts")
            n_firsts = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            again[np.repeat(w.first[:-1], n_firsts) + lists.flatten().to_numpy(zero_copy_only=False)] = False
            at = np.flatnonzero(again)
            mark = np.zeros(len(w) + 1, np.int64)
            mark[at] += 1
            mark[at + size] -= 1
            gone = np.cumsum(mark)[:-1] > 0
            n, removed, kept = [], [], []
            for i in range(batch.num_rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if copies[i] > 1:
                    gone[a:b] = b - a >= size
                left = np.flatnonzero(~gone[a:b]) + a
                n.append(b - a)
                removed.append(b - a - len(left))
                kept.append(b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[left], w.ends[left], strict=True)).decode())
            cols = [batch.column(c) for c in ("_no", "_id", "_h", "text")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*("_no", "_id", "_h", "text"), "n_words", "n_removed", "kept"])

    return df.mapInArrow(scan, spec)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return removal(docs, **options).select(doc_id().alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
