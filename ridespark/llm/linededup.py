"""Lines that several documents share, kept in one of them, as compressed keep bitmaps.

A line's key is the line without the white space `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Keys
of `least` code points or more in at least `documents` documents keep their lines in the document of
the largest id only, with all their lines there.

Hashes of keys are range-partitioned together with document and position, so that a key that many
documents share lies in as many partitions as it fills, and are sorted so that a key's last document
comes first. A task streams through its rows: the first document of a key keeps its lines, those of
later ones go once a third document is seen. The first and the last key of a task may go on in
another one; their rows wait for a summary of these keys, two rows a task, and are decided by it.

Rows with one id are one document; a null id is a document of its own, before all others. A null or
an empty text is one empty line. Lines, texts and keys of any length are whole; memory holds one
text and a bounded number of rows. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import refuse, unused, written
from .words import slices, text_buffers

LEAST, DOCUMENTS = 20, 3
SLICE_TEXT = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
#: Ids and text hashes a task remembers so as to send the lines of a repeated row once.
_REPEATED = 1 << 16

KEYS = ["_no", "_id", "_h"]


def keyed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_no` (the id is null), `_id`, `_h` (a hash of the text) and `text` (empty for null): rows with equal keys have the same lines."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).isNull().alias("_no"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("_id"), F.xxhash64(value).alias("_h"), value.alias("text"))


def key_of(line: bytes, least: int) -> bytes | None:
    """The key of a line, None if it is shorter than `least` code points."""
    k = line.strip(_SPACE).lower()  # of bytes: A-Z only
    if len(k) < least or len(k) < 4 * least and len(k.decode()) < least:
        return None
    return k


def line_hashes(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """KEYS, `a`, `b` (128 bits of a key's hash) and `line` (its number from 0 on) for every line with a key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: set[tuple] = set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_TEXT):
                data, at = text_buffers(batch.column("text"))
                data = data.tobytes() if batch.num_rows else b""
                no, ids, texts = (batch.column(k).to_pylist() for k in KEYS)
                hashes, lines, row = [], [], []
                for r, mark in enumerate(zip(no, ids, texts, strict=True)):
                    if mark in seen:
                        continue
                    if len(seen) >= _REPEATED:
                        seen.clear()
                    seen.add(mark)
                    for n, line in enumerate(data[at[r] : at[r + 1]].split(b"\n")):
                        if (k := key_of(line, least)) is not None:
                            hashes.append(xxh3_128_digest(k))
                            lines.append(n)
                            row.append(r)
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                taken = batch.select(KEYS).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(lines, pa.int32())], names=[*KEYS, "a", "b", "line"])

    return rows.select(*KEYS, "text").mapInArrow(run, "_no boolean, _id long, _h long, a long, b long, line int")


# -- decisions --------------------------------------------------------------------

GOES, WAITS, MARK = 0, 1, 2


def _order() -> list[Column]:
    """A key's rows from its last document on; a null id is before all others, and so comes last here."""
    return [F.col("a"), F.col("b"), F.col("_no"), F.col("_id").desc(), F.col("_h"), F.col("line")]


class _Stream:
    """The rows of one task in order. Of the key at hand it knows how many documents it has had."""

    def __init__(self, documents: int) -> None:
        self.documents = documents
        self.first = self.key = self.doc = None
        self.n = 0
        self.held: list[pa.RecordBatch] = []  # rows of later documents of the key at hand, not yet decided
        self.marks: list[pa.RecordBatch] = []  # its first documents

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, no, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "_no", "_id"))
        self.first = self.first or (a[0], b[0])
        new_key = np.concatenate(([self.key != (a[0], b[0])], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        new_doc = new_key | np.concatenate(([self.doc != (no[0], ids[0])], (no[1:] != no[:-1]) | (ids[1:] != ids[:-1])))
        if new_key[0]:
            self.n = 0
        # number of the row's document inside its key, from 1 on
        run, count = np.cumsum(new_key) - new_key[0], np.cumsum(new_doc)
        starts = np.concatenate(([0], np.flatnonzero(new_key[1:]) + 1))
        before = np.concatenate(([-self.n], count[starts[1:]] - 1))
        number = count - before[run]
        most = number[np.concatenate((starts[1:], [len(a)])) - 1]  # numbers ascend inside a key

        if self.held and (new_key[0] or most[0] >= self.documents):
            if not new_key[0]:
                yield from (_told(x, GOES) for x in self.held)
            self.held = []
        if new_key[0] or run[-1] > 0:
            self.marks = []
        begins = (a == self.first[0]) & (b == self.first[1])
        later = (number > 1) & ~begins
        here = run == run[-1]
        heads = new_doc & (number <= self.documents)
        if run[-1] > 0:
            self.held = []
        self.marks.append(_part(batch, heads & here & ~begins))
        if most[-1] < self.documents:
            self.held.append(_part(batch, later & here))
        yield _told(_part(batch, later & (most[run] >= self.documents)), GOES)
        if begins.any():
            yield _told(_part(batch, begins), WAITS)
            yield _told(_part(batch, begins & heads), MARK)
        self.key, self.doc, self.n = (a[-1], b[-1]), (no[-1], ids[-1]), int(number[-1])

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from (_told(x, WAITS) for x in self.held)
        yield from (_told(x, MARK) for x in self.marks)


def _part(batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(mask))


def _told(rows: pa.RecordBatch, what: int) -> pa.RecordBatch:
    return rows.append_column("what", pa.array(np.full(rows.num_rows, what, np.int32)))


def dropped_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """KEYS and `line` of the rows of `line_hashes` that go. `lines` is read twice: write it before."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = lines.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(documents)
        for batch in batches:
            if batch.num_rows:
                yield from stream.rows(batch)
        yield from stream.rest()

    told = written(laid.select(*KEYS, "a", "b", "line").mapInArrow(run, "_no boolean, _id long, _h long, a long, b long, line int, what int"), "lines-decided")
    # at most 2 * documents rows a task
    marks = told.where(F.col("what") == MARK).select("a", "b", "_no", "_id").distinct()
    keys = marks.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((~F.col("_no")).alias("there"), F.col("_id"))).alias("last"))
    waiting = told.where(F.col("what") == WAITS).join(F.broadcast(keys), ["a", "b"])
    late = waiting.where((F.col("n") >= documents) & (F.struct((~F.col("_no")).alias("there"), F.col("_id")) != F.col("last")))
    return told.where(F.col("what") == GOES).select(*KEYS, "line").unionByName(late.select(*KEYS, "line"))


# -- bitmaps ------------------------------------------------------------------------


def bitmap(gone: np.ndarray) -> bytes:
    """A compressed bit for each line up to the last that goes, 0 for a line that stays and 1 for one
    that goes, so that what fills the last byte, and all lines beyond it, stay."""
    bits = np.zeros(int(gone.max()) + 1, bool)
    bits[gone] = True
    return zlib.compress(np.packbits(bits).tobytes())


def gone_lines(keep: bytes | None) -> np.ndarray:
    """The numbers of the lines that go, from 0 on."""
    if keep is None:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)) == 1)


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """KEYS and `keep` of every document that loses lines."""
    lines = written(line_hashes(keyed(docs, key=key, text=text), least), "lines")
    lists = dropped_lines(lines, documents).groupBy(*KEYS).agg(F.collect_list("line").alias("lines"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lines")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            maps = [bitmap(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(maps, pa.binary())], names=[*KEYS, "keep"])

    return lists.mapInArrow(run, "_no boolean, _id long, _h long, keep binary")


def with_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with a column `keep`, null where all lines stay."""
    refuse(docs, "keep")
    maps = keep_bitmaps(docs, key=key, text=text, **options)
    names = {k: unused(k, docs.columns) for k in KEYS}
    marked = docs.withColumns({names[k]: v for k, v in zip(KEYS, (F.col(key).isNull(), F.coalesce(F.col(key), F.lit(0)).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))), strict=True)})
    return marked.join(maps.withColumnsRenamed(names), list(names.values()), "left").select(*docs.columns, "keep")


def kept_texts(docs: DataFrame, *, text: str = "text", keep: str = "keep") -> DataFrame:
    """`docs` without `keep`, `text` without its lines that go, with n_lines (before) and n_dropped."""
    refuse(docs, "n_lines", "n_dropped")
    names = [c for c in docs.columns if c != keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != keep), "n_lines long", "n_dropped long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, SLICE_TEXT):
                data, at = text_buffers(batch.column(text))
                data = data.tobytes() if batch.num_rows else b""
                texts, total, lost = [], [], []
                for r, keep_ in enumerate(batch.column(keep).to_pylist()):
                    value = data[at[r] : at[r + 1]]
                    total.append(value.count(b"\n") + 1)
                    gone = gone_lines(keep_)
                    lost.append(len(gone))
                    if len(gone):
                        gone = set(gone.tolist())
                        value = b"\n".join(line for n, line in enumerate(value.split(b"\n")) if n not in gone)
                    texts.append(value)
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(run, schema)


def line_digests(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_lines, n_dropped, kept_sha256 of the lines that stay, joined by line feeds."""
    kept = kept_texts(with_bitmaps(docs.select(key, "text"), key=key))
    return kept.select(key, "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
