"""Benchmark decontamination: windows of benchmark words looked up in every training text.

Words are the runs of digits, letters and characters beyond ASCII, with A-Z lowered. A window is
`size` consecutive words of an item, or all of an item with fewer. The hashes of all windows form
a broadcast set; a scan hashes every window of the texts, looks it up, verifies hits against the
words themselves and marks the words they cover.

The set is cut into slices of at most SLICE_BYTES, and the texts are scanned once per slice, with
the marks carried along. So what is broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import refuse, unused, written
from .words import ALPHANUMERIC, LOWER, inside, runs, slices, text_buffers, windows, words_of

SIZE = 10
SLICE_BYTES = 32 << 20
_FILTER_BITS = 20
_HITS = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:int,past:int>>,bytes:array<struct<first:int,past:int>>>"


def benchmark_windows(benchmark: DataFrame, *, size: int = SIZE, text: str = "text", item: str = "item_id") -> DataFrame:
    """n, hash, words, item: the distinct windows of every item. A null id is the item 'null'."""

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(*text_buffers(batch.column("text")), ALPHANUMERIC)
                h, of, count = w.hashes(LOWER), w.text_of(), w.counts
                seen = set()
                for n in sorted({min(int(c), size) for c in count if c}):
                    keys = windows(h, n, 1)
                    ok = inside(w, n) & ((count[of[: len(keys)]] >= size) if n == size else (count[of[: len(keys)]] == n))
                    seen.update((n, int(keys[i].view(np.int64)), w.bytes_of(i, i + n, LOWER), batch.column("item")[int(of[i])].as_py()) for i in np.flatnonzero(ok))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(seen)], schema=out)

    names = ["n", "hash", "words", "item"]
    spec = "n int, hash long, words binary, item string"
    out = to_arrow_schema(benchmark.sparkSession.createDataFrame([], spec).schema)
    items = benchmark.select(F.col(text).alias("text"), F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"))
    return items.mapInArrow(cut, spec).distinct()


class Table:
    """A slice of the windows: sorted hashes for the scan, words and items for the verification."""

    def __init__(self, rows: list) -> None:
        found: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        for r in rows:
            found.setdefault((r["n"], r["hash"]), {}).setdefault(bytes(r["words"]), set()).add(r["item"])
        self.found = found
        self.hashes = {n: np.unique(np.array([h for m, h in found if m == n], np.int64).view(np.uint64)) for n in {m for m, _ in found}}
        self.filters = {}
        for n, h in self.hashes.items():
            self.filters[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[n][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, w) -> Iterator[tuple[int, int, set[str]]]:
        """Verified (first word, number of words, items) of the texts in `w`."""
        h = w.hashes(LOWER)
        for n, table in self.hashes.items():
            keys = windows(h, n, 1)
            maybe = np.flatnonzero(self.filters[n][(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & inside(w, n))
            at = np.searchsorted(table, keys[maybe])
            maybe = maybe[(at < len(table)) & (table[np.minimum(at, len(table) - 1)] == keys[maybe])]
            for i in maybe:
                items = self.found[n, int(keys[i].view(np.int64))].get(w.bytes_of(i, i + n, LOWER))
                if items:
                    yield int(i), n, items


def _pass(docs: DataFrame, table, text: str, hits: str, taken: bool) -> DataFrame:
    """Adds a slice's hits to the column `hits` (`taken`: it holds those of earlier slices)."""
    schema = docs.schema if taken else docs.withColumn(hits, F.lit(None).cast(_HITS)).schema

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema).field(hits).type
        for whole in batches:
            for batch in slices(whole, text):
                w = words_of(*text_buffers(batch.column(text)), ALPHANUMERIC)
                found = [set() for _ in range(batch.num_rows)]
                mark = np.zeros(len(w) + 1, np.int32)
                if taken:
                    for i, r in enumerate(batch.column(hits).to_pylist()):
                        found[i] |= set(r["items"])
                        for s in r["spans"]:
                            mark[w.first[i] + s["first"]] += 1
                            mark[w.first[i] + s["past"]] -= 1
                for i, n, items in table.value.hits(w):
                    mark[i] += 1
                    mark[i + n] -= 1
                    found[int(np.searchsorted(w.first, i, "right")) - 1] |= items
                covered = np.cumsum(mark)[:-1] > 0
                total = np.concatenate(([0], np.cumsum(covered)))
                rows = []
                for i in range(batch.num_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    n_hit = int(total[b] - total[a])
                    first, past = runs(covered[a:b]) if n_hit else ((), ())
                    rows.append({
                        "n_words": b - a, "n_hit": n_hit, "items": sorted(found[i]),
                        "spans": [{"first": int(x), "past": int(y)} for x, y in zip(first, past, strict=True)],
                        "bytes": [{"first": int(w.starts[a + x] - w.text_at[i]), "past": int(w.ends[a + y - 1] - w.text_at[i])} for x, y in zip(first, past, strict=True)],
                    })
                kept = [batch.column(c) for c in batch.schema.names if c != hits]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], names=[*(c for c in batch.schema.names if c != hits), hits])

    return docs.mapInArrow(scan, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, out: str = "hits", size: int = SIZE, text: str = "text", slice_bytes: int = SLICE_BYTES, **columns: str) -> DataFrame:
    """`docs` with a last column `out`: n_words, n_hit, items, and the covered runs as word and byte ranges.

    A null text has no words and no hits. Repeated rows are each scanned; an empty benchmark hits nothing.
    """
    refuse(docs, out)
    table = written(benchmark_windows(benchmark, size=size, **columns), "benchmark-windows")
    cost = F.length("words") + F.length("item") + 300  # what an entry takes in a Python dictionary
    total = table.agg(F.sum(cost)).first()[0] or 0
    n = int(total // (slice_bytes // 2)) + 1
    table = table.withColumn("_slice", F.pmod(F.xxhash64("hash", "item"), F.lit(n)))
    if n > 1:
        largest = table.groupBy("_slice").agg(F.sum(cost).alias("b")).agg(F.max("b")).first()[0]
        if largest > 2 * slice_bytes:
            raise ValueError("one benchmark item is larger than a slice; raise slice_bytes")
    sc = docs.sparkSession.sparkContext
    for k in range(n):
        rows = table.where(F.col("_slice") == k).select("n", "hash", "words", "item").collect()
        docs = _pass(docs, sc.broadcast(Table(rows)), text, out, k > 0)
        if k < n - 1:
            docs = written(docs, "scanned")
    return docs


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for every row of `docs`."""
    found = scan(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, **options) -> DataFrame:
    """`docs` without those of which more than `max_share` of the words are hit."""
    hits = unused("hits", docs.columns)
    found = scan(docs, benchmark, out=hits, **options)
    return found.where(F.col(f"{hits}.n_hit") <= F.lit(max_share) * F.col(f"{hits}.n_words")).drop(hits)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """`docs` with the covered runs, from their first word's start to their last word's end, cut out of `text`."""
    hits = unused("hits", docs.columns)
    found = scan(docs, benchmark, out=hits, text=text, **options)
    raw = F.encode(text, "UTF-8")
    cuts = F.col(f"{hits}.bytes")
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["past"]))
    ends = F.concat(F.transform(cuts, lambda c: c["first"]), F.array(F.octet_length(text)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(raw, p["a"] + 1, p["b"] - p["a"]))
    joined = F.decode(F.aggregate(pieces, F.lit(b""), lambda x, y: F.concat(x, y)), "UTF-8")
    return found.withColumn(text, F.when(F.size(cuts) > 0, joined).otherwise(F.col(text))).drop(hits)
