"""Token ids of whole texts, in byte-aligned variable-length files.

A file table has one row per block of documents. Ids are replaced by their rank in the
corpus-wide frequency order, so that the commonest 256 take one byte. A rank takes 1 to 4
little-endian bytes in `data`; its length less one takes two bits in `control`, four ranks a
control byte. Every document is padded with rank 0 to a whole control byte. `ranks.parquet`
beside the blocks holds the id of every rank. Decoding looks lengths up in a table of 256 x 4.

Documents lie in ascending order of their id, nulls first, and rows of one id in the order of a
hash of their ids; shards are numbered in the same order.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import drop_table
from .tables import new_path, refuse, written
from .words import ragged, slices

END_ID = 2
BLOCK_IDS = 1 << 18
SLICE_TEXT = 8 << 20
CACHED_WORDS = 700_000

#: Bytes of the four ranks under each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


# -- coding -------------------------------------------------------------------


def encode(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control and data bytes of every document; `counts` says how many of the ranks each has."""
    groups = -(-counts // 4)
    padded = np.zeros(int(groups.sum()) * 4, np.uint32)
    padded[ragged(4 * (np.cumsum(groups) - groups), counts)] = ranks
    size = (1 + (padded > 0xFF) + (padded > 0xFFFF) + (padded > 0xFFFFFF)).astype(np.uint8)
    code = (size - 1).reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes()
    data = padded.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    c = np.concatenate(([0], np.cumsum(groups)))
    d = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[4 * c]
    return [(control[c[i] : c[i + 1]], data[d[i] : d[i + 1]]) for i in range(len(counts))]


def decode(control: bytes, data: bytes) -> np.ndarray:
    """The ranks, padding included."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    end = np.cumsum(size)
    at = end - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    out = raw[at]
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


# -- tokens -------------------------------------------------------------------

_loaded: dict[int, tuple] = {}
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Memo:
    """Ids of the words met so far: a word's number, and per number its place in one array of ids."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.used = np.empty(0, np.int32)

    def shrink(self) -> None:
        """Forgets the words that one slice only has had."""
        words = [w for w, n in self.number.items() if self.used[n] > 1]
        if len(words) > CACHED_WORDS // 2:
            return self.clear()
        at = np.fromiter((self.number[w] for w in words), np.int64, len(words))
        ids, lengths, used = self.ids[ragged(self.starts[at], self.lengths[at])], self.lengths[at], self.used[at]
        self.clear()
        self._append(ids, lengths)
        self.used = used
        self.number = {w: i for i, w in enumerate(words)}

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Words without special tokens are encoded together, with one between them."""
        mark = self.special[0] if self.special else None
        all_ = "\n".join(words)
        if mark is None or any(s in all_ for s in self.special):
            found = [e.ids for i in range(0, len(words), 5_000) for e in self.tokenizer.encode_batch_fast(words[i : i + 5_000], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths
        joined = [mark.join(words[i : i + 50]) for i in range(0, len(words), 50)]
        code, parts = self.tokenizer.token_to_id(mark), []
        for i in range(0, len(joined), 200):
            for e in self.tokenizer.encode_batch_fast(joined[i : i + 200], add_special_tokens=False):
                parts += [e.ids, (code,)]
        ids = np.fromiter(itertools.chain.from_iterable(parts), np.uint32)
        ends = np.flatnonzero(ids == code)
        if len(ends) != len(words):
            raise ValueError("the special token does not part words")
        return ids[ids != code], np.diff(ends, prepend=-1) - 1

    def add(self, words: list[str]) -> None:
        """Encodes new words. Letters and the signs that end a word are separate to the tokenizer, and so is case."""
        number = self.number
        cores, ends = [], []
        for w in words:
            core = w.rstrip(_PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < "\u0130"):
                cores.append(core.lower())
                ends.append(w[len(core) :])
            else:
                cores.append(w)
                ends.append("")
        new = [w for w in dict.fromkeys(itertools.chain(cores, ends)) if w not in number]
        first = len(self.lengths)
        self._append(*self.encode(new))
        number.update(zip(new, range(first, first + len(new)), strict=True))
        # a word with an ending sign, from the ids of both; any other is its core
        pairs = [(w, a, b) for w, a, b in zip(words, cores, ends, strict=True) if b]
        number.update((w, number[a]) for w, a, b in zip(words, cores, ends, strict=True) if not b)
        if pairs:
            at = np.array([(number[a], number[b]) for _, a, b in pairs], np.int64)
            ids = self.ids[ragged(self.starts[at].ravel(), self.lengths[at].ravel())]
            first = len(self.lengths)
            self._append(ids, self.lengths[at].sum(axis=1))
            number.update((w, first + i) for i, (w, _, _) in enumerate(pairs))

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.used = np.concatenate((self.used, np.zeros(len(lengths), np.int32)))
        self.ids = np.concatenate((self.ids, ids))


def _tokenizer(definition: str):
    """The tokenizer and its memo of white-space separated words, one per worker process."""
    key = hash(definition)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        tokenizer = Tokenizer.from_str(definition)
        _loaded[key] = (tokenizer, Memo(tokenizer))
    return _loaded[key]


def ids_of_texts(texts: pa.Array, definition: str, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has.

    `by_word` encodes every distinct white-space separated word once, and of a word of letters and
    ending signs both parts. That gives the ids of the whole text when the tokenizer drops white
    space and case and parts letters from signs before its merges, and its special tokens hold no
    white space, as the word tokenizer here does.
    """
    tokenizer, memo = _tokenizer(definition)
    texts = texts.fill_null("")
    if not by_word:
        encoded = [e.ids for e in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(encoded), np.uint32), np.array([len(e) for e in encoded], np.int64)
    split = pc.ascii_split_whitespace(texts.cast(pa.string()))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(memo.number) > CACHED_WORDS:
        memo.shrink()
    number = memo.number
    missing = [w for w in words if w not in number]
    if missing:
        memo.add(missing)
    at = np.fromiter(map(memo.number.__getitem__, words), np.int64, len(words))
    memo.used[at] += 1
    at = at[coded.indices.to_numpy(zero_copy_only=False)]
    lengths = memo.lengths[at]
    ids = memo.ids[ragged(memo.starts[at], lengths)]
    sums = np.concatenate(([0], np.cumsum(lengths)))
    at = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.diff(sums[at - at[0]])


def tokenize(
    docs: DataFrame, definition: str, *, end_id: int = END_ID, text: str = "text", out: str = "ids", by_word: bool = True, kind: str = "<u4"
) -> DataFrame:
    """`docs` with a binary column `out`: the ids of the whole text and the end id, as integers of `kind`.
    A null text has the end id only.
    """
    refuse(docs, out)
    schema = docs.withColumn(out, F.lit(b"")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, SLICE_TEXT):
                ids, counts = ids_of_texts(batch.column(text), definition, by_word)
                end = np.cumsum(counts)
                ids = np.insert(ids, end, end_id).astype(kind)
                at = np.concatenate(([0], end + np.arange(1, len(counts) + 1)))
                rows = [ids[at[i] : at[i + 1]].tobytes() for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def kind_of(definition: str, end_id: int = END_ID) -> str:
    """The narrowest integers that hold all ids of a tokenizer."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values())
    return "<u2" if most < 1 << 16 else "<u4"


# fixed value: the words of a tokenizer file whose words may be encoded apart
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_by_word(definition: str) -> bool:
    """Whether a tokenizer gives the ids of a text word by word: it lowers case, drops white space and
    parts letters from signs before its merges, and no special token holds white space."""
    d = json.loads(definition)
    steps = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers", [])]
    split = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    tokens = [t["content"] for t in d.get("added_tokens", [])]
    return (
        "Lowercase" in steps
        and set(steps) <= {"NFC", "Replace", "Lowercase"}
        and split.get("pattern", {}).get("Regex") == _WORDS
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and not any(c.isspace() for t in tokens for c in t)
    )


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and how many each row has."""
    _, at, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    width = np.dtype(kind).itemsize
    return (whole if whole.ctypes.data % width == 0 else whole.copy()).view(kind), np.diff(at) // width


def frequencies(tokens: DataFrame, ids: str = "ids", kind: str = "<u4") -> DataFrame:
    """id, n: how often each id occurs. A task sends at most one row per id."""

    def count(batches):
        seen = np.zeros(1, np.int64)
        for batch in batches:
            some = np.bincount(_ids(batch.column(0), kind)[0], minlength=len(seen))
            some[: len(seen)] += seen
            seen = some
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["id", "n"])

    return tokens.select(ids).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- files --------------------------------------------------------------------


def write_files(docs: DataFrame, path: str, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, by_word: bool | None = None) -> None:
    """Encode `docs` into the files below `path` (`ranks.parquet`, `blocks.parquet`).

    `vocabulary` is the path of a `tokenizers` file, read on the driver; its definition says whether words
    may be encoded apart (`by_word`), otherwise whole texts are. Texts are tokenized once;
    the ids are kept in the shared folder, counted, coded and dealt out by ranges of the key.
    """
    spark = docs.sparkSession
    definition = Path(vocabulary).read_text(encoding="utf-8")
    by_word = encodes_by_word(definition) if by_word is None else by_word
    narrow = kind_of(definition, end_id)
    tokens = tokenize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), definition, end_id=end_id, by_word=by_word, kind=narrow)
    held = new_path(spark, "token-ids")
    tokens = written(tokens.select("key", "ids"), "token-ids", held)
    # as many rows as the vocabulary has ids
    order = [r["id"] for r in frequencies(tokens, kind=narrow).orderBy(F.desc("n"), "id").collect()]
    ranks = spark.createDataFrame(list(enumerate(order)), "rank int, id int")
    ranks.coalesce(1).write.parquet(f"{path}/ranks.parquet")
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[np.array(order, np.int64)] = np.arange(len(order))
    table = spark.sparkContext.broadcast(rank_of)

    kind = tokens.schema["key"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    laid = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches):
        shard, start, block = TaskContext.get().partitionId(), 0, []

        def row():
            n = [r[3] for r in block]
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "start": start, "keys": [r[0] for r in block], "counts": n, "n_ids": sum(n), "control": b"".join(r[1] for r in block), "data": b"".join(r[2] for r in block)}],
                schema=blocks,
            )

        held = 0
        for batch in batches:
            ids, counts = _ids(batch.column("ids"), narrow)
            coded = encode(table.value[ids], counts)
            for k, (control, data), n in zip(batch.column("key").to_pylist(), coded, counts.tolist(), strict=True):
                block.append((k, control, data, n))
                held += n
                if held >= BLOCK_IDS:
                    yield row()
                    start, block, held = start + held, [], 0
        if block:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema

    spec = f"shard int, start long, keys array<{kind}>, counts array<long>, n_ids long, control binary, data binary"
    blocks = to_arrow_schema(spark.createDataFrame([], spec).schema)
    laid.select("key", "ids").mapInArrow(pack, spec).write.parquet(f"{path}/blocks.parquet")
    drop_table(spark, held)


def read_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, `start` (ids before it), `ids` as unsigned 32-bit integers."""
    blocks = spark.read.parquet(f"{path}/blocks.parquet")
    order = [r["id"] for r in spark.read.parquet(f"{path}/ranks.parquet").orderBy("rank").collect()]  # the vocabulary at most
    ids = spark.sparkContext.broadcast(np.array(order, "<u4"))
    # one row per shard, as many as the files' writer had partitions
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = shards.select("shard", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))

    def unpack(batches):
        for batch in batches:
            for b in batch.to_pylist():
                values = ids.value[decode(b["control"], b["data"])]
                counts = np.array(b["counts"], np.int64)
                padded = -(-counts // 4) * 4
                at = np.cumsum(padded) - padded
                start = b["start"] + np.cumsum(counts) - counts
                rows = [values[i : i + n].tobytes() for i, n in zip(at, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), b["shard"], np.int32)), pa.array(b["keys"], batch.schema.field("keys").type.value_type), pa.array(start), pa.array(counts), pa.array(rows, pa.binary())],
                    names=["shard", "key", "start", "n_tokens", "ids"],
                )

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    rows = blocks.mapInArrow(unpack, f"shard int, key {kind}, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "shard").select(F.col("key").alias(key), (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def token_digests(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Write the files, read them back and return doc_id, start, n_tokens, ids_crc32 per document.

    No documents give no rows; rows with one id each have their own row; a null id sorts first.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_files(docs, path, vocabulary, **options)
    key = options.get("key", "doc_id")
    return read_files(spark, path, key).withColumn("ids_crc32", F.crc32("ids")).select(key, "start", "n_tokens", "ids_crc32")
