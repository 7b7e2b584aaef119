"""Alignment of two tokenizers' ids over the bytes of the same text.

Tokenizer A is a byte-level file of the `tokenizers` library, B a `sentencepiece` model, which puts a
space before the text; A gets the text with that space. The bytes of the tokens give the cumulative
ends of both id lists. Two dictionaries lead from an end to the last token that ends there; the ends
that both hold, sorted, slice both lists into groups, and every pair of tokens of a slice that end
with it is a link.

Both tokenizers treat text between certain spaces independently, so the work is done once per
distinct piece between those spaces and remembered by each worker. `by_word` says whether two
vocabularies allow that; others are given whole texts.

Null and empty texts, and texts whose tokens do not spell them (some characters are unknown to a
vocabulary, or changed by it), have no tokens. All other columns are passed through; rows are
independent, so repeated rows, ties and empty tables need no rule.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import refuse, unused, written
from .words import ragged, slices

SLICE_TEXT = 1 << 20
#: Bytes of pieces that are encoded as one text.
JOINED = 1 << 16
#: Pieces a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
#: Id pairs in one broadcast, at 12 bytes each.
PAIRS = 2_000_000

OUT = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "links": "binary"}

_PLAIN = frozenset(string.punctuation)


# -- vocabularies ---------------------------------------------------------------


def byte_of_sign() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: visible Latin-1 signs stand for
    themselves, the other bytes, in order, for the signs from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabularies:
    """Both files' contents, read on the driver and sent to the workers."""

    a: str
    b: bytes

    @staticmethod
    def read(a: str, b: str) -> Vocabularies:
        return Vocabularies(Path(a).read_text(encoding="utf-8"), Path(b).read_bytes())


class Tokens:
    """Ids and token bytes of both tokenizers."""

    def __init__(self, files: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(files.a)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_proto=files.b)
        vocab, sign = self._a.get_vocab(with_added_tokens=True), byte_of_sign()
        self.bytes_a = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(len(self._b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.by_word = splits_at_spaces(json.loads(files.a)) and not any(re.search("[^▁]▁", p) for p in pieces)
        # how a token is written in `groups`: followed by a comma inside a group, else by what ends its side
        self.written = [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.kind = np.dtype("<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<u8")

    def encode(self, spaced: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that starts with the space that B adds by itself."""
        a = self._a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids
        return np.array(a, np.int64), np.array(self._b.encode(spaced[1:], num_threads=1), np.int64)

    def spells(self, spaced: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return all(b"".join(map(table.__getitem__, ids.tolist())) == spaced for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))


def splits_at_spaces(definition: dict) -> bool:
    """Whether a `tokenizers` file starts a new word at every space before a visible sign."""
    split = definition.get("pre_tokenizer") or {}
    return (
        definition.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and all(t.get("special") for t in definition.get("added_tokens", []))
    )


# -- alignment ------------------------------------------------------------------


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The ends that both lists hold, ascending, and the last token of each list that ends there."""
    last_a = dict(zip(ends_a.tolist(), range(len(ends_a))))
    last_b = dict(zip(ends_b.tolist(), range(len(ends_b))))
    ends = sorted(last_a.keys() & last_b.keys())
    return ends, [last_a[e] for e in ends], [last_b[e] for e in ends]


@dataclass
class Aligned:
    """Groups of consecutive texts. Group g holds the tokens cut_a[g] to cut_a[g + 1] - 1 of `a`, likewise of `b`."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray  # byte offset at which each group ends
    cut_a: np.ndarray
    cut_b: np.ndarray
    links: np.ndarray  # a, b: places of linked tokens
    of_link: np.ndarray  # the group of each link


def align(tokens: Tokens, a: np.ndarray, b: np.ndarray) -> Aligned:
    ends_a, ends_b = np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[b])
    common, last_a, last_b = common_ends(ends_a, ends_b)
    ends = np.array(common, np.int64)
    cut_a, cut_b = (np.array([0, *(i + 1 for i in last)], np.int64) for last in (last_a, last_b))
    # a token without bytes ends where the one before it ends: each side of a slice has a run of last tokens
    run_a, run_b = (cut[1:] - np.searchsorted(all_, ends) for cut, all_ in ((cut_a, ends_a), (cut_b, ends_b)))
    n = run_a * run_b
    of = np.repeat(np.arange(len(ends)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    links = np.stack((cut_a[1:][of] - run_a[of] + k // run_b[of], cut_b[1:][of] - run_b[of] + k % run_b[of]))
    return Aligned(a, b, ends, cut_a, cut_b, links, of)


def texts_of_groups(tokens: Tokens, x: Aligned) -> list[bytes]:
    """All tokens in writing, group by group: ids of A, ids of B, each with the sign that follows it."""
    width = len(tokens.written) // 3
    code_a, code_b = x.a.copy(), x.b.copy()
    code_a[x.cut_a[1:] - 1] += width
    code_b[x.cut_b[1:] - 1] += 2 * width
    at_a = np.arange(len(x.a)) + np.repeat(x.cut_b[:-1], np.diff(x.cut_a))
    at_b = np.arange(len(x.b)) + np.repeat(x.cut_a[1:], np.diff(x.cut_b))
    out = np.empty(len(x.a) + len(x.b), np.int64)
    out[at_a], out[at_b] = code_a, code_b
    return list(map(tokens.written.__getitem__, out.tolist()))


@dataclass
class Memo:
    """Alignments of pieces, by number; number 0 stands for a piece that its tokens do not spell."""

    tokens: Tokens
    number: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number = {}
        self.n = np.zeros((1, 4), np.int64)  # tokens of A, of B, groups, links
        self.first = np.zeros(1, np.int64)
        self.links = np.empty(0, self.tokens.kind)
        self.texts: list[bytes] = [b""]
        self.used = np.zeros(1, np.int32)

    def shrink(self) -> None:
        """Keeps the pieces met in more than one slice, if they are few enough."""
        keep = [(w, i) for w, i in self.number.items() if self.used[i] > 1 and len(w) <= LONGEST and i]
        n, first, links, texts, used = self.n, self.first, self.links, self.texts, self.used
        self.clear()
        if len(keep) > REMEMBERED // 2:
            return
        at = np.array([0, *(i for _, i in keep)], np.int64)
        self.n, self.links = n[at], links[ragged(first[at], n[at, 3])]
        self.first = np.cumsum(self.n[:, 3]) - self.n[:, 3]
        self.texts, self.used = [texts[i] for i in at.tolist()], used[at] // 2
        self.number = {w: k for k, (w, _) in enumerate(keep, 1)}

    def add(self, pieces: list[str]) -> None:
        """Pieces that end in no space and start with one before a visible sign are encoded together."""
        plain = [p for p in pieces if not p.endswith(" ") and _starts(p[1:2])] if self.tokens.by_word else []
        held, size = [], 0
        for p in plain:
            held.append(p)
            size += len(p)
            if size >= JOINED:
                self._add(held)
                held, size = [], 0
        self._add(held)
        for p in pieces:
            if p not in self.number:
                self._add([p])

    def _add(self, pieces: list[str]) -> None:
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        a, b = self.tokens.encode("".join(pieces))
        if not self.tokens.spells(b"".join(raw), a, b):
            if len(pieces) == 1:
                self.number[pieces[0]] = 0
            else:
                for p in pieces:
                    self._add([p])
            return
        x = align(self.tokens, a, b)
        parts = texts_of_groups(self.tokens, x)
        group = np.concatenate(([0], np.searchsorted(x.ends, np.cumsum([len(r) for r in raw])) + 1))
        cut_a, cut_b = x.cut_a[group], x.cut_b[group]
        cut_link = np.searchsorted(x.of_link, group)
        at = (cut_a + cut_b).tolist()
        first = len(self.texts)
        # the sign after the last group of a piece is left to the text it stands in
        self.texts += [b"".join(parts[i:j])[:-1] for i, j in itertools.pairwise(at)]
        n = np.stack([np.diff(c) for c in (cut_a, cut_b, group, cut_link)], axis=1)
        self.n = np.concatenate((self.n, n))
        self.first = np.concatenate((self.first, len(self.links) + cut_link[:-1]))
        pair = x.b[x.links[1]] * len(self.tokens.bytes_a) + x.a[x.links[0]]
        self.links = np.concatenate((self.links, pair.astype(self.tokens.kind)))
        self.used = np.concatenate((self.used, np.zeros(len(pieces), np.int32)))
        self.number.update(zip(pieces, range(first, first + len(pieces)), strict=True))


def _starts(sign: str) -> bool:
    """Whether a piece may start at the space before this sign."""
    return sign in _PLAIN or sign.isalnum()


def _pieces(words: Iterable[str]) -> list[str]:
    """The words of a text that was split at every space, put together where neither tokenizer splits."""
    out, before = [], ""
    for w in words:
        if out and (not before or not _starts(w[:1])):
            out[-1] += " " + w
        else:
            out.append(" " + w)
        before = w
    return out


def _numbers(memo: Memo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pieces of all texts one after the other, and how many each text has."""
    if not memo.tokens.by_word:
        pieces = [" " + t for t in texts.to_pylist()]
        memo.add([p for p in dict.fromkeys(pieces) if p not in memo.number])
        return np.array([memo.number[p] for p in pieces], np.int64), np.ones(len(pieces), np.int64)
    split = pc.split_pattern(texts, " ")
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    coded = split.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    odd = np.array([not _starts(w[:1]) for w in words], bool)
    rows = np.add.reduceat(odd[code], at[:-1]) if len(code) else np.empty(0, np.int64)
    apart = {int(r): _pieces(words[c] for c in code[at[r] : at[r + 1]].tolist()) for r in np.flatnonzero(rows)}
    # words of the other texts are pieces
    used = np.zeros(len(words), bool)
    used[code[np.repeat(rows == 0, np.diff(at))]] = True
    plain = {i: " " + words[i] for i in np.flatnonzero(used).tolist()}
    number = memo.number
    memo.add([p for p in dict.fromkeys(itertools.chain(plain.values(), *apart.values())) if p not in number])
    of_word = np.zeros(len(words), np.int64)
    of_word[list(plain)] = [number[p] for p in plain.values()]
    if not apart:
        return of_word[code], np.diff(at)
    parts = [np.array([number[p] for p in apart[r]], np.int64) if r in apart else of_word[code[at[r] : at[r + 1]]] for r in range(len(rows))]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_memos: dict[int, Memo] = {}


def _memo(files: Vocabularies) -> Memo:
    key = hash(files)
    if key not in _memos:
        _memos.clear()
        _memos[key] = Memo(Tokens(files))
    return _memos[key]


def aligned_columns(texts: pa.Array, memo: Memo) -> dict[str, pa.Array]:
    """The columns OUT of some texts."""
    texts = texts.fill_null("").cast(pa.string())
    if len(memo.number) > REMEMBERED:
        memo.shrink()
    numbers, counts = _numbers(memo, texts)
    memo.used[np.unique(numbers)] += 1
    end = np.cumsum(counts)
    start = end - counts
    fine = np.add.reduceat(numbers == 0, start) == 0 if len(counts) else np.empty(0, bool)
    fine &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    numbers = numbers[np.repeat(fine, counts)]
    end = np.cumsum(counts * fine)
    start = end - counts * fine
    sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(memo.n[numbers], axis=0)))
    n = sums[end] - sums[start]
    links = memo.links[ragged(memo.first[numbers], memo.n[numbers, 3])]
    at = sums[:, 3]
    names, picked = memo.texts, numbers.tolist()
    spans = list(zip(start.tolist(), end.tolist(), strict=True))
    return {
        **{name: pa.array(n[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups": pa.array([b";".join([names[k] for k in picked[i:j]]) for i, j in spans], pa.binary()).cast(pa.string()),
        "links": pa.array([links[at[i] : at[j]].tobytes() for i, j in spans], pa.binary()),
    }


def aligned(docs: DataFrame, files: Vocabularies, *, text: str = "text") -> DataFrame:
    """`docs` with the columns OUT.

    `groups` reads `a1,a2|b1;a3|b2,b3`: ids of A, ids of B, groups in order. `links` holds one number
    per linked pair of tokens in text order, id of B times the size of A plus id of A, as
    little-endian integers (`link_kind`).
    """
    refuse(docs, *OUT)
    broadcast = docs.sparkSession.sparkContext.broadcast(files)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {v}" for k, v in OUT.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(broadcast.value)
        for whole in batches:
            for batch in slices(whole, text, SLICE_TEXT):
                columns = aligned_columns(batch.column(text), memo)
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

    return docs.mapInArrow(run, schema)


# -- counts of id pairs -----------------------------------------------------------


def _links(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All links of a column and how many each row has."""
    _, at, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
    return np.frombuffer(whole, kind), np.diff(at) // np.dtype(kind).itemsize


def pair_counts(rows: DataFrame, kind: str, *, held: int = 1_000_000) -> DataFrame:
    """pair, n: how often each linked pair of ids occurs. A task adds up before it sends, `held` pairs at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, at = np.unique(pairs, return_inverse=True)
            return unique, np.bincount(at, n, len(unique)).astype(np.int64)

        for batch in batches:
            found, _ = _links(batch.column(0), kind)
            for i in range(0, len(found), held):
                parts.append(np.unique(found[i : i + held], return_counts=True))
                size += len(parts[-1][0])
            if size > held:
                parts = [added(parts)]
                size = len(parts[0][0])
                if size > held:
                    yield _pairs(*parts[0])
                    parts, size = [], 0
        if parts:
            yield _pairs(*added(parts))

    def _pairs(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def rated(rows: DataFrame, files: Vocabularies) -> DataFrame:
    """A written table of `aligned` with n_best and count_sum instead of `links`.

    A link counts as often as its pair is linked in all rows; it is best when no pair of its B id
    counts more. The counts are sent to the workers in parts of at most about PAIRS pairs, which
    every worker looks up in the links it reads; no link is shuffled.
    """
    refuse(rows, "n_best", "count_sum")
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    size_a, kind = _shape(files)
    counts = written(pair_counts(rows, kind).withColumn("b", F.expr(f"pair div {size_a}")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = written(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    parts = max(1, -(-counts.count() // PAIRS))
    uid = unused("uid", rows.columns)
    numbered = written(rows.withColumn(uid, F.monotonically_increasing_id()), "links") if parts > 1 else rows
    found = None
    for k in range(parts):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k).toArrow() if parts > 1 else counts.toArrow()
        pairs = part.column("pair").to_numpy().astype(kind)
        order = np.argsort(pairs)
        table = sc.broadcast((pairs[order], part.column("n").to_numpy()[order], part.column("best").to_numpy(zero_copy_only=False)[order]))
        one = _looked_up(numbered, table, kind)
        if parts == 1:
            return one
        one = one.select(uid, "n_best", "count_sum")
        found = one if found is None else found.unionByName(one)
    total = found.groupBy(uid).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.drop("links").join(total, uid).drop(uid)


def _shape(files: Vocabularies) -> tuple[int, str]:
    tokens = Tokens(files)
    return len(tokens.bytes_a), tokens.kind.str


def _looked_up(rows: DataFrame, table, kind: str) -> DataFrame:
    kept = [f for f in rows.schema if f.name != "links"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_best long", "count_sum long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            links, n = _links(batch.column("links"), kind)
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            here = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
            end = np.cumsum(n)
            sums = []
            for values in (best, counts):
                some = np.concatenate(([0], np.cumsum(np.where(here, values[at], 0) if len(pairs) else here, dtype=np.int64)))
                sums.append(pa.array(some[end] - some[end - n]))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *sums], names=[*(f.name for f in kept), "n_best", "count_sum"])

    return rows.mapInArrow(run, schema)


def alignment_digests(docs: DataFrame, a: str, b: str, *, key: str = "doc_id") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (empty without tokens)."""
    files = Vocabularies.read(a, b)
    rows = aligned(docs.select(key, "text"), files).drop("text")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = written(rows.select(key, "n_a", "n_b", "n_groups", "n_links", digest, "links"), "links")
    return rated(rows, files).select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
