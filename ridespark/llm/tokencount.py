"""Token counts by a linear longest-match automaton, without building pieces.

A word is cut greedily into the longest entries of the vocabulary. The trie of all entries has
failure links: where a character does not continue a node's string, the greedy pieces that are
settled by then are popped and the walk goes on at the node of what is left. How many pieces are
popped is precomputed, so a word costs one walk over its bytes and counts only.

The vocabulary is that of a byte-level file of the `tokenizers` library whose entries that end a
word carry a suffix: a word is its UTF-8 bytes, A-Z lowered, and an end sign. An end sign that the
last piece does not take in counts nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .tables import refuse
from .words import slices

SYMBOLS = 257
END = 256
_SLICE = 8 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b if b in prints else next(rest)): b for b in range(256)}


def entries(vocabulary: str) -> list[tuple[int, ...]]:
    """The vocabulary's entries as byte values, with END where they end a word."""
    model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    letters, suffix = byte_letters(), model["model"].get("end_of_word_suffix") or ""
    special = {t["content"] for t in model.get("added_tokens", [])}
    out = []
    for token in model["model"]["vocab"]:
        if token in special:
            continue
        ends = bool(suffix) and token.endswith(suffix)
        body = token[: len(token) - len(suffix)] if ends else token
        out.append(tuple(letters[c] for c in body) + ((END,) if ends else ()))
    return out


@dataclass
class Automaton:
    """Edges of the trie by node * SYMBOLS + symbol; per node the failure link, the pieces it pops, and all pieces of its string."""

    keys: np.ndarray
    children: np.ndarray
    link: np.ndarray
    pops: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of(cls, words: list[tuple[int, ...]]) -> Automaton:
        child: dict[int, int] = {}
        parent, symbol, final = [0], [0], [False]
        for w in [(END,), *words]:
            at = 0
            for s in w:
                key = at * SYMBOLS + s
                if key not in child:
                    child[key] = len(parent)
                    parent.append(at)
                    symbol.append(s)
                    final.append(False)
                at = child[key]
            final[at] = at > 0
        singles = {s for s in range(SYMBOLS - 1) if final[child.get(s, 0)]}
        if len(singles) < SYMBOLS - 1:
            raise ValueError("the vocabulary lacks a single byte")  # else a walk could get stuck
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        link, pops, pieces = [-1] * len(parent), [0] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[v]:
                link[v], pops[v], pieces[v] = 0, 1, 1
                if v == child[END]:
                    pops[v] = pieces[v] = 0
                continue
            z, popped = link[parent[v]], pops[parent[v]]
            while z >= 0 and z * SYMBOLS + symbol[v] not in child:
                popped += pops[z]
                z = link[z]
            if z >= 0:
                link[v], pops[v] = child[z * SYMBOLS + symbol[v]], popped
                pieces[v] = popped + pieces[link[v]]
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        return cls(keys[order], np.fromiter(child.values(), np.int32, len(child))[order], *(np.array(x, np.int32) for x in (link, pops, pieces)))

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pieces of every word: bytes at[i] to at[i + 1] of `data`, and the end sign. An empty word has none."""
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        start, length = at[:-1][order], length[order]
        node, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        live = int(np.count_nonzero(length))
        for k in range(int(length[0]) + 1 if live else 0):
            live = int(np.searchsorted(-length, -k, "right")) if k else live  # words with a symbol at k
            s = np.full(live, END, np.int64)
            inner = length[:live] > k
            s[inner] = data[start[:live][inner] + k]
            some = np.flatnonzero(length[:live] > 0)
            s = s[some]
            while len(some):
                to = self._step(node[some], s)
                ok = to >= 0
                node[some[ok]] = to[ok]
                some, s = some[~ok], s[~ok]
                total[some] += self.pops[node[some]]
                node[some] = self.link[node[some]]
        total += self.pieces[node]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def counted(docs: DataFrame, vocabulary: str, *, text: str = "text", words_out: str = "n_words", tokens_out: str = "n_tokens") -> DataFrame:
    """`docs` with the number of words (parted by space, tab, line feed, vertical tab, form feed, return) and of greedy pieces.

    A null text has none. `vocabulary` is the path of a `tokenizers` file, read on the driver.
    """
    refuse(docs, words_out, tokens_out)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.of(entries(vocabulary)))  # some bytes per entry
    schema = docs.withColumn(words_out, F.lit(0).cast("long")).withColumn(tokens_out, F.lit(0).cast("long")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, _SLICE):
                split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(text).fill_null("").cast(pa.string())))
                coded = split.flatten().dictionary_encode()
                words = coded.dictionary.cast(pa.large_binary())
                _, at, data = words.buffers()
                at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
                each = shared.value.count(np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at)
                index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                place = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
                place = place - place[0]
                sums = [np.concatenate(([0], np.cumsum(x)))[place] for x in ((np.diff(at) > 0)[index], each[index])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.diff(x)) for x in sums)], names=[*batch.schema.names, words_out, tokens_out])

    return docs.mapInArrow(run, schema)
