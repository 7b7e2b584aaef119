import hashlib
import json
import os
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ridespark.llm import decontaminate, fixity, tables, tokencount, tokenids, words
from ridespark.llm.queries import vocabulary

from .corpus import odd_rows, sentence, table

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_hits(docs, items, size=10):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = cut(t)
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (s := windows.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    found |= s
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [32 << 20, 9000])
def test_hits_equal_brute_force(spark, slice_bytes):
    docs = odd_rows()
    base, passage = docs[0][1], docs[12][1].split()[-30:]
    items = [(1, base.title()), (2, " ".join(passage[:12]) + "!"), (3, "one"), (3, "Viktor"), (4, ""), (5, None), (None, "w1 w2"), (12, base), (6, " ".join(passage[5:15]))]
    found = decontaminate.digests(table(spark, docs, hits=1, n_words="x"), bench(spark, items), slice_bytes=slice_bytes)
    assert sorted(map(tuple, found.collect()), key=str) == brute_hits([r[:2] for r in docs], items)


def test_scan_of_nothing(spark):
    docs = table(spark, odd_rows())
    assert decontaminate.digests(docs.limit(0), bench(spark, [(1, "a b")])).count() == 0
    clean = decontaminate.digests(docs, bench(spark, [])).collect()
    assert len(clean) == docs.count() and not any(r.contaminated for r in clean)


def test_spans_and_documents_are_removed(spark):
    rng = random.Random(3)
    passage, other = sentence(rng, 12), sentence(rng, 12)
    docs = table(spark, [(1, f"Before. {passage.upper()}! after"), (2, "clean text"), (3, f"{passage} mid {other}"), (4, None)], hits="kept", _hits=2)
    items = bench(spark, [(7, passage), (8, other)])
    left = decontaminate.remove_documents(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 4]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut == {1: "Before. ! after", 2: "clean text", 3: " mid ", 4: None}
    with pytest.raises(ValueError):
        decontaminate.scan(docs, items, out="hits")


def test_word_hashes_across_slices(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    texts = ["alpha beta " * 20 + "gamma", "", "x" * 300 + " beta", "é beta"]
    w = words.words_of(*words.text_buffers(pa.array(texts)), words.NOT_SPACE)
    h = w.hashes()
    flat = [x for t in texts for x in t.split()]
    assert len(h) == len(flat) and len({(x, int(y)) for x, y in zip(flat, h, strict=True)}) == len(set(flat))


# -- token files ----------------------------------------------------------------


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_token_files_round_trip(spark):
    rows = [r for r in odd_rows() if r[0] not in (41, 42)]
    rows += [(60, "Don't <|endoftext|>x<|startoftext|> ΟΔΟΣ İi, 1,000! '' 's's a​b nbsp em\x1cfs"), (61, "ab " * 70_000)]
    found = [tuple(r) for r in tokenids.token_digests(table(spark, rows, ids=1, key="k"), vocabulary("word_bpe_49k.json")).collect()]
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r[1] for r in found] == list(np.cumsum([0, *(r[2] for r in found[:-1])]))
    expect = sorted((str(r[0]), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, plain([r[1] for r in rows]), strict=True))
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == expect


def test_no_documents_give_no_tokens(spark):
    assert tokenids.token_digests(table(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_coding_is_reversible():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 4, 5, 1000])
    ranks = (2.0 ** rng.uniform(0, 31, counts.sum())).astype(np.uint32)
    back, at = [], 0
    for (control, data), n in zip(tokenids.encode(ranks, counts), counts, strict=True):
        assert len(control) == -(-n // 4)
        back.append(tokenids.decode(control, data)[:n])
    assert (np.concatenate(back) == ranks).all()


# -- token counts -----------------------------------------------------------------


def greedy(word, entries):
    s, n, i = (*word, tokencount.END), 0, 0
    while i < len(s):
        k = next(k for k in range(len(s) - i, 0, -1) if s[i : i + k] in entries or s[i : i + k] == (tokencount.END,))
        n += s[i : i + k] != (tokencount.END,)
        i += k
    return n


def test_counts_equal_greedy_matching(spark):
    entries = set(tokencount.entries(vocabulary("word_bpe_49k.json")))
    rows = [r for r in odd_rows() if r[0] != 42]
    found = tokencount.counted(table(spark, rows, n=1).select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    expect = []
    for r in rows:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().translate(lower))
        expect.append((str(r[0]), r[1], len(ws), sum(greedy(w, entries) for w in ws)))
    key = lambda r: (r[0], r[2], r[3])
    assert sorted(((str(r.doc_id), r.text, r.n_words, r.n_tokens) for r in found.collect()), key=key) == sorted(expect, key=key)


def test_counts_of_a_small_vocabulary():
    entries = [(b,) for b in range(256)] + [tuple(b"abcd"), tuple(b"bc"), tuple(b"bcx"), (*b"cd", tokencount.END), tuple(b"aaa")]
    automaton = tokencount.Automaton.of(entries)
    ws = [b"abcd", b"abcx", b"abce", b"bcd", b"aaaaaaa", b"", b"abcabcd", b"cdcd", b"\xff"]
    at = np.concatenate(([0], np.cumsum([len(w) for w in ws])))
    got = automaton.count(np.frombuffer(b"".join(ws), np.uint8), at)
    assert got.tolist() == [greedy(w, set(entries)) for w in ws]


# -- fixity -----------------------------------------------------------------------


def test_audit_finds_what_was_damaged(spark):
    from pyspark.sql import functions as F

    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("html"), F.lit(1).alias("file"))
    rows = fixity.page_audit(pages, changed=F.col("page_id").isin(17, 4095, 4999), lost=F.col("page_id").isin(0, 4096)).collect()
    assert {(r.file * 4096 + r.no, r.kind) for r in rows} == {(17, "changed"), (4095, "changed"), (4999, "changed"), (0, "missing"), (4096, "missing")}
    assert all(r.root != r.replica_root for r in rows) and {r.n_records for r in rows} == {4096, 904}


def test_audit_of_intact_and_odd_pages(spark):
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "h" * 100_000)], "page_id long, url string, html string")
    rows = fixity.page_audit(odd, changed=F.lit(False), lost=F.lit(False)).collect()
    assert len(rows) == 1 and rows[0].root == rows[0].replica_root and rows[0].no is None and rows[0].n_records == 4
    all_lost = fixity.page_audit(odd, changed=F.lit(False), lost=F.lit(True)).collect()
    assert len(all_lost) == 4 and {r.kind for r in all_lost} == {"missing"} and all_lost[0].replica_root is None
    assert fixity.page_audit(odd.limit(0), changed=F.lit(False), lost=F.lit(False)).count() == 0


# -- vocabularies and intermediate tables --------------------------------------------


def test_words_apart_only_where_the_definition_allows():
    text = Path(vocabulary("word_bpe_49k.json")).read_text(encoding="utf-8")
    assert tokenids.encodes_by_word(text)
    assert not tokenids.encodes_by_word(Path(vocabulary("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    for change in (
        lambda d: d.update(normalizer=None),
        lambda d: d["normalizer"]["normalizers"].append({"type": "StripAccents"}),
        lambda d: d.update(pre_tokenizer=None),
        lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(invert=False),
        lambda d: d["added_tokens"].append({"content": "a b"}),
    ):
        other = json.loads(text)
        change(other)
        assert not tokenids.encodes_by_word(json.dumps(other))


def test_another_vocabulary_gets_whole_texts(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] not in (None, 41, 42, 50, 51)]
    tokenids.write_files(table(spark, rows), str(tmp_path / "files"), vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenids.read_files(spark, str(tmp_path / "files")).collect()}
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert got == {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, tokenids.END_ID] for r in rows}


def test_a_stage_drops_what_led_to_its_input(spark):
    made = []

    @corpus_pipeline.stage
    def copied(spark, docs, folder):
        made.append(tables.new_path(spark, "copy"))
        return tables.written(docs, "copy", made[-1])

    there = lambda: [os.path.exists(p.removeprefix("file:")) for p in made]
    docs = table(spark, odd_rows()[:5])
    first = copied(spark, docs, "")
    second = copied(spark, first, "")  # still reads the first table
    assert there() == [True, True] and second.count() == 5
    copied(spark, docs, "")
    assert there() == [True, False, True]
