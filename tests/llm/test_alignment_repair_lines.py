"""Alignment of tokenizers, repair of conversations and line dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridespark.llm import align, conversations, linededup
from ridespark.llm.queries import vocabulary

from .corpus import odd_rows, table

# -- alignment --------------------------------------------------------------------


@pytest.fixture(scope="module")
def files():
    return align.Vocabularies.read(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def brute_groups(tokens, text):
    """Token ids of both sides by group, from the whole text; none if the tokens do not spell it."""
    if not text:
        return []
    a, b = (x.tolist() for x in tokens.encode(" " + text))
    raw = [[t[i] for i in ids] for t, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
    if any(b"".join(x) != (" " + text).encode() for x in raw):
        return []
    ends = [list(itertools.accumulate(map(len, x))) for x in raw]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def written_groups(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


ODD_TEXTS = [
    "", " ", "   ", "a", "a ", " a", "  a  b", "a\n", "\n a", "a \n b\n\nc", "x\x00y", "a▁b", "▁", "<s> </s> <|endoftext|> <0x41>", "日本語 のテキスト です", "\U0001f600 hi",
    "don't 'tis ''s x's", "a　b 　c", "é \xa0x", "\t\tx y", "(a) \"b\" -c- $5 7%", "z" * 5_000, "ab " * 400,
]


def test_pieces_give_the_groups_of_whole_texts(files):
    rng = random.Random(5)
    texts = [*ODD_TEXTS, *("".join(rng.choice("ab1 .,'\n\té日▁Z  ") for _ in range(rng.randrange(40))) for _ in range(1500))]
    tokens = align.Tokens(files)
    assert tokens.by_word
    for by_word in (True, False):
        tokens.by_word = by_word
        memo = align.Memo(tokens)
        for _ in range(2):  # the second time from memory
            out = align.aligned_columns(pa.array([None, *texts]), memo)
            assert [c[0].as_py() for c in out.values()] == [0, 0, 0, 0, "", b""]
            for i, text in enumerate(texts, 1):
                groups = brute_groups(tokens, text)
                assert out["groups"][i].as_py() == written_groups(groups), repr(text)
                links = np.frombuffer(out["links"][i].as_py(), tokens.kind).tolist()
                assert links == [b[-1] * len(tokens.bytes_a) + a[-1] for a, b in groups]
                assert [out[k][i].as_py() for k in ("n_a", "n_b", "n_groups", "n_links")] == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links)]
            memo.shrink()


def test_tokens_without_bytes_link_with_all_that_end_there(files):
    class Sizes:
        size_a, size_b = np.array([1, 0, 2]), np.array([1, 0, 3])

    x = align.align(Sizes, np.array([0, 1, 2]), np.array([0, 1, 1, 0, 0]))
    assert x.ends.tolist() == [1, 3] and x.cut_a.tolist() == [0, 2, 3] and x.cut_b.tolist() == [0, 3, 5]
    assert sorted(zip(*x.links.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 4)]


def test_other_vocabularies_get_whole_texts():
    base = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "added_tokens": [{"special": True}]}
    assert align.splits_at_spaces(base)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": base["pre_tokenizer"] | {"use_regex": False}}, {"added_tokens": [{"special": False}]}):
        assert not align.splits_at_spaces(base | change)


@pytest.mark.parametrize("pairs", [2_000_000, 60])
def test_alignment_digests(spark, files, monkeypatch, pairs):
    monkeypatch.setattr(align, "PAIRS", pairs)  # 60: several broadcasts
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [r for r in odd_rows() if r[0] not in (41, 42)]
    got = align.alignment_digests(table(spark, rows, n_a="x", uid=1), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()
    tokens = align.Tokens(files)
    groups = [brute_groups(tokens, r[1]) for r in rows]
    linked = collections.Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = collections.Counter()
    for (_, b), n in linked.items():
        most[b] = max(most[b], n)
    want = []
    for (key, *_), g in zip(rows, groups, strict=True):
        pairs_ = [(a[-1], b[-1]) for a, b in g]
        digest = hashlib.sha256(written_groups(g).encode()).hexdigest() if g else ""
        want.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs_), sum(linked[p] == most[p[1]] for p in pairs_), sum(linked[p] for p in pairs_), digest))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_alignment_of_an_empty_table(spark):
    out = align.alignment_digests(table(spark, []), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert out.collect() == [] and "groups_sha256" in out.columns


# -- conversations ------------------------------------------------------------------


def lightest(messages):
    """Cost and audit of the best repair, by all edits of one message after the other."""
    states = {0: (0, "")}

    def insert(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                t = conversations.CHOSEN[s][0]
                states[t] = min(states.get(t, (c + 3, a + "I")), (c + 3, a + "I"))
        return states

    states = insert(states)
    for m in messages:
        after = {}
        for s, (c, a) in states.items():
            for w, t, e in conversations.edits(s, m):
                after[t] = min(after.get(t, (c + w, a + e)), (c + w, a + e))
        states = insert(after)
    return min(states[s] for s in (0, 3) if s in states)


def exhaustive(messages, inserts=2):
    """As `lightest`, over all sequences of edits with up to `inserts` insertions at each place."""
    found = []
    for choice in itertools.product("DKR", repeat=len(messages)):
        for places in itertools.product(range(inserts + 1), repeat=len(messages) + 1):
            audit = "I" * places[0] + "".join(e + "I" * n for e, n in zip(choice, places[1:], strict=True))
            state, cost, i = 0, 0, 0
            for e in audit:
                if e == "I":
                    state, cost = conversations.CHOSEN[state][0], cost + 3
                    continue
                step = [(w, t) for w, t, x in conversations.edits(state, messages[i]) if x == e]
                if not step:
                    break
                cost, state, i = cost + step[0][0], step[0][1], i + 1
            else:
                if state in (0, 3):
                    found.append((cost, audit))
    return min(found)


def some_messages(rng, n):
    return [conversations.Message(rng.choice("suax"), rng.choice([None, 0, 0, 0, 3])) for _ in range(n)]


def test_agenda_finds_the_lightest_repair():
    rng = random.Random(2)
    for n in [0, 1, 2, 3] * 12:
        messages = some_messages(rng, n)
        assert conversations.derivation(messages) == exhaustive(messages) == lightest(messages)
    for _ in range(200):
        messages = some_messages(rng, rng.randrange(40))
        assert conversations.derivation(messages) == lightest(messages)


def test_joined_segments_give_the_same_repair(monkeypatch):
    monkeypatch.setattr(conversations, "AGENDA", 4)
    rng = random.Random(3)
    for _ in range(60):
        messages = some_messages(rng, rng.randrange(1, 50))
        want = lightest(messages)
        assert conversations.derivation(messages) == want
        cuts = sorted(rng.randrange(len(messages) + 1) for _ in range(5))
        parts = [messages[i:j] for i, j in zip([0, *cuts], [*cuts, len(messages)], strict=True)]
        weight, ways = conversations._path([conversations.spans_of_segment(p) for p in parts])
        assert weight == want and "".join(a for _, a in ways) == want[1]


def test_a_run_that_must_go_is_one_step():
    run = [conversations.Message("u", 0), conversations.Message("a", None, 5), conversations.Message("a", 0)]
    flat = [run[0], *[conversations.Message("a", None)] * 5, run[2]]
    assert conversations.derivation(run) == lightest(flat) == (20, "KDDDDDK")
    assert conversations.applied(0, "KDDDDDK", ["user", "ai"], ["x", "y"], [0, 5, 0]) == (["user", "ai"], ["x", "y"])


def brute_repair(rows):
    """conv_id -> the digest columns, from rows (conv_id, turn, role, text)."""
    space = " \t\n\x0b\x0c\r"
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, messages = set(), [], []
        for _, role, text in kept:
            fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            messages.append(conversations.Message(role[:1], None if fault in ("blank", "duplicate") else 3 if fault else 0))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit = lightest(messages)
        state, i, lines = 0, 0, []
        for e in audit:
            if e == "K":
                role, state = kept[i][1], conversations.AFTER[state, kept[i][1][:1]]
            elif e != "D":
                state, role = conversations.CHOSEN[state]
            if e != "D":
                lines.append(f"{role}:" + ("" if e == "I" else kept[i][2]))
            i += e != "I"
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(kept))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TALK = "conv_id long, turn long, role string, text string, n long, seq int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], TALK)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(4)
    words = ["Yes.", "no", "Why?", "", " \n", "Go on!  ", "ü.", "x" * 50_000, None, "a.b", "...", " "]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "USER"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(words)) for c in [*range(60), None] for t in range(rng.randrange(12))]
    rows += [(100, None, None, None)] * 7 + [(101, 3, "user", "again.")] * 5 + [(102, 2**61, "user", "far."), (102, 0, "assistant", "near.")]
    # one conversation with most of all rows, repeats of one message in many turns, and one message very often
    rows += [(200, t, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["ok.", f"text {t}.", f"text {t}", ""])) for t in range(3_000)]
    rows += [(201, 1, "user", "same.")] * 2_000 + [(201, 2, "assistant", "fine.")]
    rng.shuffle(rows)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_digests(talk(spark, rows)).collect()}
    assert got == brute_repair(rows)


def test_real_outputs_of_a_repair(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (2, 0, "assistant", "Yes."), (3, 0, "user", "Hi."), (3, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    found = conversations.repaired(frame)
    whole = {r.conv_id: (r.audit, list(zip(r.roles, r.texts))) for r in found.whole.collect()}
    cut = {r.conv_id: r.audit for r in found.cut.collect()}
    for r in sorted(found.parts.collect(), key=lambda r: (r.part, r.seq)):
        whole.setdefault(r.conv_id, (cut[r.conv_id], []))[1].extend(zip(r.roles, r.texts))
    assert whole == {
        1: ("KR", [("user", "Hi."), ("assistant", "Hello?")]),
        2: ("IK", [("user", ""), ("assistant", "Yes.")]),
        3: ("KK", [("user", "Hi."), ("assistant", "Yes.")]),
    }


def test_repair_of_no_conversations(spark):
    assert conversations.repair_digests(talk(spark, [])).collect() == []


# -- lines ---------------------------------------------------------------------------


def brute_lines(rows):
    """One row of digests per row (doc_id, text, ...); a null id is one document before all others."""
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        k = line.strip(space).translate(lower)
        return k if len(k) >= 20 else None

    docs = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add((doc is not None, doc or 0))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(docs[key(x)]) < 3 or max(docs[key(x)]) == (doc is not None, doc or 0)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(n, seed=6):
    rng = random.Random(seed)
    pool = [f"This is the shared line number {i}, Ünïcode." for i in range(30)] + ["short", "", "   ", "日本語のテキスト" * 2, "日本語のテキスト" * 3, "exactly twenty chars"]
    common = "A line that nearly every document has."
    rows = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str, str.lower])(rng.choice(pool)) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randrange(8))]
        lines += [common] * rng.choice([0, 1, 1, 3])
        rng.shuffle(lines)
        rows.append((i if rng.random() < 0.95 else None, "\n".join(lines)))
    return rows


def test_line_dedup(spark):
    rows = line_rows(700) + odd_rows() + [(5, "\n"), (5, "A line that nearly every document has.")] + [(800, "Always the same row, one of a great many.\nAnother line that is the same in all.")] * 50
    got = linededup.line_digests(table(spark, rows, _id=1, keep="x", line=2))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows)


def test_line_dedup_of_an_empty_table(spark):
    assert linededup.line_digests(table(spark, [])).collect() == []


def test_other_thresholds(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 4))) for i in range(12)]
    out = linededup.kept_texts(linededup.with_bitmaps(table(spark, rows), least=6, documents=2))
    assert {r.doc_id: r.text for r in out.collect()} == {i: ("\n".join(f"line {j}" for j in range(i % 4)) if i in (11,) else "") for i in range(12)}


def test_stream_decides_as_whole_table_does():
    """Batches and tasks of every size give the same decisions."""
    rng = random.Random(8)
    for _ in range(150):
        rows = sorted({(rng.randrange(6), 0, rng.random() < 0.1, -rng.randrange(9), 0, n) for n in range(rng.randrange(1, 60))})
        want = set()
        for a, _, no, doc, _, line in rows:
            docs = sorted({(no_, d) for a_, _, no_, d, _, _ in rows if a_ == a})
            if len(docs) >= 3 and (no, doc) != docs[0]:
                want.add((a, no, -doc, line))
        tasks = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(4)))
        goes, waits, marks = [], [], []
        for i, j in zip([0, *tasks], [*tasks, len(rows)], strict=True):
            stream = linededup._Stream(3)
            out = []
            k = i
            while k < j:
                m = min(j, k + rng.randrange(1, 9))
                cols = list(zip(*rows[k:m], strict=True))
                batch = pa.record_batch(
                    [pa.array(cols[2]), pa.array([-d for d in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[5], pa.int32())],
                    names=["_no", "_id", "_h", "a", "b", "line"],
                )
                out += list(stream.rows(batch))
                k = m
            out += list(stream.rest())
            for r in (r for x in out for r in x.to_pylist()):
                (goes, waits, marks)[r["what"]].append(r)
        keys = collections.defaultdict(set)
        for r in marks:
            keys[r["a"]].add((r["_no"], -r["_id"]))
        late = [r for r in waits if len(keys[r["a"]]) >= 3 and (r["_no"], -r["_id"]) != min(keys[r["a"]])]
        assert {(r["a"], r["_no"], r["_id"], r["line"]) for r in goes + late} == want


def test_bitmaps_round_trip():
    for gone in ([0], [3, 1], [7], [8, 9, 1000]):
        assert linededup.gone_lines(linededup.bitmap(np.array(gone))).tolist() == sorted(gone)
    assert linededup.gone_lines(None).tolist() == []


def test_bitmaps_instead_of_texts(spark):
    docs = table(spark, [(i, "A line that all three documents have\nown " + str(i)) for i in range(3)])
    maps = linededup.keep_bitmaps(docs)
    assert maps.columns == ["_no", "_id", "_h", "keep"]
    assert sorted((r._id, linededup.gone_lines(r.keep).tolist()) for r in maps.collect()) == [(0, [0]), (1, [0])]
    assert linededup.with_bitmaps(docs).where(F.col("keep").isNull()).count() == 1
