import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridespark.llm import fingerprint, jaccard, language, mixing, repeats, toxicity
from ridespark.llm.queries import QUERIES

from .corpus import odd_rows, sentence, table
from .test_scan_and_tokens import LOWER, bench, brute_hits, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
same = lambda rows: sorted(map(tuple, rows), key=str)


def order(i):
    return (i is None, i or 0)


# -- Jaccard join -------------------------------------------------------------------


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0], key=order)
    return same((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def near_copies(n=60, groups=3, seed=5):
    """Chains and stars of copies that differ from each other by more and more words."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = sentence(rng, 150, 10_000).split()
        for _ in range(n // groups):
            t = base.copy()
            for _ in range(rng.randrange(5)):
                t[rng.randrange(150)] = f"y{rng.randrange(1000)}"
            rows.append((rng.randrange(10**6), " ".join(t)))
            if rng.random() < 0.3:
                base = t
    return rows


@pytest.mark.parametrize("options", [{}, {"star_rounds": 1, "block": 4}])
def test_components_equal_brute_force(spark, options):
    rows = [r for r in odd_rows() if r[0] != 42] + near_copies()
    found = jaccard.components_of(table(spark, rows, n=1, c=2, s=3), **options)
    assert same(found.collect()) == brute_components(rows)


def test_common_passages_do_not_link(spark):
    rng = random.Random(2)
    common = sentence(rng, 30)
    rows = [(i, f"{common} {sentence(rng, 12, 10_000)}") for i in range(80)]
    assert same(jaccard.components_of(table(spark, rows), star_rounds=1, block=8).collect()) == brute_components(rows)


def test_no_documents_have_no_components(spark):
    assert jaccard.components_of(table(spark, [])).count() == 0
    assert same(jaccard.components_of(table(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in odd_rows() if r[0] not in (41, 42)]
    docs = table(spark, rows, row=1, _k="x", r_id=2)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=order)
    assert ids.count(10) == 1 and ids.count(51) == 1 and not {11, 12, 14, 24} & set(ids) and {13, 20, 21, 22, 50} <= set(ids)


# -- substring dedup ------------------------------------------------------------------


def brute_repeats(rows, size=20):
    cut = sorted(((order(r[0]), r[1] or "", WORD.findall(r[1] or "")) for r in rows), key=lambda x: x[0])
    seen, out = set(), []
    for i, _, w in cut:
        gone = set()
        for j in range(len(w) - size + 1):
            g = tuple(w[j : j + size])
            if g in seen:
                gone.update(range(j, j + size))
            seen.add(g)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if i[0] else i[1], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return same(out)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 50] + near_copies(12, 2)
    passage = sentence(rng, 45)
    rows += [(200_000_000 + i, f"{sentence(rng, i)} {passage} {sentence(rng, 5)} {passage[: 30 * i]}") for i in range(12)]
    rows += [(None, passage), (2_000, "tic " * 19), (2_001, "tic " * 20), (2_002, "tic " * 21), (2_003, "tic tac " * 40)]
    assert same(repeats.digests(table(spark, rows, at=1, h1=2, kept="k")).collect()) == brute_repeats(rows)


def test_rows_of_one_id_lose_what_the_other_has(spark):
    text = " ".join(map(str, range(30)))
    found = repeats.digests(table(spark, [(1, text), (1, f"{text} more"), (1, text)])).collect()
    assert sum(r.n_words - r.n_removed for r in found) == 31
    assert repeats.digests(table(spark, [])).count() == 0


# -- fingerprints -----------------------------------------------------------------------


def test_fingerprints_follow_the_next_document(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 50] + [(52, "x" * 9), (60, sentence(random.Random(9), 300))]
    found = {r.doc_id: r for r in fingerprint.edited_fingerprints(table(spark, rows, _edited=1, pos=2)).collect() if r.doc_id != 51}
    ordered = sorted(rows, key=lambda r: r[0])
    for i, r in enumerate(ordered):
        if r[0] == 51:
            continue
        text, other = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        got = found[r[0]]
        assert got.n_chars == n and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
        assert (edited == text) <= (got.fingerprint == got.edited_fingerprint and got.near_edited == 1)
    assert found[10].fingerprint == found[11].fingerprint and found[10].near_next == 1 and found[20].fingerprint == ""
    assert found[60].near_edited > 0.25 > found[60].near_next


def test_equal_rows_and_the_last_document_wrap_around(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h"), (None, "i j")]
    found = sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.edited_fingerprints(table(spark, rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # eleven characters keep six
    assert found == sorted([("1", sha("a b c " + "a b c")), ("1", sha("a b c " + "g h")), ("2", sha("g " + "i")), ("None", sha("i " + "a"))])
    assert fingerprint.edited_fingerprints(table(spark, [])).count() == 0


def test_sketches_merge_and_contain(spark):
    rng = random.Random(4)
    a, b = sentence(rng, 2_000, 10**6), sentence(rng, 200, 10**6)
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = fingerprint.with_sketch(df, c, f"s_{c}")
    r = df.select(
        F.size("s_a").alias("n"), fingerprint.containment(F.col("s_b"), F.col("s_ab")).alias("in_ab"), fingerprint.containment(F.col("s_b"), F.col("s_a")).alias("in_a"),
        F.size(F.array_except("s_ab", fingerprint.merged(F.col("s_a"), F.col("s_b")))).alias("rest"),
    ).first()
    assert 180 < r.n < 320 and r.in_ab == 1 and r.in_a == 0 and r.rest <= 4


# -- mixing -------------------------------------------------------------------------------


def filled(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        level = (left - sum(out.values())) / max(1, sum(weight[s] for s in open_))
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(1000 + i, sentence(rng, rng.randrange(1, 60)), None, rng.choice(["a", "a", "a", "a", "b", "c", "D", None])) for i in range(600)] + odd_rows()
    docs = table(spark, rows, key=1, at=2, need=3, size=4)
    found = mixing.mixed_sizes(docs).collect()
    assert len(found) == len(rows) and same(found) == same(mixing.mixed_sizes(docs.repartition(7)).collect())
    sizes = {}
    for r in rows:
        sizes[r[3] if len(r) > 3 else None] = sizes.get(r[3] if len(r) > 3 else None, 0) + len(WORD.findall(r[1] or ""))
    want, taken = filled(sizes), {}
    source = {r[0]: r[3] if len(r) > 3 else None for r in rows if r[0] is not None}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            taken[s] = taken.get(s, 0) + r.taken
    for s in ("b", "c", "D"):
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s]), (s, taken[s], want[s])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.where("doc_id >= 1000").groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.taken // r["size"] for r in found if (r.doc_id or 0) >= 1000 and r.taken}


@pytest.mark.parametrize("share", [0.1, 0.33, 0.5])
def test_mix_meets_its_targets_with_a_long_document(spark, share):
    """Wherever a long document stands in the order, the small ones close what it leaves."""
    rng = random.Random(13)
    rows, names = [], [f"s{i:02}" for i in range(24)]
    for s in names:
        small = [rng.randrange(20, 60) for _ in range(150)]
        rows += [(rng.randrange(10**9), "w " * n, None, s) for n in (*small, int(sum(small) * share / (1 - share)))]
    found = mixing.mixed_sizes(table(spark, rows)).collect()
    taken, target = dict.fromkeys(names, 0), {}
    source = {r[0]: r[3] for r in rows}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert {s: (taken[s], target[s]) for s in names if abs(taken[s] - target[s]) > 20} == {}


def test_mix_of_nothing(spark):
    assert mixing.mixed_sizes(table(spark, [])).count() == 0
    rows = mixing.mixed_sizes(table(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert {(r["size"], r.target, r.taken) for r in rows} == {(0, 0.0, 0)}


# -- language and toxicity -------------------------------------------------------------------


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def talk(rng, lang):
    parts = {"en": ["the", "ing", "tion", "and", "er", "wh"], "de": ["sch", "ung", "ei", "der", "cht", "ö"], "fr": ["eau", "oi", "ment", "que", "é", "les"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))


def test_language_of_held_out_documents(spark):
    rng = random.Random(7)
    rows = [(i, talk(rng, lang), lang, "s") for i in range(150) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !? 456", "fr"), (None, "the and ing", "en"), (1003, "ß", None)]
    found = language.held_out_predictions(table(spark, rows, lang_pred=1, score=2)).collect()
    known = {r[0]: r[2] for r in rows}
    out = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert len(out) > 30 and np.mean([r.lang_pred == known[r.doc_id] for r in out]) > 0.97
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1000, 1001, 1002}


def test_bundles_equal_their_definition():
    texts, d = ["Ab ba!", "ß1ß", "", None, "日"], 128
    vectors, letters = language.bundle(texts, np.arange(5), 5, 3, d)
    for t, v, n in zip(texts, vectors, letters, strict=True):
        s = f" {re.sub(r'[^ab日ß]+', ' ', (t or '').lower())} ".replace("  ", " ")
        expect = np.zeros(d)
        for i in range(len(s) - 2):
            g = np.ones(d)
            for k, c in enumerate(s[i : i + 3]):
                g = g * np.roll(language.letter_vectors(np.array([0 if c == " " else ord(c)]), d)[0], k)
            expect += g
        assert n == sum(c.isalpha() for c in t or "") and (v == expect).all()


def test_documents_of_no_language_go(spark):
    rows = [(1, "the thing and the other", "en"), (2, "und der sch ung", "de"), (3, "$$ 11", "en"), (4, None, None), (5, "the other thing", None)]
    docs = table(spark, rows, lang_pred="x", lang_score=1.0)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert language.keep_identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.held_out_predictions(table(spark, [(1, "text", None)])).collect()} == {"und"}


def test_noise_and_unlearned_scripts_go(spark):
    rng = random.Random(21)
    drawn = lambda letters: "".join(rng.choice(letters) if rng.random() < 0.85 else " " for _ in range(400))
    rows = [(i, talk(rng, lang), lang) for i in range(150) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(200 + i, w, None) for i, w in enumerate(["the", "wh and", "sch", "der ei", "eau", "les que"])]
    rows += [(1000 + i, drawn("bdfgjkmpqvxyz"), None) for i in range(40)]
    rows += [(2000 + i, drawn([chr(c) for c in range(0x10D0, 0x10F0)]), None) for i in range(40)]
    kept = {r.doc_id for r in language.keep_identified(table(spark, rows, n_letters=1)).collect()}
    assert kept == {r[0] for r in rows if r[0] < 1000}


def toxic_corpus(seed=11, n=700):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        t = sentence(rng, rng.randrange(3, 200), 300).split()
        bad = rng.random() < 0.2
        if bad:
            w = rng.choice(["scoundrel", "sc0undrel", "ѕcoundrel", "Sco​undrel", "vermin", "v3rmin", f"grok{rng.choice('abcdefgh')}ta"])
            t.insert(rng.randrange(len(t)), w)
        elif rng.random() < 0.2:
            t.insert(rng.randrange(len(t)), "harmless vermin control")
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(rng.random() < 0.5), int(bad)))
    return rows, labels


def test_toxicity_of_held_out_documents(spark):
    rows, labels = toxic_corpus()
    docs, marks = table(spark, [*rows, (5_000, None), (5_001, ""), (None, "scoundrel")], toxic=1, score=2), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.held_out_scores(docs, marks).collect()
    known = {r[0]: r[2] for r in labels}
    out = [r for r in found if r.doc_id in known and r.held_out]
    assert len(out) > 90 and np.mean([r.predicted == known[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and held(r.doc_id, 5) == 0) for r in found)
    # labels of held-out documents change nothing
    flipped = marks.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert same(toxicity.held_out_scores(docs, flipped).collect()) == same(found)


def test_sampled_labels_keep_their_share(spark):
    """A word that is toxic in a fifth of its documents stays harmless when both labels are capped."""
    rng, rows, labels = random.Random(17), [], []
    for i in range(1500):
        bad = i % 15 == 0
        vague = bad or rng.random() < 0.3
        rows.append((i, f"{sentence(rng, 20, 40)} {'murky' if vague else 'plain'} {sentence(rng, 20, 40)}", "en", "s"))
        labels.append((i, 0, int(bad)))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, marks, 60)
    stands = {r.toxic: (r.n, round(r.s)) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("stands_for").alias("s")).collect()}
    assert stands == {0: (60, 1400), 1: (60, 100)}
    model = toxicity.learn(sample, least_weight=0.5)
    assert any("murky".startswith(t.strip()) for t in model.weights)
    scored = toxicity.score(docs.join(marks, "doc_id"), model).collect()
    assert abs(np.mean([r.score for r in scored]) - 100 / 1500) < 0.04
    assert np.mean([r.score >= 0.5 for r in scored]) < 0.05


def test_toxicity_without_labels_or_documents(spark):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.held_out_scores(table(spark, odd_rows()), marks).collect()} == {0.0}
    assert toxicity.held_out_scores(table(spark, []), marks).count() == 0


def test_folding():
    assert toxicity.folded("1D10T, іdіоt! ｉｄｉｏｔ id​iot x@b $$$ a!!") == " idiot idiot idiot idiot xab a "
    assert toxicity.folded(None).split() == [] and toxicity.folded(" \n").split() == []


# -- pipeline ---------------------------------------------------------------------------------


def test_stages_follow_each_other(spark, folder, tmp_path):
    rng = random.Random(12)
    item = sentence(rng, 15)
    rows = [(i, f"{talk(rng, 'en')} {sentence(rng, 30, 10_000)}", "en", rng.choice("ab")) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a"), (101, f"{sentence(rng, 20)} {item} {sentence(rng, 9)}", "en", "a"), (102, "99 !!", "en", "b"), (103, None, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, [(1, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert kept["language"] == [*range(60), 100, 101]
    assert kept["near_duplicates"] == sorted({c for _, _, c in brute_components([r[:2] for r in rows if r[0] in set(kept["language"])])})
    assert kept["decontamination"] == [r[0] for r in brute_hits([(i, t) for i, t, *_ in rows if i in set(kept["near_duplicates"])], [(1, item)]) if not r[5]] or kept["decontamination"] == [*range(60)]
    out = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert sorted(r[0] for r in out) == kept["mixing"]
    text = {r[0]: r[1] for r in rows}
    assert [r[2] for r in out] == [len(x) for x in plain([text[r[0]] for r in out])]


def test_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11))
