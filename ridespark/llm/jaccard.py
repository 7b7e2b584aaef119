"""Jaccard join of documents on their sets of five-word shingles, and the components of its links.

The product of the document by shingle matrix with its transpose holds the overlap of every two
documents. Only cells that can reach the similarity are formed:

- Equal sets are one row of the matrix (a class).
- A set's shingles are ordered by rarity, and only the columns of its prefix are looked at. Of two sets of
  similarity t the first k common shingles lie among the first n - ceil(t n) + k of both, so a pair with
  fewer than k common ones there is discarded; k grows with the size. The order comes from a counting
  sketch of all documents; it affects the amount of work, not the result.
- Sizes below t times the other's are discarded.
- Columns of a prefix that no other prefix has count as missing from the other set, so a column that comes
  after too many of these is discarded, and so is a pair whose places leave too few in common.
- The other cells are counted exactly in blocks of candidate pairs: rows of a block are multiplied with
  the marked columns of one set at a time.

A column that thousands of near copies share is not squared. In the first rounds each column names one
of its sets, and each set is compared with the few that its columns name most often; columns whose sets are by then in one component are done. What is left is
joined in full, in blocks of BLOCK sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import ordinal
from ..session import drop_table
from .keys import KEYS, keyed
from .tables import new_path, written
from .words import LOWER, NOT_SPACE, Words, mix, slices, text_buffers, windows, words_of

SHINGLE = 5
#: The similarity, as a percentage.
PERCENT = 80
CELLS = 20
STAR_ROUNDS = 2
STARS = 4
#: One in so many shingles of a set, and one more, must be common in the prefixes.
COMMON_SHARE = 20
BLOCK = 512
BROADCAST_CLASSES = 300_000


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where each text's begin (n + 1 offsets).

    A text of fewer than `size` words, but not none, has one: all of it.
    """
    h, counts = w.hashes(LOWER), w.counts
    whole = windows(h, size, 5)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(int(at[-1]), np.uint64)
    long = counts >= size
    of = np.repeat(long, many)
    start = np.repeat(w.first[:-1] - at[:-1], many) + np.arange(len(out))
    out[of] = whole[start[of]]
    for i in np.flatnonzero((counts > 0) & ~long):
        a, b = w.first[i], w.first[i + 1]
        out[at[i]] = windows(h[a:b], b - a, 6)[0]
    return out, at


def sets_of(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, at = shingles(words_of(*text_buffers(column), NOT_SPACE), size)
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def heavy_cells(rows: DataFrame, size: int) -> np.ndarray:
    """For each of 2**CELLS cells of the hash range the logarithm of its count, 0 unless far above the mean.

    A task sends the cells that are far above its own mean; so the result is bounded by the sketch.
    """

    def count(batches):
        seen = np.zeros(1 << CELLS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                h, _ = shingles(words_of(*text_buffers(batch.column("text")), NOT_SPACE), size)
                seen += np.bincount((h >> np.uint64(64 - CELLS)).astype(np.int64), minlength=len(seen))
        at = np.flatnonzero(seen >= 2 * seen.mean() + 8)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    found = rows.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << CELLS, np.uint8)
    out[found["cell"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(float)).astype(np.uint8) + 1
    return out


def prefixes(rows: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: KEYS, `s` and `n` (hash and size of its set), `prefix` (its rarest shingles in order)."""
    cells = rows.sparkSession.sparkContext.broadcast(heavy_cells(rows, size))  # 1 MB

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = cells.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, sizes, firsts = [], [], []
                for u in sets_of(batch.column("text"), size):
                    n = len(u)
                    take = min(n, n - -(-percent * n // 100) + n // COMMON_SHARE + 1)
                    heavy = weight[(u >> np.uint64(64 - CELLS)).astype(np.int64)]
                    light = u[heavy == 0]
                    first = light[:take]
                    if len(first) < take and n:
                        rest, h = u[heavy > 0], heavy[heavy > 0]
                        first = np.concatenate((first, rest[np.lexsort((rest, h))][: take - len(first)]))
                    ids.append(int(mix(u).sum().view(np.int64)))
                    sizes.append(n)
                    firsts.append(first.view(np.int64))
                at = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(firsts)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists], names=[*KEYS, "s", "n", "prefix"])

    kind = dict(rows.dtypes)["_id"]
    return rows.select(*KEYS, "text").mapInArrow(scan, f"_no boolean, _id {kind}, _h long, s long, n long, prefix array<long>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _common(a: Column, b: Column) -> Column:
    """How many common shingles the prefixes of sets of these sizes have at least, if the sets reach the similarity."""
    return F.floor(F.least(a, b) / COMMON_SHARE) + 1


def _reaches(overlap: Column, sizes: Column, percent: int) -> Column:
    """Whether an overlap of this size reaches the similarity, from the sum of both sizes."""
    return overlap * (100 + percent) >= sizes * percent


def _possible(entries: DataFrame, percent: int) -> DataFrame:
    """Of c, n, p (place), gram: the columns that a set may share with a similar one, with `q`, how many before them may be.

    Columns are in one order in all sets. So if two sets share the column at place p of a prefix, any
    other that they share before it is in both prefixes, and one that is in no other prefix is
    missing from the other set. A set of n with q other candidates before p shares q + n - p at most.
    """
    often = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("_often")).where("_often > 1").select("gram")
    shared = entries.join(often, "gram").withColumn("q", F.row_number().over(W.partitionBy("c").orderBy("p")) - 1)
    return shared.where((F.col("q") + F.col("n") - F.col("p")) * 100 >= F.col("n") * percent)


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (x, y) of classes, those that reach the similarity; `texts` has c, text."""
    y = texts.select(F.col("c").alias("y"), F.col("text").alias("ty"))
    x = texts.select(F.col("c").alias("x"), F.col("text").alias("tx"))
    both = pairs.select("x", "y").join(y, "y").join(x, "x")

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ty"):
                cx, cy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                rows = sets_of(batch.column("ty"), size)
                n = np.array([len(r) for r in rows], np.int64)
                columns, at = np.unique(np.concatenate(rows), return_inverse=True)
                owner = np.repeat(np.arange(len(rows)), n)
                overlap, nx = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for c in np.unique(cx):
                    mine = np.flatnonzero(cx == c)
                    s = sets_of(batch.column("tx").slice(mine[0], 1), size)[0]
                    marked = np.isin(columns, s, assume_unique=True)
                    overlap[mine] = np.bincount(owner, weights=marked[at], minlength=len(rows)).astype(np.int64)[mine]
                    nx[mine] = len(s)
                ok = 100 * overlap >= percent * (nx + n - overlap)
                yield pa.RecordBatch.from_arrays([pa.array(cx[ok]), pa.array(cy[ok])], names=["x", "y"])

    return both.select("x", "y", "tx", "ty").mapInArrow(multiply, "x long, y long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """c, label: the least node that every node of the links reaches.

    Labels go to the neighbours and are then replaced by their own labels, until none changes: a
    number of rounds in the order of the logarithm of the longest path.
    """
    edges = written(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(links.select("y", "x")).distinct(), "edges")
    now = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "c"), name)
    while True:
        near = edges.join(now.select(F.col("c").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near.withColumnRenamed("a", "c"), "c").select("c", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("c").alias("label"), F.col("label").alias("next"))
        after = written(step.join(jump, "label", "left").select("c", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), name)
        now = after.select("c", "label")
        if after.where("label <> old").isEmpty():
            return now


def _joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` after further links: the components of the labels at the links' ends."""
    of = lambda end: labels.select(F.col("c").alias(end), F.col("label").alias(f"l{end}"))
    ends = links.join(of("x"), "x", "left").join(of("y"), "y", "left")
    ends = written(ends.select("x", "y", F.coalesce("lx", "x").alias("lx"), F.coalesce("ly", "y").alias("ly")), "label-links")
    up = components(ends.select(F.col("lx").alias("x"), F.col("ly").alias("y")).where("x <> y").distinct())
    known = labels.union(ends.select("x", "lx")).union(ends.select("y", "ly")).distinct()
    above = up.select(F.col("c").alias("label"), F.col("label").alias("up"))
    return written(known.join(above, "label", "left").select("c", F.coalesce("up", "label").alias("label")), "labels")


def joined(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: KEYS, n (size of its set), and `r_no`, `r_id`, `r_h`: the keys of the least document of its component.

    Texts without words have the empty set and are linked with nothing. Equal rows have equal sets.
    """
    rows = keyed(docs, key=key, text=text)
    sets = written(prefixes(rows, size, percent), "sets")
    # equal sets have equal prefixes: one row a class from here on
    spark = docs.sparkSession
    held = [new_path(spark, name) for name in ("class-prefixes", "possible")]
    classes = sets.where("n > 0").groupBy("s", "n").agg(F.min(F.struct(*KEYS, "prefix")).alias("r")).select("s", "n", "r.*")
    classes = written(classes, "classes", held[0])
    firsts = classes.select("s", "n", "prefix")
    classes = written(ordinal(classes.drop("prefix"), [F.col(k) for k in KEYS], name="c"), "classes")

    entries = firsts.join(classes.select("s", "n", "c"), ["s", "n"]).select("c", "n", F.posexplode("prefix").alias("p", "gram"))
    entries = written(_possible(entries, percent), "entries", held[1])
    drop_table(spark, held[0])
    ends = entries.groupBy("gram").agg(F.min("c").alias("x"), F.max("c").alias("_last")).where("x < _last").select("gram", "x")
    entries = written(entries.join(ends, "gram"), "entries")
    drop_table(spark, held[1])

    # texts of the classes that share a column, one each
    wanted = entries.select("c").distinct().join(classes.select("c", *KEYS), "c")
    wanted = written(wanted, "wanted")
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = written(rows.join(wanted, KEYS).groupBy("c").agg(F.first("text").alias("text")), "texts")
    sizes = classes.select("c", "n")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return written(linked(written(pairs.distinct(), name), texts, size, percent), "links")

    star = entries.where("c <> x").groupBy("x", F.col("c").alias("y")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"))
    star = star.join(sizes.select(F.col("c").alias("x"), F.col("n").alias("nx")), "x").where(_sizes_fit(F.col("n"), F.col("nx"), percent))
    star = star.withColumn("k", _common(F.col("n"), F.col("nx")))
    # a common column may have another first set, so part of the count is enough here
    labels = components(verified(_nearest(star.where("3 * m >= k")), "star"))
    for k in range(1, star_rounds + 1):
        named = entries.drop("x").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
        named_at = new_path(spark, "named")
        named = written(named, "named", named_at)
        ends = named.groupBy("gram").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_m"), F.min(F.struct(F.xxhash64("label", F.lit(k)), F.xxhash64("c", F.lit(k)), "c", "n", "label")).alias("_x"))
        apart = written(named.join(ends.where("_lo < _hi").select("gram", "_m", "_x"), "gram"), "apart")
        drop_table(spark, named_at)
        if apart.isEmpty():
            break
        if k < star_rounds:
            pairs = apart.where((F.col("label") != F.col("_x.label")) & _sizes_fit(F.col("n"), F.col("_x.n"), percent))
            pairs = pairs.groupBy(F.col("_x.c").alias("x"), F.col("c").alias("y")).agg(F.count(F.lit(1)).alias("m"), _common(F.min("n"), F.min("_x.n")).alias("k")).where("3 * m >= k")
            pairs = _nearest(pairs).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        else:
            pairs = _all_pairs(apart.drop("_x"), percent, block)
        more = verified(pairs, "pairs")
        if not more.isEmpty():
            labels = _joined_labels(labels, more)
    least = classes.select(F.col("c").alias("label"), F.col("_no").alias("r_no"), F.col("_id").alias("r_id"), F.col("_h").alias("r_h"))
    roots = classes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")).join(least, "label").select("s", "n", "r_no", "r_id", "r_h")
    some = sets.where("n > 0").select(*KEYS, "s", "n").join(written(roots, "roots"), ["s", "n"]).drop("s")
    none = sets.where("n = 0").select("n", *KEYS, F.col("_no").alias("r_no"), F.col("_id").alias("r_id"), F.col("_h").alias("r_h"))
    return some.unionByName(none)


def _nearest(star: DataFrame) -> DataFrame:
    """The STARS sets x that each set y has most columns in common with, as pairs.

    One link is enough to put a near copy where its group is. A copy of a large group meets another
    first set in each of its columns; without this, the texts of all these pairs would be compared.
    What stays apart is paired in full at the end.
    """
    w = W.partitionBy("y").orderBy(F.desc("m"), "x")
    return star.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= STARS).select("x", "y")


def _all_pairs(apart: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of sets in different components that share enough columns.

    A column of m sets is dealt into m / block blocks; each set goes to one block on the left
    and to every block on the right.
    """
    blocks = F.ceil(F.col("_m") / block).cast("int")
    left = apart.withColumn("_b", F.pmod(F.xxhash64("c"), blocks).cast("int")).select("gram", "_b", *[F.col(c).alias(f"l_{c}") for c in ("c", "n", "label", "p", "q")])
    right = apart.withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_m")
    rest = F.least(F.col("l_n") - F.col("l_p"), F.col("n") - F.col("p"))
    reach = _reaches(F.least("l_q", "q") + rest, F.col("l_n") + F.col("n"), percent)
    both = left.join(right, ["gram", "_b"]).where((F.col("l_c") < F.col("c")) & (F.col("l_label") != F.col("label")) & _sizes_fit(F.col("l_n"), F.col("n"), percent) & reach)
    # columns of sets in different components are all among these, so the count is whole
    counted = both.groupBy(F.col("l_c").alias("x"), F.col("c").alias("y")).agg(F.count(F.lit(1)).alias("m"), F.min("l_n").alias("nx"), F.min("n").alias("ny"), F.min(rest).alias("rest"))
    # behind the last common column of the prefixes, which is one of the m
    reach = _reaches(F.col("m") + F.col("rest") - 1, F.col("nx") + F.col("ny"), percent)
    return counted.where((F.col("m") >= _common(F.col("nx"), F.col("ny"))) & reach).select("x", "y")


def components_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id; a row for every row of `docs`. A null id comes after all others."""
    found = joined(docs, **options)
    return found.select(F.when(~F.col("_no"), F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~F.col("r_no"), F.col("r_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are the least document of their component; of equal rows one."""
    found = joined(docs, key=key, text=text, **options)
    least = (F.col("_no") == F.col("r_no")) & (F.col("_id") == F.col("r_id")) & (F.col("_h") == F.col("r_h"))
    found = written(found.select(*KEYS, least.alias("least")), "least")
    gone = found.where(~F.col("least")).select(*KEYS).distinct()
    again = found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(*KEYS)
    several = again.count()
    if gone.count() + several <= BROADCAST_CLASSES:
        gone, again = F.broadcast(gone), F.broadcast(again)
    row, value = F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(key).isNull().alias("_no"), F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.xxhash64(value).alias("_h"), row)
    whole = whole.join(gone, KEYS, "left_anti")
    if not several:
        return whole.select("row.*")
    one = whole.join(again, KEYS, "left_semi").withColumn("_k", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.xxhash64(F.to_json("row")))))
    return whole.join(again, KEYS, "left_anti").select("row.*").union(one.where("_k = 1").select("row.*"))
