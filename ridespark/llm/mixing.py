"""Mixing sources to target numbers of words by entropy balancing, with DataFrame functions only.

A document's rate is the tilt exp(lambda) of its source, the rates nearest to one (in relative
entropy over words) that meet every source's target. Newton steps solve the convex dual: at each,
a job sums the tilted words of every source, and the step is (target - sum) / sum, the gradient
over the second derivative, at most one. Rates then become copies: every document gets the whole
part of its rate, and the rest of the rate decides how many documents of every size get one more.
Sizes are gone through from the longest down, and what rounding leaves or exceeds at one size is
made up at the next, so that the smallest documents close the sum. If that leaves more than going
down the sizes and giving every document that still fits one more, the latter counts.

Decisions are one row per source and size: the last document, in the order of a hash of the id,
that gets one more. So they can be applied to any table with the same rows without a join on
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import freeze
from .tables import unused, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STEPS = 60
CLOSE = 1e-12
BUCKET_ROWS = 50_000
#: Decisions are broadcast up to this many sources and sizes, some 100 bytes each; beyond, Spark joins them.
BROADCAST_ROWS = 400_000
#: Beyond every place in the rounding order, and before every one.
ALL, NONE = 1 << 60, -1


def n_words(text: Column) -> Column:
    """How many runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    """60 bits of the id's md5: the order in which documents get one more copy."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _rows(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """key (of the source), source, doc_id, size, and `at`, the document's place in the rounding order."""
    size = n_words(F.col(text))
    return docs.select(
        F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias("key"),
        F.col(source).cast("string").alias("source"), F.col(key).alias("doc_id"), size.alias("size"),
    ).withColumn("at", _place(F.col("doc_id")))


def targets(sources: DataFrame, *, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`sources` (source, source_size) with weight and target.

    Targets share `share` of all words by weight and stop at `most` times the source's words; what
    is cut off is shared again by weight. The level at which that ends comes from one pass over
    the sources in the order of the level that fills them.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * most
    rows = sources.withColumn("weight", pick).withColumn("_fills", full / F.col("weight"))
    order = W.orderBy("_fills", F.col("source").asc_nulls_last())
    earlier, later, all_ = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    total = F.sum("source_size").over(all_) * F.lit(float(share))
    level = (total - F.coalesce(F.sum(full).over(earlier), F.lit(0))) / F.sum("weight").over(later)
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_fills"), F.struct("_fills", "_level"))).over(all_)["_level"])
    target = F.least(full.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), full.cast("double")))
    return rows.withColumn("target", target).drop("_fills", "_level")


def balance(cells: DataFrame, *, mass: str, target: str, group: str, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """`cells` with `tilt`: lambda such that the mass times exp(tilt) of every group sums to its target.

    A group with a target of 0 or no mass has no finite tilt and gets null, a rate of 0.
    """
    now = cells.withColumn("tilt", F.when((F.col(target) > 0) & (F.col(mass) > 0), F.lit(0.0)))
    for _ in range(steps):
        now = freeze(now)
        sums = now.groupBy(group).agg(F.sum(F.col(mass) * F.exp("tilt")).alias("_sum"), F.max(target).alias("_target"))
        off = sums.agg(F.max(F.abs(F.col("_sum") / F.col("_target") - 1))).first()[0]
        if off is None or off < close:
            break
        step = sums.select(group, F.least(F.col("_target") / F.col("_sum") - 1, F.lit(1.0)).alias("_step"))
        now = now.join(step, group).withColumn("tilt", F.col("tilt") + F.col("_step")).drop("_step")
    return now


def _shared(sizes: Column, need: Column, share: Column, even: bool) -> Column:
    """left, more: how many of each of `sizes` (size, n; longest first) get one more, and the words still wanted.

    `even` gives every size its share, rounded, with what is left from the sizes before; otherwise
    all that fits is given from the longest down.
    """

    def step(done: Column, x: Column) -> Column:
        wanted = done["left"] + share * x["n"] * x["size"] if even else done["left"]
        fits = F.floor(wanted / x["size"] + F.lit(0.5 if even else 0.0))
        # a document without words changes no sum
        more = F.when(x["size"] == 0, F.floor(share * x["n"] + 0.5)).otherwise(F.greatest(F.lit(0).cast("long"), F.least(x["n"], fits)))
        return F.struct((wanted - more * x["size"]).alias("left"), F.array_append(done["more"], more).alias("more"))

    start = F.lit(0.0) if even else need
    return F.aggregate(sizes, F.struct(start.alias("left"), F.array().cast("array<long>").alias("more")), step)


def _last(rows: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    """key, size, last: the place up to which `more` of the `n` rows of a source and size lie.

    Rows of one place are not parted; of the two counts around `more` the nearer one is met. Counts
    run first over buckets of the place, then inside the one in which `more` is reached.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET_ROWS))).cast("int")
    cut = cells.where("0 < more and more < n").select("key", "size", "more", bits.alias("_bits"))
    part = rows.select("key", "size", "at").join(F.broadcast(cut) if small else cut, ["key", "size"]).withColumn("_b", F.expr("shiftright(at, 60 - _bits)"))
    buckets = part.groupBy("key", "size", "_b").agg(F.count(F.lit(1)).alias("_w"), F.max("more").alias("more"))
    before = W.partitionBy("key", "size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    edge = buckets.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0))).where("_before < more and _before + _w >= more").select("key", "size", "_b", "_before")
    upto = W.partitionBy("key", "size", "_b").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    walked = part.join(F.broadcast(edge) if small else edge, ["key", "size", "_b"]).withColumn("_n", F.col("_before") + F.count(F.lit(1)).over(upto))
    # the places before the bucket's first row are one that can be met, too
    first = walked.groupBy("key", "size").agg((F.min("at") - 1).alias("at"), F.max(F.col("more") - F.col("_before")).alias("_off"))
    met = walked.select("key", "size", "at", F.abs(F.col("_n") - F.col("more")).alias("_off")).union(first.select("key", "size", "at", "_off"))
    return met.groupBy("key", "size").agg(F.min_by("at", F.struct("_off", "at")).alias("last"))


def decide(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> tuple[DataFrame, DataFrame]:
    """(documents, decisions): key, source, doc_id, size, at per document; a row per source and size."""
    rows = written(_rows(docs, text, key, source), "sizes")
    sizes = written(rows.groupBy("key", "size").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("n")), "counts")
    sources = written(sizes.groupBy("key").agg(F.max("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    rated = balance(targets(sources, **options), mass="source_size", target="target", group="key")
    rate = F.coalesce(F.least(F.round(F.exp("tilt"), 9), F.lit(float(options.get("most", MOST)))), F.lit(0.0))
    rated = rated.withColumn("copies", F.floor(rate))
    rated = rated.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    rated = rated.withColumn("share", F.when(F.col("source_size") > 0, F.least(F.lit(1.0), F.col("need") / F.col("source_size"))).otherwise(F.lit(0.0)))
    rated = written(rated.select("key", "source_size", "target", "copies", "need", "share"), "rates")

    by_size = sizes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    both = rated.join(by_size, "key").select("*", *[_shared(F.col("sizes"), F.col("need"), F.col("share"), even).alias(name) for name, even in (("_even", True), ("_full", False))])
    best = F.when(F.abs("_even.left") <= F.abs("_full.left"), F.col("_even.more")).otherwise(F.col("_full.more"))
    each = both.select("key", "source_size", "target", "copies", F.explode(F.arrays_zip(F.col("sizes"), best.alias("more"))).alias("x"))
    cells = written(each.select("key", "source_size", "target", "copies", "x.sizes.size", "x.sizes.n", "x.more"), "cells")
    last = _last(rows, cells, cells.count() <= BROADCAST_ROWS)
    place = F.when(F.col("more") <= 0, F.lit(NONE)).when(F.col("more") >= F.col("n"), F.lit(ALL)).otherwise(F.col("last"))
    return rows, written(cells.join(last, ["key", "size"], "left").withColumn("last", place.cast("long")).drop("n", "more"), "decisions")


def _apply(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """`rows` with their decision, and `_n`, how often a document is taken."""
    small = decisions.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(decisions) if small else decisions, ["key", "size"])
    return found.withColumn("_n", F.col("copies") + F.when((F.col("copies") < MOST) & (F.col("at") <= F.col("last")), 1).otherwise(0))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken; a row for every row of `docs`.

    A null text has size 0 and nothing taken. A null source is a source, last in order. Rows with
    one id and size share a decision.
    """
    rows, decisions = decide(docs, **options)
    found = _apply(rows, decisions)
    return found.select("doc_id", "size", "source_size", "target", (F.col("_n") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    _, decisions = decide(docs, text=text, key=key, source=source, **options)
    row = unused("row", docs.columns)
    part = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(row))
    inner = part.select(F.col(row), *[F.col(f"{row}.{c}").alias(f"_c{i}") for i, c in enumerate((text, key, source))])
    marked = inner.select(
        F.col(row).alias("row"), F.when(F.col("_c2").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("_c2").cast("string"))).alias("key"),
        n_words(F.col("_c0")).alias("size"), _place(F.col("_c1")).alias("at"),
    )
    found = _apply(marked, decisions.select("key", "size", "copies", "last"))
    return found.where("_n > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("row.*")
