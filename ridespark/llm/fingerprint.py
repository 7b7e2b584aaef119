"""Document fingerprints: every shingle hash below a fixed fraction of the hash range, with DataFrame functions only.

A shingle is five consecutive words of the lower-cased text, or all of a text with fewer. Since a
hash is kept whatever else the text holds, sketches of unequal texts can be compared and merged:
the sketch of a union is the union of the sketches. So that a short text has a fingerprint too,
its least hash is kept where none is below the threshold; `merged` drops such a hash again when
another is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import ordinal
from .tables import written

SHINGLE = 5
#: One hash in 8 is kept. Hashes have 63 bits.
KEPT = 8
_TOP = (1 << 63) - 1


def words(text: Column) -> Column:
    """What stands between spaces, tabs, line feeds, vertical tabs, form feeds and returns."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, out: str, *, shingle: int = SHINGLE, kept: int = KEPT) -> DataFrame:
    """`df` with a sorted array `out` of the hashes kept for the column `text`."""
    w, n = F.col("_words"), F.size("_words")
    parts = lambda i: [F.get(w, i + k) for k in range(shingle)]
    hashes = (
        F.when(n >= shingle, F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*parts(i)).bitwiseAND(F.lit(_TOP))))
        .when(n > 0, F.array(F.xxhash64(w).bitwiseAND(F.lit(_TOP))))
        .otherwise(F.array().cast("array<long>"))
    )
    low = F.filter("_hashes", lambda h: h < F.lit(_TOP // kept))
    sketch = F.when(F.size("_low") > 0, F.array_sort(F.array_distinct("_low"))).when(F.size("_hashes") > 0, F.array(F.array_min("_hashes"))).otherwise(F.array().cast("array<long>"))
    # each step names what the next reads more than once, so that it is computed once
    steps = df.withColumn("_words", words(F.col(text))).withColumn("_hashes", hashes).drop("_words")
    return steps.withColumn("_low", low).withColumn(out, sketch).drop("_hashes", "_low")


def merged(a: Column, b: Column, kept: int = KEPT) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(_TOP // kept))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of `a` that `b` has; 1 for an empty `a`."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The greater of both containments; 1 for two empty sketches, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def as_text(sketch: Column) -> Column:
    """Sixteen hex digits per hash, in ascending order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def neighbours(rows: DataFrame) -> DataFrame:
    """Keys of distinct rows (`_no`, `_id`, `_h`) with `_c`, how many rows have them, and keys and length of those before."""
    groups = written(rows.groupBy("_no", "_id", "_h").agg(F.max("n_chars").alias("n"), F.count(F.lit(1)).alias("_c")), "keys")
    placed = written(ordinal(groups, [F.col("_no"), F.col("_id"), F.col("_h")], name="pos"), "order")
    total = placed.count()
    before = placed.select((F.col("pos") % max(total, 1) + 1).alias("pos"), F.col("_no").alias("p_no"), F.col("_id").alias("p_id"), F.col("_h").alias("p_h"), F.col("n").alias("p_n"))
    return placed.join(before, "pos").drop("pos", "n")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_chars.

    The edited text is the first half of the document's code points, rounded up, and as many of the
    next document's first ones as were cut off. The next document has the next id (nulls last; rows of one
    id by a hash of the text, equal rows follow each other); after the last comes the first. A null text
    is empty, and so is its fingerprint; empty texts are alike (1).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").isNull().alias("_no"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"), F.xxhash64(text).alias("_h"),
        text.alias("text"), F.length(text).cast("long").alias("n_chars"),
    )
    keys = ["_no", "_id", "_h"]
    around = neighbours(rows.select(*keys, "n_chars"))
    sketched = with_sketch(rows, "text", "_sketch")
    placed = sketched.join(around, keys).withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("n_chars")))
    half = lambda n: F.floor(n / 2).cast("int")
    following = placed.where("_k = 1").select(
        F.col("p_no").alias("_no"), F.col("p_id").alias("_id"), F.col("p_h").alias("_h"),
        F.substring(F.col("text"), F.lit(1), half(F.col("p_n"))).alias("_head"), F.col("_sketch").alias("_next"), F.col("n_chars").alias("next_chars"),
    )
    # all but the last of equal rows are followed by themselves
    again = F.col("_k") < F.col("_c")
    n = F.col("n_chars")
    own = lambda mine, other: F.when(again, mine).otherwise(other)
    both = placed.join(following, keys).select(
        F.when(~F.col("_no"), F.col("_id")).alias("doc_id"), n.alias("n_chars"), "_sketch",
        F.concat(F.substring(F.col("text"), F.lit(1), (n - half(n)).cast("int")), own(F.substring(F.col("text"), F.lit(1), half(n)), F.col("_head"))).alias("_edited"),
        own(F.col("_sketch"), F.col("_next")).alias("_next"), own(n, F.col("next_chars")).alias("next_chars"),
    )
    done = with_sketch(both, "_edited", "_edited_sketch")
    a, b = F.col("_sketch"), F.col("_edited_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, F.col("_next")).alias("near_next"), "next_chars",
    )
