"""Fixity audit of WARC replicas by Merkle trees.

The leaves of a tree are the records of an archive file in the order of their offsets; a leaf is the
SHA-256 of the record's bytes. A node above stands for FAN neighbouring nodes and hashes its byte
range and their digests. Replicas are compared at the roots, and below only where a digest
differs: of an intact file only the root is looked at.

A node holds at most FAN children and a file FAN ** LEVELS records, so groups are small whatever
the archive's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import ordinal
from .tables import written

FAN = 16
LEVELS = 3


def record(url: Column, page_id: Column, payload: Column) -> Column:
    """A WARC response record as text, from its version line to the blank lines after its block."""
    body = F.coalesce(payload, F.lit(""))
    head = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))), ("WARC-Target-URI", F.coalesce(url, F.lit(""))), ("Content-Length", F.octet_length(body).cast("string"))]
    lines = [F.lit("WARC/1.0\r\n"), *(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in head)]
    return F.concat(*lines, F.lit("\r\n"), body, F.lit("\r\n\r\n"))


def laid_out(records: DataFrame, *, order: list[Column], length: str = "length") -> DataFrame:
    """`records` with `file`, `no` (in the file, from 0) and `offset`, in the given order; equal records lie side by side."""
    size = FAN**LEVELS
    at = ordinal(records, order, name="_place").withColumn("_place", F.col("_place") - 1)
    at = at.withColumn("file", F.floor(F.col("_place") / size)).withColumn("no", (F.col("_place") % size).cast("int")).drop("_place")
    before = W.partitionBy("file").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    return at.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels from the leaves (file, no, offset, length, digest) to the roots, one node per file at the last.

    A leaf without a digest, one that the replica lacks, is left out of its parent.
    """
    levels = [leaves.select("file", "no", "offset", "length", "digest")]
    for _ in range(LEVELS):
        child = F.struct("no", "offset", "length", "digest")
        up = levels[-1].where("digest is not null").groupBy("file", F.floor(F.col("no") / FAN).cast("int").alias("no")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        start, end = F.col("c")[0]["offset"], F.element_at("c", -1)["offset"] + F.element_at("c", -1)["length"]
        text = F.concat_ws(":", start.cast("string"), end.cast("string"), F.array_join(F.transform("c", lambda x: x["digest"]), ""))
        levels.append(up.select("file", "no", start.alias("offset"), (end - start).alias("length"), F.sha2(text, 256).alias("digest")))
    return levels


def mismatches(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """file, no, offset, length, digest, replica_digest of the leaves that differ, or that one side lacks (null)."""
    suspects = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if suspects is not None:
            parents = suspects.select("file", F.col("no").alias("_up"))
            a, b = (x.withColumn("_up", F.floor(F.col("no") / FAN).cast("int")).join(parents, ["file", "_up"], "left_semi").drop("_up") for x in (a, b))
        b = b.select("file", "no", F.col("offset").alias("o"), F.col("length").alias("l"), F.col("digest").alias("replica_digest"))
        both = a.join(b, ["file", "no"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))
        suspects = both.select("file", "no", F.coalesce("offset", "o").alias("offset"), F.coalesce("length", "l").alias("length"), "digest", "replica_digest")
    return suspects


def audit(leaves: DataFrame) -> DataFrame:
    """file, n_records, n_bytes, root, replica_root, no, offset, length, kind of every damaged record; an intact file has one row, without a record.

    `leaves` has file, no, offset, length, digest and replica_digest (null: the replica lacks the record).
    """
    leaves = written(leaves, "leaves")
    ours = tree(leaves)
    theirs = tree(leaves.drop("digest").withColumnRenamed("replica_digest", "digest"))
    ours, theirs = ([x[0], *(written(y, "nodes") for y in x[1:])] for x in (ours, theirs))
    found = mismatches(ours, theirs).select("file", "no", "offset", "length", F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed").alias("kind"))
    files = leaves.groupBy("file").agg(F.count("digest").alias("n_records"), F.sum("length").alias("n_bytes"))
    roots = [x[-1].select("file", F.col("digest").alias(name)) for x, name in ((ours, "root"), (theirs, "replica_root"))]
    return reduce(lambda x, y: x.join(y, "file", "left"), [files, *roots, found])


def page_audit(pages: DataFrame, *, changed: Column, lost: Column) -> DataFrame:
    """Audit of an archive of `pages` against a replica in which `changed` records have another first character and `lost` ones are gone.

    Pages lie in ascending order of page_id, nulls last, equal ids by digest. A null url or html is empty.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    ours = record(F.col("url"), F.col("page_id"), body)
    other = record(F.col("url"), F.col("page_id"), F.concat(F.lit("~"), F.substring(body, 2, 2**31 - 1)))
    rows = pages.select(
        "page_id", F.octet_length(ours).cast("long").alias("length"), F.sha2(ours, 256).alias("digest"),
        F.when(F.coalesce(lost, F.lit(False)), F.lit(None)).when(F.coalesce(changed, F.lit(False)), F.sha2(other, 256)).otherwise(F.sha2(ours, 256)).alias("replica_digest"),
    )
    rows = written(rows, "records")
    return audit(laid_out(rows, order=[F.col("page_id").asc_nulls_last(), F.col("digest"), F.col("replica_digest").asc_nulls_last()]))
