"""Stored sample sequences and music analyses: keys, digests, lookup, upkeep.

A stored sequence is described by a catalog row: entry_id, contract_key, source,
start_s, end_s and what `audit.sequence_validity` found. Files are written by Spark's
own commit protocol, so a failed write leaves nothing readable behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.digests import settings_key
from ..plans.ordered import running
from ..schemas import SAMPLE_COLUMNS
from ..session import freeze

ROWS_PER_BLOCK = 4096
COVER = 1e-6


def contract_key(settings: Mapping[str, Column]) -> Column:
    """Key of the extraction settings a sequence was made with, its interval left out."""
    return settings_key(settings)


def write_sequences(samples: DataFrame, path: str, *, keys: Sequence[str] = ("video_id",), mode: str = "append") -> None:
    """Parquet by contract, rows of a video in blocks and in order.

    Blocks of a video go to different tasks; within a file rows are sorted, so row
    groups carry tight video and time ranges for pruning.
    """
    block = F.floor(F.col("sample_idx") / ROWS_PER_BLOCK)
    (
        samples.repartition("contract_key", *keys, block)
        .sortWithinPartitions("contract_key", *keys, "sample_idx")
        .write.mode(mode)
        .partitionBy("contract_key")
        .parquet(path)
    )


def read_interval(
    spark: SparkSession, path: str, contract: str, *, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Stored samples of one contract, cut to (start, end); both filters reach the scan."""
    df = spark.read.parquet(path).where(F.col("contract_key") == contract)
    if start is not None:
        df = df.where(F.col("t") > start + COVER)
    if end is not None:
        df = df.where(F.col("t") < end - COVER)
    return df


def on_lattice(
    requests: DataFrame, entries: DataFrame, *, rate: float, keys: Sequence[str] = ("entry_id",)
) -> DataFrame:
    """Requests whose start lies a whole number of steps after the start of the stored entry."""
    both = requests.join(entries.select(*keys, F.col("start_s").alias("stored_start")), list(keys))
    phase = (F.col("start_s") - F.col("stored_start")) * rate
    return both.where(F.abs(phase - F.round(phase)) <= COVER).drop("stored_start")


def sequence_digest(samples: DataFrame, *, keys: Sequence[str] = ("video_id",), names: Sequence[str] = SAMPLE_COLUMNS) -> DataFrame:
    """SHA-256 per key over its rows in order: digests of fixed-size blocks, then of their list."""
    keys = list(keys)
    row = F.to_json(F.struct("sample_idx", "t", *names), {"ignoreNullFields": "false"})
    blocks = samples.groupBy(*keys, F.floor(F.col("sample_idx") / ROWS_PER_BLOCK).alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", row.alias("row")))).alias("_rows")
    )
    digest = F.sha2(F.array_join(F.transform("_rows", lambda r: r["row"]), "\n"), 256)
    return (
        blocks.select(*keys, F.struct("_b", digest.alias("d")).alias("_d"))
        .groupBy(*keys)
        .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_d")), lambda x: x["d"]), "\n"), 256).alias("digest"))
    )


def changed_sequences(samples: DataFrame, recorded: DataFrame, *, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Keys whose content no longer has the recorded digest, or has none recorded."""
    now = sequence_digest(samples, keys=keys).withColumnRenamed("digest", "_now")
    return now.join(recorded.select(*keys, "digest"), list(keys), "left").where(
        ~F.col("_now").eqNullSafe(F.col("digest"))
    ).select(*keys)


def needed_end(start: Column, end: Column, window: float | None, stride: float | None) -> Column:
    """End of the last complete window of a request; the request's end when not windowed."""
    if window is None or stride is None:
        return end
    last = F.floor((end - start - window + COVER) / stride)
    return F.when(end - start >= window - COVER, start + last * stride + window)


def find_covering(
    requests: DataFrame,
    entries: DataFrame,
    *,
    window: float | None = None,
    stride: float | None = None,
    bucket: float = 600.0,
) -> DataFrame:
    """The stored entry to use for each request (request_id, contract_key, source, start_s, end_s).

    Same contract and source, containing the request; an exact match wins, then the
    shortest entry, then the entry id. Requests nothing covers are absent.

    Exact matches come from an equality join with the least id of each interval. The shortest
    cover is a search for the least (length, id) among entries that start early and end late
    enough. Entries are numbered by their start; those that start early enough are a prefix, cut
    into at most three blocks of each size 4**k. Inside a block, a running minimum along descending
    ends answers all its requests at once. No entry is paired with a request: rows grow by the
    logarithm of a source's entries, base four. `bucket` is the chunk of seconds of the running values.
    """
    scope = ["contract_key", "source"]
    have = entries.select("entry_id", *scope, F.col("start_s").alias("_s"), F.col("end_s").alias("_e")).where("_s is not null and _e is not null")
    want = requests.select("request_id", *scope, "start_s", "end_s").withColumn("_need", needed_end(F.col("start_s"), F.col("end_s"), window, stride))
    same = have.groupBy(*scope, F.col("_s").alias("start_s"), F.col("_e").alias("end_s")).agg(F.min("entry_id").alias("_same"))

    # order of starts: entries before the requests that they start early enough for
    rows = have.select(*scope, F.col("_s").alias("_x"), F.lit(0).alias("_kind"), F.col("_e").alias("_y"), F.struct((F.col("_e") - F.col("_s")).alias("len"), "entry_id").alias("_best"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    asked = want.where("start_s is not null and _need is not null").select(
        *scope, (F.col("start_s") + COVER).alias("_x"), F.lit(1).alias("_kind"), (F.col("_need") - COVER).alias("_y"),
        F.lit(None).cast(rows.schema["_best"].dataType).alias("_best"), "request_id",
    )
    order = [F.col("_x"), F.col("_kind"), F.col("_best"), F.col("request_id")]
    counted = freeze(running(rows.unionByName(asked), scope, F.col("_x"), bucket, order, {"_before": ("sum", F.lit(1) - F.col("_kind"))}))
    total = counted.groupBy(*scope).agg(F.max("_before").alias("_n"))

    # an entry stands in its block of each size; a request asks the blocks that its prefix is made of
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") + 1) / 2).cast("int") - 1)
    mine = F.transform(F.sequence(F.lit(0), deep), lambda k: F.struct(k.alias("k"), F.floor(F.col("_before") / F.pow(F.lit(4.0), k)).cast("long").alias("block")))

    def prefix(k: Column) -> Column:
        high = F.floor(F.col("_before") / F.pow(F.lit(4.0), k)).cast("long")
        digit = F.pmod(high, F.lit(4))
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda j: j < digit), lambda j: F.struct(k.alias("k"), (high - digit + j).alias("block")))

    asks = F.flatten(F.transform(F.sequence(F.lit(0), deep), prefix))
    blocks = counted.join(total, scope).withColumn("_at", F.explode(F.when(F.col("_kind") == 0, mine).otherwise(asks)))
    blocks = blocks.select(*scope, F.col("_at.k").alias("_k"), F.col("_at.block").alias("_block"), (-F.col("_y")).alias("_down"), "_kind", "_best", "request_id")
    order = [F.col("_down"), F.col("_kind"), F.col("_best"), F.col("request_id")]
    found = running(blocks, [*scope, "_k", "_block"], F.col("_down"), bucket, order, {"_least": ("min", F.col("_best"))})
    shortest = found.where(F.col("_kind") == 1).groupBy("request_id").agg(F.min("_least").alias("_least"))
    exact = want.join(same, [*scope, "start_s", "end_s"]).select("request_id", "_same")
    return (
        shortest.join(exact, "request_id", "left")
        .where("_least is not null")
        .select("request_id", F.coalesce("_same", F.col("_least.entry_id")).alias("entry_id"), F.col("_same").isNotNull().alias("exact"))
    )


def compatibility(
    requests: DataFrame, entries: DataFrame, fields: Sequence[str], *, rate_field: str | None = "rate"
) -> DataFrame:
    """Why a request's proposed entry (`entry_id`) cannot serve it; an empty list means it can.

    `fields` are compared one by one (rates within 1e-6). Digest mode "sha256" needs the
    request to carry the same source digest.
    """
    e = entries.select("entry_id", *[F.col(c).alias(f"_e_{c}") for c in entries.columns if c != "entry_id"])
    both = requests.join(e, "entry_id")
    same = lambda f: (
        F.coalesce(F.abs(F.col(f) - F.col(f"_e_{f}")) <= COVER, F.lit(False))
        if f == rate_field
        else F.col(f).eqNullSafe(F.col(f"_e_{f}"))
    )
    reasons = [F.when(~same(f), f"{f}_mismatch") for f in fields]
    if "fingerprint_mode" in entries.columns:
        mode = F.coalesce(F.col("_e_fingerprint_mode"), F.lit("metadata"))
        reasons.append(
            F.when((mode == "sha256") & F.col("source_sha256").isNull(), "source_sha256_not_verified")
            .when((mode == "sha256") & ~F.col("source_sha256").eqNullSafe(F.col("_e_source_sha256")), "source_sha256_mismatch")
            .when(~mode.isin("sha256", "metadata"), "unknown_fingerprint_mode")
        )
    bounds = F.col("_e_start_s").isNull() | F.col("_e_end_s").isNull()
    outside = (F.col("_e_start_s") > F.col("start_s") + COVER) | (F.col("_e_end_s") < F.col("end_s") - COVER)
    reasons.append(F.when(bounds, "interval_missing").when(outside, "requested_interval_not_covered"))
    return both.select("request_id", "entry_id", F.array_compact(F.array(*reasons)).alias("reasons")).withColumn(
        "compatible", F.size("reasons") == 0
    )


MUSIC_MATCH = ("cache_version", "source_path", "source_hash", "bass_sensitivity", "bass_min_gap_s")


def reusable_analyses(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored music analyses that match in version, path, content and settings; and what is missing."""
    on = list(MUSIC_MATCH)
    return stored.join(wanted.select(*on).distinct(), on, "left_semi"), wanted.join(stored.select(*on), on, "left_anti")


def retention_plan(catalog: DataFrame, keep: DataFrame, *, suffix: str = ".parquet") -> tuple[DataFrame, DataFrame]:
    """Entries to delete and findings about the keep list. Nothing is deleted here.

    `catalog`: path, valid; `keep`: path, relative to the same root. The plan is empty as
    long as the keep list has a finding.
    """
    clean = keep.select(F.trim("path").alias("path"))
    counts = clean.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    both = counts.join(catalog.select("path", "valid"), "path", "left")
    code = F.array_compact(
        F.array(
            F.when(F.col("_n") > 1, "duplicate"),
            F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "outside_root"),
            F.when(~F.col("path").endswith(suffix), "wrong_type"),
            F.when(F.col("valid").isNull(), "missing").when(~F.col("valid"), "invalid"),
        )
    )
    issues = both.select("path", F.explode(code).alias("code"))
    sound = issues.agg((F.count(F.lit(1)) == 0).alias("_sound"))
    plan = catalog.join(clean, "path", "left_anti").withColumn("_one", F.lit(1))
    gate = sound.where("_sound").select(F.lit(1).alias("_one"))
    return plan.join(gate, "_one", "left_semi").drop("_one"), issues


def reconcile_catalog(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """The catalog after a listing: found paths inserted or updated, absent ones gone. Column `change` says which."""
    old = catalog.select("path", *[F.col(c).alias(f"_o_{c}") for c in catalog.columns if c != "path"])
    both = listing.withColumn("_found", F.lit(True)).join(old.withColumn("_known", F.lit(True)), "path", "full_outer")
    values = [c for c in catalog.columns if c != "path"]
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    change = (
        F.when(F.col("_found").isNull(), "removed")
        .when(F.col("_known").isNull(), "added")
        .when(differs, "updated")
        .otherwise("same")
    )
    return both.select("path", *values, change.alias("change"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, length and change time of files, contents not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    )
