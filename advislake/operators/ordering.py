"""Orderings, top lists and ranks."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import lookup, truthy
from advislake.operators.risk import exploited
from advislake.operators.severity import severity_band
from advislake.sources.scratch import fresh_path


def publication_order() -> list:
    """Exploited first, then band, network first, cve."""
    bands = {b: i for i, b in enumerate(vocab.BANDS)}
    return [(~exploited()).asc(), lookup(bands, F.col("severity.normalized_band"), 99).asc(),
            (~truthy(F.col("attack.vector") == "network")).asc(), F.col("cve").asc()]


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers and letters ignore case.

    A run is led by its own length, so runs of any length compare.
    """
    pieces = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\d+|\D+"), 0)
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.concat(
        F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p))).otherwise(p)), "")


def advisory_sort(df: DataFrame, key: str, direction: str = "desc", position: str = None) -> DataFrame:
    """Sort by cve, threat, baseline or predicted; missing values last both ways.

    ``threat``, ``baseline`` and ``predicted`` need the profile columns; ``cve`` does not.
    """
    up = direction == "asc"
    go = lambda c: c.asc_nulls_last() if up else c.desc_nulls_last()
    number = natural_key(F.col("cve"))
    if key == "cve":
        keys = [number.asc() if up else number.desc()]
    elif key == "threat":
        rank = F.when(exploited(), 3).otherwise(F.col("base_likelihood"))
        keys = [go(rank), go(F.col("threat.epss")), go(F.col("cvss.base_score"))]
    elif key in ("baseline", "predicted"):
        side = "base" if key == "baseline" else "resid"
        keys = [go(F.col(f"{side}_action")), go(F.col(f"{side}_likelihood"))]
    else:
        return df
    tail = [] if key == "cve" else [number.asc()]
    return df.orderBy(*keys, *tail, *([F.col(position).asc()] if position else []))


WORST_KEYS = ["resid_action", "resid_likelihood", "_score"]


def worst_first(df: DataFrame, minimum: int = 8, max_top_up: int = 8) -> DataFrame:
    """All Immediate records, topped up with Out-of-cycle to a readable minimum.

    Needs the residual columns. The top-up is a bounded top-k and the count of
    Immediate records stops at ``minimum``, so no stage ranks the whole set.
    """
    ranked = df.withColumn("_score", F.coalesce("cvss.base_score", F.lit(0.0)))
    keys = [F.col(c).desc() for c in WORST_KEYS] + [F.col("cve").asc()]
    emergency = ranked.where(F.col("resid_action") == 3)
    found = emergency.limit(minimum).agg(F.count("*")).scalar()
    best = ranked.where(F.col("resid_action") == 2).orderBy(*keys).limit(min(max_top_up, minimum))
    # at most ``minimum`` rows remain here
    top_up = best.withColumn("_rn", F.row_number().over(Window.orderBy(*keys))).where(
        F.col("_rn") <= F.least(F.lit(max_top_up), F.lit(minimum) - found)).drop("_rn")
    return emergency.unionByName(top_up).orderBy(*keys).drop("_score")


def number_rows(ordered: DataFrame, into: str = "rank") -> DataFrame:
    """0-based position of each row of a sorted frame without one global window.

    Rows are numbered inside each sorted partition and shifted by the sizes of the
    partitions before. The numbered table is written first: range bounds are sampled, so
    they must not be drawn twice.
    """
    spark = ordered.sparkSession
    path = fresh_path(spark, "rank")
    ordered.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    # partition number in the high bits, row number in the low 33
    numbered = spark.read.parquet(path).withColumns({
        "_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per shuffle partition, a bound set by the configuration
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_off")))
    return numbered.join(offsets, "_part").withColumn(
        into, F.col("_off") + F.col("_row")).drop("_id", "_part", "_row", "_off")


def global_rank(df: DataFrame, keys, into: str = "rank") -> DataFrame:
    """0-based position of each row in the total order of ``keys``."""
    return number_rows(df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys), into)


def shards(df: DataFrame, count: int, batch: int) -> DataFrame:
    """Round-robin shard of each row by cve order, then batches of ``batch`` in a shard."""
    ranked = global_rank(df, ["cve"])
    return ranked.withColumns({
        "shard": F.pmod("rank", F.lit(count)),
        "batch": F.floor(F.floor(F.col("rank") / count) / batch)})


def batches(df: DataFrame, size: int) -> DataFrame:
    """Consecutive batches of ``size`` in cve order."""
    return global_rank(df, ["cve"]).withColumn("batch", F.floor(F.col("rank") / size))


def release_keys() -> list:
    """Newest release first; a real month before its demo."""
    year = F.split_part("month", F.lit("-"), F.lit(1)).cast("int")
    name = F.split_part("month", F.lit("-"), F.lit(2))
    position = lookup({m: i for i, m in enumerate(vocab.MONTHS)}, name)
    return [year.desc(), position.desc(), (~F.col("month").endswith("-demo")).desc()]


def release_order(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(*release_keys())


def default_release(manifest: DataFrame) -> DataFrame:
    """First release that is not a demo, else the first."""
    demo = F.col("month").endswith("-demo")
    return manifest.orderBy(demo.asc(), *release_keys()).limit(1)


def first_few(df: DataFrame, keys, count: int) -> DataFrame:
    """First ``count`` rows in order, each with the size of the whole set."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*keys).limit(count).withColumn("total", total)
