"""Seeded samples and splits: hash order, so a draw does not depend on partitioning."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import has, overlaps, truthy, within
from advislake.operators.risk import misses_impact_judgement
from advislake.operators.severity import severity_band

# fixed values: share of each stratum in a set
WEIGHTS = {"unknown-severity": 5, "signal-conflict": 6, "no-mitigation-candidates": 5, "routine": 4}


def stratum(flagged: Column = None) -> Column:
    """At most one stratum per record, the most specific first."""
    flagged = F.lit(False) if flagged is None else truthy(flagged)
    epss = F.col("threat.epss")
    conflict = truthy(epss >= 0.01) & within(F.col("threat.exploitation_assessment"), ["unlikely", "less-likely"])
    return (F.when(flagged, "reference-failure").when(severity_band() == "unknown", "unknown-severity")
            .when(misses_impact_judgement(), "reference-failure").when(conflict, "signal-conflict")
            .when(F.coalesce(F.size("mitigation_candidates"), F.lit(0)) < 1, "no-mitigation-candidates")
            .otherwise("routine"))


def draw_key(seed: int, key: str = "cve") -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def first_per_stratum(df: DataFrame, seed: int, most: int) -> DataFrame:
    """The ``most`` first rows of each stratum in draw order, with their rank.

    Ranks are cut twice: inside hash slices of a stratum, then over the slices' few
    survivors, so a stratum with most of the rows is never ranked in one task.
    """
    order = [F.col("_draw"), F.col("cve")]
    sliced = df.withColumns({"_draw": draw_key(seed), "_slice": F.pmod(F.xxhash64("cve"), F.lit(64))})
    local = Window.partitionBy("stratum", "_slice").orderBy(*order)
    few = sliced.withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= most)
    final = Window.partitionBy("stratum").orderBy(*order)
    return few.withColumn("rank", F.row_number().over(final)).where(
        F.col("rank") <= most).drop("_draw", "_slice", "_rn")


def dev_holdout_split(df: DataFrame, seed: int, per_set: int) -> DataFrame:
    """Rows (cve, stratum, split): disjoint sets with equal quotas per stratum.

    A stratum gives each set at most half of itself; what a set lacks is topped up from
    routine; reference failures go to dev only, all of them.
    """
    total = sum(WEIGHTS.values())
    wants = {s: round(per_set * w / total) for s, w in WEIGHTS.items()}
    labelled = df.select("cve", "stratum")
    sizes = labelled.groupBy("stratum").agg(F.count("*").alias("n"))
    quota = F.lit(0)
    for name, want in wants.items():
        quota = F.when(F.col("stratum") == name, F.least(F.lit(want).cast("bigint"), F.floor(F.col("n") / 2))).otherwise(quota)
    quotas = sizes.withColumn("quota", quota)
    shortfall = F.lit(per_set) - quotas.where(F.col("stratum").isin(list(wants))).agg(F.sum("quota")).scalar()
    drawn = first_per_stratum(labelled.where(F.col("stratum").isin(list(wants))), seed, 4 * per_set)
    ranked = drawn.join(quotas.select("stratum", "quota"), "stratum")
    rank, q = F.col("rank"), F.col("quota")
    extra = F.greatest(shortfall, F.lit(0))
    routine = F.col("stratum") == "routine"
    split = (F.when(rank <= q, "dev").when(rank <= 2 * q, "holdout")
             .when(routine & (rank <= 2 * q + extra), "dev")
             .when(routine & (rank <= 2 * q + 2 * extra), "holdout"))
    chosen = ranked.withColumn("split", split).where("split is not null").select("cve", "stratum", "split")
    reference = labelled.where("stratum = 'reference-failure'").withColumn("split", F.lit("dev"))
    return chosen.unionByName(reference)


def simple_sample(df: DataFrame, seed: int, count: int) -> DataFrame:
    """``count`` ids without replacement; the same seed draws the same ids."""
    return df.select("cve").orderBy(draw_key(seed), "cve").limit(count)
