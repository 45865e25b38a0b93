"""Overview tiles, totals and coverage summaries."""
from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import label_of, lookup, words
from advislake.operators.parse import ssvc
from advislake.operators.search import filter_tags
from advislake.operators.severity import severity_band


def _tile_aggregates() -> list:
    out = [F.count("*").alias("total"), F.count_if("review.required").alias("review_count")]
    for i in range(len(vocab.ACTIONS)):
        at = F.col("resid_action") == i
        out += [F.count_if(at).alias(f"n{i}"),
                F.count_if(at & (severity_band() != "unknown")).alias(f"rated{i}")]
    return out


def _tile_columns() -> dict:
    """Worst action, unverified flag and state from the per-action counts."""
    worst = F.lit(-1)
    worst_count, rated = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i in range(len(vocab.ACTIONS)):
        some = F.col(f"n{i}") > 0
        worst = F.when(some, i).otherwise(worst)
        worst_count = F.when(some, F.col(f"n{i}")).otherwise(worst_count)
        rated = F.when(some, F.col(f"rated{i}")).otherwise(rated)
    unverified = worst.isin(0, 1) & (rated == 0)
    action = label_of(vocab.ACTIONS, worst)
    return {
        "worst_action": F.when(worst >= 0, action), "worst_count": worst_count,
        "unverified": unverified,
        "state": F.when(worst < 0, "empty").when(unverified, "unverified").otherwise(
            lookup(vocab.TILE_STATES, action)),
    }


def tile_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Tiles per key; needs resid_action and review. One pass of map-side aggregates."""
    grouped = df.groupBy(*keys).agg(*_tile_aggregates())
    return grouped.withColumns(_tile_columns()).drop(*[f"rated{i}" for i in range(4)])


def board_options(spark, board_only: bool = True) -> DataFrame:
    """Filter configuration as rows, one per option (a fixed table)."""
    rows = [(g, source, tag, label, at) for at, (g, source, tag, label, shown) in enumerate(
        (g, source, tag, label, shown) for g, source, options in vocab.FILTER_GROUPS
        for tag, label, shown in options) if shown or not board_only]
    return spark.createDataFrame(rows, "group string, source string, tag string, label string, position int")


def option_rows(df: DataFrame, board_only: bool) -> DataFrame:
    """One row per record and filter option it matches."""
    def matches(group, source, options):
        wanted = words([t for t, _, shown in options if shown or not board_only])
        return F.transform(F.array_intersect(filter_tags(source), wanted), lambda t: F.struct(
            F.lit(group).alias("group"), t.alias("tag")))

    hits = [matches(*entry) for entry in vocab.FILTER_GROUPS]
    return df.withColumn("_o", F.explode(F.concat(*hits))).withColumns(
        {"group": F.col("_o.group"), "tag": F.col("_o.tag")}).drop("_o")


def overview_board(df: DataFrame) -> DataFrame:
    """Tile per board option, empty ones kept. Each record is profiled once, before the
    explode over its tags."""
    slim = df.select("resid_action", "severity", "review", "product_tags", "tags")
    tiles = option_rows(slim, True).groupBy("group", "tag").agg(*_tile_aggregates())
    options = board_options(df.sparkSession)
    joined = options.join(tiles, ["group", "tag"], "left")
    numbers = [c for c in tiles.columns if c not in ("group", "tag")]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return filled.withColumns(_tile_columns()).drop(*[f"rated{i}" for i in range(4)])


def month_totals(df: DataFrame) -> DataFrame:
    """Totals per month: records, records per action and records to review."""
    return df.groupBy("month").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("resid_action") == i).alias(f"n{i}") for i in range(4)],
        F.count_if("review.required").alias("review_count"))


def option_counts(df: DataFrame) -> DataFrame:
    """Records per filter option, options without records included."""
    counts = option_rows(df.select("product_tags", "tags"), False).groupBy("group", "tag").agg(
        F.count("*").alias("records"))
    return (board_options(df.sparkSession, False).join(counts, ["group", "tag"], "left")
            .select("group", "tag", "label", F.coalesce("records", F.lit(0)).alias("records")))


def visible_summary(df: DataFrame) -> DataFrame:
    score = F.col("threat.epss")
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("resid_action") == i).alias(f"n{i}") for i in range(4)],
        F.count_if("review.required").alias("review_count"),
        F.count_if(score.isNotNull() & ~F.isnan(score)).alias("epss_scored"))


def enrichment_coverage(df: DataFrame) -> DataFrame:
    """One row of program-record coverage over distinct requested ids."""
    status = F.col("cve_program.status")
    found = F.coalesce(status == "found", F.lit(False))
    return df.agg(
        F.count("*").alias("requested"), F.count_if(found).alias("found"),
        F.count_if(status == "not-published").alias("not_published"),
        F.count_if(~F.coalesce(status.isin("found", "not-published"), F.lit(False))).alias("failed"),
        F.count_if(ssvc().isNotNull()).alias("with_ssvc"),
        F.count_if(found & F.col("cve_program.vendor_severity").isNotNull()).alias("with_cna_severity"),
    ).withColumn("ssvc_coverage", F.round(F.try_divide("with_ssvc", "requested"), 4))


def exploitation_histogram(df: DataFrame) -> DataFrame:
    return (df.where(ssvc().isNotNull()).groupBy(ssvc()["exploitation"].alias("exploitation"))
            .agg(F.count("*").alias("records")))
