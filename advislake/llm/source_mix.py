"""Mixing sources to target weights with DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from advislake.llm.registry import register
from advislake.sources.scratch import fresh_path

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 5_000
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """``sizes`` (source, source_size, rows), one row per source, with ``target`` in words.

    All words are shared by weight (1, 2, 3 repeating in code-point order, null last). A target stops at
    three times its source's size and the excess is shared again by weight. That ends where the sources
    with the lowest size per weight are full: in the order of that ratio, the first k are full for the
    smallest k whose level (words left / weights left) is not above the next ratio.
    """
    by_name = Win.orderBy(F.col("source").asc_nulls_last())
    weight = weights if weights is not None else (F.row_number().over(by_name) - 1) % 3 + 1
    full = F.col("source_size") * MOST_EPOCHS
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("full", full)
    ratio = F.col("full") / F.col("weight")
    order = Win.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Win.unboundedPreceding, -1)
    whole = Win.rowsBetween(Win.unboundedPreceding, Win.unboundedFollowing).partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0))
    heft = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / heft).withColumn("ratio", ratio)
    # levels rise while the next source is below its share; the first that is not above its ratio holds
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return s.withColumn("final", final).select(
        "source", "source_size", "rows",
        F.when(F.col("final").isNull(), F.col("full").cast("double"))
        .otherwise(F.least(F.col("full").cast("double"), F.col("weight") * F.col("final"))).alias("target"))


def mix(docs: DataFrame, size: Column, seed: int = 17, also: tuple = ()) -> DataFrame:
    """(doc_id, source, size) of each row with source_size, target and the ``taken`` words.

    ``also`` names further columns that tell rows apart; they are returned too.

    Rows are put in a random but fixed order by a hash of (seed, source, doc_id). An epoch takes a whole
    source; the budget left after whole epochs goes to the first rows in that order, and the row at the
    cut gives the words that are missing. Prefix sums are made in ranges of the hash of about
    ROWS_PER_RANGE rows, so that one large source is spread over many tasks; range totals are summed per
    source. Equal rows (doc_id, source, size and ``also``) are counted first and share one place, copy after copy.
    Null text has size 0; a null source is a source of its own; empty input gives no rows.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "doc_id", "size")]
    key = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *named)), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), *also) \
        .groupBy("doc_id", "source", "size", *also).agg(F.count(F.lit(1)).alias("copies")).withColumn("key", key)
    path = fresh_path(docs.sparkSession, "mix-rows")
    rows.write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                       F.count(F.lit(1)).alias("rows"))
    plan = targets(sizes).withColumn("ranges", F.ceil(F.col("rows") / ROWS_PER_RANGE)).select(
        F.col("source").alias("of"), "source_size", "target", "ranges",
        F.round("target").cast("long").alias("budget"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    # the top 30 of the key's 60 bits as a fraction of all keys give its range
    place = F.floor(F.shiftright("key", 30) * F.col("ranges") / (1 << 30))
    rows = rows.withColumn("range", place).withColumn("words", F.col("size") * F.col("copies"))
    within = Win.partitionBy("of", "range").orderBy("key", "doc_id", "size", *also).rowsBetween(Win.unboundedPreceding, -1)
    totals = rows.groupBy("of", "range").agg(F.sum("words").alias("total"))
    offset = Win.partitionBy("of").orderBy("range").rowsBetween(Win.unboundedPreceding, -1)
    totals = totals.select(F.col("of").alias("t_of"), F.col("range").alias("t_range"),
                           F.coalesce(F.sum("total").over(offset), F.lit(0)).alias("offset"))
    rows = rows.withColumn("prefix", F.coalesce(F.sum("words").over(within), F.lit(0))) \
        .join(totals, F.col("of").eqNullSafe(F.col("t_of")) & (F.col("range") == F.col("t_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    rows = rows.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("copy", copy)
    part = F.least(F.col("size"), F.greatest(
        F.lit(0), F.col("rest") - F.col("offset") - F.col("prefix") - F.col("copy") * F.col("size")))
    return rows.select("doc_id", "source", "size", *also, "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source),
o as (select *, 3.0::double * source_size / weight as ratio,
  (sum(source_size) over () - coalesce(sum(3 * source_size) over w, 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as level
  from s window w as (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least((3 * source_size)::double, weight * (select level from o where level <= ratio order by ratio limit 1)) as target from o),
r as (select d.doc_id, d.size, t.source_size, t.target, round(t.target)::bigint as budget,
  (coalesce(sum(size) over (partition by d.source order by ('0x' || substr(md5(concat_ws('/', '17', coalesce(d.source, ''), coalesce(doc_id::varchar, ''), size::varchar)), 1, 15))::bigint, doc_id, size
    rows between unbounded preceding and 1 preceding), 0))::bigint as prefix
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, case when source_size = 0 then 0
  else (budget // source_size) * size + least(size, greatest(0, budget % source_size - prefix)) end::bigint as taken from r"""


@register("op9_source_mix", SQL)
def op9_source_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
