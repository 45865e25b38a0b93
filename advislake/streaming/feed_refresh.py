"""Arriving scores as a restartable stream into a score log, and the log's latest scores."""
from pyspark.sql import DataFrame, SparkSession, functions as F

SCORES = "cve string, epss double, percentile double, score_date string"


def log_on_arrival(feed: DataFrame, log: str, checkpoint: str):
    """Starts a query that writes each arriving batch of scores to its own folder of ``log``.

    ``feed`` streams (cve, epss, percentile, score_date) rows. A batch holds the ids that it brings,
    one row each; a batch that is repeated after a restart replaces its own folder, so the log stays
    the same. Nothing of the release is rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("cve").agg(F.max_by(
            F.struct("epss", "percentile", "score_date"), F.struct("score_date", "epss")).alias("s"))
        newest.select("cve", "s.*").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_scores(spark: SparkSession, log: str) -> DataFrame:
    """The last score of each id in the log, ready for ``joins.refresh_scores`` of the ids it holds."""
    rows = spark.read.schema(f"{SCORES}, batch long").parquet(log)
    last = F.max_by(F.struct("epss", "percentile", "score_date"), F.struct("score_date", "batch"))
    return rows.groupBy("cve").agg(last.alias("s")).select("cve", "s.*")
