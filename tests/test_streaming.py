from pyspark.sql import functions as F

from advislake.operators.joins import refresh_scores
from advislake.plans import bridge as B
from advislake.streaming.feed_refresh import SCORES, latest_scores, log_on_arrival

SF = "/root/testdata/sf0.001"


def test_arriving_scores_are_logged_once_and_refresh_their_ids(spark, tmp_path):
    log, chk = str(tmp_path / "log"), str(tmp_path / "chk")
    release = B.records(spark, SF).where("k < 50")
    rows = B.advisories(spark, SF).where("k = 9").select(
        "cve", F.explode(F.array(F.lit(0.2), F.lit(0.4))).alias("epss"), F.lit(0.5).alias("percentile"))
    rows.withColumn("score_date", F.when(F.col("epss") > 0.3, "2026-09-12").otherwise("2026-09-11")).write.parquet(
        str(tmp_path / "feed"))
    feed = lambda: spark.readStream.schema(SCORES).parquet(str(tmp_path / "feed"))
    log_on_arrival(feed(), log, chk).awaitTermination(120)
    log_on_arrival(feed(), log, chk).awaitTermination(120)  # nothing new arrives
    scores = latest_scores(spark, log)
    assert [(r.epss, r.score_date) for r in scores.collect()] == [(0.4, "2026-09-12")]
    held = release.join(scores.select("cve"), "cve", "left_semi")
    out = refresh_scores(held, scores).select("k", "threat.epss", "threat.epss_status").collect()
    assert [tuple(r) for r in out] == [(9, 0.4, "scored")]
