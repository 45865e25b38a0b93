"""Findings of round 3 that were left open: whole training, narrow releases."""
from pyspark.sql import functions as F

from advislake.llm import kneser_ney
from advislake.plans import bridge, ingest_queries
from advislake.sources import scratch

SF = "/root/testdata/sf0.001"


def test_quality_model_counts_every_trusted_text(spark, monkeypatch):
    """beyond 20,000 trusted texts the model's counts came from a draw of them."""
    docs = spark.range(0, 30_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("en").alias("lang"))
    counted = []

    def counts(learn, text="text"):
        counted.append(learn.count())
        return kept(learn.limit(50), text)

    kept = kneser_ney.gram_counts
    monkeypatch.setattr(kneser_ney, "gram_counts", counts)
    kneser_ney.classify(docs, docs.select("doc_id"))
    apart = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(kneser_ney.FOLDS)) == 0
    assert counted == [docs.where(~apart).count()] and counted[0] > 23_000


def test_release_without_severity_has_no_severity_in_its_plan(spark):
    """Severity stands behind a barrier and was made for every query, whatever columns it reads."""
    narrow = bridge.build_release(spark, SF, ("k", "cve", "tags"))
    assert "scale-mapping" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    whole = bridge.build_release(spark, SF).select("k", "cve", "tags")
    assert narrow.count() == whole.count() and narrow.exceptAll(whole).isEmpty()


def test_assembly_reads_three_columns_of_the_release(spark, monkeypatch):
    """the whole release was made and stored for the candidates of an overlay."""
    monkeypatch.setattr(scratch, "_STORED", {})
    ingest_queries.assemble(spark, SF)
    assert not scratch.is_stored(spark, SF, "release") and scratch.is_stored(spark, SF, "release-k-cve-mitigation_candidates")
