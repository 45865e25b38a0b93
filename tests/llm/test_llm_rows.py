"""Null and repeated ids, clashing columns and empty tables in the pipeline's stages and their operators."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from advislake.llm import language_crf, minmax_dedup, substring_dedup
from advislake.llm.registry import findable

NAMES = ["text_key", "repeated", "size", "total", "copy", "row", "row_id", "row_key", "stay_id", "stay_key", "m_id", "cut_text", "n_words",
         "n_removed", "clean_text", "kept_sha256", "removed_spans", "root", "kept", "lang_pred", "score", "doc", "draw", "label", "id",
         "taken", "copies", "key", "range", "words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    findable(spark)
    r = random.Random(3)
    english = "the of and to in is that with for was on are this by".split()
    german = "der die und in den von zu das mit sich des auf ist im".split()
    rows = []
    for i in range(120):
        words = english if i % 2 else german
        text = " ".join(r.choice(words) + str(r.randint(0, 9)) * (r.random() < .3) for _ in range(r.randint(20, 80)))
        rows.append(([None, 7, i][i % 3], text, ["de", "en"][i % 2], "s", len(text)))
    rows += [rows[0]] * 3 + [(None, None, "en", None, None), (7, "", None, "t", 0)]
    return spark.createDataFrame([row + tuple(f"own {c}" for c in NAMES) for row in rows], SCHEMA).repartition(4)


def test_stages_keep_clashing_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        rows = out.collect()
        kept = [c for c in NAMES if c in out.columns]
        assert kept == NAMES, name
        assert rows and all(r[c] == f"own {c}" for r in rows for c in NAMES), name
        if name != "sentence_pieces":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "unused").count() == 0


def test_many_rows_of_one_id_stay_linear(spark):
    findable(spark)
    for key in (None, 5):
        docs = spark.createDataFrame([(key, f"text number {i} of many {i * 7} different {i % 13} ones") for i in range(2000)], "doc_id long, text string")
        near = minmax_dedup.near_duplicates(docs.union(docs), size=2)
        assert near.count() == 4000 and near.where("n_shingles = 0").count() == 0
        named = spark.createDataFrame([(r["cls"], key, r["text_key"]) for r in minmax_dedup._signed(docs, "text", 2).select(
            F.col("class").alias("cls"), "text_key").collect()], "class long, id long, id_key long")
        assert minmax_dedup._texts_of(docs, named, 2).count() == 2000
        clean = substring_dedup.remove_repeats(docs.union(docs), window=8)
        assert clean.count() == 4000 and clean.where("n_removed <> n_words").count() == 0


def test_field_draws_rows_without_ids_and_of_one_id(spark, docs):
    texts = docs.select("doc_id", "text", "lang")
    for ids in (F.lit(None).cast("long"), F.lit(1).cast("long")):
        field = language_crf.fit(texts.withColumn("doc_id", ids), sample_docs=40)
        assert field.labels == ["de", "en"]
        told = language_crf.label(texts.where("text <> ''"), field).where("lang is not null")
        assert told.where("lang = lang_pred").count() > 0.9 * told.count()
    assert language_crf.fit(texts.limit(0)).labels == []
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="more than 256 labels"):
        language_crf.fit(many)


def test_draw_counts_equal_rows_once(spark):
    findable(spark)
    copies = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.lit("immer wieder das gleiche").alias("text"), F.lit("de").alias("lang"))
    others = spark.range(30).select("id", F.concat(F.lit("ein anderer satz "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    english = spark.range(31).select("id", F.concat(F.lit("one more line "), F.col("id").cast("string")), F.lit("en"))
    field = language_crf.fit(copies.union(others).union(english), sample_docs=31, epochs=60)
    told = language_crf.label(others, field).collect()
    assert field.labels == ["de", "en"] and all(r["lang_pred"] == "de" and r["score"] > 0.8 for r in told)
