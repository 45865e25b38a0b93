"""A training corpus from ``documents``: language ID, near-dedup, substring dedup, mixing, pieces.

Every stage takes all rows that the stage before has kept. ``run`` writes each stage as Parquet in the
shared folder and reads it again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advislake.llm import language_crf, minmax_dedup, sentence_pieces, source_mix, substring_dedup
from advislake.llm.components import written
from advislake.llm.registry import findable, register

LEAST_SHARE = 0.5  # a document in which no language has half of the letters is rejected
REPEAT_WORDS = 50


def _one_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """Drops all but one of equal rows; only rows marked ``repeated`` are shuffled for it."""
    once = rows.where("not repeated")
    return once.unionByName(rows.where("repeated").dropDuplicates(list(key))).drop("repeated")


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its id and the hash of its text, so no column of its own meets one of a stage."""
    return docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("row_id"), F.xxhash64(docs["text"]).alias("row_key"))


def _rewritten(docs: DataFrame, held, text, changed) -> list:
    """The columns of ``docs``, as ``held`` finds them, with another text, and its length where it has changed."""
    chars = lambda c: F.when(changed, F.length(text)).otherwise(held(c)).cast(docs.schema[c].dataType)
    return [(text if c == "text" else chars(c) if c == "n_chars" else held(c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which one learned language has at least half of the letters.

    Ids play no part but in the draw of examples; rows without text go. An empty table stays empty.
    """
    findable(spark)
    field = language_crf.fit(docs)
    labelled = language_crf.label(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}), field, "own_text")
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)) \
        .select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; texts without words are linked with nothing.

    Rows are told apart by doc_id and text together, so null and repeated ids are fine.
    """
    findable(spark)
    near = minmax_dedup.near_duplicates(docs)
    alike = near.groupBy("doc_id", "text_key", "root").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    alike = alike.where("kept").withColumn("repeated", F.col("n") > 1)
    first = F.min(F.struct("doc_id", "text_key", "repeated"))
    stay = alike.where("root is not null").groupBy("root").agg(first.alias("s")).select("s.*").unionByName(
        alike.where("root is null").select("doc_id", "text_key", "repeated"))
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("text_key").alias("stay_key"), "repeated")
    kept = _packed(docs).join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_key") == F.col("stay_key")))
    return _one_of_each(kept.select("row", "row_id", "row_key", "repeated"), "row_id", "row_key").select("row.*")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of REPEAT_WORDS words and more that occur elsewhere; documents left without words go."""
    findable(spark)
    own = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "doc_id"})
    clean = substring_dedup.remove_repeats(own, "own_text", REPEAT_WORDS).where("n_removed = 0 or n_removed < n_words")
    held = lambda c: F.col(c if c == "doc_id" else f"own_{c}")
    return clean.select(*_rewritten(docs, held, F.col("clean_text"), F.col("n_removed") > 0))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or drops documents so that each source gives its target of words.

    The document at a source's cut gives its first words only, so that the budget is met. Rows are told
    apart by doc_id, source and text, so null and repeated ids are fine; rows without words go.
    """
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"))
    mixed = source_mix.mix(keyed, source_mix.word_count(F.col("text")), also=("text_key",))
    mixed = mixed.groupBy("doc_id", "source", "text_key").agg(
        F.sum("taken").alias("total"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).where("total > 0")
    mixed = mixed.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("text_key").alias("m_key"),
                         "total", "size", (F.col("n") > 1).alias("repeated"))
    rows = _packed(docs).withColumn("row_source", F.col("row.source"))
    rows = rows.join(mixed, F.col("row_id").eqNullSafe(F.col("m_id")) & F.col("row_source").eqNullSafe(F.col("m_source"))
                     & (F.col("row_key") == F.col("m_key"))).drop("m_id", "m_source", "m_key")
    rows = _one_of_each(rows, "row_id", "row_source", "row_key")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / F.col("size")))))
    left = F.col("total") - (F.col("copy") - 1) * F.col("size")
    words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(source_mix.WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    cut = rows.withColumn("cut_text", F.when(left < F.col("size"), words))
    return cut.select(*_rewritten(docs, lambda c: F.col("row")[c], F.coalesce("cut_text", "row.text"), F.col("cut_text").isNotNull()))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text's pieces, their number, and whether they decode to the text; row by row."""
    findable(spark)
    coded = sentence_pieces.encode(docs, sentence_pieces.default_model(), check=True)
    return coded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", repeat_removal), ("source_mix", mixing),
          ("sentence_pieces", pieces)]
ORACLE_SQL = None  # neither the language model nor the pieces can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


@register("pipeline")
def pipeline(spark, sf_dir):
    return run(spark, sf_dir)
