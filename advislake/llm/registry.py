"""Queries of the training-data operators and their DuckDB oracles."""
import functools
import importlib
import os

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ["quality_rules", "url_filters", "substring_dedup", "recurrent_lm", "language_crf", "minmax_dedup",
           "kneser_ney", "embedding_dedup", "source_mix", "sentence_pieces", "fill_in_middle", "line_runs",
           "phrase_graph"]


def findable(spark) -> None:
    """Lets Python workers import the package from the driver's folder when it isn't installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)


def register(name, sql=None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` with an optional DuckDB oracle."""
    def add(fn):
        @functools.wraps(fn)
        def query(spark, sf_dir):
            findable(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def load():
    for module in MODULES:
        importlib.import_module(f"advislake.llm.{module}")
    return QUERIES, ORACLES
