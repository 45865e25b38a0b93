"""Registered queries and their oracle SQL."""
import importlib

from advislake.plans.sql_views import compose

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None, needs=()):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` with an optional DuckDB oracle."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql, *needs)
        return fn
    return add


AREAS = ["risk_queries", "board_queries", "search_queries", "ingest_queries", "gate_queries",
         "reconcile_queries", "text_queries"]


def load():
    for area in AREAS:
        importlib.import_module(f"advislake.plans.{area}")
    return QUERIES, ORACLES
