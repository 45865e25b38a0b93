"""Text operators whose plans changed: positions, guards, term matching, corpus runs and product trees."""
import itertools
import json
import random
import re
import time

from pyspark.sql import functions as F

from advislake.functions import vocab
from advislake.functions.exprs import prefix_sums
from advislake.operators import citation, parse, privacy, tagcheck


def test_prefix_sums(spark):
    rows = spark.createDataFrame([([(7 * k) % 11 - 3 for k in range(n)],) for n in (0, 1, 2, 3, 4, 5, 255, 256, 257, 1000)], "a array<int>")
    for row in rows.select("a", prefix_sums(F.col("a")).alias("s")).collect():
        assert row["s"] == list(itertools.accumulate(row["a"]))


def test_positions_of_very_many_matches(spark):
    text = "x@y.zz, " * 100_000
    df = spark.createDataFrame([(text,), ("none here",), (None,), ("",)], "t string")
    start = time.time()
    got = df.select(F.size(privacy.matches(F.col("t"), privacy.EMAIL)).alias("n"), F.get(privacy.matches(F.col("t"), privacy.EMAIL), F.lit(99_999)).alias("m")).collect()
    assert [r["n"] for r in got][:2] == [100_000, 0] and tuple(got[0]["m"]) == ("x@y.zz", 799_992, 799_998)
    assert time.time() - start < 60


def test_guards_never_hide_a_match(spark):
    r = random.Random(4)
    parts = ["10.2.3.4", "fe80::1", "1:2:3:4:5:6:7:8", "::1", "a@b.cc", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "00-1A-2B-3C-4D-5E", "001a.2b3c.4d5e",
             "S-1-5-21", "\\\\srv\\share", "C:\\x\\y", "~/x", "/home/a", "host=web01", "Host : db-7", "http://h.zz", "ftp://u@h.zz:1/", "w3.example.io",
             "plain", "a.b", "1.2.3", " ", "\n", "-", ":"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randint(1, 6))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for p in dict.fromkeys([*privacy.GUARDS, *privacy.SHAPES])]
    shut = [F.rlike("t", F.lit(p)) & ~privacy._possible(F.col("t"), p) for p in patterns]
    seen = df.select(*[F.count_if(F.rlike("t", F.lit(p))).alias(f"n{i}") for i, p in enumerate(patterns)], *[F.count_if(c).alias(f"s{i}") for i, c in enumerate(shut)]).first()
    for i, p in enumerate(patterns):
        assert seen[f"n{i}"] > 0 and seen[f"s{i}"] == 0, p


def test_terms_as_single_patterns_find_them(spark):
    terms = {"a": ["active directory", "active", ".net"], "b": ["directory", "sql server"], "c": ["sql", "ab"], "d": ["abc", "abd", "a.b"]}
    r = random.Random(6)
    parts = ["active", "directory", " ", "a.b", "x", ".net", "sql server", "sql", "ab", "c", "d", ".", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "_text string").select("_text", tagcheck.terms_at_words(terms).alias("n")).collect()
    for row in got:
        want = []
        for tag, ts in terms.items():
            hit = next((t for t in ts if re.search(r"\b" + re.escape(t), row["_text"])), None)
            want += [(tag, hit)] if hit else []
        assert [tuple(n) for n in row["n"]] == want, row["_text"]


def test_all_listed_terms_are_told_apart(spark):
    every = sorted({t for ts in vocab.WORKLOAD_TERMS.values() for t in ts})
    got = spark.createDataFrame([(f"x {t} y",) for t in every], "_text string").select("_text", tagcheck.terms_at_words(vocab.WORKLOAD_TERMS).alias("n")).collect()
    for row in got:
        want = {tag: next((t for t in ts if re.search(r"\b" + re.escape(t), row["_text"])), None) for tag, ts in vocab.WORKLOAD_TERMS.items()}
        assert {n["tag"]: n["term"] for n in row["n"]} == {k: v for k, v in want.items() if v}


def test_corpus_runs(spark, monkeypatch):
    docs = spark.createDataFrame([("one two three four five six seven",), ("red green blue",), ("a b",), (None,), ("red green blue",)], "text string")
    spans = [("long", "two three four five six seven"), ("broken", "two three four five six eight"), ("short", "red green blue"), ("no", "green red blue"),
             ("two", "red green blue | nothing of the kind"), ("tiny", "a b"), ("null", None), ("empty", "")]
    asked = spark.createDataFrame(spans, "k string, span string")
    want = {"long": (1, 1), "broken": (1, 0), "short": (1, 1), "no": (1, 0), "two": (2, 1), "tiny": (1, 0)}
    for most in (200_000, 1):
        monkeypatch.setattr(citation, "MOST_RUNS", most)
        got = {r["k"]: (r["components"], r["matched"]) for r in citation.verify_in_corpus(asked, docs, "k", "span", "text").collect()}
        assert got == want


def test_product_tree_is_one_scan(spark, tmp_path):
    tree = {"Branch": [{"Items": [{"ProductID": "A", "Value": "deep"}, 7, "x"]}], "FullProductName": [{"ProductID": "A", "Value": "late"}, {"product_id": "B", "value": "b"}],
            "x": {"ProductID": "C", "Value": "own", "FullProductName": {"ProductID": "C", "Value": "full"}}, "y": []}
    rows = [("d", json.dumps(tree)), ("e", "{}"), ("f", "[]"), ("g", None), ("h", '{"ProductID": "A", "Value": "other"}')]
    spark.createDataFrame(rows, "doc_id string, t string").select("doc_id", F.parse_json("t").alias("tree")).write.parquet(str(tmp_path / "t"))
    names = parse.product_names(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(tuple(r) for r in names.collect()) == [("d", "A", "late"), ("d", "B", "b"), ("d", "C", "full"), ("h", "A", "other")]
    assert names._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
