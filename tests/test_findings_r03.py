"""Findings of round 3: planted structs, guards of the privacy scan, depth, landed files, narrow releases."""
import glob
import random

from pyspark.sql import functions as F

from advislake.operators import parse, privacy
from advislake.plans import bridge, gate_queries, ingest_queries
from advislake.sources import readers, scratch, sinks

SF = "/root/testdata/sf0.001"


def test_planting_four_leaves_does_not_multiply_the_plan(spark):
    """each of the four leaves once copied the struct before it."""
    plan = gate_queries.framework_vocabulary(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("odd") <= 40


def test_texts_without_any_shape_are_left_out_and_no_finding_is_lost(spark):
    """the guard before the scan keeps every text that the detectors find something in."""
    r = random.Random(9)
    parts = ["10.2.3.4", "fe80::1", "1:2:3:4:5:6:7:8", "a@b.cc", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "00-1A-2B-3C-4D-5E", "001a.2b3c.4d5e",
             "S-1-5-21", "\\\\srv\\share", "C:\\x\\y", "~/x", "/home/a", "Host : db-7", "http://h.zz", "w3.example.io", "SYD-DC-01 MEL-FS-02 PER-SQL-03",
             "Host Name, serial number", "CVE-2026-0000001", "2026-09-10T00:00:00Z", "word", "\n"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randint(1, 4))) for _ in range(400)] + ["plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = df.select("i", F.explode(privacy.scan("t")).alias("f")).select("i", "f.start", "f.category", "f.span")
    got = privacy.scan_text(df, "t", ["i"]).select("i", "start", "category", "span")
    assert got.count() == found.count() > 300 and found.exceptAll(got).isEmpty()
    assert not df.where("t in ('plain', 'CVE-2026-0000001')").where(privacy.suspect("t")).count()


def test_depth_of_shallow_and_very_deep_documents(spark):
    docs = [('{"a": "[[{"}', 1), ("[]", 1), ("3", 0), ('{"a": [{"b": []}], "c": {}}', 4), ("[" * 30 + "]" * 30, 30), ("[[[[[[[[]]]]]]]]", 8), ("[[[[[[[[[]]]]]]]],[]]", 9)]
    for text, deep in docs:
        df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("doc"))
        assert parse.document_depth(df, "doc") == deep, text


def test_landed_text_and_exports_are_compressed(spark):
    """whole records as plain JSON lines filled the disk."""
    rows = spark.range(2000).select(F.concat(F.lit("CVE-2026-"), F.col("id").cast("string")).alias("cve"), F.repeat(F.lit("title "), 50).alias("title"))
    path = scratch.fresh_path(spark, "packed")
    sinks.export_jsonl(rows, path, "gzip")
    assert glob.glob(f"{path}/*.json.gz") and not glob.glob(f"{path}/*.json")
    assert readers.read_advisories(spark, path).select("cve", "title").exceptAll(rows).isEmpty()
    landed = ingest_queries.landed(spark, "packed", rows.select(F.to_json(F.struct("*")).alias("value")))
    assert glob.glob(f"{landed}/*.txt.gz") and spark.read.text(landed).count() == 2000


def test_columns_of_the_release_are_those_of_whole_records(spark, monkeypatch):
    """F6 and others: a query that reads two columns no longer makes and stores all of them."""
    monkeypatch.setattr(scratch, "_STORED", {})
    narrow = bridge.records(spark, SF, "cve", "tags", "product_tags")
    assert not scratch.is_stored(spark, SF, "release") and narrow.columns == ["cve", "tags", "product_tags"]
    whole = bridge.records(spark, SF).select("cve", "tags", "product_tags")
    assert narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()
    assert scratch.is_stored(spark, SF, "release") and bridge.records(spark, SF, "cve", "tags").exceptAll(whole.select("cve", "tags")).isEmpty()


def test_plain_texts_are_made_once(spark):
    """the test of a text copied its eleven patterns into a filter."""
    notes = "array<struct<title:string,type:int,value:string>>"
    df = spark.createDataFrame([("c", [("FAQ", 4, "<p>a</p>"), ("Other", 4, "x"), ("faq", 4, "a"), ("Description", 2, "<p> </p>")])], f"cve string, n {notes}")
    out = parse.source_content(df.select("cve", F.struct(F.col("n").alias("notes")).alias("vendor_guidance")))
    assert [(r["kind"], r["text"], r["pos"]) for r in out.collect()] == [("faq", "a", 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("blockquote") == 1
