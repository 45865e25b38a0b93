"""Findings of round 3 at 6 GB: work that was made again, in one task, or sorted and spilled."""
import glob

from pyspark.sql import functions as F

from advislake.functions.scalar import as_list
from advislake.operators import parse, reconcile
from advislake.plans import ingest_queries, reconcile_queries
from advislake.sources import readers, scratch, sinks

SF = "/root/testdata/sf0.001"


def test_a_reading_is_fingerprinted_once(spark, monkeypatch):
    """F8: each step of a pass made the fingerprints of whole records anew, twelve times in two passes."""
    made, kept = [], reconcile.fingerprint
    monkeypatch.setattr(reconcile, "fingerprint", lambda df: made.append(1) or kept(df))
    rows = lambda *r: spark.createDataFrame(list(r), "cve string, title string")
    first, then = rows(("a", "x"), ("b", "x"), ("d", "x")), rows(("a", "x"), ("b", "y"), ("c", "x"))
    readings, passes = iter([first, then, then]), iter(["1", "2"])
    none = spark.createDataFrame([], "cve string, fingerprint string, made string")
    records, done = reconcile.settle_release(
        lambda: next(readings), lambda df: df.select("cve", F.lit(next(passes)).alias("made")), none)
    assert len(made) == 3 and records.columns == ["cve", "title"]
    assert sorted(map(tuple, records.collect())) == [("a", "x"), ("b", "y"), ("c", "x")]
    assert sorted((r["cve"], r["made"]) for r in done.collect()) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_fingerprints_do_not_make_judgement(spark, monkeypatch):
    """F8: columns that a fingerprint leaves out were made, stored and written with every reading."""
    monkeypatch.setattr(scratch, "_STORED", {})
    after = reconcile_queries.next_release(spark, SF)
    assert not scratch.is_stored(spark, SF, "release") and not set(reconcile.VOLATILE) & set(after.columns)


def test_parts_are_dealt_out(spark):
    """all trees were made and walked in the one task that reads a small file of millions of parts."""
    plan = ingest_queries.product_tree(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_typed_columns_are_made_for_those_that_read_them(spark):
    """notes, threats, score sets and remediations were typed for queries that read an id."""
    path = scratch.fresh_path(spark, "docs")
    spark.createDataFrame([('{"Vulnerability": {"CVE": "c", "Title": "t", "Notes": null, "Threats": [], "Flags": 3}, "Vulnerabilities": []}',)],
                          "value string").write.text(path)
    docs = readers.read_vendor_documents(spark, path)
    narrow, whole = readers.vulnerability_rows(docs, "cve"), readers.vulnerability_rows(docs)
    assert "TemporalScore" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert narrow.columns == ["doc_id", "revision", "raw", "cve"]
    assert [r["cve"] for r in narrow.collect()] == ["c"] == [r["cve"] for r in whole.collect()]
    facts = narrow.select(parse.evidence_facts(F.col("raw"), "vendor").alias("f"))
    assert facts.first()["f"] == {"CVE": '"c"', "Title": '"t"', "Notes": "null", "Threats": "[]", "Flags": "3"}


def test_lists_opened_in_place(spark):
    values = ['{"a": [1, {"b": 2}, null]}', '{"a": {"b": 1}}', '{"a": "x"}', '{"a": null}', '{"a": []}', '{}', '[3]', None]
    df = spark.createDataFrame([(v,) for v in values], "t string").select(F.parse_json("t").alias("v"))
    show = lambda c: F.to_json(c)
    got = df.select(show(as_list(F.col("v"), "$.a")).alias("x"), show(as_list(F.try_variant_get("v", "$.a", "variant"))).alias("y")).collect()
    want = ['[1,{"b":2},null]', '[{"b":1}]', '["x"]', "[]", "[]", "[]", "[]", "[]"]
    assert [r["x"] for r in got] == want == [r["y"] for r in got]


def test_months_are_written_without_a_sort(spark, monkeypatch):
    """whole records were sorted by month before the write, as rows, and spilled."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    rows = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("m"), (F.col("id") % 7).cast("string")).alias("month"), "id")
    for most in (sinks.OPEN_MONTHS, 3):  # with three files open, the months beyond are sorted
        monkeypatch.setattr(sinks, "OPEN_MONTHS", most)
        path = scratch.fresh_path(spark, "months")
        sinks.write_months(rows, path)
        assert len(glob.glob(f"{path}/month=*/*.zstd.parquet")) >= 7
        back = spark.read.parquet(path).select("month", "id")
        assert back.exceptAll(rows).isEmpty() and back.count() == 3000
        assert spark.conf.get(name, None) == before
