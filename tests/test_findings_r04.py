"""Findings of round 4: characters told apart, values made once, columns that are read, bounded memory and disk."""
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from advislake.functions import vocab
from advislake.llm import embedding_dedup, kneser_ney
from advislake.llm import words as W
from advislake.llm.registry import findable
from advislake.operators import citation, joins, privacy, tagcheck
from advislake.plans import ingest_queries, text_queries
from advislake.sources import readers, scratch

SF = "/root/testdata/sf0.001"


def test_signs_digits_and_spaces_are_told_apart():
    """other signs were one unit, and so were digits, `!` and `?`, and all white space."""
    codes = np.array([c for c in range(0x300) if not (chr(c).isupper() and chr(c).lower() in kneser_ney.ACCENTS)], np.uint32)
    units, first = kneser_ney._spelled(codes)
    assert units.min() >= 0 and units.max() < kneser_ney.SYMBOLS
    assert len({tuple(units[a:b]) for a, b in itertools.pairwise(first)}) == len(codes)
    data, at = W.text_bytes(pa.array(["a#1!", "a$2?"]))
    gram, first = kneser_ney._grams(data, at, 0, 2)
    assert first.tolist() == [0, 6, 12] and not set(gram[3:6]) & set(gram[9:])


def test_blocks_of_vectors_meet_in_rounds_and_lose_no_link(spark, monkeypatch):
    """each tile of 2,048 vectors was shuffled once for every tile it met."""
    findable(spark)
    r = np.random.RandomState(4)
    centres = r.standard_normal((40, 16))
    x = np.concatenate([c + 0.12 * r.standard_normal((20, 16)) for c in centres]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    kept, labels = embedding_dedup.written, []
    monkeypatch.setattr(embedding_dedup, "written", lambda df, label: labels.append(label) or kept(df, label))
    whole = embedding_dedup.near_vectors(rows).collect()
    assert labels.count("vector-links") == 1 and labels.count("vector-blocks") == 1
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 8 * 16 * 40)
    monkeypatch.setattr(embedding_dedup, "SHIPS", 2)
    parted = embedding_dedup.near_vectors(rows).collect()
    assert labels.count("vector-links") > 3 and sorted(parted) == sorted(whole)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.max() > 5 and [n for _, n in sorted((w["vec_id"], w["n_links"]) for w in whole)] == want.tolist()


def test_a_table_that_is_written_gives_its_shuffle_back(spark):
    """shuffle files of finished steps stayed beside those of later ones."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with scratch.shuffle_given_back(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_the_line_is_made_once_for_all_runs(spark):
    """the tokens of a text were made anew for each run that was looked for in it."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(words, words[9:60]), (words, "w1 w2 w3 w4 w5 x"), ("", words), (None, None), ("a b", "a b")], "t string, n string")
    seen = rows.select(citation.contains_run(citation.token_line(F.col("t")), citation.tokens(F.col("n")), F.lit(6)).alias("hit"))
    assert [r["hit"] for r in seen.collect()] == [True, False, False, False, False]
    plan = text_queries.contains_run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("a-z0-9]+") == 2  # of the text and of the citation, each bound to a name


def test_checks_make_what_is_read_and_search_once(spark):
    """reasons were read behind a barrier of all findings, and terms were searched twice."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    given = text_queries.checkable(spark, SF)
    reasons = plan(text_queries.reason_histogram(spark, SF))
    assert "active" not in reasons and "regexp_extract_all" not in reasons and "to_json" not in reasons
    spoken = spark.createDataFrame([("dns and kerberos of windows",)], "_text string").select(
        tagcheck.terms_at_words({"dns": ["dns"], "identity": ["ldap", "kerberos"]}).alias("n"))
    assert plan(spoken).count("regexp_extract_all") == 1
    assert [tuple(n) for n in spoken.first()["n"]] == [("dns", "dns"), ("identity", "kerberos")]
    whole, narrow = tagcheck.with_checks(given), tagcheck.with_checks(given, made=("states",))
    assert narrow.columns == [*given.columns, "states"]
    assert whole.select("cve", "states").exceptAll(narrow.select("cve", "states")).isEmpty()


def test_source_text_is_told_blank_without_making_it(spark):
    part = "struct<notes:array<struct<title:string,type:int,value:string>>,remediations:array<struct<url:string>>>"
    rows = spark.createDataFrame([
        ("t", None, None), (" ", [("p",)], None), (None, [(" ",), (None,)], None), ("", [], (None, None)), (None, None, ([], None)),
        (None, None, (None, [(None,)])), (" ", None, None), ("\t", None, None)], f"title string, products array<struct<name:string>>, vendor_guidance {part}")
    got = rows.select(tagcheck.no_source_text().alias("a"), (F.trim(tagcheck.source_text()) == "").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [False, False, True, True, False, False, True, False]


def test_tokens_and_verdicts_are_as_before(spark):
    """tags and entities go in one pass, parts are tokenised once."""
    texts = ['A <b>bold</b> &amp; &quot;x&quot; it&#8217;s', "&AMP; &am<i>p; a<b", "<<a>b>c&amp;quot;", "K\u212alm \u0130b é", "", None, "a\n<p\n>b", " \t x "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = []
    for t in texts:
        t = re.sub("<[^>]+>", " ", t or "").replace("&quot;", " ").replace("&amp;", " ").replace("&#8217;", "'")
        want.append(re.findall("[a-z0-9]+", t.lower()))
    got = rows.select(citation.tokens(F.col("t")).alias("w"), citation.token_line(F.col("t")).alias("l")).collect()
    assert [r["w"] for r in got] == want and [r["l"] for r in got] == [f" {' '.join(w)} " for w in want]
    spans = [('"Title: one two three" ; "four five six"', ["one two three", "four five six"]), (" a | b c ", ["a | b c"]), ("  ", []), (None, [])]
    parts = spark.createDataFrame([(s,) for s, _ in spans], "s string").select(citation.components(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in parts] == [p for _, p in spans]


def test_stamping_writes_months_and_not_records(spark, monkeypatch):
    """whole refreshed records were joined, written and read back for the months in which a score changed."""
    paths, kept = [], joins.fresh_path
    monkeypatch.setattr(joins, "fresh_path", lambda s, label: paths.append(kept(s, label)) or paths[-1])
    rows = spark.createDataFrame([("a", "m1", True), ("a", "m1", False), ("b", "m2", False), ("c", None, True), (None, "m3", True)],
                                 "cve string, month string, score_changed boolean")
    out = joins.stamp_provenance(rows, "u", "0", "2026-09-11")
    assert len(paths) == 1 and spark.read.parquet(paths[0]).columns == ["_month"]
    got = {(r["cve"], r["month"], r["score_changed"]): r["epss_source"] is not None for r in out.collect()}
    assert got == {("a", "m1", True): True, ("a", "m1", False): True, ("b", "m2", False): False, ("c", None, True): False, (None, "m3", True): True}
    monkeypatch.setattr(scratch, "_STORED", {})
    ingest_queries.refresh_provenance(spark, SF)
    assert not scratch.is_stored(spark, SF, "release")


def test_digests_of_releases_are_not_broadcast(spark):
    """the digests of all records were gathered in the driver for a broadcast."""
    out = ingest_queries.export_jsonl(spark, SF)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("whole").count() == out.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_the_guard_of_the_scan_keeps_short_lists_and_special_signs(spark):
    """every leaf went through all guards; now a text needs a sign that patterns share, or room for two terms."""
    terms = vocab.INVENTORY_TERMS
    tight = min((a + b[k:] for a in terms for b in terms if a != b for k in range(len(b)) if a.endswith(b[:k])), key=len)
    assert len(tight) == privacy.LEAST_LISTED
    texts = [tight, tight.upper(), tight[1:], "hostname", "evidence for waf", "a.b", "1.2.3.4", "x@y.zz", "C:\\x", "\\\\s\\t", "~/x", "SYD-DC-01 MEL-FS-02 PER-SQL-03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", privacy.suspect("t").alias("s"), (F.size(privacy.scan("t")) > 0).alias("f"))
    got = {r["t"]: (r["s"], r["f"]) for r in df.collect()}
    assert got[tight] == got[tight.upper()] == (True, True) and all(s or not f for s, f in got.values())
    assert not got["hostname"][0] and not got["evidence for waf"][0] and got["1.2.3.4"][0]


def test_ids_of_products_are_read_without_typing_all_columns(spark, monkeypatch):
    """notes, threats, scores and remediations were typed three times, twice of them for ids alone."""
    asked, landed, rows, land = [], [], readers.vulnerability_rows, ingest_queries.landed
    monkeypatch.setattr(readers, "vulnerability_rows", lambda docs, *fields: asked.append(fields) or rows(docs, *fields))
    monkeypatch.setattr(ingest_queries, "landed", lambda *at: landed.append(at[1]) or land(*at))
    out = ingest_queries.assemble(spark, SF)
    assert sorted(asked) == [(), ("cve", "product_ids")] and landed == ["documents"]
    assert out.where("own_names = n_products").count() == out.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
