"""Literal fixtures: every gate has a row it passes and a row it refuses."""
import html
import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from advislake.functions import scalar, vocab
from advislake.operators import (board, citation, gates, joins, ordering, parse, privacy, reconcile, review,
                                 risk, sampling, search, severity)
from advislake.plans import bridge as B
from advislake.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def one(df):
    return df.collect()[0][0]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


# --- scalars -------------------------------------------------------------------------
def js_fixed(x, digits):
    from decimal import ROUND_HALF_UP, Decimal
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def test_epss_text(spark):
    cases = {None: "Not yet scored", 0.0: "0.00%", 0.00005: "<0.01%", 0.0001: "0.01%", 0.00999: "0.999%",
             0.009996: "<1%", 0.0996: "9.96%", 0.09999: "9.999%", 0.1: "10.0%", 0.0225: "2.3%", 0.91: "91.0%"}
    rows = column(spark, list(cases), "double").select("v", scalar.format_epss(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases


def test_fixed_decimals_match_exact_rounding(spark):
    values = [0.125, 2.5, 2.25, 1.005, 0.615, 8.345, 12.75, 99.95, 0.045, 3.0]
    rows = column(spark, values, "double").select("v", *[scalar.to_fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2)]).collect()
    for r in rows:
        assert (r.d1, r.d2) == (js_fixed(r.v, 1), js_fixed(r.v, 2))


def test_priority_text(spark):
    cases = {"Immediate action": "Emergency action", "scheduled patching; normal scheduled work": "Normal scheduled patching; normal scheduled work",
             "out of cycle and out-of-cycle.": "Expedited and Expedited.", "it is scheduled.": "it is Normal scheduled.",
             "a scheduled task": "a scheduled task", "Defer and Review": "No customer action"}
    rows = column(spark, list(cases)).select("v", scalar.format_priority_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases


def test_plain_text_on_pages(spark):
    pages = {"<p>One</p><p>Two &amp; three</p>": "One\n\nTwo & three",
             "<ul><li>a</li><li class='x'>b</li></ul>": "• a\n\n• b",
             "a<!-- hidden <b>x</b> -->b<script>var t='</p>';</script>c<STYLE>p{}</STYLE >d": "abcd",
             "line<br/>break &lt;kept&gt; &#65;&#x42; &copy; &#xD800;": "line\n\nbreak <kept> AB &copy; &#xD800;",
             "<h2>Head</h2>\n\n\n\ntail  \n": "Head\n\ntail", "": "", "\u00a0 x \u3000": "x"}
    got = column(spark, list(pages)).select("v", scalar.source_plain_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == pages


def test_entities_of_the_whole_standard(spark):
    texts = ["&copy; &Copy; &AMP;&amp;amp; &frac12; &sup2; &Eacute;&eacute; &nope; &NotEqualTilde; &nbsp;|"]
    got = column(spark, texts).select(scalar.strip_markup(F.col("v"))).first()[0]
    assert got == html.unescape(texts[0])


# --- severity ------------------------------------------------------------------------
def test_resolve_severity(spark):
    cases = [(None, None, "Unknown", "absent"), ("Low", 9.8, "Critical", "vendor"), (None, 0.0, "Low", "cvss"),
             (None, 7.0, "Important", "cvss"), ("Moderate", None, "Moderate", "vendor"), ("n/a", None, "Unknown", "absent")]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in cases], "t string, s double")
    got = df.select(severity.resolve_severity(F.col("t"), F.col("s")).alias("r")).select("r.*").collect()
    assert [(r.severity, r.basis) for r in got] == [(c, d) for _, _, c, d in cases]


def test_score_gap_is_unknown(spark):
    df = column(spark, [8.95, 8.9, 9.0, 0.0, None], "double")
    assert [r[0] for r in df.select(severity.band_from_score(F.col("v"))).collect()] == [
        "unknown", "high", "critical", "unknown", "unknown"]


def test_undefined_band_fails(spark):
    rows = spark.createDataFrame([("A", "adobe", "Low"), ("B", "adobe", "Critical")], "cve string, scale string, band string")
    assert [r.cve for r in severity.unmapped_bands(rows, "scale", "band").collect()] == ["A"]
    bad = B.sourced(spark, SF).limit(5).withColumn("cve_program", F.col("cve_program").withField("assigner", F.lit("Adobe")).withField(
        "vendor_severity", F.struct(F.lit("Low").alias("band"), F.lit("adobe").alias("scale"), F.lit("x").alias("basis"),
                                    F.lit("").alias("cvss_version"), F.lit(1.0).alias("base_score"), F.lit("").alias("vector"))))
    with pytest.raises(PySparkException):
        severity.with_severity(bad).collect()


# --- titles and tags --------------------------------------------------------------------
def test_title_components(spark):
    cases = {"Windows DNS Server Remote Code Execution Vulnerability": (["dns"], "Windows DNS Server"),
             "Windows Internet Key Exchange (IKE) Extension Spoofing Vulnerability": ([], "Windows Internet Key Exchange (IKE) Extension"),
             "Microsoft Exchange Server Spoofing Vulnerability": (["exchange"], "Microsoft Exchange Server"),
             "Remote Code Execution Vulnerability": (None, None), "DNS trouble": (None, None),
             "Active Directory Federation via IIS Tampering Vulnerabilities": (["identity", "web-server"], "Active Directory Federation via IIS")}
    rows = column(spark, list(cases)).select("v", parse.workload_tags(F.col("v")).alias("w"), parse.title_component(F.col("v")).alias("c")).collect()
    for r in rows:
        assert r.c == cases[r.v][1]
        assert (r.w or []) == (cases[r.v][0] or [])


def test_editor_is_not_the_ide(spark):
    df = spark.createDataFrame([(["Visual Studio Code"],), (["Visual Studio Code", "Microsoft Visual Studio 2022"],)], "n array<string>")
    tags = [r[0] for r in df.select(parse.product_tags(F.col("n"), F.lit(""))).collect()]
    assert "visual-studio" not in tags[0] and "visual-studio" in tags[1]


# --- privacy -----------------------------------------------------------------------------
REFUSED = {
    "ipv4_address": ["host 10.1.2.3 is up", "see 8.8.8.8 now", "10.0.0.1"],
    "ipv6_address": ["at fe80::1 now", "2001:db8:0:0:0:0:0:1"],
    "email_address": ["write jane@contoso.com", "jane@microsoft.com"],
    "guid": ["id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 ok"],
    "tenant_identifier": ["tenant id: 3f2504e0-4f89-11d3-9a0c-0305e82c3301"],
    "hostname": ["go to https://evil.io/x", "on srv1.corp.local today", "Hostname: SYD-DC-01"],
    "unc_path": ["from \\\\fs01\\share$\\x"],
    "filesystem_path": ["in C:\\Users\\jane\\x", "at /home/jane/x", "~/notes"],
    "security_identifier": ["S-1-5-21-1-2-3-500"],
    "mac_address": ["nic 00:1a:2b:3c:4d:5e", "0011.2233.4455"],
    "asset_inventory": ["hostname, ip address, owner", "SYD-DC-01 MEL-FS-02 PER-SQL-03"],
}
PASSED = ["kernel 6.6.150.1-1 fixed", "zlib 1.3.1.2 through 1.3.2", "version 26.2.5.21", "999.1.1.1", "secure@microsoft.com",
          "https://learn.microsoft.com/?id=3f2504e0-4f89-11d3-9a0c-0305e82c3301", "uses ASP.NET and Spaceport.sys", "C:\\Windows\\System32\\x",
          "Customer Action Required: Yes", "Server: 2019", "CVE-2026-1 CWE-79 KB-5001 RFC-2606", "HKLM\\Software\\X", "CD-ROM", "time 12:30:45", ""]


@pytest.mark.parametrize("category", list(REFUSED))
def test_private_text_is_found(spark, category):
    df = spark.createDataFrame(list(enumerate(REFUSED[category])), "i int, v string")
    rows = privacy.scan_text(df, "v", ["i", "v"]).collect()
    assert {r.i for r in rows if r.category == category} == set(range(len(REFUSED[category])))
    for r in rows:
        if r.category != "asset_inventory":
            assert r.v[r.start:r.end] == r.span


def test_public_text_passes(spark):
    rows = privacy.scan_text(spark.createDataFrame(list(enumerate(PASSED)), "i int, v string"), "v", ["v"]).collect()
    assert [(r.v, r.category, r.span) for r in rows] == []


def test_gate_refuses_whole_row(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "jane@contoso.com")], "i int, v string")
    assert [r.i for r in privacy.clean_rows(df, "v").collect()] == [1]
    assert [r.i for r in privacy.clean_rows(df, "v", ["contoso.com"]).collect()] == [1]
    with pytest.raises(PySparkException):
        privacy.refuse(df, "v", "i").collect()


def test_simple_detectors_against_brute_force(spark):
    docs = B.priv_text(spark, SF)
    patterns = {"security_identifier": r"(?<![\w-])S-1-\d{1,10}(?:-\d{1,10}){1,15}(?![\w-])",
                "mac_address": r"(?<![\w:.-])(?:(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4})(?![\w:.-])",
                "unc_path": r"\\\\(?:\?\\UNC\\)?[A-Za-z0-9._$-]{1,63}\\[^\s\"'<>|]{1,120}"}
    got = {(r.doc_id, r.category, r.start, r.end) for r in privacy.scan_text(docs, "text", ["doc_id"]).collect() if r.category in patterns}
    want = {(d.doc_id, c, m.start(), m.end()) for d in docs.collect() for c, p in patterns.items() for m in re.finditer(p, d.text)}
    assert got == want


# --- citations ---------------------------------------------------------------------------
def test_citations(spark):
    view = 'An attacker who convinces a user to open the file could run code. "vector": "local"'
    cases = [("an attacker who convinces a user to open", True, True), ("invented words that never appear here", False, False),
             ("user open file attacker code run", False, False), ('"vector": "local"', True, True), ("", False, False),
             ('Title: convinces a user to open the file ... something else entirely new', True, False)]
    df = spark.createDataFrame([(i, s, view) for i, (s, _, _) in enumerate(cases)], "i int, span string, view string")
    rows = citation.verify_pairs(df, "span", "view").orderBy("i").collect()
    assert [(r.citation.verified, r.citation.fully_verified) for r in rows] == [(a, b) for _, a, b in cases]


# --- ordering and board --------------------------------------------------------------------
@pytest.mark.parametrize("emergencies,shown", [(0, 8), (5, 8), (8, 8), (9, 9), (37, 37)])
def test_worst_first_boundaries(spark, emergencies, shown):
    rows = [(f"E{i:02d}", 3, 3, 9.0) for i in range(emergencies)] + [(f"O{i:02d}", 2, 2, None) for i in range(20)]
    df = spark.createDataFrame(rows, "cve string, resid_action int, resid_likelihood int, score double").withColumn(
        "cvss", F.struct(F.col("score").alias("base_score")))
    out = ordering.worst_first(df).collect()
    assert len(out) == shown and sum(r.cve[0] == "E" for r in out) == emergencies


def test_natural_order(spark):
    ids = ["CVE-2026-10000", "CVE-2026-9999", "CVE-2025-2", "cve-2026-10"]
    got = [r.v for r in column(spark, ids).orderBy(ordering.natural_key(F.col("v"))).collect()]
    assert got == ["CVE-2025-2", "cve-2026-10", "CVE-2026-9999", "CVE-2026-10000"]


def test_unverified_tile(spark):
    df = spark.createDataFrame([("g", 1, "unknown", True), ("h", 1, "low", False), ("i", 3, "unknown", False)],
                               "key string, resid_action int, band string, req boolean").select(
        "key", "resid_action", F.struct(F.col("band").alias("normalized_band")).alias("severity"),
        F.struct(F.col("req").alias("required")).alias("review"))
    assert {r.key: r.state for r in board.tile_summary(df, "key").collect()} == {
        "g": "unverified", "h": "scheduled", "i": "emergency"}


# --- search --------------------------------------------------------------------------------
def test_tokens():
    assert search.query_tokens('a "b c" -"d e" tag:"f g"') == ["a", "b c", '-"d', 'e"', 'tag:"f', 'g"']


def test_numbers(spark):
    df = column(spark, [0.05, None, 9.0], "double")
    run = lambda e: [r[0] for r in df.select(search.compare_number(F.col("v"), e)).collect()]
    assert run(">=5%") == [True, False, True] and run("=9") == [False, False, True] and run("1.2.3") == [False] * 3


# --- gates ---------------------------------------------------------------------------------
def test_candidate_gate(spark):
    cand = "struct<id:string,relevance:string,confidence:string,evidence:string,effect:struct<likelihood_steps:int,consequence_steps:int,path_block:boolean>>"
    good = ("segmentation_acl", "relevant", "high", "because", (1, 0, False))
    bad = {"unknown-control": ("magic", "relevant", "high", "b", (1, 0, False)), "relevance": ("segmentation_acl", "maybe", "high", "b", (0, 0, False)),
           "confidence": ("segmentation_acl", "relevant", "sure", "b", (0, 0, False)), "steps": ("segmentation_acl", "relevant", "high", "b", (0, 3, False)),
           "credit-without-relevance": ("segmentation_acl", "unknown", "high", "b", (1, 0, False)),
           "path-block": ("segmentation_acl", "relevant", "high", "b", (1, 0, True)), "two-steps": ("vendor_workaround", "relevant", "high", "b", (2, 0, False)),
           "evidence": ("segmentation_acl", "relevant", "high", " ", (1, 0, False))}
    df = spark.createDataFrame([(good,)] + [(c,) for c in bad.values()], f"c {cand}")
    got = [r[0] for r in df.select(gates.candidate_errors(F.col("c"))).collect()]
    assert got[0] == [] and all(code in found for code, found in zip(bad, got[1:]))


def test_enforce_raises(spark):
    df = spark.createDataFrame([("A", [])], "cve string, v array<string>")
    assert gates.enforce(df, "v").count() == 1
    with pytest.raises(PySparkException):
        gates.enforce(spark.createDataFrame([("A", ["x"])], "cve string, v array<string>"), "v").collect()


def test_direction_gate_can_require_a_direction(spark):
    df = B.records(spark, SF).where("inference.attack_path is null").limit(1)
    with pytest.raises(PySparkException):
        gates.with_direction_gate(df, allow_missing=False).select("direction_gate").collect()


def test_publication_gates(spark):
    good = B.records(spark, SF).where("k % 8 <> 0")
    assert sinks.publication_gates(good).count() == 0
    assert {r.gate for r in sinks.publication_gates(good.unionByName(good.limit(1))).collect()} == {"duplicate-cve"}
    assert sinks.empty_release(good.where("false")).count() == 1 and sinks.empty_release(good).count() == 0


# --- sources -------------------------------------------------------------------------------
def test_broken_jsonl_fails(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"cve": "CVE-2026-1", "severity": "Critical"}\n{"cve": \n')
    with pytest.raises(PySparkException):
        readers.read_advisories(spark, str(path)).select("cve").collect()
    path.write_text('{"cve": "CVE-2026-1", "severity": "Critical"}\n{"cve": "CVE-2026-2", "severity": {"normalized_band": "high"}}\n')
    rows = readers.read_advisories(spark, str(path)).select(severity.severity_band()).collect()
    assert sorted(r[0] for r in rows) == ["high", "unknown"]


def test_vendor_document_with_bom(spark, tmp_path):
    doc = {"ProductTree": {"FullProductName": [{"ProductID": "1", "Value": "Windows 11"}]},
           "Vulnerability": {"CVE": "CVE-2026-1", "Title": {"Value": "T"}, "Notes": {"Title": "Description", "Type": 2, "Value": "x"},
                             "ProductStatuses": [{"ProductID": "1", "Type": 3}]}}
    (tmp_path / "d.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(doc, indent=1).encode())
    docs = readers.read_vendor_documents(spark, str(tmp_path / "d.json"), multi_line=True)
    row = readers.vulnerability_rows(docs).collect()[0]
    assert (row.cve, row.title, row.product_ids, len(row.notes)) == ("CVE-2026-1", "T", ["1"], 1)
    assert [(r.product_id, r.name) for r in parse.product_names(docs).collect()] == [("1", "Windows 11")]


def test_dimension_files(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        return str(tmp_path / name)
    scales = put("s.json", {"version": "1.0", "scales": {"x": {"bands": {"Bad": {"maps_to": "high"}}}}})
    assert [tuple(r) for r in readers.read_scales(spark, scales).collect()] == [("x", "Bad", "high")]
    with pytest.raises(PySparkException):
        readers.read_scales(spark, put("t.json", {"scales": {"x": {"bands": {"Bad": {"maps_to": "awful"}}}}})).collect()
    assert readers.read_taxonomy(spark, put("n.json", {"namespaces": {"a": ["b", "c"]}, "definitions": {"_n": "", "b": "d"}})).count() == 2
    assert readers.read_definitions(spark, str(tmp_path / "n.json")).count() == 1
    controls = readers.read_controls(spark, put("c.json", [{"id": "i", "name": "n", "category": "c"}])).collect()
    assert controls[0].directions == vocab.DIRECTIONS
    assert readers.read_filters(spark, put("f.json", {"groups": [{"id": "g", "source": "tags", "options": [
        {"tag": "t", "label": "T", "overview": False}]}]})).collect()[0].overview is False
    assert readers.read_manifest(spark, put("m.json", [{"month": "2026-Sep", "file": "f", "record_count": 5}])).collect()[0].record_count == 5


def test_split_tops_up_from_routine(spark):
    rows = [(f"C{i:03d}", "routine" if i > 10 else "signal-conflict") for i in range(200)] + [("R", "reference-failure")]
    out = sampling.dev_holdout_split(spark.createDataFrame(rows, "cve string, stratum string"), 1, 20).collect()
    sizes = {s: sum(r.split == s and r.stratum != "reference-failure" for r in out) for s in ("dev", "holdout")}
    assert sizes == {"dev": 20, "holdout": 20} and len({r.cve for r in out}) == len(out)


def test_first_duplicate_control_wins(spark):
    df = B.records(spark, SF).where("k % 31 = 0 and k > 0")
    out = risk.with_profile(df, vocab.CONTROL_IDS).select("cve", F.transform("applied", lambda c: c["id"]).alias("ids")).collect()
    assert all(len(set(r.ids)) == len(r.ids) for r in out)


def test_content_digest_ignores_order(spark):
    df = B.table(spark, SF, "nation")
    assert reconcile.content_digest(df).collect() == reconcile.content_digest(df.orderBy(F.desc("n_name"))).collect()
    assert reconcile.content_digest(df).collect() != reconcile.content_digest(df.where("n_nationkey > 0")).collect()
