"""Whole records through reading, merging, correcting and writing; literal fixtures."""
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window, functions as F

from advislake.operators import gates, joins, merge, parse, review
from advislake.plans import bridge as B
from advislake.sources import readers, sinks

SF = "/root/testdata/sf0.001"
RECORD = {
    "schema_version": "2.0", "month": "2026-Sep", "cve": "CVE-2026-1", "title": "A title", "severity_basis": "vendor",
    "severity": {"primary": "msrc", "normalized_band": "high", "normalized_basis": "publisher", "assessments": [
        {"source": "msrc", "role": "publisher", "scale": "msrc", "value": "Important", "basis": "vendor"}]},
    "customer_action_required": True, "cvss": {"base_score": 8.5, "vector": "CVSS:3.1/AV:N", "version": "3.1"},
    "products": [{"product_id": "P1", "name": "One"}], "tags": ["dns"], "product_tags": ["windows"],
    "attack": {"vector": "network", "privileges_required": "none", "user_interaction": "none"},
    "threat": {"kev": False, "epss": 0.25, "epss_status": "scored"}, "source": {"type": "T", "revision": "r", "url": "u"},
    "mitigation_candidates": [{"id": "waf_virtual_patch", "relevance": "relevant", "confidence": "high", "evidence": "e",
                               "effect": {"likelihood_steps": 1, "consequence_steps": 0, "path_block": False}}],
    "vendor_guidance": {"notes": [{"title": "FAQ", "type": 4, "value": "v"}], "remediations": [{"type": "2", "product_ids": ["P1"]}]},
    "dataset_provenance": {"sources": {"epss": {"n": 1, "ok": True}}}, "review": {"required": True, "reasons": ["r", 2]},
    "priority": "Immediate", "assessment": {"profile": {"a": [1, {"b": None}]}}, "tier1_review": {"status": "flagged"},
    "cve_program": {"status": "found", "assigner": "a", "url": "u", "sha256": "0f", "date_updated": "2026-01-02", "ssvc_provider": "CISA-ADP",
                    "ssvc": {"exploitation": "poc", "automatable": "no", "technical_impact": "total"},
                    "cna": {"title": "t", "affected": [{"v": 1.5}]}},
    "inference": {"model": "m", "review_status": "reviewed", "taxonomy_version": "1.0", "generated_at": "g", "assessment_status": "model-assessed",
                  "guidance_version": "monthly-1", "attack_path": {"direction": "inbound", "evidence": "e"},
                  "direction_gate": {"status": "violations-found", "reason": "x", "violations": [
                      {"code": "direction-contradiction", "control": "c", "direction": "local", "applies_to_direction": ["inbound"],
                       "claimed": {"likelihood_steps": 1, "path_block": False}, "evidence": "e", "message": "m"}]},
                  "framework_assessment": {"baseline_model": "m", "baseline_action": "Immediate", "factors": {"uncertainty": "None"},
                                           "risk_communication": {"summary": "s"}},
                  "verification": {"reviewer": "q", "n": 3}, "pipeline_validation": {"type": "t"}, "invocation": {"schema_enforced": True}}}


def landed(tmp_path, *lines):
    path = tmp_path / "release.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def pruned(value):
    if isinstance(value, dict):
        return {k: pruned(v) for k, v in value.items() if v is not None}
    return [pruned(v) for v in value] if isinstance(value, list) else value


def test_a_record_with_every_field_comes_back_whole(spark, tmp_path):
    read = readers.read_advisories(spark, landed(tmp_path, RECORD))
    sinks.export_jsonl(read, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).first()[0]
    assert pruned(json.loads(text)) == pruned(RECORD)


def test_a_broken_line_stops_every_projection(spark, tmp_path):
    read = readers.read_advisories(spark, landed(tmp_path, RECORD, '{"cve": "CVE-2026-2", "title": '))
    for ask in (lambda d: d.count(), lambda d: d.select("title").collect(), lambda d: d.select("cve").collect()):
        with pytest.raises(PySparkException, match="invalid JSON line"):
            ask(read)


def test_a_container_without_metrics_does_not_hide_another(spark):
    doc = {"containers": {"adp": [{"providerMetadata": {"shortName": "X"}}, {"providerMetadata": {"shortName": "CISA-ADP"}, "metrics": [
        {"other": {"type": "ssvc", "content": {"timestamp": "t", "options": [{"Exploitation": "active"}]}}}]}]}}
    rows = spark.createDataFrame([(json.dumps(doc),)], "text string").select(F.from_json("text", parse.PROGRAM_SCHEMA).alias("doc"))
    got = rows.select(*[v.alias(k) for k, v in parse.ssvc_facts(F.col("doc.containers.adp")).items()]).first()
    assert got.ssvc.exploitation == "active" and got.ssvc_provider == "CISA-ADP"


def test_a_fix_without_products_does_not_hide_another(spark, tmp_path):
    record = RECORD | {"vendor_guidance": {"remediations": [{"type": "2"}, {"type": "2", "product_ids": ["P1"]}]}}
    got = readers.read_advisories(spark, landed(tmp_path, record)).select(review.update_counts().alias("c")).first()
    assert (got.c.total, got.c.available) == (1, 1)


def test_long_digit_runs_compare_as_numbers(spark):
    from advislake.operators.ordering import natural_key
    names = ["CVE-" + "1" * 40, "CVE-" + "9" * 39, "CVE-007", "CVE-7", "cve-10"]
    rows = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r.v for r in rows.orderBy(natural_key(F.col("v")), "v").collect()]
    assert got[:2] == ["CVE-007", "CVE-7"] and got[2:] == ["cve-10", "CVE-" + "9" * 39, "CVE-" + "1" * 40]


def test_keys_are_found_whatever_they_hold(spark):
    docs = spark.createDataFrame([(1, json.dumps({"a": {"7": [[], {"b": {"c": 1}}]}, "d": None, "e": "x"}))], "i int, t string")
    rows = docs.select("i", F.parse_json("t").alias("doc"))
    got = {(r.pointer, r.text) for r in parse.string_leaves(rows, with_keys=True, dotted=True).collect()}
    assert got == {("a<key>", "a"), ("a.7<key>", "7"), ("a.7[1].b<key>", "b"), ("a.7[1].b.c<key>", "c"), ("d<key>", "d"), ("e<key>", "e"), ("e", "x")}
    assert {(r.pointer, r.text) for r in parse.string_leaves(rows).collect()} == {("/e", "x")}


def test_a_refused_merge_stops_and_merged_rows_stay(spark, tmp_path):
    base = readers.read_advisories(spark, landed(tmp_path, RECORD, RECORD | {"cve": "CVE-2026-2"}))
    overlay = base.where("cve = 'CVE-2026-1'").select("cve", "tags", "mitigation_candidates", "inference", F.struct(
        F.col("cvss.base_score"), F.col("cvss.vector"), F.col("attack.vector").alias("attack_vector"),
        F.col("attack.privileges_required"), F.col("attack.user_interaction")).alias("cvss_basis"))
    found = merge.merge_violations(base, overlay.unionByName(overlay.withColumn("cve", F.lit("CVE-2026-9"))), complete=True)
    said = {(r.cve, r.gate, r.violation) for r in found.where("gate in ('overlay-id', 'completeness')").collect()}
    assert said == {("CVE-2026-9", "overlay-id", "absent-from-baseline"), ("CVE-2026-2", "completeness", "not-reviewed")}
    out = merge.merge_release(base, overlay, include_unreviewed=True)
    rows = {r.cve: r.inference for r in out.collect()}
    assert rows["CVE-2026-1"].framework_assessment.risk_communication.summary == "s" and rows["CVE-2026-1"].guidance_version == "monthly-1"
    assert rows["CVE-2026-2"].direction_gate.status == "not-applicable" and rows["CVE-2026-2"].framework_assessment is None
    with pytest.raises(PySparkException, match="merge refused"):
        merge.enforced(out, found).collect()
    assert merge.enforced(out, found.limit(0)).count() == 2


def test_corrections_reach_any_leaf_and_refuse_unknown_ones(spark, tmp_path):
    base = readers.read_advisories(spark, landed(tmp_path, RECORD))
    fixes = spark.sql("""SELECT 'CVE-2026-1' AS cve, 'why' AS reason, named_struct('confidence', 'low', 'factors', map('new', 'x'),
      'risk_communication', named_struct('summary', CAST(NULL AS STRING), 'why_this_action', 'w')) AS fields,
      map('waf_virtual_patch', named_struct('effect', named_struct('likelihood_steps', 0))) AS controls""")
    got = joins.apply_corrections(base, fixes, "d", "qa").first()
    saved = got.inference.framework_assessment
    assert saved.factors == {"uncertainty": "None", "new": "x"} and saved.confidence == "low" and saved.policy_adjustments == ["Source review: why"]
    assert saved.risk_communication.summary == "s" and saved.risk_communication.why_this_action == "w"
    assert got.mitigation_candidates[0].effect.likelihood_steps == 0 and got.mitigation_candidates[0].evidence == "e"
    with pytest.raises(ValueError, match="does not have"):
        joins.apply_corrections(base, fixes.withColumn("fields", F.struct(F.lit(1).alias("nonsense"))), "d", "qa")


def test_violations_tell_what_was_claimed(spark):
    rows = B.records(spark, SF).where("inference.attack_path.direction = 'local'")
    got = gates.with_direction_gate(rows).select(F.explode("direction_gate.violations").alias("v")).select("v.*").limit(5).collect()
    assert got and all(r.code == "direction-contradiction" and r.message.endswith("Credit removed; assessment retained.") and
                       "local" not in r.applies_to_direction for r in got)


def release(spark, month, titles):

    rows = B.records(spark, SF).where("inference.framework_assessment is not null").limit(len(titles))
    named = F.get(F.array(*[F.lit(t) for t in titles]), F.row_number().over(Window.orderBy("cve")) - 1)
    return rows.withColumns({"month": F.lit(month), "title": named,
                             "inference": F.col("inference").withField("review_status", F.lit("reviewed"))})


def test_publishing_one_month_leaves_the_others(spark, tmp_path):
    files = lambda: {p: p.read_bytes() for p in (tmp_path / "r").rglob("*.parquet")}
    root = str(tmp_path / "r")
    assert sinks.published_manifest(spark, root).count() == 0
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.published_release(spark, root)
    sinks.publish_release(release(spark, "2026-Sep", ["a", "b"]), root, "t1", {"2026-Sep": "September"})
    sinks.publish_release(release(spark, "2026-Oct", ["c"]), root, "t2")
    before = files()
    manifest = sinks.publish_release(release(spark, "2026-Sep", ["d", "e", "f"]), root, "t3")
    assert [(m["month"], m["label"], m["record_count"], m["published_at"]) for m in manifest.collect()] == [
        ("2026-Oct", "2026-Oct", 1, "t2"), ("2026-Sep", "2026-Sep", 3, "t3")]
    now = files()
    assert all(now[p] == raw for p, raw in before.items()) and len(now) > len(before)
    titles = lambda: sorted((r["month"], r["title"]) for r in sinks.published_release(spark, root).select("month", "title").collect())
    assert titles() == [("2026-Oct", "c"), ("2026-Sep", "d"), ("2026-Sep", "e"), ("2026-Sep", "f")]
    assert sinks.published_release(spark, root, ["2026-Oct"]).count() == 1
    # files of a lost publication, which wrote no manifest, are not seen
    sinks.annotate(release(spark, "2026-Sep", ["lost"])).write.partitionBy("month").parquet(f"{root}/data/release=lost")
    assert len(titles()) == 4
    twice = release(spark, "2026-Nov", ["x"])
    for refused in (twice.union(twice), twice.withColumn("inference", F.lit(None).cast(twice.schema["inference"].dataType)), twice.limit(0)):
        with pytest.raises(ValueError, match="refusing"):
            sinks.publish_release(refused, root, "t4")
    assert len(titles()) == 4


def test_static_publication_keeps_other_months(spark, tmp_path):
    sinks.publish(release(spark, "2026-Sep", ["a"]), str(tmp_path))
    sinks.publish(release(spark, "2026-Oct", ["b"]), str(tmp_path))
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path)).select("title").collect()) == ["a", "b"]


def test_program_facts_prune_every_level(spark):
    given = [
        '{"cveMetadata": {"cveId": "C", "assigner": "x"}, "credits": 1, "containers": {"other": {}, "cna": {"title": "t", "credits": [1],'
        ' "providerMetadata": {"shortName": "a", "orgId": "o"}, "metrics": [{"credits": "inside"}]}, "adp": [{"title": "q", "x": 1}, 7]}}',
        '{"containers": {"cna": [{"title": "l", "z": 1}], "adp": {"providerMetadata": "text", "z": 2}}}', "{}", "[1]", None]
    want = [
        '{"containers":{"adp":[{"title":"q"},null],"cna":{"metrics":[{"credits":"inside"}],"providerMetadata":{"shortName":"a"},"title":"t"}},"cveMetadata":{"cveId":"C"}}',
        '{"containers":{"adp":{"providerMetadata":"text"},"cna":[{"title":"l"}]},"cveMetadata":{}}',
        '{"containers":{},"cveMetadata":{}}', '{"containers":{},"cveMetadata":{}}', None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select(
        "i", F.to_json(parse.program_evidence(F.parse_json("t"))).alias("j")).orderBy("i").collect()
    assert [r["j"] for r in rows] == want


def test_syntax_proof_edges(spark):
    cases = [  # value, span, start, category, pointer, proved
        ("http://a.b.test/x http://c.d.test/y", "c.d.test", 26, "hostname", "/u", True),
        ("http://a.b.test/x c.d.test", "c.d.test", 18, "hostname", "/u", False),
        ("xxhttps://a.b.test", "a.b.test", 10, "hostname", "/u", True),
        ("a.b.test,https://a.b.test", "a.b.test", 0, "hostname", "/u", False),
        ("tps://A.b.test.:1", "A.b.test", 6, "hostname", "/u", True),
        ("https://x/ a.b.test", "a.b.test", 11, "hostname", "/u", False),
        ("reproduced on 1.2.3.4", "1.2.3.4", 14, "ipv4_address", "/n", True),
        ("reproduced on 192.0.0.9", "192.0.0.9", 14, "ipv4_address", "/n", True),
        ("reproduced on 192.0.0.11", "192.0.0.11", 14, "ipv4_address", "/n", False),
        ("reproduced on 1.2.3.04", "1.2.3.04", 14, "ipv4_address", "/n", False),
        ("reproduced on" + " " * 70 + "1.2.3.4", "1.2.3.4", 83, "ipv4_address", "/n", False),
        ("10.0.0.1", "10.0.0.1", 0, "ipv4_address", "/a/versionEndExcluding", True),
        ("10.0.0.1", "10.0.0.1", 0, "ipv4_address", "version", False),
        ("10.0.0.1", "10.0.0.1", 0, "ipv4_address", None, False),
        ("10.0.0.1", "10.0.0.1", 0, "mac_address", "/a/version", False)]
    rows = [(str(i), "f", c, v, s, at, at + len(s)) for i, (v, s, at, c, _, _) in enumerate(cases)]
    found = spark.createDataFrame(rows + [("none", "f", "hostname", "text", "t", 0, 1), (None, "f", "hostname", None, None, None, None)],
                                  "cve string, field string, category string, value string, span string, start int, end int")
    sources = spark.createDataFrame([(str(i), c[0], "raw", c[4]) for i, c in enumerate(cases)] + [(None, None, None, None)],
                                    "cve string, value string, location string, pointer string")
    got = {r["cve"]: r["proved"] for r in joins.proof_of_findings(found, sources).collect()}
    assert got == {str(i): c[5] for i, c in enumerate(cases)} | {"none": False, None: False}
