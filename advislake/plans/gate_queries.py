"""Validation gate and overlay merge queries."""
import json

from pyspark.sql import functions as F

from advislake.functions import vocab
from advislake.functions.exprs import attach, struct_of, words
from advislake.operators import gates, joins, merge, severity
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import inlist, pick, values, view
from advislake.sources import readers
from advislake.sources.scratch import fresh_path

flat = lambda c, sep="|": F.array_join(c, sep)
_DIRS = [(cid, d) for cid, _, _, ds in vocab.CONTROLS for d in ds]
view("ctrldir", [], f"SELECT * FROM (VALUES {values(_DIRS)}) AS t(id, direction)")


def codes(name, rows, needs, extra=""):
    """Oracle of (cve, violation) rows from (code, condition) pairs over ``rows``."""
    def wrap(pairs):
        return " UNION ALL ".join(f"SELECT cve{extra}, '{c}' AS violation FROM {rows} WHERE {w}" for c, w in pairs)
    return lambda pairs: register(name, wrap(pairs), needs)


def exploded(df, array):
    return df.select("cve", F.explode(array).alias("violation"))


@codes("v1_cvss_basis", "facts", ["facts"])([
    ("basis-missing", "k % 50 = 3"), ("basis-base_score", "k % 50 <> 3 AND k % 37 = 1 AND base_score IS NOT NULL"),
    ("basis-vector", "k % 50 <> 3 AND k % 41 = 2")])
def cvss_basis(spark, sf):
    k = F.col("k")
    basis = struct_of(
        base_score=F.when(k % 37 != 1, F.col("cvss.base_score")),
        vector=F.when(k % 41 == 2, "none").otherwise(F.col("cvss.vector")), attack_vector=F.col("attack.vector"),
        privileges_required=F.col("attack.privileges_required"), user_interaction=F.col("attack.user_interaction"))
    return exploded(B.records(spark, sf).withColumn("cvss_basis", F.when(k % 50 != 3, basis)), gates.cvss_basis_errors())


@codes("v2_framework_vocabulary", "rec", ["rec"])([
    ("unknown-archetype", "has_fw AND k % 71 = 3"), ("likelihood", "has_fw AND k % 73 = 4"),
    ("action", "has_fw AND k % 79 = 5"), ("confidence", "has_fw AND k % 83 = 6"),
    ("framework-missing", "NOT has_fw"), ("model-version", f"has_fw AND model_version <> '{vocab.RISK_MODEL_VERSION}'"),
    ("factors", "has_fw AND (k % 37 = 0 OR k % 5 = 2)"), ("communication", "has_fw AND (k % 4 = 1 OR k % 6 = 5)")])
def framework_vocabulary(spark, sf):
    k, path = F.col("k"), "inference.framework_assessment"
    # each leaf is written beside the others: rewriting the whole struct leaf by leaf would copy it for every leaf
    framework = F.col(path)
    for leaf, odd in (("baseline_model", k % 71 == 3), ("baseline_likelihood", k % 73 == 4),
                      ("baseline_action", k % 79 == 5), ("confidence", k % 83 == 6)):
        framework = framework.withField(leaf, F.when(odd, "odd").otherwise(F.col(f"{path}.{leaf}")))
    planted = F.when(F.col(path).isNotNull(), F.col("inference").withField("framework_assessment", framework)).otherwise(F.col("inference"))
    # behind a barrier, or every rule would copy the planting
    rows = attach(B.records(spark, sf), struct_of(planted=planted))
    return exploded(rows.drop("inference").withColumnRenamed("planted", "inference"), gates.framework_errors())


@codes("v3_framework_floors", "(SELECT *, car IS DISTINCT FROM false AS act FROM ev2 WHERE has_fw)", ["ev2"])([
    ("no-action-model", "NOT act AND (saved_model <> 'no-customer-action' OR saved_a <> 0)"),
    ("confirmed-exploitation", "act AND (kev OR det) AND (saved_model <> 'active-exploitation' OR saved_a <> 3 OR saved_l <> 3)"),
    ("preauth-rce-action", "act AND NOT kev AND NOT det AND rce AND saved_a < 2"),
    ("preauth-rce-archetype", "act AND NOT kev AND NOT det AND rce AND ev_l >= 2 AND saved_model <> 'critical-preauth-network-rce'"),
    ("more-likely-floor", "act AND exa = 'more-likely' AND saved_l < 2"),
    ("below-public-evidence", "act AND saved_l < ev_l")])
def framework_floors(spark, sf):
    return exploded(B.records(spark, sf), gates.floor_errors())


@codes("v4_archetype", "ev2", ["ev2"])([("archetype", "has_fw AND saved_model <> determined")])
def archetype_gate(spark, sf):
    return exploded(B.records(spark, sf), gates.archetype_error())


@codes("v5_candidate_rules", "cand", ["cand"], ", id AS control")([
    ("credit-without-relevance", "relevance <> 'relevant' AND (ls <> 0 OR cs <> 0 OR block)"),
    ("path-block", f"block AND NOT (confidence = 'high' AND id IN {inlist(vocab.PATH_BLOCK_CONTROLS)})"),
    ("two-steps", "ls = 2 AND NOT block"), ("evidence", "evidence = ''")])
def candidate_rules(spark, sf):
    return gates.candidate_violations(B.records(spark, sf))


@codes("v6_path_compatibility", "(SELECT c.*, av, pr, has_uc FROM cand c JOIN rec USING (k)) x", ["cand", "rec"], ", id AS control")([
    ("network-control", f"ls <> 0 AND id IN {inlist(vocab.NETWORK_CONTROLS)} AND av NOT IN ('network', 'adjacent')"),
    ("content-control", f"ls <> 0 AND id IN {inlist(vocab.CONTENT_CONTROLS)} AND NOT has_uc"),
    ("identity-control", f"ls <> 0 AND id IN {inlist(vocab.IDENTITY_CONTROLS)} AND pr NOT IN ('low', 'high')"),
    ("response-control", f"ls <> 0 AND id IN {inlist(vocab.RESPONSE_CONTROLS)}")])
def path_compatibility(spark, sf):
    return gates.candidate_violations(B.records(spark, sf), gates.path_errors)


@register("v7_tag_vocabulary", "SELECT cve, 'made-up' AS tag FROM adv WHERE k % 9 = 2", ["adv"])
def tag_vocabulary(spark, sf):
    odd = B.records(spark, sf).withColumn("tags", F.when(F.col("k") % 9 == 2, F.array_union(
        "tags", words(["made-up"]))).otherwise(F.col("tags")))
    return gates.unknown_tags(odd)


view("dirgate", ["cand", "rec", "ctrldir"], """
SELECT c.k, c.cve, c.pos, c.id, r.direction, direction IS NOT NULL AND (ls > 0 OR block OR (direction = 'unknown' AND cs > 0))
  AND (direction = 'unknown' OR NOT EXISTS (SELECT 1 FROM ctrldir d WHERE d.id = c.id AND d.direction = r.direction)) AS bad,
  ls, cs, block FROM cand c JOIN rec r USING (k)""")


@register("v8_direction_gate", """SELECT r.cve, CASE WHEN r.direction IS NULL THEN 'unchecked' WHEN r.direction = 'unknown' THEN 'unknown'
   WHEN coalesce(bool_or(bad), false) THEN 'violations-found' ELSE 'clean' END AS status, coalesce(string_agg(id, '|' ORDER BY pos) FILTER (bad), '') AS controls
  FROM rec r LEFT JOIN dirgate g ON g.k = r.k GROUP BY r.cve, r.direction""", ["rec", "dirgate"])
def direction_gate(spark, sf):
    out = gates.with_direction_gate(B.records(spark, sf))
    return out.select("cve", "direction_gate.status", flat(F.transform(
        "direction_gate.violations", lambda v: v["control"])).alias("controls"))


@register("v8_direction_credit_left", """SELECT cve, sum(CASE WHEN bad THEN 0 ELSE ls END)::BIGINT AS likelihood,
  sum(CASE WHEN bad AND direction = 'unknown' THEN 0 ELSE cs END)::BIGINT AS consequence FROM dirgate GROUP BY 1""", ["dirgate"])
def direction_credit(spark, sf):
    out = gates.with_direction_gate(B.records(spark, sf))
    total = lambda f: F.aggregate("mitigation_candidates", F.lit(0).cast("bigint"), lambda a, c: a + c["effect"][f])
    return out.where(F.size("mitigation_candidates") > 0).select(
        "cve", total("likelihood_steps").alias("likelihood"), total("consequence_steps").alias("consequence"))


@register("a12_direction_summary", """SELECT (SELECT count(*) FROM rec) AS overlays, (SELECT count(direction) FROM rec) AS checked,
  count(DISTINCT cve) FILTER (bad) AS contradicting, count(*) FILTER (bad) AS credits_removed,
  (SELECT count(*) FROM rec WHERE direction IS NULL) AS unchecked FROM dirgate""", ["rec", "dirgate"])
def direction_summary(spark, sf):
    return gates.direction_summary(gates.with_direction_gate(B.records(spark, sf)))


@register("j13_candidate_directions", """SELECT c.cve, c.id AS control, r.direction, r.direction IS NOT NULL AND EXISTS (
  SELECT 1 FROM ctrldir d WHERE d.id = c.id AND d.direction = r.direction) AS acts FROM cand c JOIN rec r USING (k)""", ["cand", "rec", "ctrldir"])
def candidate_directions(spark, sf):
    return joins.candidate_directions(B.records(spark, sf))


@register("v9_severity_basis_pin", """SELECT cve, band, nbasis, nbasis = 'cvss-derived' AS derived FROM rec WHERE k % 3 <> 0 AND k % 5 <> 0""", ["rec"])
def severity_pin(spark, sf):
    k = F.col("k")
    staged = B.records(spark, sf).withColumns({
        "assessment_status": F.when(k % 3 != 0, "model-assessed"),
        "guidance_version": F.when(k % 5 != 0, "monthly-1").otherwise("2026"),
        "validation_type": F.lit("automated-source-and-schema"), "schema_enforced": F.lit(True)})
    return gates.with_severity_basis(staged).where("pinned_basis is not null").select(
        "cve", F.col("pinned_basis.normalized_band").alias("band"), F.col("pinned_basis.normalized_basis").alias("nbasis"),
        F.col("pinned_basis.derived_cvss").isNotNull().alias("derived"))


_MONTHLY = "(SELECT r.*, (SELECT count(*) FROM cand c WHERE c.k = r.k AND (ls <> 0 OR cs <> 0 OR block)) AS credits FROM rec r) x"


@codes("v10_monthly_overlay", _MONTHLY, ["rec", "cand"])([
    ("controls-once", "true"), ("tag-evidence", "NOT has_fw OR k % 4 = 0"),
    ("direction", "direction IS NULL"), ("unknown-direction-review", "direction = 'unknown' AND NOT (has_fw AND k % 10 = 3)"),
    ("unknown-direction-credit", "direction = 'unknown' AND credits > 0")])
def monthly_overlay(spark, sf):
    return exploded(B.records(spark, sf), gates.monthly_errors())


@register("v11_evidence_floor", f"""SELECT cve, {pick(vocab.LIKELIHOODS, "greatest(saved_l, CASE WHEN car = false THEN 0 ELSE ev_l END)")} AS likelihood,
  CASE WHEN saved_l < CASE WHEN car = false THEN 0 ELSE ev_l END THEN 1 ELSE 0 END AS adjustments,
  CASE WHEN saved_l < CASE WHEN car = false THEN 0 ELSE ev_l END THEN 1 ELSE 0 END + CASE WHEN k % 12 = 5 THEN 1 ELSE 0 END AS noted FROM ev WHERE has_fw""", ["ev"])
def evidence_floor(spark, sf):
    return gates.with_evidence_floor(B.records(spark, sf)).where("floored_likelihood is not null").select(
        "cve", F.col("inference.framework_assessment.baseline_likelihood").alias("likelihood"), F.size("floor_adjustments").alias("adjustments"),
        F.coalesce(F.size("inference.framework_assessment.policy_adjustments"), F.lit(0)).alias("noted"))


_BADC = f"""((relevance <> 'relevant' AND (ls <> 0 OR cs <> 0 OR block)) OR (block AND NOT (confidence = 'high' AND id IN {inlist(vocab.PATH_BLOCK_CONTROLS)}))
  OR (ls = 2 AND NOT block) OR evidence = '' OR (ls <> 0 AND id IN {inlist(vocab.NETWORK_CONTROLS)} AND av NOT IN ('network', 'adjacent'))
  OR (ls <> 0 AND id IN {inlist(vocab.CONTENT_CONTROLS)} AND NOT has_uc) OR (ls <> 0 AND id IN {inlist(vocab.IDENTITY_CONTROLS)} AND pr NOT IN ('low', 'high'))
  OR (ls <> 0 AND id IN {inlist(vocab.RESPONSE_CONTROLS)}))"""


@register("v12_fail_closed", f"""SELECT c.cve, c.pos, c.id, CASE WHEN {_BADC} THEN 0 ELSE ls END AS ls, CASE WHEN {_BADC} THEN 'low' ELSE confidence END AS confidence
  FROM (SELECT c.* EXCLUDE (pos), row_number() OVER (PARTITION BY c.k ORDER BY c.pos) - 1 AS pos, av, pr, has_uc
    FROM cand c JOIN (SELECT k, av, pr, has_uc FROM rec) r USING (k)) c""", ["cand", "rec"])
def fail_closed(spark, sf):
    out = gates.fail_closed(B.records(spark, sf)).select("cve", F.posexplode("mitigation_candidates").alias("pos", "c"))
    return out.select("cve", "pos", "c.id", F.col("c.effect.likelihood_steps").alias("ls"), "c.confidence")


@register("v13_taxonomy_closure", f"""SELECT a.cve, NOT a.has_uc AND EXISTS (SELECT 1 FROM cand c WHERE c.k = a.k AND c.id IN {inlist(vocab.CONTENT_CONTROLS)}
  AND relevance = 'relevant' AND ls > 0) AS added FROM rec a""", ["rec", "cand"])
def taxonomy_closure(spark, sf):
    return gates.with_taxonomy_closure(B.records(spark, sf)).select("cve", F.col("closure_added").alias("added"))


@register("v14_provenance", """SELECT cve, 'assessor-' || ((k // 10) % 3) AS model, sha256('r' || (k // 10)) AS response, k // 10 AS batch FROM adv""", ["adv"])
def provenance(spark, sf):
    overlay = B.advisories(spark, sf).select("cve", F.floor(F.col("k") / 10).alias("batch"))
    b = F.col("batch")
    calls = overlay.select("batch").distinct().select(
        "batch", F.concat(F.lit("assessor-"), (b % 3).cast("string")).alias("model"), F.lit("a").alias("arm"),
        F.lit("served").alias("model_served"), F.lit("2026-09-10").alias("finished_at"),
        F.sha2(F.concat(F.lit("p"), b.cast("string")), 256).alias("prompt_sha256"),
        F.sha2(F.concat(F.lit("r"), b.cast("string")), 256).alias("response_sha256"),
        F.lit(True).alias("schema_enforced"), F.sha2(F.lit("s"), 256).alias("source_sha256"))
    return gates.with_provenance(overlay, calls, "2026-09-11").select(
        "cve", "provenance.model", F.col("provenance.invocation.response_sha256").alias("response"),
        F.col("provenance.invocation.batch").alias("batch"))


@register("v15_qa_flags", """SELECT cve, issue, control FROM (
  SELECT cve, 'likelihood-above-evidence' AS issue, NULL AS control FROM ev WHERE has_fw AND car IS DISTINCT FROM false AND saved_l > ev_l
  UNION ALL SELECT cve, 'archetype-without-evidence', NULL FROM ev WHERE has_fw AND car IS DISTINCT FROM false AND saved_model = 'critical-preauth-network-rce' AND saved_l < 2
  UNION ALL SELECT c.cve, 'generic-control', id FROM cand c JOIN ev USING (k) WHERE has_fw AND relevance = 'relevant' AND c.confidence IN ('high', 'medium') AND (ls <> 0 OR cs <> 0) AND id IN ('edr_detection_response', 'attack_surface_reduction')
  UNION ALL SELECT c.cve, 'strong-effect', id FROM cand c JOIN ev USING (k) WHERE has_fw AND relevance = 'relevant' AND c.confidence IN ('high', 'medium') AND (ls <> 0 OR cs <> 0) AND (cs <> 0 OR block))""", ["ev", "cand"])
def qa_flags(spark, sf):
    return gates.qa_flags(B.records(spark, sf))


# --- overlay merge -----------------------------------------------------------------------
def overlays(spark, sf):
    """Overlays of the assessed records, as an assessor would hand them in."""
    return B.records(spark, sf).where("k % 8 <> 0").select(
        "cve", words(["web"]).alias("o_tags"), F.col("mitigation_candidates").alias("o_candidates"),
        F.col("inference").alias("o_inference"))


@register("j8_merge_overlay", """SELECT a.cve, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags, 'reviewed' AS status
  FROM adv a JOIN (SELECT k, tag FROM advtag UNION ALL SELECT k, 'web' FROM adv) t ON t.k = a.k WHERE a.k % 8 <> 0 GROUP BY 1""", ["adv", "advtag"])
def merge_overlay(spark, sf):
    return joins.merge_overlay(B.records(spark, sf), overlays(spark, sf)).select(
        "cve", flat(F.col("tags")).alias("tags"), F.col("inference.review_status").alias("status"))


@register("j9_with_unreviewed", f"""SELECT cve, CASE WHEN k % 8 = 0 THEN 'unreviewed' ELSE 'reviewed' END AS status, CASE WHEN k % 8 = 0 THEN 'not-applicable'
  WHEN direction = 'unknown' THEN 'unknown' ELSE 'clean' END AS gate, CASE WHEN k % 8 = 0 THEN 'record carries no inference overlay' END AS reason,
  CASE WHEN k % 8 = 0 THEN 'none' ELSE 'assessor-1' END AS model, '1.0' AS taxonomy, CASE WHEN k % 8 <> 0 THEN direction END AS direction,
  CASE WHEN k % 8 <> 0 THEN {pick(vocab.ACTIONS, 'saved_a')} END AS action, CASE WHEN k % 8 <> 0 THEN model_version END AS model_version,
  CASE WHEN k % 8 <> 0 AND k % 3 = 0 THEN nbasis END AS basis FROM rec""", ["rec"])
def with_unreviewed(spark, sf):
    records = B.records(spark, sf)
    merged = joins.merge_overlay(records, overlays(spark, sf))
    at = lambda path, name: F.col(f"inference.{path}").alias(name)
    return joins.with_unreviewed(merged, records).select(
        "cve", at("review_status", "status"), at("direction_gate.status", "gate"), at("direction_gate.reason", "reason"),
        at("model", "model"), at("taxonomy_version", "taxonomy"), at("attack_path.direction", "direction"),
        at("framework_assessment.baseline_action", "action"), at("framework_assessment.risk_model_version", "model_version"),
        at("severity_basis.normalized_basis", "basis"))


def authored(spark, sf):
    """Overlays as an assessor hands them in; some repeated, some without a record."""
    k = F.col("k")
    call = {"assessment_status": F.when(k % 3 != 0, "model-assessed"), "guidance_version": F.when(k % 5 != 0, "monthly-1"),
            "pipeline_validation": F.parse_json(F.lit('{"type": "automated-source-and-schema"}')),
            "invocation": F.parse_json(F.lit('{"schema_enforced": true}'))}
    inference = F.col("inference")
    for name, value in call.items():
        inference = inference.withField(name, value)
    return B.records(spark, sf).where("k % 8 <> 0").select(
        "k", "cve", words(["web"]).alias("tags"), "mitigation_candidates", inference.alias("inference"),
        struct_of(base_score=F.col("cvss.base_score"), vector=F.col("cvss.vector"), attack_vector=F.col("attack.vector"),
                  privileges_required=F.col("attack.privileges_required"), user_interaction=F.col("attack.user_interaction")
                  ).alias("cvss_basis"))


@register("j8_merge_refusals", """SELECT cve || '-X' AS cve, 'overlay-id' AS gate, 'absent-from-baseline' AS violation FROM rec WHERE k % 8 <> 0 AND k % 40 = 7
  UNION ALL SELECT cve, 'overlay-id', 'repeated-overlay' FROM rec WHERE k % 8 <> 0 AND k % 60 = 9
  UNION ALL SELECT cve, 'tags', 'made-up' FROM rec WHERE k % 8 <> 0 AND k % 50 = 11
  UNION ALL SELECT cve, 'completeness', 'not-reviewed' FROM rec WHERE k % 8 = 0""", ["rec"])
def merge_refusals(spark, sf):
    given = authored(spark, sf).withColumn("tags", F.when(F.col("k") % 50 == 11, words(["made-up"])).otherwise(F.col("tags")))
    absent = given.where("k % 40 = 7").withColumn("cve", F.concat("cve", F.lit("-X")))
    handed = given.unionByName(absent).unionByName(given.where("k % 60 = 9 and k % 50 <> 11"))
    return merge.merge_violations(B.records(spark, sf), handed.drop("k"), complete=True).where(
        "gate in ('overlay-id', 'tags', 'completeness')")


@register("j8_merge_flow", """SELECT r.cve, CASE WHEN r.k % 8 = 0 THEN 'unreviewed' ELSE 'reviewed' END AS status, CASE WHEN r.k % 8 = 0 THEN 'not-applicable'
   WHEN r.direction IS NULL THEN 'unchecked' WHEN r.direction = 'unknown' THEN 'unknown' WHEN coalesce(bool_or(bad), false) THEN 'violations-found' ELSE 'clean' END AS gate,
  CASE WHEN r.k % 8 <> 0 THEN coalesce(string_agg(id, '|' ORDER BY pos) FILTER (bad), '') END AS controls,
  CASE WHEN r.k % 8 <> 0 AND r.k % 3 <> 0 AND r.k % 5 <> 0 THEN r.nbasis WHEN r.k % 8 <> 0 AND r.k % 3 = 0 THEN r.nbasis END AS pinned
  FROM rec r LEFT JOIN dirgate g ON g.k = r.k GROUP BY r.cve, r.k, r.direction, r.nbasis""", ["rec", "dirgate"])
def merge_flow(spark, sf):
    out = merge.merge_release(B.records(spark, sf), authored(spark, sf).drop("k", "cvss_basis"), complete=True,
                              include_unreviewed=True, allow_missing_direction=True)
    gate = F.col("inference.direction_gate")
    return out.select("cve", F.col("inference.review_status").alias("status"), gate["status"].alias("gate"),
                      flat(F.transform(gate["violations"], lambda v: v["control"])).alias("controls"),
                      F.col("inference.severity_basis.normalized_basis").alias("pinned"))


@register("v5_closed_values", """SELECT cve, CASE WHEN k % 5 = 0 THEN 'made-up' ELSE 'waf_virtual_patch' END AS control,
  CASE k % 5 WHEN 0 THEN 'unknown-control' WHEN 1 THEN 'relevance' WHEN 2 THEN 'confidence' ELSE 'steps' END AS violation FROM adv WHERE k % 5 <> 4""", ["adv"])
def closed_values(spark, sf):
    k = F.col("k") % 5
    planted = struct_of(
        id=F.when(k == 0, "made-up").otherwise("waf_virtual_patch"), relevance=F.when(k == 1, "odd").otherwise("relevant"),
        confidence=F.when(k == 2, "odd").otherwise("high"), evidence="stated", direction_override=F.lit(None).cast("boolean"),
        effect=struct_of(likelihood_steps=F.lit(0), consequence_steps=F.when(k == 3, 5).otherwise(0), path_block=F.lit(False)))
    return gates.candidate_violations(B.advisories(spark, sf).select("k", "cve", F.array(planted).alias("mitigation_candidates")))


def corrections(spark, sf):
    field = struct_of(baseline_action=F.lit("Immediate"), factors=F.create_map(F.lit("uncertainty"), F.lit("None")),
                      risk_communication=struct_of(summary=F.lit("Corrected summary")))
    control = struct_of(relevance="not-relevant", evidence="amended", effect=struct_of(likelihood_steps=F.lit(0)))
    return B.advisories(spark, sf).where("k % 25 = 1").select(
        "cve", F.lit("typo").alias("reason"), field.alias("fields"),
        F.create_map(F.lit("waf_virtual_patch"), control).alias("controls"))


_FIXED = "(CASE WHEN r.k % 25 = 1 THEN {} ELSE {} END)"


@register("j17_apply_corrections", f"""SELECT r.cve, CASE WHEN r.k % 25 = 1 THEN 'Immediate' WHEN has_fw THEN {pick(vocab.ACTIONS, 'saved_a')} END AS action, r.k % 25 = 1 AS corrected,
  CASE WHEN r.k % 25 = 1 THEN 'Corrected summary' WHEN has_fw AND r.k % 4 <> 1 THEN 'Assessed ' || r.cve END AS summary,
  CASE WHEN r.k % 25 = 1 THEN 'None' WHEN has_fw THEN {pick(B.UNCERTAINTIES, 'k % 5')} END AS uncertainty,
  CASE WHEN has_fw THEN CASE WHEN r.k % 37 = 0 THEN '' ELSE 'stated' END END AS impact, CASE WHEN has_fw THEN model_version END AS model_version,
  (SELECT string_agg(CASE WHEN r.k % 25 = 1 AND id = 'waf_virtual_patch' THEN 'not-relevant:amended:0:' || cs ELSE relevance || ':' || evidence || ':' || ls || ':' || cs END, '|' ORDER BY pos) FROM cand c WHERE c.k = r.k) AS controls
  FROM rec r""", ["rec", "cand"])
def apply_corrections(spark, sf):
    """All records, also those without an assessment: a correction of such a one states what it names and nothing else."""
    out = joins.apply_corrections(B.records(spark, sf), corrections(spark, sf), "0" * 64, "qa")
    at = lambda path, name: F.col(f"inference.framework_assessment.{path}").alias(name)
    steps = lambda c, f: c["effect"][f].cast("string")
    return out.select("cve", at("baseline_action", "action"), F.col("inference.verification").isNotNull().alias("corrected"),
                      at("risk_communication.summary", "summary"), at("factors.uncertainty", "uncertainty"),
                      at("factors.technical_impact", "impact"), at("risk_model_version", "model_version"),
                      flat(F.transform("mitigation_candidates", lambda c: F.concat_ws(
                          ":", c["relevance"], c["evidence"], steps(c, "likelihood_steps"), steps(c, "consequence_steps")))).alias("controls"))


@register("j17_unknown_corrections", "SELECT cve || '-X' AS cve FROM adv WHERE k % 200 = 1", ["adv"])
def unknown_corrections(spark, sf):
    asked = corrections(spark, sf).select("cve").unionByName(B.advisories(spark, sf).where("k % 200 = 1").select(
        F.concat("cve", F.lit("-X")).alias("cve")))
    return joins.unknown_corrections(B.advisories(spark, sf), asked)


# --- dimension files in use ----------------------------------------------------------------
def dimension(spark, label, document):
    """A dimension file as an owner of the vocabulary would hand it in."""
    path = fresh_path(spark, label)
    spark.range(1).select(F.lit(json.dumps(document)).alias("value")).coalesce(1).write.text(path)
    return path


@register("s7_scales_in_use", """SELECT a.cve, CASE WHEN a.cna_scale = 'chromium' AND lower(a.cna_band) = 'low' THEN 'medium' ELSE s.target END AS band
  FROM adv a LEFT JOIN scale s ON s.scale = a.cna_scale AND lower(s.band) = lower(a.cna_band) WHERE a.cna_band IS NOT NULL""", ["adv", "scale"])
def scales_in_use(spark, sf):
    scales = {scale: {"bands": {band: {"maps_to": target} for band, target in bands.items()}} for scale, bands in vocab.SEVERITY_SCALES.items()}
    scales["chromium"]["bands"]["Low"]["maps_to"] = "medium"
    table = readers.read_scales(spark, dimension(spark, "scales", {"scales": scales}))
    return severity.with_mapped_band(B.advisories(spark, sf).where("cna_band is not null"), table, "cna_scale", "cna_band", "band").select("cve", "band")


OWN_RANGES = [(8.0, 10.0, "critical"), (5.0, 7.9, "high"), (2.0, 4.9, "medium"), (0.0, 1.9, "low")]
_OWN = " ".join(f"WHEN base_score BETWEEN {low} AND {high} THEN '{band}'" for low, high, band in OWN_RANGES)
_RULED = f"""WITH m AS (SELECT s.*, CASE WHEN cna_nband IS NOT NULL AND cna_scale = 'chromium' AND lower(cna_band) = 'low' THEN 'medium' ELSE cna_nband END AS cb FROM sev s),
  x AS (SELECT m.*, cb IS NULL OR coalesce(p.rank, -1) >= c.rank AS pub_wins, CASE {_OWN} ELSE 'unknown' END AS derived
    FROM m LEFT JOIN bandrank p ON p.band = m.pub_band LEFT JOIN bandrank c ON c.band = m.cb),
  y AS (SELECT *, CASE WHEN pub_band IS NULL AND cb IS NULL THEN derived WHEN pub_wins THEN pub_band ELSE cb END AS new_band FROM x)"""


def own_rules(spark):
    """Rules of a file with other cut-offs, one other target and its own version."""
    scales = {scale: {"bands": {band: {"maps_to": target} for band, target in bands.items()}} for scale, bands in vocab.SEVERITY_SCALES.items()}
    scales["chromium"]["bands"]["Low"]["maps_to"] = "medium"
    scales["cvss-score"] = {"ranges": [{"min": low, "max": high, "maps_to": band} for low, high, band in OWN_RANGES]}
    path = dimension(spark, "scales", {"version": "2.3", "scales": scales})
    return severity.Rules(readers.read_scales(spark, path), readers.read_score_ranges(spark, path), readers.scales_version(spark, path))


@register("s7_severity_by_file", f"""{_RULED} SELECT cve, new_band AS band, CASE WHEN pub_band IS NULL AND cb IS NULL THEN
    CASE WHEN derived = 'unknown' THEN 'absent' ELSE 'cvss-derived' END
    WHEN pub_wins THEN 'scale-mapping:msrc:2.3' ELSE 'scale-mapping:' || cna_scale || ':2.3' END AS basis FROM y""", ["sev", "bandrank"])
def severity_by_file(spark, sf):
    return severity.with_severity(B.sourced(spark, sf), rules=own_rules(spark)).select(
        "cve", F.col("severity.normalized_band").alias("band"), F.col("severity.normalized_basis").alias("basis"))


@register("m6_renormalise_by_file", f"""{_RULED} SELECT band, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM (
    SELECT r.band, 1 AS b, 0 AS a FROM rec r UNION ALL SELECT new_band, 0, 1 FROM y) GROUP BY 1""", ["sev", "bandrank", "rec"])
def renormalise_by_file(spark, sf):
    return severity.band_moves(severity.renormalise(B.records(spark, sf), own_rules(spark)))


@register("j11_score_band_by_file", f"""SELECT cve, CASE {_OWN} ELSE 'unknown' END AS band FROM (SELECT cve, base_score + (CASE WHEN k % 2 = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS base_score FROM adv)""", ["adv"])
def score_band_by_file(spark, sf):
    scored = B.advisories(spark, sf).select("cve", (F.col("base_score") + F.when(F.col("k") % 2 == 0, 0.05).otherwise(0.0)).alias("s"))
    return severity.with_score_band(scored, "s", own_rules(spark)).select("cve", "band")


@register("s7_taxonomy_in_use", "SELECT cve, tag FROM advtag WHERE tag IN ('user-content', 'dns')", ["advtag"])
def taxonomy_in_use(spark, sf):
    kept = {n: [t for t in tags if t not in ("user-content", "dns")] for n, tags in vocab.NAMESPACES.items()}
    taxonomy = readers.read_taxonomy(spark, dimension(spark, "taxonomy", {"namespaces": kept}))
    return gates.unknown_tags(B.records(spark, sf), taxonomy)


@register("s7_controls_in_use", """SELECT c.cve, c.id AS control, r.direction, r.direction IS NOT NULL AND r.direction <> 'unknown' AND CASE WHEN c.id = 'waf_virtual_patch' THEN r.direction = 'local'
  ELSE EXISTS (SELECT 1 FROM ctrldir d WHERE d.id = c.id AND d.direction = r.direction) END AS acts FROM cand c JOIN rec r USING (k)""", ["cand", "rec", "ctrldir"])
def controls_in_use(spark, sf):
    listed = [{"id": i, "name": n, "category": c, "applies_to_direction": ["local"] if i == "waf_virtual_patch" else list(d)}
              for i, n, c, d in vocab.CONTROLS]
    return joins.candidate_directions(B.records(spark, sf), readers.read_controls(spark, dimension(spark, "controls", listed)))


@register("s7_definitions_in_use", "SELECT cve, tag, 'meaning of ' || tag AS definition FROM advtag", ["advtag"])
def definitions_in_use(spark, sf):
    document = {"definitions": {"_remark": "x"} | {t: f"meaning of {t}" for tags in vocab.NAMESPACES.values() for t in tags}}
    defined = readers.read_definitions(spark, dimension(spark, "definitions", document))
    return B.records(spark, sf).select("cve", F.explode("tags").alias("tag")).join(defined, "tag", "left").select("cve", "tag", "definition")


@register("s7_filters_in_use", """SELECT CASE WHEN tag IN ('email', 'web', 'user-content') THEN 'reach' ELSE 'impact' END AS "group", tag, upper(tag) AS label, count(*) AS records
  FROM advtag WHERE tag IN ('email', 'web', 'user-content', 'remote-code-execution', 'spoofing') AND tag <> 'web' GROUP BY 1, 2, 3""", ["advtag"])
def filters_in_use(spark, sf):
    group = lambda name, tags: {"id": name, "source": "tags", "options": [
        {"tag": t, "label": t.upper()} | ({"overview": False} if t == "web" else {}) for t in tags]}
    document = {"groups": [group("reach", ["email", "web", "user-content"]), group("impact", ["remote-code-execution", "spoofing"])]}
    board = readers.read_filters(spark, dimension(spark, "filters", document)).where("overview")
    rows = B.records(spark, sf).select("cve", F.explode("tags").alias("tag")).join(board, "tag")
    return rows.groupBy("group", "tag", "label").agg(F.count("*").alias("records"))


@register("s7_manifest_in_use", """SELECT month, month || '.jsonl' AS file, count(*) AS records, count(*) = max(n) AS complete FROM (
  SELECT month, count(*) OVER (PARTITION BY month) AS n FROM adv) GROUP BY 1""", ["adv"])
def manifest_in_use(spark, sf):
    """Record counts that a manifest states, against the release."""
    held = B.records(spark, sf).groupBy("month").agg(F.count("*").alias("records"))
    entries = held.select(F.to_json(F.array(F.struct("month", F.concat("month", F.lit(".jsonl")).alias("file"), F.col("records").alias("record_count")))).alias("value"))
    path = fresh_path(spark, "manifest")
    entries.write.text(path)
    manifest = spark.read.text(path).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.expr("substr(value, 2, length(value) - 2)"))), ","), F.lit("]")).alias("value"))
    one = fresh_path(spark, "manifest")
    manifest.coalesce(1).write.text(one)
    stated = readers.read_manifest(spark, one)
    return stated.join(held, "month").select("month", "file", "records", (F.col("record_count") == F.col("records")).alias("complete"))
