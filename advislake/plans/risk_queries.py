"""Severity, risk model and scalar queries."""
from pyspark.sql import functions as F

from advislake.functions import scalar, vocab
from advislake.functions.exprs import index_of
from advislake.operators import parse, risk, severity
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import SELECTION, idx, inlist, pick, profile_view

flat = lambda c, sep="|": F.array_join(c, sep)
n = lambda c: c.cast("bigint")


@register("m4_build_severity", """SELECT cve, band, primary_src, nbasis, div_kind, div_spread, declined,
  concat_ws('|', CASE WHEN pub_band IS NOT NULL THEN 'publisher:' || sev_word END,
    CASE WHEN cna_nband IS NOT NULL THEN 'assigning-cna:' || cna_band END) AS parties FROM rec""", ["rec"])
def build_severity(spark, sf):
    s = F.col("severity")
    return severity.with_severity(B.sourced(spark, sf)).select(
        "cve", s["normalized_band"].alias("band"), s["primary"].alias("primary_src"),
        s["normalized_basis"].alias("nbasis"), s["divergence"]["kind"].alias("div_kind"),
        s["divergence"]["spread"].alias("div_spread"),
        s["publisher_declined"].isNotNull().alias("declined"),
        flat(F.transform(s["assessments"], lambda a: F.concat(a.role, F.lit(":"), a.value))).alias("parties"))


@register("m1_publisher_assessment", """SELECT cve, sev_word AS value, base_score FROM sev
  WHERE severity_text IS NOT NULL""", ["sev"])
def publisher_assessment(spark, sf):
    a = F.filter("severity.assessments", lambda x: x.role == "publisher")
    return (severity.with_severity(B.sourced(spark, sf)).select("cve", F.get(a, F.lit(0)).alias("a")).where("a is not null")
            .select("cve", F.col("a.value").alias("value"), F.col("a.cvss.base_score").alias("base_score")))


@register("m2_cna_assessment", """SELECT cve, prog_assigner AS source, cna_scale AS scale, cna_band AS value,
  cna_score FROM sev WHERE found AND cna_band IS NOT NULL""", ["sev"])
def cna_assessment(spark, sf):
    a = F.filter("severity.assessments", lambda x: x.role == "assigning-cna")
    return (severity.with_severity(B.sourced(spark, sf)).select("cve", F.get(a, F.lit(0)).alias("a")).where("a is not null")
            .select("cve", "a.source", "a.scale", "a.value", F.col("a.cvss.base_score").alias("cna_score")))


@register("m3_divergence", """SELECT div_kind AS kind, count(*) AS records, max(div_spread) AS widest
  FROM rec WHERE div_kind IS NOT NULL GROUP BY 1""", ["rec"])
def divergence(spark, sf):
    return (severity.with_severity(B.sourced(spark, sf)).select("severity.divergence").where("divergence is not null")
            .groupBy("divergence.kind").agg(F.count("*").alias("records"),
                                            F.max("divergence.spread").alias("widest")))


@register("m5_severity_band", "SELECT band, count(*) AS records FROM rec GROUP BY 1", ["rec"])
def band_counts(spark, sf):
    return severity.with_severity(B.sourced(spark, sf)).groupBy(severity.severity_band().alias("band")).agg(
        F.count("*").alias("records"))


@register("m6_renormalise", """WITH x AS (SELECT CASE WHEN k % 15 = 0 THEN 'low' ELSE band END AS b0, band AS b1 FROM rec)
  SELECT band, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM (
   SELECT b0 AS band, 1 AS b, 0 AS a FROM x UNION ALL SELECT b1, 0, 1 FROM x) GROUP BY 1""", ["rec"])
def renormalise(spark, sf):
    stale = B.records(spark, sf).withColumn("severity", F.col("severity").withField(
        "normalized_band", F.when(F.col("k") % 15 == 0, "low").otherwise(F.col("severity.normalized_band"))))
    return severity.band_moves(severity.renormalise(stale))


@register("j10_scale_lookup", """SELECT a.cve, s.target AS band FROM adv a JOIN scale s ON s.scale = a.cna_scale
  AND lower(s.band) = lower(a.cna_band)""", ["adv", "scale"])
def scale_lookup(spark, sf):
    return (B.advisories(spark, sf).where("cna_band is not null").select(
        "cve", severity.mapped_band(F.col("cna_scale"), F.upper("cna_band")).alias("band")))


@register("j10_scale_gate", """SELECT a.cve, a.severity_text AS band FROM adv a
  WHERE severity_text = 'Low'""", ["adv"])
def scale_gate(spark, sf):
    asked = B.advisories(spark, sf).withColumn("scale", F.lit("adobe"))
    return severity.unmapped_bands(asked, "scale", "severity_text").select(
        "cve", F.col("severity_text").alias("band"))


@register("j11_score_band", """SELECT CASE WHEN s IS NULL THEN 'unknown' WHEN s >= 9.0 AND s <= 10.0 THEN 'critical'
   WHEN s >= 7.0 AND s <= 8.9 THEN 'high' WHEN s >= 4.0 AND s <= 6.9 THEN 'medium'
   WHEN s >= 0.1 AND s <= 3.9 THEN 'low' ELSE 'unknown' END AS band, count(*) AS records
  FROM (SELECT base_score + (CASE WHEN k % 2 = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS s FROM adv) GROUP BY 1""", ["adv"])
def score_band(spark, sf):
    s = F.col("base_score") + F.when(F.col("k") % 2 == 0, 0.05).otherwise(0.0)
    return (B.advisories(spark, sf)
            .groupBy(severity.band_from_score(s).alias("band")).agg(F.count("*").alias("records")))


@register("p7_resolve_severity", "SELECT cve, sev_word AS severity, sev_basis AS basis FROM sev", ["sev"])
def resolve_severity(spark, sf):
    r = severity.resolve_severity(F.col("severity_text"), F.col("base_score"))
    return B.advisories(spark, sf).select("cve", r["severity"].alias("severity"), r["basis"].alias("basis"))


@register("r1_archetype", "SELECT cve, fallback AS model, fallback_a AS action FROM ev3", ["ev3"])
def archetype(spark, sf):
    m = risk.archetype(risk.evidence_likelihood())
    return B.records(spark, sf).select("cve", m.alias("model")).withColumn(
        "action", risk.archetype_action(F.col("model")))


@register("r2_public_threat_likelihood", "SELECT cve, ev_l AS likelihood FROM ev", ["ev"])
def public_likelihood(spark, sf):
    return B.records(spark, sf).select("cve", risk.evidence_likelihood().alias("likelihood"))


@register("r3_baseline_profile", f"""SELECT cve, base_l, base_a, base_m, CASE WHEN car = false THEN base_reason ELSE concat_ws('|',
   'Microsoft exploitation assessment: ' || CASE exa WHEN 'detected' THEN 'Detected' WHEN 'more-likely' THEN 'More likely'
     WHEN 'less-likely' THEN 'Less likely' WHEN 'unlikely' THEN 'Unlikely' ELSE 'Not published' END,
   CASE WHEN kev THEN 'CISA KEV' WHEN det THEN 'Microsoft exploitation detected' END,
   CASE WHEN epss >= 0.1 THEN 'EPSS provides elevated exploitation evidence'
        WHEN epss >= 0.01 THEN 'EPSS provides additional exploitation evidence' END,
   CASE WHEN use_fw THEN 'Framework assessment: ' || CASE WHEN k % 6 <> 5 THEN 'Because of ' || title
        ELSE (SELECT reason FROM arch WHERE model = saved_model) END ELSE fallback_reason END,
   CASE WHEN use_fw AND k % 12 = 5 THEN 'Policy floor applied' END,
   CASE WHEN exceeds THEN 'Current source evidence exceeds the saved inference; its likelihood and remediation floor take precedence. Review the saved explanation.' END,
   CASE WHEN understates THEN 'The saved assessment calls this ' || saved_model || ', but the vendor-published severity selects '
     || determined || '. The higher remediation floor applies; the saved explanation describes a lesser record.' END) END AS reasons
  FROM prof0""", ["prof0"])
def baseline(spark, sf):
    return risk.with_baseline(B.records(spark, sf)).select(
        "cve", F.col("base_likelihood").alias("base_l"), F.col("base_action").alias("base_a"),
        F.col("base_model").alias("base_m"), flat(F.col("base_reasons")).alias("reasons"))


@register("r4_archetype_mismatch", """SELECT cve, saved_model AS saved, determined, understates FROM ev3
  WHERE mismatch""", ["ev3"])
def mismatch(spark, sf):
    return (risk.with_baseline(B.records(spark, sf)).where("archetype_saved is not null").select(
        "cve", F.col("archetype_saved").alias("saved"), F.col("archetype_determined").alias("determined"),
        F.col("archetype_understates").alias("understates")))


@register("r5_residual_profile", """SELECT cve, base_l, base_a, res_l, res_a, base_m, applied, ignored FROM prof""", ["prof"])
def residual(spark, sf):
    return risk.with_profile(B.records(spark, sf), SELECTION).select(
        "cve", F.col("base_likelihood").alias("base_l"), F.col("base_action").alias("base_a"),
        F.col("resid_likelihood").alias("res_l"), F.col("resid_action").alias("res_a"),
        F.col("base_model").alias("base_m"), flat(F.transform("applied", lambda c: c.id)).alias("applied"),
        flat(F.col("ignored")).alias("ignored"))


@register("r5_residual_reasons", """SELECT cve, concat_ws('|', CASE WHEN n_applied > 0 THEN n_applied ||
   ' verified exploit-relevant mitigation' || (CASE WHEN n_applied = 1 THEN '' ELSE 's' END) || ' applied' END,
   CASE WHEN car IS DISTINCT FROM false AND flr = 2 AND res_a = 2 THEN base_reason || '; the model enforces an out-of-cycle remediation floor' END) AS extra
   FROM prof""", ["prof"])
def residual_reasons(spark, sf):
    return risk.with_profile(B.records(spark, sf), SELECTION).select("cve", flat(F.slice(
        "reasons", F.size("base_reasons") + 1, F.greatest(F.size("reasons") - F.size("base_reasons"), F.lit(0))
    )).alias("extra"))


@register("r6_public_profile", f"""SELECT cve, {pick(list(vocab.PRIORITY_LABELS[a] for a in vocab.ACTIONS), 'base_a')} AS baseline_action,
   {pick(list(vocab.PRIORITY_LABELS[a] for a in vocab.ACTIONS), 'res_a')} AS residual_action,
   {pick(vocab.LIKELIHOODS, 'res_l')} AS residual_likelihood, base_a <> res_a OR base_l <> res_l AS adjusted FROM prof""", ["prof"])
def public_profile(spark, sf):
    out = risk.with_profile(B.records(spark, sf), SELECTION)
    return out.select("cve", risk.profile_struct(public=True).alias("p"),
                      risk.adjusted_by_controls().alias("adjusted")).select(
        "cve", F.col("p.baseline.action").alias("baseline_action"),
        F.col("p.residual.action").alias("residual_action"),
        F.col("p.residual.likelihood").alias("residual_likelihood"), "adjusted")


@register("r10_interpretation", """SELECT CASE WHEN has_fw AND k % 4 <> 1 THEN 'summary'
   WHEN car = false THEN 'no-action' WHEN kev OR det THEN 'exploited' WHEN rce AND base_l = 2 THEN 'rce'
   WHEN band = 'unknown' THEN 'unknown' WHEN band = 'critical' THEN 'critical' ELSE 'other' END AS kind,
   count(*) AS records FROM base GROUP BY 1""", ["base"])
def interpretation(spark, sf):
    text = risk.interpretation()
    kind = (F.when(text.startswith("Assessed "), "summary").when(text.startswith("Microsoft states"), "no-action")
            .when(text.contains("confirmed exploitation"), "exploited").when(text.contains("combination"), "rce")
            .when(text.startswith("No party"), "unknown").when(text.startswith("Out-of-cycle"), "critical")
            .otherwise("other"))
    return risk.with_baseline(B.records(spark, sf)).groupBy(kind.alias("kind")).agg(F.count("*").alias("records"))


_SWEEP = """WITH e AS (SELECT b.k, b.cve, e.id, b.base_l, b.base_a, b.base_m, b.car, e.ls, e.cs, e.block, e.rel AND NOT e.incompatible AS ok, e.confidence
   FROM base b JOIN elig e ON e.k = b.k WHERE b.car IS DISTINCT FROM false),
 r AS (SELECT e.*, a.floor0, a.floor1, block AND confidence = 'high' AS blk,
   least(ls, CASE WHEN block AND confidence = 'high' THEN 2 ELSE 1 END) AS lc, least(cs, 1) AS cc FROM e JOIN arch a ON a.model = e.base_m WHERE ok),
 z AS (SELECT id AS control, greatest(0, base_l - lc) AS rl, greatest(greatest(1, CASE WHEN blk THEN floor1 ELSE floor0 END),
   base_a - (CASE WHEN lc >= 1 OR cc >= 1 THEN 1 ELSE 0 END) - (CASE WHEN lc >= 2 AND cc >= 1 THEN 1 ELSE 0 END)) AS ra,
   base_l, base_a FROM r)"""


@register("j12_control_sweep", _SWEEP + f"""
 , allc AS (SELECT unnest({vocab.CONTROL_IDS}) AS control)
 SELECT allc.control, (SELECT count(*) FROM base) AS records, count(z.control) AS applied,
   count(*) FILTER (z.ra < z.base_a) AS action_lowered, count(*) FILTER (z.rl < z.base_l) AS likelihood_lowered
 FROM allc LEFT JOIN z ON z.control = allc.control GROUP BY 1""", ["base", "elig", "arch"])
def control_sweep(spark, sf):
    swept = risk.control_sweep(B.records(spark, sf))
    return swept.groupBy("control").agg(
        F.count("*").alias("records"), F.count_if(F.size("applied") > 0).alias("applied"),
        F.count_if(F.col("resid_action") < F.col("base_action")).alias("action_lowered"),
        F.count_if(F.col("resid_likelihood") < F.col("base_likelihood")).alias("likelihood_lowered"))


@register("v16_selection_audit", f"""WITH ok AS (SELECT e.k, e.id, e.ls FROM elig e JOIN rec q ON q.k = e.k WHERE e.rel AND NOT e.incompatible AND q.car IS DISTINCT FROM false),
  x AS (SELECT r.k, r.cve, r.av, r.has_uc, (SELECT string_agg(id, '|' ORDER BY id) FROM ok WHERE ok.k = r.k) AS applied,
    (SELECT string_agg(id, '|' ORDER BY id) FROM cand c WHERE c.k = r.k AND c.relevance = 'relevant' AND c.confidence <> 'low') AS expected FROM rec r)
  SELECT cve, 'eligible-mismatch' AS violation FROM x WHERE applied IS DISTINCT FROM expected
  UNION ALL SELECT cve, 'network-control' FROM x WHERE av NOT IN ('network', 'adjacent') AND EXISTS (SELECT 1 FROM ok WHERE ok.k = x.k AND id IN {inlist([c for c in vocab.NETWORK_CONTROLS if c != 'isolation_airgap'])})
  UNION ALL SELECT cve, 'content-control' FROM x WHERE NOT has_uc AND EXISTS (SELECT 1 FROM ok WHERE ok.k = x.k AND id IN {inlist(vocab.CONTENT_CONTROLS)})
  UNION ALL SELECT cve, 'response-control' FROM x WHERE EXISTS (SELECT 1 FROM ok WHERE ok.k = x.k AND ls <> 0 AND id IN {inlist(vocab.RESPONSE_CONTROLS)})""", ["elig", "cand", "rec"])
def selection_audit(spark, sf):
    return risk.selection_violations(B.records(spark, sf))


@register("v16_credit_property_audit", """WITH ids AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS bit, ls, cs, block, confidence,
   rel AND NOT incompatible AS ok FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY pos) AS r FROM (
     SELECT e.* FROM elig e WHERE EXISTS (SELECT 1 FROM cand c WHERE c.k = e.k AND c.id = e.id AND c.relevance = 'relevant'
       AND c.confidence <> 'low' AND (c.ls > 0 OR c.cs > 0)))) WHERE r = 1),
 masks AS (SELECT k, unnest(range(1 << n)) AS mask FROM (SELECT b.k, count(i.id) AS n FROM base b LEFT JOIN ids i ON i.k = b.k GROUP BY b.k)),
 s AS (SELECT m.k, m.mask, coalesce(sum(ls) FILTER (ok), 0) AS ls, coalesce(sum(cs) FILTER (ok), 0) AS cs,
   coalesce(bool_or(block AND confidence = 'high') FILTER (ok), false) AS blk
   FROM masks m LEFT JOIN ids i ON i.k = m.k AND (m.mask >> i.bit) & 1 = 1 GROUP BY 1, 2),
 p AS (SELECT b.cve, s.mask, b.base_l, b.base_a, b.car, blk, CASE WHEN blk THEN floor1 ELSE floor0 END AS flr,
   CASE WHEN car = false THEN 0 ELSE least(ls, CASE WHEN blk THEN 2 ELSE 1 END) END AS lc, CASE WHEN car = false THEN 0 ELSE least(cs, 1) END AS cc
   FROM s JOIN base b ON b.k = s.k JOIN arch a ON a.model = b.base_m),
 f AS (SELECT *, CASE WHEN car = false THEN base_l ELSE greatest(0, base_l - lc) END AS rl, CASE WHEN car = false THEN base_a ELSE
   greatest(greatest(1, flr), base_a - (CASE WHEN lc >= 1 OR cc >= 1 THEN 1 ELSE 0 END) - (CASE WHEN lc >= 2 AND cc >= 1 THEN 1 ELSE 0 END)) END AS ra FROM p)
 SELECT violation, count(*) AS cases FROM (
   SELECT 'raised-action' AS violation FROM f WHERE ra > base_a UNION ALL SELECT 'raised-likelihood' FROM f WHERE rl > base_l
   UNION ALL SELECT 'erased-patch-obligation' FROM f WHERE car IS DISTINCT FROM false AND ra < 1
   UNION ALL SELECT 'stacked-credit' FROM f WHERE car IS DISTINCT FROM false AND base_l - rl > (CASE WHEN blk THEN 2 ELSE 1 END)
   UNION ALL SELECT 'broke-floor' FROM f WHERE ra < flr) GROUP BY 1""", ["base", "elig", "cand", "arch"])
def property_audit(spark, sf):
    return risk.credit_violations(B.records(spark, sf)).groupBy("violation").agg(F.sum("cases").alias("cases"))


@register("v16_unrelated_controls", f"""SELECT b.cve, c.control FROM base b JOIN arch a ON a.model = b.base_m,
   (SELECT unnest({vocab.CONTROL_IDS}) AS control) c WHERE car IS DISTINCT FROM false AND greatest(1, floor0) > base_a
   AND NOT EXISTS (SELECT 1 FROM cand d WHERE d.k = b.k AND d.id = c.control AND d.relevance = 'relevant' AND d.confidence <> 'low')""",
          ["base", "arch", "cand"])
def unrelated(spark, sf):
    return risk.unrelated_control_effect(B.records(spark, sf))


@register("j14_relevant_controls", f"""SELECT cve, {pick([c[1] for c in vocab.CONTROLS], idx(vocab.CONTROL_IDS, 'id'))} AS name,
   CASE WHEN confidence = 'low' THEN 'no credit · low confidence' ELSE 'likelihood −' || ls || ', consequence −' || cs
     || CASE WHEN block THEN ' · blocks the path' ELSE '' END END AS credit FROM cand WHERE relevance = 'relevant'""", ["cand"])
def relevant_controls(spark, sf):
    from advislake.operators import joins
    return joins.relevant_controls(B.records(spark, sf)).select("cve", "name", "credit")


# --- scalar functions ------------------------------------------------------------------
@register("c1_format_priority", f"""SELECT {pick(list(vocab.PRIORITY_LABELS[a] for a in vocab.ACTIONS), 'base_a')} AS label,
   count(*) AS records FROM base GROUP BY 1""", ["base"])
def priority_label(spark, sf):
    from advislake.functions.exprs import label_of
    lab = scalar.format_priority(label_of(vocab.ACTIONS, F.col("base_action")))
    return risk.with_baseline(B.records(spark, sf)).groupBy(lab.alias("label")).agg(F.count("*").alias("records"))


@register("c2_format_priority_text", """SELECT cve, replace(replace(replace(replace(t, 'Defer and review', 'No customer action'), 'out-of-cycle', 'Expedited'),
   'Immediate', 'Emergency'), '|scheduled patching', '|Normal scheduled patching') AS text FROM (
   SELECT cve, title || ': Immediate or out-of-cycle, then Defer and review|scheduled patching, normal scheduled action, scheduled work' AS t FROM adv)""", ["adv"])
def priority_text(spark, sf):
    t = F.concat("title", F.lit(": Immediate or out-of-cycle, then Defer and review|scheduled patching, "
                                "normal scheduled action, scheduled work"))
    return B.advisories(spark, sf).select("cve", scalar.format_priority_text(t).alias("text"))


_FIXED = ("CASE WHEN {v} * {p} = floor({v} * {p}) AND floor({v} * {p})::BIGINT % 2 = 1 THEN printf('%.{d}f', {v} + 0.0001) "
          "ELSE printf('%.{d}f', {v}) END")
_EPSS_TEXT = f"""CASE WHEN epss IS NULL THEN 'Not yet scored' WHEN p > 0 AND p < 0.01 THEN '<0.01%'
   WHEN p < 1 AND ({_FIXED.format(v='p', p=8, d=2)})::DOUBLE >= 1 THEN (printf('%.3f', p))::DOUBLE || '%'
   WHEN p < 10 AND p >= 1 AND ({_FIXED.format(v='p', p=4, d=1)})::DOUBLE >= 10 THEN (printf('%.3f', p))::DOUBLE || '%'
   WHEN p < 1 THEN ({_FIXED.format(v='p', p=8, d=2)}) || '%' ELSE ({_FIXED.format(v='p', p=4, d=1)}) || '%' END"""


@register("c3_format_epss", f"""SELECT cve, {_EPSS_TEXT} AS shown FROM (SELECT cve, epss, epss * 100 AS p FROM facts)""", ["facts"])
def format_epss(spark, sf):
    return B.records(spark, sf).select("cve", scalar.format_epss(F.col("threat.epss")).alias("shown"))


@register("c4_epss_display", f"""SELECT cve, CASE epss_status WHEN 'pending' THEN s || ' · feed 2026-09-10'
   WHEN 'stale' THEN s || ' · previous published value'
   ELSE s || ' · ' || ({_FIXED.format(v='q', p=4, d=1)}) || 'th percentile' END AS shown
  FROM (SELECT cve, epss_status, percentile * 100 AS q, {_EPSS_TEXT} AS s FROM (SELECT *, epss * 100 AS p FROM facts))""", ["facts"])
def epss_display(spark, sf):
    return B.records(spark, sf).select("cve", scalar.epss_display().alias("shown"))


@register("c5_vendor_assessment_label", """SELECT CASE exa WHEN 'detected' THEN 'Detected' WHEN 'more-likely' THEN 'More likely'
   WHEN 'less-likely' THEN 'Less likely' WHEN 'unlikely' THEN 'Unlikely' ELSE 'Not published' END AS label, count(*) AS records
   FROM facts GROUP BY 1""", ["facts"])
def vendor_label(spark, sf):
    lab = scalar.format_vendor_assessment(F.col("threat.exploitation_assessment"))
    return B.records(spark, sf).groupBy(lab.alias("label")).agg(F.count("*").alias("records"))


@register("c6_epss_band", """SELECT CASE WHEN epss IS NULL THEN 'absent' WHEN epss >= 0.1 THEN 'elevated' WHEN epss >= 0.01 THEN 'plausible'
   ELSE 'low' END AS band, count(*) AS records FROM facts GROUP BY 1""", ["facts"])
def epss_bands(spark, sf):
    return B.records(spark, sf).groupBy(scalar.epss_band(F.col("threat.epss")).alias("band")).agg(
        F.count("*").alias("records"))


def _replaced(text, steps):
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


_BLOCK, _NL = "p|div|li|h[1-6]", "chr(10)"
_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_BARE = _replaced("html", [
    ("(?s)<!--.*?-->", "''"), *[(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "''") for t in ("script", "style", "template", "iframe")],
    (r">\s*\\[rn]\s*<", "'>' || chr(10) || '<'"), (rf"(?i)(</(?:{_BLOCK})>)[ \t]*\\[rn]\s*\z", r"'\1'"),
    (rf"(?i)<br\s*/?>|</(?:{_BLOCK}|tr|section|blockquote)\s*>", f"{_NL} || {_NL}"), (r"(?i)<li\b[^>]*>", "'• '"), ("<[^>]*>", "''")])
_PLAIN = _replaced("replace(replace(t, '&quot;', '\"'), '&amp;', '&')", [
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "''"), (r"[ \t]+\n", _NL), (r"\n{3,}", f"{_NL} || {_NL}"), (rf"^{_BLANK}+|{_BLANK}+\z", "''")])


@register("c8_source_plain_text", f"SELECT page_id, {_PLAIN} AS text FROM (SELECT page_id, {_BARE} AS t FROM pages)")
def plain_text(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", scalar.source_plain_text(F.col("html")).alias("text"))


@register("c10_strip_markup", """SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM (
   SELECT page_id, regexp_replace(html, '&', 'and', 'g') AS html FROM pages)""")
def strip_markup(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", scalar.strip_markup(F.replace(
        F.col("html"), F.lit("&"), F.lit("and"))).alias("text"))


@register("c10_entities", """SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'),
  '&quot;', '"'), '&amp;', '&') AS text FROM pages""")
def entities(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", scalar.strip_markup(F.col("html")).alias("text"))


@register("c11_canonical_sha256", """SELECT cve, sha256('{"cve":"' || cve || '","score":' || coalesce(CAST(base_score AS VARCHAR), 'null')
   || ',"title":"' || title || '"}') AS digest FROM adv""", ["adv"])
def canonical_digest(spark, sf):
    return B.advisories(spark, sf).select("cve", scalar.canonical_sha256(
        {"title": F.col("title"), "cve": F.col("cve"), "score": F.col("base_score")}).alias("digest"))
