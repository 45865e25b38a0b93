"""Update availability and review status of records."""
from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import (filled, index_of, overlaps, reusable, settle, struct_of, truthy, within,
                                       words)
from advislake.operators.parse import issuing_cna, record_url, ssvc
from advislake.operators.risk import (exploited, framework_usable, fw, misses_impact_judgement,
                                      no_customer_action, superseded, with_baseline)
from advislake.operators.severity import severity_band


# --- update availability, long form ------------------------------------------------------
def update_status(products: DataFrame, remediations: DataFrame) -> DataFrame:
    """Per product: available, kind, kb, url.

    products: cve, product_id, name. remediations: cve, pos, type, subtype, url,
    description, product_id, one row per listed product. One aggregation on
    (cve, product_id) keeps the first of each kind, with partial aggregates before the
    shuffle.
    """
    kind, subtype = F.col("type").cast("string"), F.col("subtype")
    kb = F.when(kind == "3", subtype).when(kind == "6", F.col("description"))
    kb_pos = F.when(F.coalesce(kb, F.lit("")) != "", F.col("pos"))
    fix_pos = F.when(kind == "2", F.col("pos"))
    fix = F.coalesce(F.nullif(subtype, F.lit("")), F.lit("Security Update"))
    facts = remediations.groupBy("cve", "product_id").agg(
        F.min_by(F.struct(kb.alias("kb"), F.nullif("url", F.lit("")).alias("url")), kb_pos).alias("ref"),
        F.min_by(fix, fix_pos).alias("kind"))
    return products.join(facts, ["cve", "product_id"], "left").select(
        "cve", "product_id", "name", F.col("kind").isNotNull().alias("available"), "kind",
        F.col("ref.kb").alias("kb"), F.col("ref.url").alias("url"))


def update_summary(status: DataFrame, records: DataFrame, selected=()) -> DataFrame:
    """Per record: total, available, missing and the flag, scoped to selected products.

    ``records``: cve, tags, product_tags. The missing products' names come with the record;
    they are as many as its products at most.
    """
    counts = status.groupBy("cve").agg(F.count("*").alias("total"),
                                       F.count_if("available").alias("available"),
                                       F.array_sort(F.collect_list(F.when(~F.col("available"), F.coalesce(
                                           "name", "product_id")))).alias("missing_names"))
    out = records.join(counts, "cve", "left").withColumns({
        "total": F.coalesce("total", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    in_scope = overlaps(F.concat(F.coalesce("product_tags", words([])), F.coalesce("tags", words([]))),
                        list(selected))
    missing = F.col("total") - F.col("available")
    flag = (in_scope & (missing > 0)) if selected else (
        (F.col("total") > 0) & (F.col("available") == 0))
    return out.select("cve", "total", "available", missing.alias("missing"), flag.alias("flag"),
                      F.coalesce("missing_names", words([])).alias("missing_names"))


def pending_first(status: DataFrame) -> DataFrame:
    """Products still waiting for an update before those that have one."""
    return status.orderBy("cve", "available", "product_id")


# --- update availability, nested form ----------------------------------------------------
def fixed_products() -> Column:
    """Product ids with a listed fix, from the record's own remediation array."""
    fixes = F.filter("vendor_guidance.remediations", lambda r: r["type"].cast("string") == "2")
    return F.coalesce(F.flatten(F.transform(fixes, lambda r: F.coalesce(r.product_ids, words([])))), words([]))


def update_counts() -> Column:
    """struct<total, available> from nested products and remediations, row-local."""
    ids = F.transform("products", lambda p: p.product_id)
    fixed = fixed_products()
    # an intersection hashes both sides; repeated ids need the slower exact count
    available = F.when(F.size(F.array_distinct(ids)) == F.size(ids),
                       F.size(F.array_intersect(ids, fixed))).otherwise(
        F.size(F.filter(ids, lambda i: F.array_contains(fixed, i))))
    return struct_of(total=F.coalesce(F.size("products"), F.lit(0)),
                     available=F.coalesce(available, F.lit(0)))


# --- review status -----------------------------------------------------------------------
# fixed values: doubts that contradict the guidance, and those that only weigh it
CONFLICT = r"(?i)\b(?:conflicts?|conflicting|contradict\w*|inconsisten\w*|discrepanc\w*|tension)\b"
INTERPRETATION_ONLY = (
    r"(?i)simplistic|simple .{0,25}interpretation|EPSS signal conflicts|Critical severity.*CVSS"
    r"|between Critical severity and|privileges-required value conflicts with the FAQ.s "
    r"authorized-user SQL Copilot workflow|CVSS says no user interaction while the FAQ describes "
    r"file opening or preview rendering")

# fixed values: the reason texts by code; braces mark values of the record
MESSAGES = {
    "missing-vendor-severity/cna": "Microsoft declined to rate this CVE because {cna} assigned it, so there is no severity, CVSS or Exploitability Index here. Read the assigning CNA's own rating before deciding.",
    "missing-vendor-severity": "The vendor published no severity rating and no CVSS score. Establish the real severity before deciding.",
    "third-party-cna/own": "{cna} assigned this CVE and the rating shown is {cna}'s own, on {cna}'s scale. Microsoft did not rate it.",
    "third-party-cna": "{cna} assigned this CVE; the rating shown is Microsoft's, not {cna}'s. Check the two agree before citing either.",
    "severity-divergence/assessment": "Two parties rated this on comparable evidence and disagreed. The higher rating is in force; read both before deciding.",
    "severity-divergence": "Two parties rated this on scales that do not compare. The higher normalised band is in force; read both on their own scales.",
    "missing-impact-judgement": "No impact tag was asserted for a high-severity, pre-authentication, network-reachable vulnerability. Establish what it actually does before relying on the remediation floor.",
    "attack-path-unknown": "The advisory does not establish the attack entry path. No mitigation reduction is established.",
    "missing-assessment": "Obtain an inference assessment for this CVE.",
    "superseded-assessment/pinned": "The severity evidence changed after the saved assessment. Deterministic policy is in force; re-run inference for this CVE.",
    "superseded-assessment": "The saved assessment was made against a severity another vendor has since overruled, so it no longer describes this record. Deterministic policy is in force; re-run inference for this CVE.",
    "unusable-assessment": "The saved assessment failed validation, so no model judgement is in force. Re-run inference for this CVE.",
    "low-confidence": "Check the assessment's low-confidence conclusion.",
    "guidance-discrepancy": "Check the reported discrepancy in exploit, impact or product guidance.",
    "no-update-available": "No vendor fix is listed for any affected product.",
    "archetype-contradicts-severity/understates": "The saved assessment treats this as routine remediation, but a vendor rated it critical. The higher remediation floor is in force; the written explanation describes a lesser record and should not be relied on.",
    "archetype-contradicts-severity": "The saved explanation cites a severity no vendor published for this CVE. The priority shown is unchanged, but the stated reasoning for it is wrong.",
    "changed-threat-evidence": "Recheck the explanation against the newer threat evidence.",
    "workload-priority": "Confirm the workload role and exposure supporting Emergency priority.",
    "incomplete-prerequisites": "Confirm the missing CVSS or exploit-prerequisite details.",
    "stale-threat-data": "Refresh the stale threat data before relying on the assessment.",
    "public-exploit-evidence/active": "CISA records this as actively exploited, and neither KEV nor the vendor says so here. Confirm before scheduling.",
    "public-exploit-evidence": "A public proof of concept exists for this CVE, which no other signal in this record reflects. Confirm before scheduling.",
    "automatable": "CISA assesses the exploitation steps for this CVE as automatable, so it is a candidate for mass exploitation rather than targeted use.",
    "ssvc-technical-impact": "No vendor severity exists, but CISA assesses the technical impact as {impact}.",
    "ssvc-absent": "No CISA exploitation assessment is available for this CVE, so its exploitation status is unknown rather than quiet.",
}


def number_text(value: Column) -> Column:
    """Shortest text of a number; whole numbers carry no decimals."""
    whole = value.cast("double") == F.floor(value.cast("double"))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _text(key: str, **values) -> Column:
    out = F.lit(MESSAGES[key])
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _reason(code: str, message: Column, evidence=None, informational: bool = False) -> Column:
    evidence = F.lit("") if evidence is None else F.coalesce(evidence, F.lit(""))
    return struct_of(code=code, message=message, evidence=evidence, informational=informational)


def _reasons(s: dict) -> Column:
    """All review reasons of a record in their fixed order; needs the baseline columns."""
    cna, band, point = s["cna"], s["band"], s["pt"]
    third_party = truthy(cna != "Microsoft")
    unknown = band == "unknown"
    where = F.concat(F.lit("Issuing CNA: "), cna, F.lit(". Rating: "),
                     F.coalesce(record_url(F.col("cve")), F.lit("CVE Program record")))
    primary = F.nullif(F.col("severity.primary"), F.lit(""))
    rating = (
        F.when(unknown & third_party, _reason(
            "missing-vendor-severity", _text("missing-vendor-severity/cna", cna=cna), where))
        .when(unknown, _reason("missing-vendor-severity", _text("missing-vendor-severity"), F.lit(
            "No vendor severity and no CVSS score on the source record.")))
        .when(third_party, _reason(
            "third-party-cna", F.when(truthy(primary != "microsoft"), _text("third-party-cna/own", cna=cna))
            .otherwise(_text("third-party-cna", cna=cna)), where, True)))
    split = F.col("severity.divergence")
    parties = F.array_join(F.transform("severity.assessments", lambda a: F.concat(
        a.source, F.lit(" "), a.value)), " against ")
    spread = F.when(split["spread"].isNotNull(), F.concat(
        F.lit(" (CVSS spread "), number_text(split["spread"]), F.lit(")"))).otherwise("")
    divergence = F.when(split.isNotNull(), _reason(
        "severity-divergence", F.when(split["kind"] == "assessment", _text("severity-divergence/assessment"))
        .otherwise(_text("severity-divergence")), F.concat(parties, spread)))
    impact = F.when(misses_impact_judgement(), _reason(
        "missing-impact-judgement", _text("missing-impact-judgement"), F.concat(
            F.lit("base_score="), number_text(F.col("cvss.base_score")), F.lit(" vector="), F.col("attack.vector"),
            F.lit(" privileges_required="), F.col("attack.privileges_required"),
            F.lit(" user_interaction="), F.col("attack.user_interaction"))))
    lost = truthy(F.col("inference.attack_path.direction") == "unknown") | truthy(
        F.col("inference.direction_gate.status") == "unknown")
    path = F.when(lost, _reason("attack-path-unknown", _text("attack-path-unknown"),
                                F.col("inference.attack_path.evidence")))
    asked = F.when(truthy(fw("review_requirement.required")), F.transform(
        F.filter(fw("review_requirement.reasons"), filled),
        lambda r: _reason("source-assessment-uncertainty", r)))
    head = F.array(rating, divergence, impact, path)
    missing = F.col("inference.framework_assessment").isNull() | truthy(F.col("inference.model") == "none")
    judged = ~missing & ~s["stale"] & s["usable"]
    state = (
        F.when(missing, _reason("missing-assessment", _text("missing-assessment")))
        .when(s["stale"], _reason(
            "superseded-assessment", F.when(F.col("inference.severity_basis").isNotNull(), _text(
                "superseded-assessment/pinned")).otherwise(_text("superseded-assessment")),
            F.concat(F.lit("normalized_band="), band, F.lit(" basis="),
                     F.coalesce("severity.normalized_basis", F.lit("absent")))))
        .when(~s["usable"], _reason("unusable-assessment", _text("unusable-assessment"), F.concat(
            F.lit("risk_model_version="), F.coalesce(fw("risk_model_version"), F.lit("absent")),
            F.lit(" baseline_model="), F.coalesce(fw("baseline_model"), F.lit("absent"))))))
    doubt = F.coalesce(F.try_element_at(fw("factors"), F.lit("uncertainty")), F.lit(""))
    workload = F.try_element_at(fw("factors"), F.lit("workload_context"))
    total, available = s["updates"]["total"], s["updates"]["available"]
    contested = F.rlike(doubt, F.lit(CONFLICT)) & ~F.rlike(doubt, F.lit(INTERPRETATION_ONLY))
    checks = F.array(
        F.when(judged & truthy(fw("confidence") == "low"),
               _reason("low-confidence", _text("low-confidence"), doubt)),
        F.when(judged & contested, _reason("guidance-discrepancy", _text("guidance-discrepancy"), doubt)),
        F.when(judged & (total > 0) & (available == 0), _reason(
            "no-update-available", _text("no-update-available"), F.concat(
                F.lit("0 of "), total.cast("string"), F.lit(" affected products have a listed update")))),
        F.when(judged & F.col("archetype_saved").isNotNull(), _reason(
            "archetype-contradicts-severity", F.when(
                F.col("archetype_understates"), _text("archetype-contradicts-severity/understates"))
            .otherwise(_text("archetype-contradicts-severity")), F.concat(
                F.lit("saved baseline_model="), F.col("archetype_saved"), F.lit(", severity band="), band,
                F.lit(" selects "), F.col("archetype_determined")))),
        F.when(judged & (F.col("base_likelihood") > index_of(vocab.LIKELIHOODS, fw("baseline_likelihood"))),
               _reason("changed-threat-evidence", _text("changed-threat-evidence"))),
        F.when(judged & (F.col("base_action") == 3) & (F.col("base_likelihood") < 2),
               _reason("workload-priority", _text("workload-priority"), workload)))
    unstated = F.col("cvss.base_score").isNull()
    for name in ("vector", "privileges_required", "user_interaction"):
        value = F.coalesce(F.col(f"attack.{name}"), F.lit(""))
        unstated = unstated | value.isin("", "unknown")
    quiet = F.col("cve_program").isNotNull() & point.isNull()
    exposed = within(point["exploitation"], ["poc", "active"]) & ~exploited()
    stated = lambda name: F.coalesce(point[name], F.lit("unstated"))
    tail = F.array(
        F.when(unstated, _reason("incomplete-prerequisites", _text("incomplete-prerequisites"))),
        F.when(truthy(F.col("threat.epss_status") == "stale"),
               _reason("stale-threat-data", _text("stale-threat-data"))),
        F.when(exposed, _reason(
            "public-exploit-evidence", F.when(point["exploitation"] == "active", _text(
                "public-exploit-evidence/active")).otherwise(_text("public-exploit-evidence")), F.concat(
                F.lit("CISA-ADP SSVC Exploitation: "), point["exploitation"], F.lit(". Automatable: "),
                stated("automatable"), F.lit(". Technical Impact: "), stated("technical_impact"), F.lit(".")))),
        F.when(truthy(point["automatable"] == "yes"), _reason(
            "automatable", _text("automatable"), F.lit("CISA-ADP SSVC Automatable: yes"), True)),
        F.when(unknown & truthy(point["technical_impact"] != ""), _reason(
            "ssvc-technical-impact", _text("ssvc-technical-impact", impact=point["technical_impact"]),
            F.concat(F.lit("CISA-ADP SSVC Technical Impact: "), point["technical_impact"]), True)),
        F.when(quiet, _reason("ssvc-absent", _text("ssvc-absent"), F.coalesce(
            F.nullif("cve_program.ssvc_absent_reason", F.lit("")), F.col("cve_program.status")), True)))
    everything = F.array_compact(F.concat(
        head, F.coalesce(asked, F.filter(head, lambda r: F.lit(False))), F.array(state), checks, tail))
    return F.when(no_customer_action(), F.filter(everything, lambda r: F.lit(False))).otherwise(everything)


@reusable
def _review_stages() -> list:
    facts = {"cna": issuing_cna(F.col("vendor_guidance.notes")), "band": severity_band(),
             "pt": ssvc(), "stale": superseded(), "usable": framework_usable(),
             "updates": update_counts()}
    return [{f"_{n}": c for n, c in facts.items()},
            {"_r": _reasons({n: F.col(f"_{n}") for n in facts})},
            {"_review": struct_of(required=F.exists("_r", lambda x: ~x["informational"]),
                                  reasons=F.col("_r"))}]


def with_review(df: DataFrame) -> DataFrame:
    """Adds review: struct<required, reasons[code, message, evidence, informational]>."""
    based = (df if "base_action" in df.columns else with_baseline(df)).drop("review")
    out = based
    for stage in _review_stages():
        out = out.withColumns(stage)
    return settle(out.select(*based.columns, "_review"), based.columns, {"review": F.col("_review")})
