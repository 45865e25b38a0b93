"""The merge of authored overlays into a baseline, with every gate run in order."""
from pyspark.sql import DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import words
from advislake.operators import gates, joins


def _under_review(baseline: DataFrame, overlays: DataFrame) -> DataFrame:
    """Overlay rows beside the source facts of their record."""
    facts = baseline.drop("tags", "mitigation_candidates", "inference", "cvss_basis")
    return overlays.join(facts, "cve", "inner")


def merge_violations(baseline: DataFrame, overlays: DataFrame, complete: bool = False) -> DataFrame:
    """(cve, gate, violation) of everything that forbids a merge; no rows means it may go on.

    ``overlays``: cve, tags, mitigation_candidates, inference (with framework assessment and
    attack path) and cvss_basis. Claims are judged as authored, before any credit is removed.
    """
    rows = _under_review(baseline, overlays)
    named = lambda df, gate: df.select("cve", F.lit(gate).alias("gate"), "violation")
    per_row = lambda array, gate: named(rows.select("cve", F.explode(array).alias("violation")), gate)
    per_control = lambda check, gate: named(gates.candidate_violations(rows, check).select(
        "cve", F.concat("control", F.lit(":"), "violation").alias("violation")), gate)
    absent = overlays.join(baseline.select("cve"), "cve", "left_anti").select("cve", F.lit("absent-from-baseline").alias("violation"))
    repeated = overlays.groupBy("cve").agg(F.count("*").alias("n")).where("n > 1").select(
        "cve", F.lit("repeated-overlay").alias("violation"))
    found = [named(absent, "overlay-id"), named(repeated, "overlay-id"),
             per_row(gates.cvss_basis_errors(), "cvss-basis"),
             per_row(F.concat(gates.framework_errors(), F.coalesce(gates.floor_errors(), words([])),
                              gates.archetype_error()), "framework"),
             per_row(F.array_except(F.coalesce("tags", words([])), words(vocab.ALL_TAGS)), "tags"),
             per_control(gates.candidate_errors, "candidate"), per_control(gates.path_errors, "path")]
    if complete:
        found.append(named(baseline.join(overlays.select("cve"), "cve", "left_anti").select(
            "cve", F.lit("not-reviewed").alias("violation")), "completeness"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def merge_release(baseline: DataFrame, overlays: DataFrame, complete: bool = False, include_unreviewed: bool = False,
                  allow_missing_direction: bool = False) -> DataFrame:
    """The merged release: tags united, candidates and judgement replaced, the direction gate last.

    The gate is written into ``inference.direction_gate`` of every merged record. A complete merge
    pins the severity facts that complete, schema-enforced assessments were made on. Repeated and
    absent ids are violations, see ``merge_violations``; here they would repeat or lose rows.
    """
    gated = gates.with_direction_gate(overlays, allow_missing_direction)
    authored = gated.select("cve", F.col("tags").alias("o_tags"), F.col("mitigation_candidates").alias("o_candidates"),
                            F.col("inference").withField("direction_gate", F.col("direction_gate")).alias("o_inference"))
    merged = joins.merge_overlay(baseline, authored)
    if complete:
        at = lambda path: F.try_variant_get(F.col(path.split("$")[0]), "$." + path.split("$")[1], "string")
        staged = merged.withColumns({
            "assessment_status": F.col("inference.assessment_status"), "guidance_version": F.col("inference.guidance_version"),
            "validation_type": at("inference.pipeline_validation$type"),
            "schema_enforced": at("inference.invocation$schema_enforced") == "true"})
        pinned = gates.with_severity_basis(staged)
        kind = merged.schema["inference"].dataType["severity_basis"].dataType
        basis = F.coalesce(F.from_json(F.to_json("pinned_basis"), kind), F.col("inference.severity_basis"))
        merged = pinned.withColumn("inference", F.col("inference").withField("severity_basis", basis)).select(*merged.columns)
    return joins.with_unreviewed(merged, baseline) if include_unreviewed else merged


def enforced(merged: DataFrame, violations: DataFrame) -> DataFrame:
    """``merged``, or a failed job that names the first violation."""
    first = violations.agg(F.min(F.concat_ws(" ", "cve", "gate", "violation"))).scalar()
    stop = F.when(first.isNotNull(), F.raise_error(F.concat(F.lit("merge refused: "), first)).cast("array<int>"))
    return merged.select("*", F.explode(F.coalesce(stop, F.array(F.lit(1)))).alias("_sound")).drop("_sound")
