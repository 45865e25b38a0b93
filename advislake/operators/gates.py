"""Validation gates: each returns violations as codes or rows; ``enforce`` fails the job."""
from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import (any_of, filled, has, index_of, label_of, lookup, overlaps,
                                       reasons, struct_of, truthy, within, words)
from advislake.operators.joins import control_directions
from advislake.operators.risk import (archetype, evidence_likelihood, exploited, fw, is_preauth_rce,
                                      no_customer_action)


def code(test: Column, name: str) -> Column:
    return F.when(test, F.lit(name))


def enforce(df: DataFrame, violations: str) -> DataFrame:
    """Fails the job on the first row with a violation."""
    message = F.concat(F.col("cve"), F.lit(": "), F.array_join(violations, ", "))
    return df.withColumn(violations, F.when(F.size(violations) > 0, F.raise_error(message).cast(
        "array<string>")).otherwise(F.col(violations)))


# --- assessment gates ----------------------------------------------------------------
def cvss_basis_errors() -> Column:
    """The overlay's stated basis must equal the source facts, field by field."""
    basis = F.col("cvss_basis")
    pairs = {"base_score": "cvss.base_score", "vector": "cvss.vector",
             "attack_vector": "attack.vector", "privileges_required": "attack.privileges_required",
             "user_interaction": "attack.user_interaction"}
    return reasons(code(basis.isNull(), "basis-missing"), *[
        code(basis.isNotNull() & ~basis[field].eqNullSafe(F.col(fact)), f"basis-{field}")
        for field, fact in pairs.items()])


def framework_errors() -> Column:
    """Closed vocabulary of a saved assessment."""
    stated = F.col("inference.framework_assessment").isNotNull()
    factors = fw("factors")
    blank = any_of([~filled(F.try_element_at(factors, F.lit(name))) for name in vocab.FACTORS])
    talk = lambda n: fw(f"risk_communication.{n}")
    silent = any_of([F.coalesce(talk(n), F.lit("")) == "" for n in vocab.COMMUNICATION[:3]]) | (
        F.coalesce(F.size(talk("reassessment_triggers")), F.lit(0)) < 1)
    return reasons(
        code(~stated, "framework-missing"),
        code(stated & ~truthy(fw("risk_model_version") == vocab.RISK_MODEL_VERSION), "model-version"),
        code(stated & ~within(fw("baseline_model"), list(vocab.ARCHETYPES)), "unknown-archetype"),
        code(stated & ~within(fw("baseline_likelihood"), vocab.LIKELIHOODS), "likelihood"),
        code(stated & ~within(fw("baseline_action"), vocab.ACTIONS), "action"),
        code(stated & ~within(fw("confidence"), ["high", "medium", "low"]), "confidence"),
        code(stated & blank, "factors"), code(stated & silent, "communication"))


def floor_errors() -> Column:
    """An assessment may not sit below what public facts require."""
    action = index_of(vocab.ACTIONS, fw("baseline_action"))
    like = index_of(vocab.LIKELIHOODS, fw("baseline_likelihood"))
    model, nca = fw("baseline_model"), no_customer_action()
    hit = ~nca & exploited()
    rce = ~nca & ~exploited() & is_preauth_rce()
    return F.when(F.col("inference.framework_assessment").isNotNull(), reasons(
        code(nca & ((model != "no-customer-action") | (action != 0)), "no-action-model"),
        code(hit & ((model != "active-exploitation") | (action != 3) | (like != 3)),
             "confirmed-exploitation"),
        code(rce & (action < 2), "preauth-rce-action"),
        code(rce & (evidence_likelihood() >= 2) & (model != "critical-preauth-network-rce"),
             "preauth-rce-archetype"),
        code(~nca & truthy(F.col("threat.exploitation_assessment") == "more-likely") & (like < 2),
             "more-likely-floor"),
        code(~nca & (like < evidence_likelihood()), "below-public-evidence"))).otherwise(words([]))


def archetype_error() -> Column:
    like = F.greatest(index_of(vocab.LIKELIHOODS, fw("baseline_likelihood")), F.lit(0))
    return reasons(code(truthy(fw("baseline_model") != archetype(like)), "archetype"))


# --- control gates -------------------------------------------------------------------
def _effect(c: Column):
    zero = F.lit(0)
    return (F.coalesce(c["effect"]["likelihood_steps"], zero),
            F.coalesce(c["effect"]["consequence_steps"], zero), truthy(c["effect"]["path_block"]))


def candidate_errors(c: Column) -> Column:
    ls, cs, block = _effect(c)
    return reasons(
        code(~within(c["id"], vocab.CONTROL_IDS), "unknown-control"),
        code(~within(c["relevance"], ["relevant", "not-relevant", "unknown"]), "relevance"),
        code(~within(c["confidence"], ["high", "medium", "low"]), "confidence"),
        code(~ls.isin(0, 1, 2) | ~cs.isin(0, 1, 2), "steps"),
        code(~truthy(c["relevance"] == "relevant") & ((ls != 0) | (cs != 0) | block),
             "credit-without-relevance"),
        code(block & ~(truthy(c["confidence"] == "high") & within(c["id"], vocab.PATH_BLOCK_CONTROLS)),
             "path-block"),
        code((ls == 2) & ~block, "two-steps"), code(~filled(c["evidence"]), "evidence"))


def path_errors(c: Column) -> Column:
    """Likelihood credit a control cannot give on the record's exploit path."""
    ls, _, _ = _effect(c)
    claims = ls != 0
    return reasons(
        code(claims & within(c["id"], vocab.NETWORK_CONTROLS)
             & ~within(F.col("attack.vector"), ["network", "adjacent"]), "network-control"),
        code(claims & within(c["id"], vocab.CONTENT_CONTROLS) & ~has(F.col("tags"), "user-content"),
             "content-control"),
        code(claims & within(c["id"], vocab.IDENTITY_CONTROLS)
             & ~within(F.col("attack.privileges_required"), ["low", "high"]), "identity-control"),
        code(claims & within(c["id"], vocab.RESPONSE_CONTROLS), "response-control"))


def candidate_violations(df: DataFrame, check=candidate_errors) -> DataFrame:
    """(cve, control, violation) rows of one control gate."""
    rows = df.withColumn("_c", F.explode("mitigation_candidates"))
    return rows.select("cve", F.col("_c.id").alias("control"),
                       F.explode(check(F.col("_c"))).alias("violation"))


def unknown_tags(df: DataFrame, taxonomy: DataFrame = None) -> DataFrame:
    """(cve, tag) of tags outside the taxonomy: the given (namespace, tag) rows, or the built-in one."""
    if taxonomy is not None:
        rows = df.select("cve", F.explode(F.array_distinct("tags")).alias("tag"))
        return rows.join(taxonomy.select("tag"), "tag", "left_anti").select("cve", "tag")
    return df.select("cve", F.explode(F.array_except("tags", words(vocab.ALL_TAGS))).alias("tag"))


# --- direction gate -------------------------------------------------------------------
def with_direction_gate(df: DataFrame, allow_missing: bool = True) -> DataFrame:
    """Zero credit that contradicts the asserted attack direction.

    Rewrites mitigation_candidates and adds direction_gate: struct<status, reason,
    violations>, the type of a saved gate. A violation tells the control, the directions it
    acts on, the credit claimed and a message. A missing direction is ``unchecked``, or fails
    the job when not allowed.
    """
    direction = F.col("inference.attack_path.direction")
    known = within(direction, vocab.DIRECTIONS)
    unknown = truthy(direction == "unknown")

    def contradicts(c):
        ls, cs, block = _effect(c)
        credited = (ls > 0) | block | (unknown & (cs > 0))
        return known & credited & (unknown | ~has(control_directions(c["id"]), direction))

    def cleared(c):
        _, cs, _ = _effect(c)
        return struct_of(
            id=c["id"], relevance="not-relevant", confidence=c["confidence"], evidence=c["evidence"],
            direction_override=F.lit(True),
            effect=struct_of(likelihood_steps=F.lit(0), consequence_steps=F.when(unknown, 0).otherwise(cs),
                             path_block=F.lit(False)))

    def violation(c):
        allowed = control_directions(c["id"])
        # fixed sentence: tools read it
        message = F.concat(c["id"], F.lit(" was credited against an "), direction, F.lit(
            " attack path but only acts on ['"), F.array_join(allowed, "', '"), F.lit(
            "']. Credit removed; assessment retained."))
        return struct_of(
            code="direction-contradiction", control=c["id"], direction=direction, applies_to_direction=allowed,
            claimed=struct_of(likelihood_steps=c["effect"]["likelihood_steps"], path_block=c["effect"]["path_block"]),
            evidence=F.coalesce(c["evidence"], F.lit("")), message=message)

    found = F.transform(F.filter("mitigation_candidates", contradicts), violation)
    status = (F.when(~known, "unchecked").when(unknown, "unknown")
              .when(F.size("_found") > 0, "violations-found").otherwise("clean"))
    reason = F.when(~known, "attack_path.direction is missing or invalid").when(
        unknown, "The source does not establish entry direction; mitigation reductions are not established.")
    if not allow_missing:
        status = F.when(~known, F.raise_error(F.concat(F.col("cve"), F.lit(
            ": attack_path.direction is missing or invalid"))).cast("string")).otherwise(status)
    rewritten = F.transform("mitigation_candidates", lambda c: F.when(
        contradicts(c), cleared(c)).otherwise(c))
    return df.withColumn("_found", found).withColumns({
        "mitigation_candidates": rewritten,
        "direction_gate": struct_of(status=status, reason=reason, violations=F.col("_found"))}).drop("_found")


def direction_summary(df: DataFrame) -> DataFrame:
    """One row: overlays, checked, records with contradicting credit, credits removed, unchecked."""
    gate = F.col("direction_gate")
    removed = F.size(gate["violations"])
    unchecked = gate["status"] == "unchecked"
    return df.agg(F.count("*").alias("overlays"), F.count_if(~unchecked).alias("checked"),
                  F.count_if(removed > 0).alias("contradicting"), F.sum(removed).alias("credits_removed"),
                  F.count_if(unchecked).alias("unchecked"))


# --- merge-time additions ---------------------------------------------------------------
def with_severity_basis(df: DataFrame) -> DataFrame:
    """Pin the severity facts of complete, schema-enforced assessments.

    Reads assessment_status, guidance_version, validation_type and schema_enforced.
    """
    pinned = (truthy(F.col("assessment_status") == "model-assessed")
              & truthy(F.col("guidance_version").startswith("monthly-"))
              & truthy(F.col("validation_type") == "automated-source-and-schema")
              & truthy(F.col("schema_enforced")) & F.col("severity").isNotNull())
    s = F.col("severity")
    basis = struct_of(
        primary=s["primary"], normalized_band=s["normalized_band"], normalized_basis=s["normalized_basis"],
        assessments=F.transform(s["assessments"], lambda a: a.dropFields("url")),
        derived_cvss=F.when(s["normalized_basis"] == "cvss-derived", struct_of(
            version=F.col("cvss.version"), base_score=F.col("cvss.base_score"), vector=F.col("cvss.vector"))))
    return df.withColumn("pinned_basis", F.when(pinned, basis))


def monthly_errors() -> Column:
    """Extra rules of a monthly overlay."""
    cands, tags = F.col("mitigation_candidates"), F.coalesce("tags", words([]))
    ids = F.transform(cands, lambda c: c["id"])
    once = (F.size(ids) == len(vocab.CONTROL_IDS)) & (
        F.array_sort(F.array_distinct(ids)) == F.array_sort(words(vocab.CONTROL_IDS)))
    evidence = fw("tag_evidence")
    cited = F.transform(evidence, lambda e: e["tag"])
    sets = truthy(F.array_sort(F.array_distinct(cited)) == F.array_sort(F.array_distinct(tags)))
    proven = sets & truthy(F.size(cited) == F.size(tags)) & truthy(F.forall(
        evidence, lambda e: filled(e["evidence"])))
    required = truthy(fw("review_requirement.required"))
    asked = F.coalesce(F.size(fw("review_requirement.reasons")), F.lit(0)) > 0
    direction = F.col("inference.attack_path.direction")
    unknown = truthy(direction == "unknown")

    def credited(c):
        ls, cs, block = _effect(c)
        return (ls != 0) | (cs != 0) | block

    return reasons(
        code(F.size(F.array_distinct(tags)) != F.size(tags), "duplicate-tags"),
        code(~once, "controls-once"), code(~proven, "tag-evidence"),
        code(required != asked, "review-flag"),
        code(~within(direction, vocab.DIRECTIONS), "direction"),
        code(unknown & ~required, "unknown-direction-review"),
        code(unknown & F.exists(cands, credited), "unknown-direction-credit"))


def with_evidence_floor(df: DataFrame) -> DataFrame:
    """Lift a saved likelihood to the public minimum, in the assessment, and say so there."""
    saved = index_of(vocab.LIKELIHOODS, fw("baseline_likelihood"))
    minimum = F.when(no_customer_action(), 0).otherwise(evidence_likelihood())
    lift = (saved >= 0) & (saved < minimum)
    raised = label_of(vocab.LIKELIHOODS, F.greatest(saved, minimum))
    text = F.concat(F.lit("Public-evidence policy floor raises "), fw("baseline_likelihood"),
                    F.lit(" to "), raised, F.lit("; original model response retained."))
    path = "inference.framework_assessment"
    lifted = F.col(path).withField("baseline_likelihood", raised).withField(
        "policy_adjustments", F.concat(F.coalesce(fw("policy_adjustments"), words([])), F.array(text)))
    return df.withColumns({
        "floored_likelihood": F.when(saved >= 0, raised),
        "floor_adjustments": F.when(lift, F.array(text)).otherwise(words([])),
        "inference": F.col("inference").withField("framework_assessment", F.when(lift, lifted).otherwise(F.col(path)))})


def fail_closed(df: DataFrame) -> DataFrame:
    """Zero the credit of every candidate a control gate rejects, keeping its rationale.

    Each rejected candidate is named in the assessment's policy adjustments.
    """
    verdict = lambda c: F.concat(candidate_errors(c), path_errors(c))

    def settle(c):
        found = verdict(c)
        blank = struct_of(
            id=c["id"], relevance="unknown", confidence="low",
            evidence=F.concat(F.lit("No assessment credit: "), F.array_join(found, ", "), F.lit(
                ". Model rationale before validation: "), F.coalesce(c["evidence"], F.lit(""))),
            direction_override=c["direction_override"],
            effect=struct_of(likelihood_steps=F.lit(0), consequence_steps=F.lit(0), path_block=F.lit(False)))
        return F.when(F.size(found) > 0, blank).otherwise(c)

    rejected = F.filter("mitigation_candidates", lambda c: F.size(verdict(c)) > 0)
    notes = F.transform(rejected, lambda c: F.concat(
        F.lit("Credit withheld from "), c["id"], F.lit(": "), F.array_join(verdict(c), ", ")))
    path = "inference.framework_assessment"
    noted = F.col(path).withField("policy_adjustments", F.concat(F.coalesce(fw("policy_adjustments"), words([])), notes))
    return df.withColumns({
        "mitigation_candidates": F.transform("mitigation_candidates", settle),
        "inference": F.col("inference").withField("framework_assessment", F.when(
            F.col(path).isNotNull() & (F.size(notes) > 0), noted).otherwise(F.col(path)))})


def with_taxonomy_closure(df: DataFrame) -> DataFrame:
    """An e-mail or web tag, or a credited content control, implies user-content."""
    content = F.exists("mitigation_candidates", lambda c: within(c["id"], vocab.CONTENT_CONTROLS)
                       & truthy(c["relevance"] == "relevant") & truthy(c["effect"]["likelihood_steps"] > 0))
    implied = overlaps(F.col("tags"), ["email", "web"]) | truthy(content)
    return df.withColumns({
        "closure_added": implied & ~has(F.col("tags"), "user-content"),
        "tags": F.when(implied, F.array_union(F.coalesce("tags", words([])), words(["user-content"])))
        .otherwise(F.col("tags"))})


def with_provenance(overlay: DataFrame, calls: DataFrame, validated_at: str) -> DataFrame:
    """Attach run provenance by batch. calls: batch, model, arm, model_served,
    finished_at, prompt_sha256, response_sha256, schema_enforced, source_sha256."""
    block = struct_of(
        model=F.col("model"), model_configured=F.col("model"), model_served=F.col("model_served"),
        arm=F.col("arm"), assessment_status="model-assessed", taxonomy_version="1.0",
        generated_at=F.col("finished_at"),
        invocation=struct_of(batch=F.col("batch"), prompt_sha256=F.col("prompt_sha256"),
                             response_sha256=F.col("response_sha256"),
                             schema_enforced=F.col("schema_enforced")),
        pipeline_validation=struct_of(type="automated-source-and-schema",
                                      source_sha256=F.col("source_sha256"), validated_at=validated_at))
    joined = overlay.join(calls, "batch", "inner")
    return joined.select(*overlay.columns, block.alias("provenance"))


def qa_flags(df: DataFrame) -> DataFrame:
    """(cve, issue, control) rows to re-read before publication."""
    text = F.lower(F.array_join(F.transform("vendor_guidance.notes", lambda n: n["value"]), " "))
    like = index_of(vocab.LIKELIHOODS, fw("baseline_likelihood"))
    act = ~no_customer_action()
    none = F.lit(None).cast("string")
    whole = reasons(
        F.when(act & (like > evidence_likelihood()), F.struct(F.lit("likelihood-above-evidence").alias("issue"), none.alias("control"))),
        F.when(act & truthy(fw("baseline_model") == "critical-preauth-network-rce") & (like < 2),
               F.struct(F.lit("archetype-without-evidence").alias("issue"), none.alias("control"))))

    def per_control(c):
        ls, cs, block = _effect(c)
        counted = truthy(c["relevance"] == "relevant") & within(c["confidence"], ["high", "medium"]) & (
            (ls != 0) | (cs != 0))
        say = lambda test, issue: F.when(counted & test, F.struct(
            F.lit(issue).alias("issue"), c["id"].alias("control")))
        preview = text.contains("rtf") | text.contains("preview pane") | text.contains("reading pane")
        return reasons(
            say((c["id"] == "remove_external_exposure") & text.contains("in-network attacker"), "internal-attacker"),
            say((c["id"] == "office_protected_view") & preview, "preview-parser"),
            say(c["id"].isin("edr_detection_response", "attack_surface_reduction"), "generic-control"),
            say((cs != 0) | block, "strong-effect"))

    flags = F.concat(whole, F.flatten(F.transform("mitigation_candidates", per_control)))
    assessed = df.where(F.col("inference.framework_assessment").isNotNull())
    return assessed.select("cve", F.explode(flags).alias("f")).select("cve", "f.issue", "f.control")
