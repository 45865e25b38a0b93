"""Risk model: baseline archetype and what-if residual, row-local with no shuffle."""
from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import (all_of, has, index_of, label_of, lookup, overlaps,
                                       reasons, reusable, settle, struct_of, truthy, within, words)
from advislake.functions.scalar import (format_priority, format_priority_text,
                                        format_vendor_assessment)
from advislake.operators.severity import severity_band

FRAMEWORK = "inference.framework_assessment"


def fw(name: str) -> Column:
    return F.col(f"{FRAMEWORK}.{name}")


def archetype_action(model: Column) -> Column:
    return lookup({k: v[0] for k, v in vocab.ARCHETYPES.items()}, model)


def archetype_floor(model: Column, path_block: Column) -> Column:
    plain = lookup({k: v[1] for k, v in vocab.ARCHETYPES.items()}, model)
    blocked = lookup({k: v[2] for k, v in vocab.ARCHETYPES.items()}, model)
    return F.when(path_block, blocked).otherwise(plain)


def archetype_reason(model: Column) -> Column:
    return lookup({k: v[3] for k, v in vocab.ARCHETYPES.items()}, model)


def no_customer_action() -> Column:
    return F.col("customer_action_required").eqNullSafe(F.lit(False))


def exploited() -> Column:
    return truthy(F.col("threat.kev")) | truthy(F.col("threat.exploitation_detected"))


def open_network_path() -> Column:
    """Score of nine or more over the network with no privileges and no interaction."""
    return all_of([truthy(F.col("cvss.base_score") >= 9),
                   truthy(F.col("attack.vector") == "network"),
                   truthy(F.col("attack.privileges_required") == "none"),
                   truthy(F.col("attack.user_interaction") == "none")])


def is_preauth_rce() -> Column:
    return open_network_path() & has(F.col("tags"), "remote-code-execution")


def misses_impact_judgement() -> Column:
    return open_network_path() & ~overlaps(F.col("tags"), vocab.IMPACT_TAGS)


def archetype(likelihood: Column) -> Column:
    """The one archetype a record's facts select at a likelihood index."""
    band = severity_band()
    return (F.when(no_customer_action(), "no-customer-action")
            .when(exploited(), "active-exploitation")
            .when(is_preauth_rce() & (likelihood >= 2), "critical-preauth-network-rce")
            .when(band == "unknown", "unknown-severity")
            .when(band == "critical", "critical-technical")
            .when((likelihood >= 2) & (band == "high"), "elevated-high-severity")
            .otherwise("standard-remediation"))


def evidence_likelihood() -> Column:
    """Minimum likelihood index that public facts imply."""
    epss = F.coalesce(F.col("threat.epss"), F.lit(0.0))
    vendor = lookup(vocab.VENDOR_LIKELIHOOD, F.col("threat.exploitation_assessment"), 1)
    raised = (F.when(epss >= vocab.EPSS_ELEVATED, 2).when(epss >= vocab.EPSS_PLAUSIBLE, 1)
              .otherwise(0))
    return F.when(exploited(), 3).otherwise(F.greatest(vendor, raised))


def framework_usable() -> Column:
    return all_of([truthy(fw("risk_model_version") == vocab.RISK_MODEL_VERSION),
                   within(fw("baseline_likelihood"), vocab.LIKELIHOODS),
                   within(fw("baseline_action"), vocab.ACTIONS),
                   within(fw("baseline_model"), list(vocab.ARCHETYPES))])


def _fact_set(assessments: Column) -> Column:
    """Assessments as an order-free list of comparable facts."""
    facts = F.transform(assessments, lambda a: F.struct(
        a.source, a.role, a.scale, a["value"], a.basis, a.cvss))
    return F.coalesce(F.sort_array(facts), F.filter(facts, lambda a: F.lit(False)),
                      F.array().cast("array<struct<source:string,role:string,scale:string,"
                                     "value:string,basis:string,cvss:struct<version:string,"
                                     "base_score:double,vector:string>>>"))


def superseded() -> Column:
    """The saved assessment was made against severity facts that no longer hold."""
    basis = F.col("inference.severity_basis")
    severity = F.col("severity")
    pinned = ["primary", "normalized_band", "normalized_basis"]
    same = all_of([severity[name].eqNullSafe(basis[name]) for name in pinned])
    same_parties = _fact_set(severity["assessments"]) == _fact_set(basis["assessments"])
    same_score = all_of([F.col(f"cvss.{name}").eqNullSafe(basis["derived_cvss"][name])
                         for name in ("version", "base_score", "vector")])
    derived = truthy(basis["normalized_basis"] == "cvss-derived")
    changed = severity.isNull() | ~same | ~same_parties | (derived & ~same_score)
    assessments = severity["assessments"]
    legacy = truthy(severity["divergence"].isNotNull()) | truthy(
        (F.size(assessments) > 0) & ~F.exists(assessments, lambda a: a.role == "publisher"))
    return F.when(basis.isNotNull(), changed).when(severity.isNull(), False).otherwise(legacy)


@reusable
def _baseline_stages() -> list:
    """Projections of the baseline, each reading the one before."""
    ev, saved_l, saved_a = F.col("_ev"), F.col("_saved_l"), F.col("_saved_a")
    use, hit, rce, nca = F.col("_use"), F.col("_hit"), F.col("_rce"), no_customer_action()
    saved, determined, fallback = fw("baseline_model"), F.col("_determined"), F.col("_fallback")
    mismatch, exceeds = use & (determined != saved), F.col("_exceeds")
    understates = F.col("_understates")
    raised = F.greatest(
        saved_a, F.when(exceeds, archetype_action(fallback)).otherwise(F.lit(-1)),
        F.when(understates, archetype_action(determined)).otherwise(F.lit(-1)))
    like, action, model = F.col("_l"), F.col("_a"), F.col("_m")
    return [
        {"_ev": evidence_likelihood(), "_use": framework_usable() & ~superseded(),
         "_hit": exploited(), "_rce": is_preauth_rce(),
         "_saved_l": index_of(vocab.LIKELIHOODS, fw("baseline_likelihood")),
         "_saved_a": index_of(vocab.ACTIONS, fw("baseline_action"))},
        {"_fallback": archetype(ev), "_determined": archetype(F.greatest(saved_l, F.lit(0))),
         "_exceeds": use & (ev > saved_l)},
        {"_understates": mismatch & (archetype_action(determined) > saved_a)},
        {"_l": F.when(hit, 3).when(use, F.greatest(ev, saved_l)).otherwise(ev),
         "_a": F.when(hit, 3).when(use, raised).otherwise(archetype_action(fallback)),
         "_m": F.when(hit, "active-exploitation").when(use & ~exceeds, saved).otherwise(fallback)},
        {"base_likelihood": F.when(nca, 0).otherwise(like),
         "base_action": F.when(nca, 0).otherwise(F.greatest(action, F.when(rce, 2).otherwise(1))),
         "base_model": F.when(nca, "no-customer-action").when(
             rce & (like >= 2) & (model != "active-exploitation"), "critical-preauth-network-rce")
         .otherwise(model),
         "base_reasons": F.when(nca, words([vocab.ARCHETYPES["no-customer-action"][3]]))
         .otherwise(_baseline_reasons({"use": use, "fallback": fallback, "exceeds": exceeds,
                                       "understates": understates, "saved": saved,
                                       "determined": determined})),
         "archetype_saved": F.when(mismatch, saved),
         "archetype_determined": F.when(mismatch, determined),
         "archetype_understates": understates},
    ]


def with_baseline(df: DataFrame) -> DataFrame:
    """Adds base_likelihood, base_action (indexes), base_model and base_reasons.

    Also adds archetype_saved / archetype_determined / archetype_understates, which
    the review rules read.
    """
    out, stages = df, _baseline_stages()
    for stage in stages:
        out = out.withColumns(stage)
    return settle(out.select(*df.columns, *[F.col(c).alias(f"_{c}") for c in stages[-1]]),
                  df.columns, {c: F.col(f"_{c}") for c in stages[-1]})


def _baseline_reasons(s: Column) -> Column:
    epss = F.coalesce(F.col("threat.epss"), F.lit(0.0))
    why = F.nullif(fw("risk_communication.why_this_action"), F.lit(""))
    evidence = reasons(
        F.concat(F.lit("Microsoft exploitation assessment: "),
                 format_vendor_assessment(F.col("threat.exploitation_assessment"))),
        F.when(truthy(F.col("threat.kev")), "CISA KEV")
        .when(truthy(F.col("threat.exploitation_detected")), "Microsoft exploitation detected"),
        F.when(epss >= vocab.EPSS_ELEVATED, "EPSS provides elevated exploitation evidence")
        .when(epss >= vocab.EPSS_PLAUSIBLE, "EPSS provides additional exploitation evidence"),
        F.when(s["use"], F.concat(F.lit("Framework assessment: "), F.coalesce(
            why, archetype_reason(fw("baseline_model")))))
        .otherwise(archetype_reason(s["fallback"])))
    adjustments = F.when(s["use"], F.array_compact(fw("policy_adjustments")))
    later = reasons(
        F.when(s["exceeds"],
               "Current source evidence exceeds the saved inference; its likelihood and "
               "remediation floor take precedence. Review the saved explanation."),
        F.when(s["understates"], F.concat(
            F.lit("The saved assessment calls this "), s["saved"],
            F.lit(", but the vendor-published severity selects "), s["determined"],
            F.lit(". The higher remediation floor applies; the saved explanation describes a "
                  "lesser record."))))
    return F.concat(evidence, F.coalesce(adjustments, words([])), later)


def _verdict(c: Column, cid: Column) -> Column:
    """Why a selected candidate earns no credit; empty when it does.

    With a literal control id the rules of other controls fold away.
    """
    ls = F.coalesce(c["effect"]["likelihood_steps"], F.lit(0))
    cs = F.coalesce(c["effect"]["consequence_steps"], F.lit(0))
    block, claims = truthy(c["effect"]["path_block"]), ls > 0
    relevant = truthy(c["relevance"] == "relevant") & within(c["confidence"], ["medium", "high"])
    incompatible = (
        (~ls.isin(0, 1, 2)) | (~cs.isin(0, 1, 2))
        | (claims & within(cid, vocab.NETWORK_CONTROLS)
           & ~within(F.col("attack.vector"), ["network", "adjacent"]))
        | (claims & within(cid, vocab.RESPONSE_CONTROLS))
        | (claims & within(cid, vocab.CONTENT_CONTROLS) & ~has(F.col("tags"), "user-content"))
        | (claims & within(cid, vocab.IDENTITY_CONTROLS)
           & ~within(F.col("attack.privileges_required"), ["low", "high"]))
        | (block & ~(truthy(c["confidence"] == "high") & within(cid, vocab.PATH_BLOCK_CONTROLS)))
        | ((ls == 2) & ~block))
    return F.when(~relevant, ": inference did not establish exploit-path relevance").when(
        incompatible, ": effect is incompatible with source prerequisites or mitigation "
        "guardrails").otherwise("")


@reusable
def _residual_stages(controls, chosen) -> list:
    """Projections of the residual; at most one candidate per selected control counts,
    so each selected control is one slot and nothing loops over the candidates."""
    nca, cands = no_customer_action(), F.col("mitigation_candidates")
    ids = F.col("mitigation_candidates.id")
    slots = range(len(controls))
    control = [F.expr(c) if chosen == "expr" else F.lit(c) for c in controls]
    at = [F.coalesce(F.array_position(ids, c), F.lit(0)).cast("int") for c in control]
    if chosen not in (None, "expr"):
        at = [F.when(F.array_contains(F.col(chosen), c), a).otherwise(0) for c, a in zip(control, at)]
    cand = [F.when(~nca & (F.col(f"_at{i}") > 0), F.get(cands, F.col(f"_at{i}") - 1)) for i in slots]
    why = [F.when(F.col(f"_c{i}").isNotNull(), _verdict(F.col(f"_c{i}"), control[i])) for i in slots]
    ok = [truthy(F.col(f"_why{i}") == "") for i in slots]

    def total(field):
        out = F.lit(0)
        for i in slots:
            out = out + F.when(ok[i], F.coalesce(F.col(f"_c{i}.effect.{field}").cast("int"), F.lit(0))).otherwise(0)
        return out

    def in_order(test, value):
        """Values of the slots that pass, in candidate order."""
        picked = F.array_compact(F.array(*[F.when(test(i), struct_of(
            at=F.col(f"_at{i}"), v=value(i))) for i in slots]))
        return F.sort_array(picked)["v"]

    block = F.lit(False)
    for i in slots:
        block = block | (ok[i] & truthy(F.col(f"_c{i}.effect.path_block"))
                         & truthy(F.col(f"_c{i}.confidence") == "high"))
    if slots:
        applied = in_order(lambda i: ok[i], lambda i: F.col(f"_c{i}"))
        ignored = in_order(lambda i: truthy(F.col(f"_why{i}") != ""),
                           lambda i: F.concat(F.col(f"_c{i}.id"), F.col(f"_why{i}")))
    else:
        applied, ignored = F.filter(cands, lambda c: F.lit(False)), words([])
    cap = F.when(F.col("_block"), vocab.PATH_BLOCK_CREDIT_CAP).otherwise(vocab.ORDINARY_CREDIT_CAP)
    steps = (F.when((F.col("_lc") >= 1) | (F.col("_cc") >= 1), 1).otherwise(0)
             + F.when((F.col("_lc") >= 2) & (F.col("_cc") >= 1), 1).otherwise(0))
    base_l, base_a = F.col("base_likelihood"), F.col("base_action")
    n = F.size("_applied")
    extra = reasons(
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" verified exploit-relevant mitigation"),
                               F.when(n == 1, "").otherwise("s"), F.lit(" applied"))),
        F.when((F.col("_floor") == 2) & (F.col("_action") == 2), F.concat(
            archetype_reason(F.col("base_model")),
            F.lit("; the model enforces an out-of-cycle remediation floor"))))
    stages = [{f"_at{i}": at[i] for i in slots}, {f"_c{i}": cand[i] for i in slots},
              {f"_why{i}": why[i] for i in slots}]
    return [s for s in stages if s] + [
        {"_lsum": total("likelihood_steps"), "_csum": total("consequence_steps"), "_block": block,
         "_applied": applied, "_ignored": ignored},
        {"_lc": F.least("_lsum", cap), "_cc": F.least("_csum", F.lit(vocab.CONSEQUENCE_CREDIT_CAP)),
         "_floor": F.greatest(F.lit(1), archetype_floor(F.col("base_model"), F.col("_block")))},
        {"_likelihood": F.when(nca, base_l).otherwise(F.greatest(F.lit(0), base_l - F.col("_lc"))),
         "_action": F.when(nca, base_a).otherwise(F.greatest(F.col("_floor"), base_a - steps))},
        {"_reasons": F.when(nca, F.col("base_reasons")).otherwise(
            F.concat(F.col("base_reasons"), extra))},
    ]


def with_profile(df: DataFrame, selection=()) -> DataFrame:
    """Baseline plus residual under a control selection.

    ``selection`` is a list of control ids, or the name of an array<string> column with
    catalogue ids for a per-row selection. Adds resid_likelihood, resid_action, applied, ignored, reasons.
    """
    based = df if "base_action" in df.columns else with_baseline(df)
    if isinstance(selection, str):
        stages = _residual_stages(tuple(vocab.CONTROL_IDS), selection)
    else:
        stages = _residual_stages(tuple(dict.fromkeys(selection)), None)
    return _with_residual(based, stages)


RESIDUAL = {"resid_likelihood": "_likelihood", "resid_action": "_action", "applied": "_applied",
            "ignored": "_ignored", "reasons": "_reasons"}


def _with_residual(based: DataFrame, stages) -> DataFrame:
    out = based
    for stage in stages:
        out = out.withColumns(stage)
    return settle(out.select(*based.columns, *RESIDUAL.values()), based.columns,
                  {name: F.col(held) for name, held in RESIDUAL.items()})


def profile_struct(public: bool = False) -> Column:
    """The computed profile with labels; ``public`` uses the display priorities."""
    shown = format_priority if public else (lambda c: c)

    def side(name):
        return F.struct(
            label_of(vocab.LIKELIHOODS, F.col(f"{name}_likelihood")).alias("likelihood"),
            shown(label_of(vocab.ACTIONS, F.col(f"{name}_action"))).alias("action"),
            F.col("base_model").alias("model"),
            F.lit(vocab.RISK_MODEL_VERSION).alias("model_version"))

    why = F.transform("reasons", format_priority_text) if public else F.col("reasons")
    return F.struct(side("base").alias("baseline"), side("resid").alias("residual"),
                    F.col("applied"), F.col("ignored"), why.alias("reasons"))


def adjusted_by_controls() -> Column:
    return (F.col("base_action") != F.col("resid_action")) | (
        F.col("base_likelihood") != F.col("resid_likelihood"))


def control_sweep(df: DataFrame, controls=None) -> DataFrame:
    """One row per record and catalogue control, each control selected on its own.

    The catalogue is a fixed literal, so the sweep is a row-local explode, not a join.
    """
    controls = list(controls or vocab.CONTROL_IDS)
    based = with_baseline(df)
    swept = based.withColumn("control", F.explode(words(controls)))
    return _with_residual(swept, _residual_stages(("control",), "expr"))


def _effective_ids() -> Column:
    eff = lambda c: truthy(c.relevance == "relevant") & ~truthy(c.confidence == "low") & (
        (F.coalesce(c.effect.likelihood_steps, F.lit(0)) > 0)
        | (F.coalesce(c.effect.consequence_steps, F.lit(0)) > 0))
    return F.coalesce(F.array_distinct(F.transform(F.filter("mitigation_candidates", eff), lambda c: c.id)), words([]))


def _chosen(ids: str, mask: str) -> Column:
    return F.filter(ids, lambda x, i: F.getbit(F.col(mask), i) == 1)


def subset_sweep(df: DataFrame) -> DataFrame:
    """Every subset of a record's effective controls; column ``selection`` is the subset.

    Subsets are enumerated from a bit mask per record, 2^k rows for k controls: for listing the subsets of
    a few records. Audits of many records go by ``selection_states``.
    """
    based = with_baseline(df).withColumn("_ids", _effective_ids())
    top = F.expr("cast(shiftleft(1L, size(_ids)) - 1 as bigint)")
    masked = based.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("bigint"), top)))
    return with_profile(masked.withColumn("selection", _chosen("_ids", "mask")).drop("_ids"), "selection")


# a selection acts through its likelihood steps (2 at most count), consequence steps (1) and path block only
STATES = [(steps, consequence, block) for steps in range(vocab.PATH_BLOCK_CREDIT_CAP + 1)
          for consequence in range(vocab.CONSEQUENCE_CREDIT_CAP + 1) for block in (0, 1)]


def selection_states(df: DataFrame) -> DataFrame:
    """One row for each outcome that selections of a record's effective controls can have.

    Columns of ``df`` with the baseline, ``selection`` and ``mask`` of one subset that leads there and
    ``cases``, the number of subsets that do. Subsets are not enumerated: controls are taken up one by one
    into the at most ``len(STATES)`` states of the credit caps, each with its count and one witness, inside
    the row, so a record with all catalogue controls costs as many steps as it has controls. Steps of
    applied controls are 0, 1 or 2, as others earn nothing.
    """
    swept = with_profile(df, vocab.CONTROL_IDS)
    effect = lambda c: struct_of(
        id=c.id, l=F.coalesce(c.effect.likelihood_steps, F.lit(0)).cast("int"), c=F.coalesce(c.effect.consequence_steps, F.lit(0)).cast("int"),
        b=F.when(truthy(c.effect.path_block) & truthy(c.confidence == "high"), 1).otherwise(0))
    nothing = lambda x: struct_of(id=x, l=F.lit(0), c=F.lit(0), b=F.lit(0))
    rows = swept.select(*df.columns, F.transform("applied", effect).alias("_effects"), _effective_ids().alias("_ids"))
    rows = rows.withColumn("_items", F.transform("_ids", lambda x: F.coalesce(
        F.get(F.filter("_effects", lambda e: e.id == x), F.lit(0)), nothing(x))))
    start = ", ".join(f"named_struct('l', {n}, 'c', {c}, 'b', {b}, 'n', {int(not n + c + b)}L, 'mask', 0L)" for n, c, b in STATES)

    def take(acc, item):
        """States after one more control: as before without it, and moved on with it."""
        def after(to):
            leads = lambda s: (F.least(s.l + item.l, F.lit(vocab.PATH_BLOCK_CREDIT_CAP)) == to.l) & (
                F.least(s.c + item.c, F.lit(vocab.CONSEQUENCE_CREDIT_CAP)) == to.c) & (F.greatest(s.b, item.b) == to.b) & (s.n > 0)
            came = F.filter(acc.states, leads)
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), acc.at)  # the Python form takes a literal only
            return struct_of(
                l=to.l, c=to.c, b=to.b, n=to.n + F.aggregate(came, F.lit(0).cast("bigint"), lambda a, s: a + s.n),
                mask=F.when(to.n > 0, to.mask).otherwise(F.coalesce(F.get(came, F.lit(0)).mask.bitwiseOR(bit), F.lit(0).cast("bigint"))))
        return struct_of(at=acc.at + 1, states=F.transform(acc.states, after))

    reached = F.aggregate("_items", struct_of(at=F.lit(0), states=F.expr(f"array({start})")), take, lambda a: F.filter(a.states, lambda s: s.n > 0))
    rows = rows.select(*df.columns, "_ids", F.explode(reached).alias("_s")).select(
        *df.columns, "_ids", F.col("_s.mask").alias("mask"), F.col("_s.n").alias("cases"))
    return with_baseline(rows.withColumn("selection", _chosen("_ids", "mask")).drop("_ids"))


def credit_violations(df: DataFrame) -> DataFrame:
    """Property audit over all subsets of a record's controls: (cve, mask, violation, cases).

    A row for each broken rule and outcome of selections; ``mask`` is one selection that breaks it and
    ``cases`` how many do.
    """
    swept = with_profile(selection_states(df), "selection")
    block = F.exists("applied", lambda c: truthy(c.effect.path_block) & truthy(c.confidence == "high"))
    drop = F.col("base_likelihood") - F.col("resid_likelihood")
    floor = archetype_floor(F.col("base_model"), block)
    nca = no_customer_action()
    broken = reasons(
        F.when(F.col("resid_likelihood") > F.col("base_likelihood"), "raised-likelihood"),
        F.when(F.col("resid_action") > F.col("base_action"), "raised-action"),
        F.when(~nca & (F.col("resid_action") < 1), "erased-patch-obligation"),
        F.when(~nca & (drop > F.when(block, 2).otherwise(1)), "stacked-credit"),
        F.when(F.col("resid_action") < floor, "broke-floor"))
    return (swept.withColumn("violation", F.explode(broken))
            .select("cve", "mask", "violation", "cases"))


def selection_violations(df: DataFrame) -> DataFrame:
    """Audit of every record under all of its controls: (cve, violation); row-local.

    The applied controls must be the eligible ones, and none may earn what its kind cannot give.
    """
    swept = with_profile(df, vocab.CONTROL_IDS)
    ids = lambda array: F.array_sort(F.transform(array, lambda c: c.id))
    eligible = F.filter("mitigation_candidates", lambda c: truthy(c.relevance == "relevant") & ~truthy(c.confidence == "low"))
    uses = lambda listed, extra=None: F.exists("applied", lambda c: within(c.id, listed) & (
        F.lit(True) if extra is None else extra(c)))
    network = [c for c in vocab.NETWORK_CONTROLS if c != "isolation_airgap"]
    broken = reasons(
        F.when(ids(eligible) != ids(F.col("applied")), "eligible-mismatch"),
        F.when(uses(network) & ~within(F.col("attack.vector"), ["network", "adjacent"]), "network-control"),
        F.when(uses(vocab.CONTENT_CONTROLS) & ~F.coalesce(F.array_contains("tags", "user-content"), F.lit(False)), "content-control"),
        F.when(uses(vocab.RESPONSE_CONTROLS, lambda c: F.coalesce(c.effect.likelihood_steps, F.lit(0)) != 0), "response-control"))
    return swept.select("cve", F.explode(broken).alias("violation"))


def unrelated_control_effect(df: DataFrame) -> DataFrame:
    """Catalogue controls the record has no eligible candidate for, that still moved it."""
    swept = control_sweep(df)
    owned = F.coalesce(F.exists("mitigation_candidates", lambda c: (c.id == F.col("control"))
                                & truthy(c.relevance == "relevant")
                                & ~truthy(c.confidence == "low")), F.lit(False))
    moved = (F.size("applied") > 0) | adjusted_by_controls()
    return swept.where(~owned & moved).select("cve", "control")


def interpretation() -> Column:
    """One-sentence reading of a record; needs the baseline columns."""
    band = severity_band()
    summary = fw("risk_communication.summary")
    return (F.when(summary != "", summary)
            .when(no_customer_action(), "Microsoft states that this service has already been "
                  "mitigated and no customer action is required.")
            .when(exploited(), "Immediate action is driven by confirmed exploitation. CVSS "
                  "describes technical impact, but observed exploitation determines present "
                  "urgency.")
            .when(is_preauth_rce() & (F.col("base_likelihood") == 2), "Immediate action is driven "
                  "by the combination of Critical impact, unauthenticated network reachability, "
                  "no user interaction, remote code execution, and elevated Microsoft "
                  "exploitation likelihood.")
            .when(band == "unknown", "No party published a severity rating and no CVSS score is "
                  "available, so no severity-driven judgement is possible. This record is "
                  "flagged for review; the scheduled action is a placeholder, not a finding of "
                  "low risk.")
            .when(band == "critical", "Out-of-cycle action is driven by Critical technical impact "
                  "even though current exploitation evidence is lower.")
            .otherwise("The action combines current exploitation evidence with technical "
                       "severity and exploit prerequisites. Selected controls adjust the result "
                       "only when the reviewed overlay links them to this exploit path."))
