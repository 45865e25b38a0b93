"""Joins of advisories with feeds, sidecars and overlays.

All are equi-joins on ``cve`` (or a small rule key). Sides are never hinted to
broadcast: feeds and overlays grow with the releases, so Catalyst and AQE decide from
their measured size.
"""
from pyspark.sql import Column, DataFrame, functions as F, types as T

from advislake.functions import vocab
from advislake.functions.exprs import has, index_of, lookup, truthy, within, words
from advislake.operators.parse import ssvc
from advislake.operators.proof import public_syntax
from advislake.sources.scratch import fresh_path, shuffle_given_back

EPSS_FIELDS = ["epss", "epss_percentile", "epss_date", "epss_status"]


def kev_flag(df: DataFrame, kev: DataFrame, into: str = "kev") -> DataFrame:
    ids = kev.select("cve").where("cve is not null").distinct().withColumn("_hit", F.lit(True))
    return df.join(ids, "cve", "left").withColumn(into, truthy(F.col("_hit"))).drop("_hit")


def epss_score(df: DataFrame, epss: DataFrame) -> DataFrame:
    return df.join(epss.select("cve", "epss"), "cve", "left")


def apply_overlay(df: DataFrame, overlay: DataFrame) -> DataFrame:
    """Left join of overlay(cve, o_tags, o_candidates, o_inference, o_threat).

    Threat fields stated by the overlay replace the record's, the rest stay.
    """
    out = df.join(overlay, "cve", "left")
    threat = F.col("threat")
    fields = [f.name for f in df.schema["threat"].dataType.fields]
    given = {f.name for f in overlay.schema["o_threat"].dataType.fields}
    merged = F.struct(*[
        (F.coalesce(F.col(f"o_threat.{n}"), threat[n]) if n in given else threat[n]).alias(n)
        for n in fields])
    return out.withColumns({
        "tags": F.array_sort(F.array_distinct(F.coalesce("o_tags", words([])))),
        "mitigation_candidates": F.col("o_candidates"),
        "inference": F.coalesce(F.col("o_inference"), F.struct(F.lit("none").alias("model"))),
        "threat": merged,
    }).drop("o_tags", "o_candidates", "o_inference", "o_threat")


def resolve_products(listed: DataFrame, names: DataFrame) -> DataFrame:
    """(cve, product_id) rows with the tree's name, the id where the tree has none."""
    return (listed.join(names.select("product_id", "name"), "product_id", "left")
            .select("cve", "product_id", F.coalesce("name", "product_id").alias("name")))


def apply_program(df: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Attach the CVE program block; a missing or failed entry keeps only its status.

    Every fact of the sidecar is carried; one that it does not have is null.
    """
    facts = ["assigner", "url", "sha256", "date_updated", "ssvc", "ssvc_provider", "vendor_severity", "cna"]
    given = lambda c: F.col(c) if c in sidecar.columns else F.lit(None).cast("string")
    side = sidecar.select("cve", F.col("status").alias("_st"), *[given(c).alias(f"_{c}") for c in facts])
    out = df.drop("cve_program").join(side, "cve", "left")
    found = truthy(F.col("_st") == "found")
    keep = lambda c: F.when(found, F.col(f"_{c}")).alias(c)
    reason = (F.when(~found, "no CVE Program record was retrieved for this CVE")
              .when(F.col("_ssvc").isNull(), "the CVE Program record carries no CISA-ADP SSVC assessment"))
    block = F.struct(F.coalesce("_st", F.lit("not-fetched")).alias("status"), *[keep(c) for c in facts],
                     reason.alias("ssvc_absent_reason"))
    return out.withColumn("cve_program", block).drop("_st", *[f"_{c}" for c in facts])


def program_counts(df: DataFrame) -> DataFrame:
    """One row: SSVC applied / record without SSVC / no record."""
    found = F.col("cve_program.status") == "found"
    return df.agg(F.count_if(found & ssvc().isNotNull()).alias("applied"),
                  F.count_if(found & ssvc().isNull()).alias("without_ssvc"),
                  F.count_if(~found).alias("missing"))


def refresh_scores(df: DataFrame, scores: DataFrame, feed_date: str = None) -> DataFrame:
    """Scored / stale / pending upsert of the threat score; adds score_changed."""
    side = scores.select("cve", F.col("epss").alias("_e"), F.col("percentile").alias("_p"),
                         F.col("score_date").alias("_d"))
    out = df.join(side, "cve", "left")
    feed = F.lit(feed_date).cast("string")
    t = lambda n: F.col(f"threat.{n}")
    scored, stale = F.col("_e").isNotNull(), t("epss").isNotNull()
    fresh = {
        "epss": F.when(scored, F.col("_e")).otherwise(t("epss")),
        "epss_percentile": F.when(scored, F.col("_p")).when(stale, t("epss_percentile")),
        "epss_date": F.when(scored, F.coalesce("_d", feed)).when(stale, t("epss_date")).otherwise(feed),
        "epss_status": F.when(scored, "scored").when(stale, "stale").otherwise("pending"),
    }
    threat = F.col("threat")
    for name, value in fresh.items():
        threat = threat.withField(name, value)
    same = None
    for name, value in fresh.items():
        part = t(name).eqNullSafe(value)
        same = part if same is None else same & part
    return (out.withColumns({"score_changed": ~same, "_threat": threat})
            .drop("threat", "_e", "_p", "_d").withColumnRenamed("_threat", "threat"))


MOST_MONTHS = 10_000  # months of a release whose table is broadcast; beyond it, the join shuffles


def stamp_provenance(df: DataFrame, url: str, sha256: str, feed_date: str, batch_api_fallback: bool = False) -> DataFrame:
    """Provenance of the feed, on every record of a month in which any score changed.

    Only the months are written; for them the refreshed rows are read with the columns that tell a change, and no
    whole record is written or shuffled but for a reader of whole records.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "months")
    with shuffle_given_back(spark):
        df.where("score_changed").select(F.col("month").alias("_month")).distinct().write.parquet(path)
    changed = spark.read.schema(f"_month {df.schema['month'].dataType.simpleString()}").parquet(path)
    changed = changed if changed.count() > MOST_MONTHS else F.broadcast(changed)
    stamp = F.struct(F.lit(url).alias("url"), F.lit(sha256).alias("sha256"), F.lit(feed_date).alias("score_date"),
                     F.lit(batch_api_fallback).alias("batch_api_fallback"))
    return df.join(changed, F.col("month") == F.col("_month"), "left").withColumn(
        "epss_source", F.when(F.col("_month").isNotNull(), stamp)).drop("_month")


def two_tier_scores(wanted: DataFrame, bulk: DataFrame, fallback: DataFrame) -> DataFrame:
    """Bulk feed rows for the wanted ids, then fallback rows only for ids the feed lacks."""
    ids = wanted.select("cve").distinct()
    first = bulk.join(ids, "cve", "left_semi")
    missing = ids.join(bulk, "cve", "left_anti")
    return first.unionByName(fallback.join(missing, "cve", "left_semi"))


def merge_overlay(baseline: DataFrame, overlay: DataFrame) -> DataFrame:
    """Inner join of validated overlays: tags union, candidates and judgement replaced.

    ``overlay``: cve, o_tags, o_candidates, o_inference (with framework, path and gate).
    """
    out = baseline.drop("mitigation_candidates", "inference").join(overlay, "cve", "inner")
    return out.withColumns({
        "tags": F.array_sort(F.array_union(F.coalesce("tags", words([])), F.coalesce("o_tags", words([])))),
        "mitigation_candidates": F.col("o_candidates"),
        "inference": F.col("o_inference").withField("review_status", F.lit("reviewed")),
    }).drop("o_tags", "o_candidates", "o_inference")


def _blank_inference(kind) -> Column:
    """An unreviewed judgement of the given struct type, with an explicit gate that did not apply."""
    gate = {"status": "not-applicable", "reason": "record carries no inference overlay"}
    said = {"model": "none", "taxonomy_version": "1.0", "review_status": "unreviewed"}
    null = lambda f, values: F.lit(values.get(f.name)).cast(f.dataType).alias(f.name)
    return F.struct(*[
        F.struct(*[null(g, gate) for g in f.dataType.fields]).alias(f.name) if f.name == "direction_gate"
        else null(f, said) for f in kind.fields])


def with_unreviewed(merged: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add baseline rows without an overlay, with an explicit not-applicable gate.

    Merged rows stay as they are; where their judgement lacks a field that an unreviewed
    one states, the field is added as null.
    """
    for path, kind in [("model", "string"), ("taxonomy_version", "string"), ("review_status", "string"),
                       ("direction_gate", "struct<status:string,reason:string>"), ("direction_gate.reason", "string")]:
        held = merged.schema["inference"].dataType
        for part in path.split(".")[:-1]:
            held = held[part].dataType
        if path.split(".")[-1] not in held.fieldNames():
            merged = merged.withColumn("inference", F.col("inference").withField(path, F.lit(None).cast(kind)))
    left = baseline.join(merged.select("cve"), "cve", "left_anti").drop("mitigation_candidates", "inference")
    blank = left.withColumns({
        "mitigation_candidates": F.array().cast(merged.schema["mitigation_candidates"].dataType),
        "inference": _blank_inference(merged.schema["inference"].dataType)})
    return merged.unionByName(blank.select(*merged.columns))


def control_directions(control: Column) -> Column:
    """Directions a control acts on; an unknown control acts on all of them."""
    found = F.lit(None).cast("array<string>")
    for cid, _, _, directions in vocab.CONTROLS:
        found = F.when(control == cid, words(directions)).otherwise(found)
    return F.coalesce(found, words(vocab.DIRECTIONS))


def candidate_directions(df: DataFrame, controls: DataFrame = None) -> DataFrame:
    """(cve, control, direction, acts) for every candidate.

    ``controls``: (id, directions) of a control file; a control that it lacks acts on all directions.
    """
    rows = df.select("cve", F.col("inference.attack_path.direction").alias("direction"),
                     F.explode(F.transform("mitigation_candidates", lambda c: c.id)).alias("control"))
    if controls is not None:
        known = controls.select(F.col("id").alias("control"), "directions")
        return rows.join(known, "control", "left").select("cve", "control", "direction", has(
            F.coalesce("directions", words(vocab.DIRECTIONS)), F.col("direction")).alias("acts"))
    return rows.withColumn("acts", has(control_directions(F.col("control")), F.col("direction")))


def relevant_controls(df: DataFrame) -> DataFrame:
    """Relevant candidates with the catalogue name and the credit they earn."""
    names = {c[0]: c[1] for c in vocab.CONTROLS}
    rows = df.select("cve", F.explode(F.filter(
        "mitigation_candidates", lambda c: truthy(c.relevance == "relevant"))).alias("c"))
    steps = lambda f: F.coalesce(F.col(f"c.effect.{f}"), F.lit(0)).cast("string")
    credit = F.when(F.col("c.confidence") == "low", "no credit · low confidence").otherwise(F.concat(
        F.lit("likelihood −"), steps("likelihood_steps"), F.lit(", consequence −"),
        steps("consequence_steps"), F.when(truthy(F.col("c.effect.path_block")), " · blocks the path").otherwise("")))
    return rows.select("cve", F.coalesce(lookup(names, F.col("c.id")), F.col("c.id")).alias("name"),
                       credit.alias("credit"),
                       F.coalesce(F.nullif("c.evidence", F.lit("")), F.lit("no evidence recorded")).alias("evidence"))


def proof_of_findings(findings: DataFrame, values: DataFrame, public: Column = None) -> DataFrame:
    """Match every finding to the first source location that holds the same whole value and makes it public.

    ``findings``: cve, field, category, value (the whole text of the field), span, start, end (0-based
    offsets of the span); ``values``: cve, value, location, pointer. A finding is proved where its value is
    the source's own and ``public`` holds on the joined row; by default the rule of its category
    (``proof.public_syntax``). Unproved findings keep a null location. Values meet by their hash, so long
    texts are not sorted, and are compared whole afterwards.
    """
    src = values.select("cve", F.sha2("value", 256).alias("digest"), "location", "pointer",
                        F.col("value").alias("source_value"))
    keyed = findings.withColumn("digest", F.sha2("value", 256))
    joined = keyed.join(src, ["cve", "digest"], "left").where(
        F.col("source_value").isNull() | (F.col("source_value") == F.col("value")))
    if public is None:
        public = public_syntax(*[F.col(c) for c in ("source_value", "span", "start", "category", "pointer")])
    good = F.col("source_value").isNotNull() & truthy(public)
    keys = [c for c in findings.columns]
    return joined.groupBy(*keys, "digest").agg(F.min(F.when(
        good, F.struct("location", "pointer"))).alias("at")).select(
            *keys, "digest", "at.location", "at.pointer", F.col("at").isNotNull().alias("proved"))


def reconcile_sources(published: DataFrame, raw: DataFrame) -> DataFrame:
    """Published rows beside their raw source rows."""
    return published.join(raw, "cve", "inner")


def _amended(old: Column, held, fix: Column, stated) -> Column:
    """``old`` with every leaf that ``fix`` states, field by field; maps entry by entry."""
    if isinstance(held, T.StructType) and isinstance(stated, T.StructType):
        unknown = set(stated.fieldNames()) - set(held.fieldNames())
        if unknown:
            raise ValueError(f"a correction names fields that the record does not have: {sorted(unknown)}")
        parts = [(_amended(old[f.name], f.dataType, fix[f.name], stated[f.name].dataType)
                  if f.name in stated.fieldNames() else old[f.name]).alias(f.name) for f in held.fields]
        return F.when(fix.isNull(), old).otherwise(F.struct(*parts))
    if isinstance(held, T.MapType):
        return F.when(old.isNull() | fix.isNull(), F.coalesce(fix, old)).otherwise(
            F.map_zip_with(old, fix, lambda k, a, b: F.coalesce(b, a)))
    return F.coalesce(fix, old)


def apply_corrections(df: DataFrame, corrections: DataFrame, digest: str, reviewer: str) -> DataFrame:
    """Deep override of saved assessments.

    ``corrections``: cve, reason, fields (a struct of any assessment leaves, null where
    nothing changes) and controls (map of control id to a struct of candidate leaves). A
    field that the record's own type lacks is refused when the plan is built.
    """
    fixes = corrections.select("cve", F.col("reason").alias("_why"), F.col("fields").alias("_f"),
                               F.col("controls").alias("_c"))
    out = df.join(fixes, "cve", "left")
    path = "inference.framework_assessment"
    original = F.sha2(F.to_json(F.col(path), {"ignoreNullFields": "false"}), 256)
    inference = df.schema["inference"].dataType
    framework = _amended(F.col(path), inference["framework_assessment"].dataType, F.col("_f"),
                         corrections.schema["fields"].dataType)
    framework = framework.withField("policy_adjustments", F.concat(
        F.coalesce(framework["policy_adjustments"], words([])),
        F.array(F.concat(F.lit("Source review: "), F.col("_why")))))
    candidate = df.schema["mitigation_candidates"].dataType.elementType
    stated = corrections.schema["controls"].dataType.valueType

    def amended(c):
        fix = F.try_element_at(F.col("_c"), c.id)
        return F.when(fix.isNotNull(), _amended(c, candidate, fix, stated)).otherwise(c)

    hit = F.col("_why").isNotNull()
    proof = F.struct(F.lit(reviewer).alias("reviewer"), F.col("_why").alias("reason"),
                     original.alias("original_assessment_sha256"), F.lit(digest).alias("corrections_file_sha256"))
    held = inference["verification"].dataType if "verification" in inference.fieldNames() else None
    if isinstance(held, T.VariantType):
        proof = F.to_variant_object(proof)
    before = F.col("inference.verification") if held else F.lit(None)
    kind = "variant" if isinstance(held, T.VariantType) else (
        "struct<reviewer:string,reason:string,original_assessment_sha256:string,corrections_file_sha256:string>")
    return out.withColumns({
        "_i": F.col("inference").withField("framework_assessment", F.when(hit, framework).otherwise(F.col(path)))
        .withField("verification", F.when(hit, proof).otherwise(before.cast(kind))),
        "mitigation_candidates": F.when(hit & F.col("_c").isNotNull(), F.transform(
            "mitigation_candidates", amended)).otherwise(F.col("mitigation_candidates")),
    }).drop("inference", "_why", "_f", "_c").withColumnRenamed("_i", "inference")


def unknown_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ids that a correction names and no record has; a release with any is refused."""
    return corrections.join(df.select("cve"), "cve", "left_anti").select("cve")


def scoring_jobs(tags: DataFrame, records: DataFrame, vocabulary) -> DataFrame:
    """Overlay tag rows whose record exists and whose tag is in the judgement vocabulary."""
    return tags.where(within(F.col("tag"), vocabulary)).join(
        records.select("cve"), "cve", "left_semi")
