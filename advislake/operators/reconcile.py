"""Set comparison, admission, integrity and reconciliation of releases and runs."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from advislake.functions.exprs import reasons, truthy
from advislake.functions.scalar import canonical_sha256, epss_band
from advislake.operators.parse import exploitation_assessment
from advislake.sources.scratch import fresh_path


def coverage_gaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only: (cve, side); no rows means exact coverage."""
    a = left.select("cve").distinct().withColumn("_l", F.lit(True))
    b = right.select("cve").distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "missing").otherwise("unexpected")
    return a.join(b, "cve", "full_outer").where("_l is null or _r is null").select("cve", side.alias("side"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key, the earliest; an aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


def batch_difference(assigned: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch, missing, extra, repeated) for batches whose returned ids differ."""
    a = assigned.select("batch", "cve").distinct().withColumn("_a", F.lit(1))
    r = returned.groupBy("batch", "cve").agg(F.count("*").alias("_n"))
    both = a.join(r, ["batch", "cve"], "full_outer")
    return both.groupBy("batch").agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"),
        F.count_if(F.col("_n") > 1).alias("repeated")).where("missing + extra + repeated > 0")


def batch_verdicts(rows: DataFrame) -> DataFrame:
    """(batch, admitted) from rows (batch, cve, valid): one bad row rejects its batch."""
    return rows.groupBy("batch").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("admitted"))


def admit_batches(rows: DataFrame) -> DataFrame:
    """Rows of the batches that passed whole. The verdict is an aggregate joined back, so a
    large batch is never gathered for a window."""
    good = batch_verdicts(rows).where("admitted").select("batch")
    return rows.join(good, "batch", "left_semi")


def uncovered_after_admission(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Source ids that no admitted batch covers; a release needs none."""
    return source.select("cve").distinct().join(admit_batches(rows).select("cve"), "cve", "left_anti")


def admission_report(rows: DataFrame, source: DataFrame) -> DataFrame:
    """One row: expected, validated, skipped batches, missing and whether to emit.

    Retried batches are fine when every one of their ids is covered elsewhere.
    """
    admitted = admit_batches(rows)
    counts = admitted.agg(F.count("*").alias("validated"), F.count_distinct("cve").alias("ids"))
    skipped = batch_verdicts(rows).agg(F.count_if(~F.col("admitted")).alias("n")).scalar()
    missing = uncovered_after_admission(rows, source).agg(F.count("*")).scalar()
    expected = source.agg(F.count_distinct("cve")).scalar()
    out = counts.select(expected.alias("expected"), "validated", "ids", skipped.alias("skipped_batches"),
                        missing.alias("missing"))
    exact = (F.col("missing") == 0) & (F.col("validated") == F.col("expected")) & (
        F.col("ids") == F.col("validated"))
    return out.withColumn("emit", exact)


def integrity_failures(df: DataFrame, text: str, recorded: str) -> DataFrame:
    """Rows whose recorded hash is not the hash of the stored text."""
    return df.where(~F.sha2(F.col(text), 256).eqNullSafe(F.lower(recorded)))


def differs(df: DataFrame, saved: str, captured: str) -> DataFrame:
    return df.where(~F.col(saved).eqNullSafe(F.col(captured)))


# --- revisions -------------------------------------------------------------------------
VOLATILE = ["dataset_provenance", "inference", "mitigation_candidates"]


def fingerprint(df: DataFrame) -> Column:
    """Hash of a record's material facts: acquisition hashes, urls and judgement left out."""
    fields = {}
    for name in df.columns:
        if name in VOLATILE:
            continue
        value = F.col(name)
        if name == "cve_program":
            value = value.dropFields(*[f for f in ("sha256", "url") if f in df.schema[name].dataType.names])
        if name == "source":
            value = value.dropFields("revision")
        fields[name] = value
    return canonical_sha256(fields)


def marked(df: DataFrame, mark: str = None) -> Column:
    """The fingerprint of a record: made here, or read from the column ``mark`` where it was stored with the record."""
    return fingerprint(df) if mark is None else F.col(mark)


def revision_diff(before: DataFrame, after: DataFrame, mark: str = None) -> DataFrame:
    """(cve, change) for added, removed and changed records."""
    a = before.select("cve", marked(before, mark).alias("_old"))
    b = after.select("cve", marked(after, mark).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(
        F.col("_old") != F.col("_new"), "changed")
    return a.join(b, "cve", "full_outer").select("cve", change.alias("change")).where("change is not null")


def pending(after: DataFrame, accepted: DataFrame, mark: str = None) -> DataFrame:
    """Records to assess: no accepted row carries their current fingerprint."""
    current = after.withColumn("fingerprint", marked(after, mark)).drop(*([mark] if mark else []))
    return current.join(accepted.select("cve", "fingerprint"), ["cve", "fingerprint"], "left_anti")


def reusable(after: DataFrame, accepted: DataFrame, mark: str = None) -> DataFrame:
    """Accepted rows that still fit: their id and fingerprint are those of a current record; one row an id.

    ``accepted`` has cve, fingerprint and what was accepted. Of several rows that fit, the first by their
    JSON text stays, so reruns agree.
    """
    current = after.select("cve", marked(after, mark).alias("fingerprint"))
    fitting = accepted.join(current, ["cve", "fingerprint"], "left_semi")
    others = [c for c in accepted.columns if c not in ("cve", "fingerprint")]
    if not others:
        return fitting.distinct()
    row = F.struct(*others)
    kept = fitting.groupBy("cve", "fingerprint").agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("r"))
    return kept.select("cve", "fingerprint", "r.*")


def release_gaps(after: DataFrame, assessed: DataFrame, mark: str = None) -> DataFrame:
    """(cve, problem) of a set of assessments against the current records: missing, extra, repeated or stale.

    No rows means that the assessments are those of the current records, each once.
    """
    current = after.select("cve", marked(after, mark).alias("now"))
    held = assessed.groupBy("cve").agg(F.count("*").alias("n"), F.min("fingerprint").alias("then"))
    both = current.join(held, "cve", "full_outer")
    problem = (F.when(F.col("n").isNull(), "missing").when(F.col("now").isNull(), "extra")
               .when(F.col("n") > 1, "repeated").when(F.col("now") != F.col("then"), "stale"))
    return both.select("cve", problem.alias("problem")).where("problem is not null")


def settle_release(snapshot, assess, accepted: DataFrame, revisions: int = 3):
    """Assessments of the newest records, with only changed ones assessed anew: (records, assessments).

    ``snapshot()`` reads the sources anew, ``assess(records)`` gives (cve, ...) rows for the records it is
    handed, ``accepted`` are earlier rows with their fingerprint. Each pass keeps what still fits, assesses
    what is pending and reads the sources again; it ends when nothing has changed meanwhile. Refused: rows
    for ids that are not current, missing or repeated rows, and sources that change in every one of
    ``revisions`` passes. Both tables are written, so a reading is made once and a lost executor repeats
    no assessment of an earlier pass. A reading is written with the fingerprints of its records, so each is
    made once and no later step of a pass reads whole records for it.
    """
    spark, mark = accepted.sparkSession, "_fingerprint"

    def written(df, label):
        path = fresh_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def reading():
        df = snapshot()
        return written(df.withColumn(mark, fingerprint(df)), "revision")

    records = reading()
    for _ in range(revisions):
        kept = reusable(records, accepted, mark)
        new = assess(pending(records, kept, mark)).join(records.select("cve", F.col(mark).alias("fingerprint")), "cve", "left")
        accepted = written(kept.unionByName(new.select(*kept.columns)), "assessed")
        broken = release_gaps(records, accepted, mark).orderBy("cve").limit(5).collect()
        if broken:
            raise ValueError(f"refusing an incomplete or foreign set of assessments: {[tuple(r) for r in broken]}")
        fresh = reading()
        if revision_diff(records, fresh, mark).isEmpty():
            return fresh.drop(mark), accepted
        records = fresh
    raise ValueError(f"the sources changed in all {revisions} passes; nothing is released")


def reserved_hash(columns) -> Column:
    return F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
                        for c in sorted(columns)])


def altered(before: DataFrame, after: DataFrame, columns) -> DataFrame:
    """Ids whose reserved columns an enrichment changed."""
    a = before.select("cve", reserved_hash(columns).alias("_a"))
    b = after.select("cve", reserved_hash(columns).alias("_b"))
    return a.join(b, "cve").where("_a <> _b").select("cve")


# --- published against source -------------------------------------------------------------
def source_audit(published: DataFrame, raw: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """Per record: does each published fact match its raw source?

    raw: cve, score_sets, severity_texts, statement. The score must come from the same
    set as the vector; scores of the feed must share the risk band.
    """
    ids = kev.select("cve").distinct().withColumn("_kev", F.lit(True))
    live = epss.select("cve", F.col("epss").alias("_live"))
    rows = published.join(raw, "cve").join(ids, "cve", "left").join(live, "cve", "left")
    vector, score = F.col("cvss.vector"), F.col("cvss.base_score")
    pair = F.exists("score_sets", lambda s: (s["Vector"] == vector) & s["BaseScore"].eqNullSafe(score))
    sets = F.coalesce(F.size("score_sets"), F.lit(0))
    publisher = F.try_element_at(F.filter("severity.assessments", lambda a: a["role"] == "publisher"), F.lit(1))
    texts = F.col("severity_texts")
    stated = F.coalesce(F.size(texts), F.lit(0)) > 0
    held = F.col("threat.epss")
    return rows.select(
        "cve", F.when(vector.isNotNull(), truthy(pair)).otherwise(sets == 0).alias("cvss_ok"),
        F.when(stated, truthy(F.array_contains(texts, publisher["value"]))).otherwise(
            publisher.isNull()).alias("severity_ok"),
        (F.col("threat.exploitation_assessment") == exploitation_assessment(F.col("statement"))).alias("exploitation_ok"),
        (F.col("threat.kev") == F.col("_kev").isNotNull()).alias("kev_ok"),
        F.when(F.col("_live").isNull(), "absent").when(epss_band(held) != epss_band(F.col("_live")), "band-differs")
        .when(~held.eqNullSafe(F.col("_live")), "drift").otherwise("equal").alias("epss_state"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("records"),
        *[F.count_if(~F.col(f"{n}_ok")).alias(f"{n}_bad") for n in ("cvss", "severity", "exploitation", "kev")],
        *[F.count_if(F.col("epss_state") == s).alias(f"epss_{s.replace('-', '_')}")
          for s in ("absent", "drift", "band-differs", "equal")])


def release_coverage(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Per real month: manifest count, records, ids, complete assessments and verdict."""
    fw = lambda n: F.col(f"inference.framework_assessment.{n}")
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    from advislake.functions import vocab
    factors = reduce(lambda a, b: a & b, [
        F.coalesce(F.length(F.trim(F.try_element_at(fw("factors"), F.lit(n)))) > 0, F.lit(False))
        for n in vocab.FACTORS])
    complete = (truthy(F.col("inference.review_status") == "reviewed") & said(F.col("inference.model"))
                & (F.col("inference.model") != "none") & said(F.col("inference.generated_at"))
                & said(fw("baseline_action")) & said(fw("baseline_likelihood")) & factors
                & said(fw("risk_communication.summary")) & said(fw("risk_communication.why_this_action")))
    per_id = records.groupBy("month", "cve").agg(F.count("*").alias("n"), F.count_if(complete).alias("c"))
    found = per_id.groupBy("month").agg(F.sum("n").alias("records"), F.count("*").alias("ids"),
                                        F.sum("c").alias("complete"))
    real = manifest.where(~F.col("month").endswith("-demo")).select("month", "record_count")
    out = real.join(found, "month", "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("records", "ids", "complete")})
    state = (F.when((F.col("ids") != F.col("records")) | (F.col("records") != F.col("record_count")), "count-mismatch")
             .when(F.col("complete") != F.col("records"), "incomplete").otherwise("ok"))
    return out.withColumn("state", state)


# --- run logs -----------------------------------------------------------------------------
def run_log_errors(events: DataFrame, terminal: str, allowed, expected_model: str = None) -> DataFrame:
    """(stream, error) rows of an event log (stream, seq, type, subtype, model).

    Every stream needs exactly one terminal event, which is last and a success; other
    kinds must be allowed; the served model must be the expected one.
    """
    kind = F.col("type")
    is_end = kind == terminal
    served = F.when(is_end, F.col("model"))
    facts = events.groupBy("stream").agg(
        F.count_if(is_end).alias("ends"), F.max("seq").alias("last"), F.max(F.when(is_end, F.col("seq"))).alias("end"),
        F.max_by(F.when(is_end, F.col("subtype")), F.when(is_end, F.col("seq"))).alias("outcome"),
        F.count_if(~kind.isin(list(allowed) + [terminal])).alias("odd"),
        F.min(served).alias("m0"), F.max(served).alias("m1"))
    wrong = F.lit(False) if expected_model is None else ~(
        F.col("m0").eqNullSafe(F.lit(expected_model)) & F.col("m1").eqNullSafe(F.lit(expected_model)))
    say = lambda test, name: F.when(test, F.lit(name))
    errors = reasons(
        say(F.col("ends") != 1, "not-one-terminal"),
        say((F.col("ends") == 1) & (F.col("end") != F.col("last")), "terminal-not-last"),
        say((F.col("ends") > 0) & ~truthy(F.col("outcome") == "success"), "not-success"),
        say(F.col("odd") > 0, "event-not-allowed"), say(wrong, "model-identity"))
    return facts.select("stream", F.explode(errors).alias("error"))


def content_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count and the sum of row digests (60 bits of MD5).

    A row's text is its columns in name order, parted by U+001F, with ``\\N`` for null; nested columns
    give their JSON.
    """
    nested = ("struct", "array", "map", "variant")
    text = lambda c, kind: F.to_json(c) if kind.startswith(nested) else F.col(c).cast("string")
    parts = [F.coalesce(text(c, kind), F.lit("\\N")) for c, kind in sorted(df.dtypes)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\u001f", *parts)), 1, 15), 16, 10)
    return df.agg(F.count("*").alias("records"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def run_progress(packets: DataFrame, outputs: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: expected, validated, unique ids and explanations, model calls and tokens."""
    expected = packets.agg(F.count_distinct("cve")).scalar()
    spent = usage.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    done = outputs.agg(F.count("*").alias("validated"), F.count_distinct("cve").alias("unique_cves"),
                       F.count_distinct("explanation").alias("unique_explanations"))
    return done.select(expected.alias("expected"), "*", spent.select("calls").scalar().alias("model_calls"),
                       spent.select("tokens").scalar().alias("tokens"))


def action_histogram(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("action").agg(F.count("*").alias("records"))
