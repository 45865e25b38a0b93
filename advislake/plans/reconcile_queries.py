"""Reconciliation, run-log and sampling queries."""
from pyspark.sql import functions as F

from advislake.functions import vocab
from advislake.operators import joins, reconcile, sampling
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import pick


def adv(spark, sf):
    return B.advisories(spark, sf).select("k", "cve")


@register("x1_coverage_gaps", """SELECT cve, 'missing' AS side FROM adv WHERE k % 97 = 0 UNION ALL SELECT cve || '-X', 'unexpected' FROM adv WHERE k % 101 = 0""", ["adv"])
def coverage_gaps(spark, sf):
    a = adv(spark, sf)
    right = a.where("k % 97 <> 0").select("cve").unionByName(a.where("k % 101 = 0").select(F.concat("cve", F.lit("-X")).alias("cve")))
    return reconcile.coverage_gaps(a, right)


@register("x2_duplicates", "SELECT 'CVE-2026-' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0') AS cve, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return reconcile.duplicates(B.adv_remediation(spark, sf), "cve")


@register("x2_first_seen", """SELECT cve, min_by(type, (p1 * 1000000 + p2) * 10 + type::INT) AS type FROM linerem GROUP BY 1""", ["linerem"])
def first_seen(spark, sf):
    return reconcile.first_seen(B.adv_remediation(spark, sf).select(
        "cve", F.struct("pos", "type").alias("pos"), "type"), "cve", "pos").select("cve", "type")


def returned(spark, sf):
    a = adv(spark, sf).withColumn("batch", F.floor(F.col("k") / 10))
    return a, a.where("k % 97 <> 0").unionByName(a.where("k % 89 = 0")).unionByName(
        a.where("k % 83 = 0").withColumn("cve", F.concat("cve", F.lit("-X"))))


@register("x3_batch_difference", """SELECT k // 10 AS batch, count(*) FILTER (k % 97 = 0 AND k % 89 <> 0) AS missing, count(*) FILTER (k % 83 = 0) AS extra,
  count(*) FILTER (k % 89 = 0 AND k % 97 <> 0) AS repeated FROM adv GROUP BY 1 HAVING missing + extra + repeated > 0""", ["adv"])
def batch_difference(spark, sf):
    a, r = returned(spark, sf)
    return reconcile.batch_difference(a, r)


def batches(spark, sf):
    k = F.col("k")
    first = adv(spark, sf).select("cve", F.floor(k / 10).alias("batch"), (k % 97 != 0).alias("valid"))
    retry = adv(spark, sf).where(F.floor(k / 10) % 7 != 3).join(
        first.where("not valid").select("batch").distinct().withColumnRenamed("batch", "_b"), F.floor(k / 10) == F.col("_b"), "left_semi")
    return first.unionByName(retry.select("cve", (-1 - F.floor(k / 10)).alias("batch"), F.lit(True).alias("valid")))


_BAD = "bad AS (SELECT DISTINCT k // 10 AS b FROM adv WHERE k % 97 = 0)"


@register("x4_admit_batches", f"""WITH {_BAD} SELECT cve, k // 10 AS batch FROM adv WHERE k // 10 NOT IN (SELECT b FROM bad)
  UNION ALL SELECT cve, -1 - k // 10 FROM adv WHERE k // 10 IN (SELECT b FROM bad) AND (k // 10) % 7 <> 3""", ["adv"])
def admit_batches(spark, sf):
    return reconcile.admit_batches(batches(spark, sf)).select("cve", "batch")


@register("x4_admission_report", f"""WITH {_BAD}, m AS (SELECT count(*) AS missing FROM adv WHERE k // 10 IN (SELECT b FROM bad) AND (k // 10) % 7 = 3)
  SELECT count(*) AS expected, count(*) - max(missing) AS validated, count(*) - max(missing) AS ids, (SELECT count(*) FROM bad) AS skipped_batches,
   max(missing) AS missing, max(missing) = 0 AS emit FROM adv, m""", ["adv"])
def admission_report(spark, sf):
    return reconcile.admission_report(batches(spark, sf), adv(spark, sf))


@register("x5_integrity_failures", "SELECT doc_id FROM documents WHERE doc_id % 13 = 5")
def integrity(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "text", F.when(
        F.col("doc_id") % 13 == 5, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("recorded"))
    return reconcile.integrity_failures(docs, "text", "recorded").select("doc_id")


@register("x5_saved_differs", "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 1")
def saved_differs(spark, sf):
    rows = B.table(spark, sf, "conversations").withColumn("saved", F.when(F.col("turn") % 3 != 1, F.col("text")))
    return reconcile.differs(rows, "saved", "text").select("conv_id", "turn")


def material(spark, sf):
    """The columns of the release that a fingerprint reads: judgement is left out, so it is not made for it."""
    return B.records(spark, sf, *[c for c in B.RELEASE if c not in reconcile.VOLATILE])


def next_release(spark, sf):
    k = F.col("k")
    r = material(spark, sf).where("k % 43 <> 0")
    r = r.withColumn("cvss", F.when(k % 41 == 0, F.col("cvss").withField("base_score", F.col("cvss.base_score") + 0.1)).otherwise(F.col("cvss")))
    r = r.withColumn("source", F.col("source").withField("revision", F.lit("later")))
    added = material(spark, sf).where("k % 500 = 1").withColumn("cve", F.concat("cve", F.lit("-N")))
    return r.unionByName(added)


_CHANGED = "k % 41 = 0 AND k % 43 <> 0 AND base_score IS NOT NULL"


@register("x6_revision_diff", f"""SELECT cve, 'removed' AS change FROM adv WHERE k % 43 = 0 UNION ALL SELECT cve, 'changed' FROM adv WHERE {_CHANGED}
  UNION ALL SELECT cve || '-N', 'added' FROM adv WHERE k % 500 = 1""", ["adv"])
def revision_diff(spark, sf):
    return reconcile.revision_diff(material(spark, sf), next_release(spark, sf))


@register("x6_pending", f"SELECT cve FROM adv WHERE {_CHANGED} UNION ALL SELECT cve || '-N' FROM adv WHERE k % 500 = 1", ["adv"])
def pending(spark, sf):
    r = material(spark, sf)
    accepted = r.select("cve", reconcile.fingerprint(r).alias("fingerprint"))
    return reconcile.pending(next_release(spark, sf), accepted).select("cve")


@register("x6_settled_release", f"""WITH now AS (SELECT cve, NOT ({_CHANGED}) AS same FROM adv WHERE k % 43 <> 0 UNION ALL SELECT cve || '-N', false FROM adv WHERE k % 500 = 1)
  SELECT cve, CASE WHEN same THEN 'first pass' ELSE 'second pass' END AS made FROM now""", ["adv"])
def settled_release(spark, sf):
    """A release whose sources change while it is assessed: unchanged records keep their first assessment,
    changed and new ones get another, removed ones go."""
    readings = iter([material(spark, sf), next_release(spark, sf), next_release(spark, sf)])
    passes = iter(["first pass", "second pass"])
    none = spark.createDataFrame([], "cve string, fingerprint string, made string")
    _, assessed = reconcile.settle_release(lambda: next(readings), lambda df: df.select("cve", F.lit(next(passes)).alias("made")), none)
    return assessed.select("cve", "made")


@register("x7_altered", "SELECT cve FROM adv WHERE k % 77 = 0", ["adv"])
def altered(spark, sf):
    r = B.records(spark, sf)
    after = r.withColumn("tags", F.when(F.col("k") % 77 == 0, F.concat("tags", F.array(F.lit("x")))).otherwise(F.col("tags")))
    return reconcile.altered(r, after.withColumn("extra", F.lit(1)), ["tags", "cvss", "threat", "severity"])


def raw_rows(spark, sf):
    """Raw source facts of each advisory, with planted disagreements."""
    k = F.col("k")
    other = F.struct(F.lit("CVSS:3.1/AV:P").alias("Vector"), (F.col("base_score") / 2).alias("BaseScore"))
    own = F.struct(F.col("vector").alias("Vector"), F.when(k % 59 == 0, F.col("base_score") + 1).otherwise(F.col("base_score")).alias("BaseScore"))
    rec = B.records(spark, sf).select("cve", F.col("severity.assessments").alias("a"))
    value = F.try_element_at(F.filter("a", lambda a: a["role"] == "publisher"), F.lit(1))["value"]
    texts = F.when(value.isNotNull(), F.array(F.when(k % 61 == 0, "Odd").otherwise(value)))
    return B.advisories(spark, sf).join(rec, "cve").select(
        "cve", F.when(F.col("vector").isNotNull(), F.array(other, own)).alias("score_sets"), texts.alias("severity_texts"),
        F.when(k % 67 == 0, "Exploitation Unlikely").otherwise(F.col("exploit_text")).alias("statement"))


@register("j16_reconcile_sources", "SELECT cve, base_score, coalesce(vector, '') AS vector FROM adv", ["adv"])
def reconcile_sources(spark, sf):
    raw = B.advisories(spark, sf).select("cve", F.col("vector").alias("raw_vector"))
    return joins.reconcile_sources(B.records(spark, sf), raw).select(
        "cve", F.col("cvss.base_score").alias("base_score"), F.coalesce("raw_vector", F.lit("")).alias("vector"))


@register("x8_source_audit", """SELECT count(*) AS records, count(*) FILTER (vector IS NOT NULL AND k % 59 = 0 AND base_score IS NOT NULL) AS cvss_bad,
  count(*) FILTER (pub_band IS NOT NULL AND k % 61 = 0) AS severity_bad, count(*) FILTER (k % 67 = 0 AND exa <> 'unlikely') AS exploitation_bad,
  count(*) FILTER (kev AND k % 2 = 0) AS kev_bad, count(*) FILTER (epss IS NULL OR k % 5 = 0) AS epss_absent,
  count(*) FILTER (k % 5 <> 0 AND k % 4 = 0 AND epss IS NOT NULL AND b0 = b1) AS epss_drift,
  count(*) FILTER (k % 5 <> 0 AND k % 4 = 0 AND epss IS NOT NULL AND b0 <> b1) AS epss_band_differs,
  count(*) FILTER (k % 5 <> 0 AND k % 4 <> 0 AND epss IS NOT NULL) AS epss_equal
  FROM (SELECT *, CASE WHEN epss >= 0.1 THEN 2 WHEN epss >= 0.01 THEN 1 ELSE 0 END AS b0, CASE WHEN epss + 0.1 >= 0.1 THEN 2 ELSE 1 END AS b1 FROM sev)""", ["sev"])
def source_audit(spark, sf):
    from advislake.plans.ingest_queries import fresh_scores
    kev = adv(spark, sf).where("k % 53 = 0 and k % 2 <> 0")
    return reconcile.audit_summary(reconcile.source_audit(
        B.records(spark, sf), raw_rows(spark, sf), kev, fresh_scores(spark, sf)))


@register("x9_release_coverage", """SELECT month, count(*) + CASE WHEN month LIKE '%-Mar' THEN 1 ELSE 0 END AS record_count, count(*) AS records, count(*) AS ids,
  count(*) FILTER (has_fw AND k % 37 <> 0 AND k % 5 <> 2 AND k % 4 <> 1 AND k % 6 <> 5) AS complete,
  CASE WHEN month LIKE '%-Mar' THEN 'count-mismatch' WHEN count(*) FILTER (has_fw AND k % 37 <> 0 AND k % 5 <> 2 AND k % 4 <> 1 AND k % 6 <> 5) <> count(*) THEN 'incomplete' ELSE 'ok' END AS state
  FROM rec GROUP BY 1""", ["rec"])
def release_coverage(spark, sf):
    manifest = B.advisories(spark, sf).groupBy("month").agg(F.count("*").alias("n")).select("month", (
        F.col("n") + F.when(F.col("month").endswith("-Mar"), 1).otherwise(0)).alias("record_count"))
    return reconcile.release_coverage(manifest, B.records(spark, sf))


def run_log(spark, sf):
    """Conversations as streams; the last turn of a stream plays its terminal event."""
    events = B.run_events(spark, sf)
    last = events.groupBy("stream").agg(F.max("seq").alias("end"))
    s, end = F.col("stream"), F.col("seq") == F.col("end")
    return events.join(last, "stream").select(
        "stream", "seq", F.when(end & (s % 11 != 0), "result").when((s % 13 == 0) & (F.col("seq") == 0), "result").otherwise(F.col("type")).alias("type"),
        F.when(s % 7 == 0, "error").otherwise("success").alias("subtype"), F.when(s % 17 == 0, "other").otherwise("model-1").alias("model"))


@register("x10_run_log", """WITH e AS (SELECT conv_id AS s, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
  t AS (SELECT s, turn, last, CASE WHEN turn = last AND s % 11 <> 0 THEN 'result' WHEN s % 13 = 0 AND turn = 0 THEN 'result' ELSE role END AS type FROM e),
  f AS (SELECT s, count(*) FILTER (type = 'result') AS ends, max(last) AS last, max(turn) FILTER (type = 'result') AS fin, count(*) FILTER (type NOT IN ('user', 'assistant', 'result')) AS odd FROM t GROUP BY 1)
  SELECT s AS stream, 'not-one-terminal' AS error FROM f WHERE ends <> 1 UNION ALL SELECT s, 'terminal-not-last' FROM f WHERE ends = 1 AND fin <> last
  UNION ALL SELECT s, 'not-success' FROM f WHERE ends > 0 AND s % 7 = 0 UNION ALL SELECT s, 'event-not-allowed' FROM f WHERE odd > 0
  UNION ALL SELECT s, 'model-identity' FROM f WHERE ends = 0 OR s % 17 = 0""")
def run_log_errors(spark, sf):
    return reconcile.run_log_errors(run_log(spark, sf), "result", ["user", "assistant"], "model-1")


_ORDER_TEXT = " || chr(31) || ".join(f"coalesce({c}::VARCHAR, '\\N')" for c in (
    "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"))


@register("x11_content_digest", f"""SELECT count(*) AS records, sum(('0x' || substr(md5({_ORDER_TEXT}), 1, 15))::BIGINT)::HUGEINT::VARCHAR AS digest FROM orders""")
def content_digest(spark, sf):
    return reconcile.content_digest(B.table(spark, sf, "orders"))


@register("a10_run_progress", """SELECT count(*) AS expected, count(*) FILTER (has_fw) AS validated, count(DISTINCT cve) FILTER (has_fw) AS unique_cves,
  count(DISTINCT CASE WHEN k % 6 <> 5 THEN title END) FILTER (has_fw) AS unique_explanations, (SELECT count(*) FROM events) AS model_calls,
  (SELECT sum(user_id)::BIGINT FROM events) AS tokens FROM rec""", ["rec"])
def run_progress(spark, sf):
    r = B.records(spark, sf)
    out = r.where("inference.framework_assessment is not null").select("cve", F.col(
        "inference.framework_assessment.risk_communication.why_this_action").alias("explanation"))
    usage = B.table(spark, sf, "events").select(F.col("user_id").alias("tokens"))
    return reconcile.run_progress(r, out, usage)


@register("a10_action_histogram", f"SELECT {pick(vocab.ACTIONS, 'saved_a')} AS action, count(*) AS records FROM rec WHERE has_fw GROUP BY 1", ["rec"])
def action_histogram(spark, sf):
    r = B.records(spark, sf).where("inference.framework_assessment is not null")
    return reconcile.action_histogram(r.select(F.col("inference.framework_assessment.baseline_action").alias("action")))


# --- sampling ----------------------------------------------------------------------------
def strata(spark, sf):
    r = B.records(spark, sf).withColumn("mitigation_candidates", F.when(
        F.col("k") % 4 != 1, F.col("mitigation_candidates")))
    return r.select("k", "cve", sampling.stratum(F.col("k") % 211 == 0).alias("stratum"))


_STRATA = """SELECT k, cve, CASE WHEN k % 211 = 0 THEN 'reference-failure' WHEN band = 'unknown' THEN 'unknown-severity' WHEN open_path AND NOT has_impact THEN 'reference-failure'
   WHEN epss >= 0.01 AND exa IN ('unlikely', 'less-likely') THEN 'signal-conflict' WHEN k % 4 = 1 THEN 'no-mitigation-candidates' ELSE 'routine' END AS stratum FROM ev"""


@register("n1_strata", _STRATA, ["ev"])
def strata_of(spark, sf):
    return strata(spark, sf)


@register("n2_dev_holdout_split", f"""WITH s AS ({_STRATA}), c AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1)
  SELECT stratum, split, CASE stratum WHEN 'unknown-severity' THEN 12 WHEN 'signal-conflict' THEN 15 WHEN 'no-mitigation-candidates' THEN 12 ELSE 11 END AS records, true AS disjoint
  FROM c, (VALUES ('dev'), ('holdout')) AS v(split) WHERE stratum <> 'reference-failure' UNION ALL SELECT stratum, 'dev', n, true FROM c WHERE stratum = 'reference-failure'""", ["ev"])
def dev_holdout(spark, sf):
    out = sampling.dev_holdout_split(strata(spark, sf), 20260910, 50)
    # an id in two splits, or twice in one, shows in its own count over the whole draw
    uses = out.groupBy("cve").agg(F.count("*").alias("uses"))
    return out.join(uses, "cve").groupBy("stratum", "split").agg(
        F.count("*").alias("records"), (F.max("uses") == 1).alias("disjoint"))


@register("n3_simple_sample", "SELECT least(20, count(*)) AS drawn, least(20, count(*)) AS ids FROM orders")
def simple_sample(spark, sf):
    drawn = sampling.simple_sample(B.advisories(spark, sf), 7, 20)
    return drawn.join(B.advisories(spark, sf), "cve", "left_semi").agg(
        F.count("*").alias("drawn"), F.count_distinct("cve").alias("ids"))
