"""Source, sink, parsing and feed-join queries."""
from pyspark.sql import functions as F

from advislake import schema
from advislake.functions import scalar, vocab
from advislake.functions.exprs import struct_of, words
from advislake.operators import joins, parse, review, risk, search
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import SELECTION, inlist, pick, values
from advislake.sources import readers, sinks
from advislake.sources.scratch import fresh_path

flat = lambda c, sep="|": F.array_join(c, sep)


def landed(spark, label, frame, fmt="text", **options):
    """Writes derived rows as landed files and returns their folder; text lands compressed, in files of bounded size."""
    path = fresh_path(spark, label)
    bounds = {"compression": "gzip", "maxRecordsPerFile": 100_000} if fmt == "text" else {}
    frame.write.options(**(bounds | options)).format(fmt).save(path)
    return path


def raw_documents(spark, sf):
    """Vendor documents as JSON text, one advisory each, in every accepted spelling."""
    k = F.col("k")
    note = lambda title, kind, value: F.struct(
        F.lit(title).alias("Title"), F.lit(kind).alias("Type"), value.alias("Value"))
    half = F.struct((F.col("base_score") / 2).alias("BaseScore"), F.lit("CVSS:3.1/AV:P").alias("Vector"))
    full = F.struct(F.col("base_score").alias("BaseScore"), F.col("vector").alias("Vector"))
    threat = lambda kind, text: F.struct(F.lit(kind).alias("Type"), F.struct(
        text.alias("Value")).alias("Description"))
    ids = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(
        F.lit("P"), ((k * 3 + i * 7) % 200).cast("string")))
    vulnerability = F.struct(
        F.col("cve").alias("CVE"), F.struct(F.col("title").alias("Value")).alias("Title"),
        F.array_compact(F.array(
            note("Description", 2, F.col("title")),
            F.when(F.col("customer_action_note").isNotNull(), note("Customer Action Required", 7, F.lit("Yes"))),
            F.when(F.col("customer_action_note").isNotNull(),
                   note("Customer Action Required", 7, F.col("customer_action_note"))))).alias("Notes"),
        F.array_compact(F.array(
            F.when(F.col("severity_text").isNotNull(), threat(3, F.col("severity_text"))),
            F.when(F.col("exploit_text") != "", threat(1, F.col("exploit_text"))))).alias("Threats"),
        F.when(F.col("base_score").isNotNull(), F.array(half, full, F.struct(
            F.col("base_score").alias("BaseScore"), F.lit("CVSS:3.0/AV:P").alias("Vector")))).alias("CVSSScoreSets"),
        F.array(F.struct(F.lit(3).alias("Type"), ids.alias("ProductID"))).alias("ProductStatuses"),
        F.array(F.struct(F.lit(2).alias("Type"), F.lit("Security Update").alias("SubType"),
                         ids.alias("ProductID"))).alias("Remediations"))
    tracking = F.struct(F.struct(F.col("cve").alias("Value")).alias("ID"),
                        F.lit("2026-09-08").alias("CurrentReleaseDate"))
    doc = lambda v, name: F.to_json(F.struct(tracking.alias("DocumentTracking"), v.alias(name)))
    return B.advisories(spark, sf).select(
        F.when(k % 3 == 0, doc(F.array(vulnerability), "Vulnerabilities"))
        .when(k % 3 == 1, doc(vulnerability, "Vulnerability"))
        .otherwise(doc(F.array(vulnerability), "vulnerabilities")).alias("value"))


def vendor_documents(spark, sf):
    return readers.read_vendor_documents(spark, landed(spark, "documents", raw_documents(spark, sf)))


def vulnerabilities(spark, sf, *fields):
    return readers.vulnerability_rows(vendor_documents(spark, sf), *fields)


# --- sources ---------------------------------------------------------------------------
@register("s1_read_advisories", """SELECT cve, month, title, band, car AS action_required, k % 4 AS n_products FROM rec
  UNION ALL SELECT cve, 'unknown', 'Untitled vulnerability', 'unknown', NULL, 0 FROM (SELECT cve || '-X' AS cve FROM adv WHERE k % 10 = 0)""", ["rec"])
def read_advisories(spark, sf):
    full = B.records(spark, sf).drop("k").select(F.to_json(F.struct("*")).alias("value"))
    bare = B.advisories(spark, sf).where("k % 10 = 0").select(F.to_json(F.struct(
        F.concat("cve", F.lit("-X")).alias("cve"), F.lit("Critical").alias("severity"))).alias("value"))
    path = landed(spark, "advisories", full.unionByName(bare))
    from advislake.operators.severity import severity_band
    return readers.read_advisories(spark, path).select(
        "cve", "month", "title", severity_band().alias("band"),
        F.col("customer_action_required").alias("action_required"), F.size("products").alias("n_products"))


@register("s1_broken_lines", "SELECT '{\"cve\": \"' || cve AS line FROM adv WHERE k % 100 = 7", ["adv"])
def broken_lines(spark, sf):
    rows = B.advisories(spark, sf).select(F.when(F.col("k") % 100 == 7, F.concat(
        F.lit('{"cve": "'), "cve")).otherwise(F.to_json(F.struct("cve", "title"))).alias("value"))
    return readers.broken_lines(spark, landed(spark, "broken", rows))


@register("s2_read_vendor_documents", """SELECT cve, title, '2026-09-08' AS revision, 1 + CASE WHEN customer_action_note IS NULL THEN 0 ELSE 2 END AS notes,
  (severity_text IS NOT NULL)::INT + (exploit_text <> '')::INT AS threats FROM adv""", ["adv"])
def read_vendor_documents(spark, sf):
    return vulnerabilities(spark, sf, "cve", "title", "notes", "threats").select("cve", "title", "revision", F.size("notes").alias("notes"),
                                             F.size("threats").alias("threats"))


@register("s3_read_kev", "SELECT cve FROM kev", ["kev"])
def read_kev(spark, sf):
    twice = B.kev(spark, sf).select(F.to_json(F.struct(F.array(
        F.struct(F.col("cve").alias("cveID")), F.struct(F.col("cve").alias("cveID"))).alias("vulnerabilities"))).alias("value"))
    return readers.read_kev(spark, landed(spark, "kev", twice), multi_line=False)


_LATE = "CAST(right(cve, 7) AS INTEGER) % 10 <> 3"


def epss_files(spark, sf):
    """Two files with a date each: half scores of all ids, then the scores of most ids again."""
    rows = B.epss(spark, sf)
    late = F.substring("cve", -7, 7).cast("int") % 10 != 3
    line = lambda score: F.concat_ws(",", "cve", score.cast("string"), F.col("percentile").cast("string"))
    lines = rows.select(F.explode(F.array(
        F.struct(F.lit(1).alias("day"), line(F.col("epss") / 2).alias("value")),
        F.struct(F.lit(2).alias("day"), F.when(late, line(F.col("epss"))).alias("value")))).alias("r")).select("r.*")
    heads = spark.createDataFrame([(d, at, text) for d in (1, 2) for at, text in enumerate(
        [f"#model_version:v1,score_date:2026-09-{9 + d:02d}T00:00:00+0000", "cve,epss,percentile"])], "day int, at int, value string")
    both = heads.unionByName(lines.where("value is not null").withColumn("at", F.lit(2)))
    path = fresh_path(spark, "scores")
    both.repartition("day").sortWithinPartitions("day", "at").drop("at").write.partitionBy("day").text(path)
    return path


@register("s4_read_epss_last_wins", f"SELECT cve, round(CASE WHEN {_LATE} THEN epss ELSE epss / 2 END, 6) AS epss FROM epss", ["epss"])
def read_epss(spark, sf):
    return readers.read_epss(spark, epss_files(spark, sf)).select("cve", F.round("epss", 6).alias("epss"))


@register("s5_read_epss_dated", f"""SELECT CASE WHEN {_LATE} THEN '2026-09-11' ELSE '2026-09-10' END AS score_date, count(*) AS records,
round(sum(percentile), 4) AS total FROM epss GROUP BY 1""", ["epss"])
def read_epss_dated(spark, sf):
    return readers.read_epss(spark, epss_files(spark, sf)).groupBy("score_date").agg(
        F.count("*").alias("records"), F.round(F.sum("percentile"), 4).alias("total"))


@register("s6_read_overlay", "SELECT cve, 'last' AS note FROM adv WHERE k % 8 <> 0", ["adv"])
def read_overlay(spark, sf):
    rows = B.advisories(spark, sf).where("k % 8 <> 0").select(F.explode(F.array(
        F.to_json(F.struct("cve", F.lit("first").alias("note"))),
        F.to_json(F.struct("cve", F.lit("last").alias("note"))))).alias("value"))
    return readers.read_overlay(spark, landed(spark, "overlay", rows), "cve string, note string")


def month_files(spark, sf):
    """One small file per month whose content is known, for provenance and discovery."""
    months = B.advisories(spark, sf).groupBy("month").agg(F.count("*").alias("n"))
    path = fresh_path(spark, "months")
    months.select(F.concat("month", F.lit("="), F.col("n").cast("string")).alias("value"), "month").repartition(
        "month").write.partitionBy("month").text(path)
    return path


@register("s8_file_provenance", "SELECT length(v) + 1 AS bytes, sha256(v || chr(10)) AS sha256 FROM (SELECT month || '=' || count(*) AS v FROM adv GROUP BY month)", ["adv"])
def file_provenance(spark, sf):
    return readers.file_provenance(spark, month_files(spark, sf)).select("bytes", "sha256")


@register("s9_published_datasets", """WITH m AS (SELECT DISTINCT month FROM adv)
  SELECT month || '.jsonl' AS file, CASE WHEN month LIKE '%-Feb' THEN 'not-in-manifest' WHEN month LIKE '%-Mar' THEN 'missing-file' ELSE 'refresh' END AS state FROM m
  UNION ALL SELECT 'demo-' || month || '.jsonl', 'synthetic' FROM m WHERE month LIKE '%-Jan'""", ["adv"])
def published_datasets(spark, sf):
    files = readers.file_provenance(spark, month_files(spark, sf)).select(
        F.concat(F.regexp_extract("path", "month=([^/]+)", 1), F.lit(".jsonl")).alias("file"))
    present = files.where(~F.col("file").contains("-Mar"))
    months = B.advisories(spark, sf).select("month").distinct()
    entry = lambda df, name: df.select("month", F.concat(F.lit(name), "month", F.lit(".jsonl")).alias("file"),
                                       F.lit(None).cast("boolean").alias("synthetic"))
    manifest = entry(months.where(~F.col("month").contains("-Feb")), "").unionByName(
        entry(months.where(F.col("month").contains("-Jan")), "demo-"))
    return readers.published_datasets(manifest, present).select("file", "state")


# --- sinks -----------------------------------------------------------------------------
def whole_records(spark, sf):
    """The release with every field that a stored record can carry."""
    k = F.col("k")
    variant = lambda **parts: F.parse_json(F.to_json(struct_of(**parts)))
    program = F.col("cve_program").withField("sha256", F.sha2("cve", 256)).withField("date_updated", F.lit("2026-02-01")) \
        .withField("ssvc_provider", F.lit("CISA-ADP")).withField("cna", variant(title=F.col("title"), weaknesses=F.array(F.lit("CWE-79"))))
    violation = F.from_json(F.lit('[{"code": "direction-contradiction", "control": "waf_virtual_patch", "direction": "local", '
                                  '"applies_to_direction": ["inbound"], "claimed": {"likelihood_steps": 1}, "evidence": "e", "message": "m"}]'),
                            schema.VIOLATIONS)
    judged = F.col("inference").withField("assessment_status", F.lit("model-assessed")).withField("guidance_version", F.lit("monthly-1")) \
        .withField("direction_gate.reason", F.when(k % 2 == 0, "stated")).withField("direction_gate.violations", violation) \
        .withField("verification", variant(reviewer=F.lit("qa"), n=k)).withField("pipeline_validation", variant(type=F.lit("t"))) \
        .withField("invocation", variant(batch=k, schema_enforced=F.lit(True)))
    return B.records(spark, sf).withColumns({
        "cve_program": program, "inference": judged, "dataset_provenance": variant(epss_source=struct_of(url=F.lit("u"), n=k)),
        "review": variant(required=k % 2 == 0, reasons=F.array(F.lit("r"))), "priority": F.parse_json(F.lit('"Immediate"')),
        "assessment": variant(profile=struct_of(a=k / 4)), "tier1_review": variant(status=F.lit("flagged"))}).drop("k")


@register("k1_export_jsonl", "SELECT cve, true AS whole FROM adv", ["adv"])
def export_jsonl(spark, sf):
    """Exported and read again: one canonical digest of all leaves before and after."""
    path = fresh_path(spark, "export")
    given = whole_records(spark, sf)
    sinks.export_jsonl(given, path, "gzip")
    # a VARIANT orders its keys, so field order does not matter
    digest = lambda df, name: df.select("cve", F.sha2(F.to_json(F.parse_json(F.to_json(F.struct(
        *sorted(df.columns))))), 256).alias(name))
    # both sides are whole releases, but two columns out of many are estimated to be small enough for a broadcast
    back = digest(readers.read_advisories(spark, path), "b").hint("merge")
    return digest(given, "a").join(back, "cve").select(
        "cve", (F.col("a") == F.col("b")).alias("whole"))


@register("k2_assessed_export", f"""SELECT cve, {pick([vocab.PRIORITY_LABELS[a] for a in vocab.ACTIONS], 'res_a')} AS residual, required,
  {len(SELECTION)} AS selected FROM fullrec""", ["fullrec"])
def assessed_export(spark, sf):
    return sinks.with_assessment(B.records(spark, sf), SELECTION, "2026-09-10T00:00:00Z").select(
        "cve", F.col("assessment.profile.residual.action").alias("residual"),
        F.col("assessment.review.required").alias("required"),
        F.size("assessment.selected_mitigations").alias("selected"))


@register("k3_publication_annotate", f"""SELECT month, {pick([vocab.PRIORITY_LABELS[a] for a in vocab.ACTIONS], 'base_a')} AS priority,
  count(*) AS records, count(*) FILTER (required) AS to_review FROM fullrec GROUP BY 1, 2""", ["fullrec"])
def publication_annotate(spark, sf):
    path = fresh_path(spark, "published")
    sinks.publish(B.records(spark, sf), path)
    return spark.read.parquet(path).groupBy("month", "priority").agg(
        F.count("*").alias("records"), F.count_if("review.required").alias("to_review"))


@register("k3_publish_month", """SELECT month, count(*) AS records, count(*) FILTER (month LIKE '%-Sep') AS changed,
  md5(string_agg(CASE WHEN month LIKE '%-Sep' THEN upper(title) ELSE title END, '|' ORDER BY cve)) AS titles FROM adv WHERE k % 8 <> 0 GROUP BY 1""", ["adv"])
def publish_month(spark, sf):
    """All months published, then the Septembers anew: the other months stay, and the manifest leads to each."""
    root = fresh_path(spark, "releases")
    complete = B.records(spark, sf).where("inference.framework_assessment is not null")  # k % 8 <> 0; a month with gaps is refused
    complete = complete.withColumn("inference", F.col("inference").withField("review_status", F.lit("reviewed")))
    sinks.publish_release(complete, root, "2026-09-10T00:00:00Z")
    again = complete.where(F.col("month").endswith("-Sep")).withColumn("title", F.upper("title"))
    sinks.publish_release(again, root, "2026-09-11T00:00:00Z")
    rows = sinks.published_release(spark, root).select("month", "cve", "title", (F.upper("title") == F.col("title")).alias("changed"))
    titles = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cve", "title"))), lambda x: x["title"]), "|"))
    return rows.groupBy("month").agg(F.count("*").alias("records"), F.count_if("changed").alias("changed"), titles.alias("titles"))


@register("k4_publication_gates", """SELECT month, 'partial-assessment' AS gate, count(*) AS expected, count(*) FILTER (has_fw) AS found FROM rec
  GROUP BY 1 HAVING count(*) <> count(*) FILTER (has_fw)""", ["rec"])
def publication_gates(spark, sf):
    return sinks.publication_gates(B.records(spark, sf))


@register("k5_manifest_upsert", """WITH m AS (SELECT month, count(*) AS n FROM adv GROUP BY 1)
  SELECT month, CASE WHEN month LIKE '%-Sep' THEN n ELSE 0 END AS record_count FROM m WHERE month NOT LIKE '%-Oct'
  UNION ALL SELECT month, n FROM m WHERE month LIKE '%-Oct'""", ["adv"])
def manifest_upsert(spark, sf):
    months = B.advisories(spark, sf).groupBy("month").agg(F.count("*").alias("record_count"))
    old = months.where(~F.col("month").contains("-Oct")).withColumn("record_count", F.lit(0).cast("bigint"))
    return sinks.upsert_manifest(old, months.where(F.col("month").rlike("-(Sep|Oct)$")))


# --- parsing ---------------------------------------------------------------------------
@register("p1_product_tree", f"""WITH p AS (SELECT p_partkey AS n, {pick(B.PRODUCT_NAMES, 'p_partkey % 16')} AS name FROM part)
  SELECT 'T' || n AS doc_id, 'P' || n AS product_id, name FROM p UNION ALL SELECT 'T' || n, 'Q' || n, 'late ' || name FROM p
  UNION ALL SELECT 'T' || n, 'R' || n, 'deep ' || name FROM p""")
def product_tree(spark, sf):
    n = F.col("p_partkey")
    name = B._at(B.PRODUCT_NAMES, n % 16)
    leaf = lambda prefix, value: F.struct(F.concat(F.lit(prefix), n.cast("string")).alias("ProductID"),
                                          value.alias("Value"))
    branch = F.struct(F.lit("Family").alias("Name"), F.array(F.struct(
        F.lit("x").alias("Name"), F.array(leaf("Q", name), leaf("R", F.concat(F.lit("deep "), name))).alias("Items"))).alias("Items"))
    tree = F.struct(F.array(branch).alias("Branch"), F.array(
        leaf("P", name), leaf("Q", F.concat(F.lit("late "), name))).alias("FullProductName"))
    # one narrow column dealt out, as a file of millions of parts is read by one task
    parts = B.table(spark, sf, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    docs = parts.select(F.concat(F.lit("T"), n.cast("string")).alias("doc_id"),
                                             F.parse_json(F.to_json(tree)).alias("tree"))
    return parse.product_names(docs)


@register("p2_product_ids", """SELECT cve, (SELECT string_agg(id, '|' ORDER BY id) FROM (SELECT DISTINCT 'P' || ((k * 3 + i * 7) % 200) AS id FROM (SELECT range AS i FROM range(3)) WHERE i <= k % 3)) AS ids FROM adv""", ["adv"])
def product_ids(spark, sf):
    return vulnerabilities(spark, sf, "cve", "product_ids").select("cve", flat(F.col("product_ids")).alias("ids"))


@register("p3_threat_description", "SELECT cve, coalesce(severity_text, '') AS severity, exploit_text FROM adv", ["adv"])
def threat_descriptions(spark, sf):
    return vulnerabilities(spark, sf, "cve", "threats").select(
        "cve", parse.threat_description(F.col("threats"), "3").alias("severity"),
        parse.threat_description(F.col("threats"), "1").alias("exploit_text"))


@register("p4_best_cvss", """SELECT cve, base_score AS score, CASE WHEN base_score = 0 THEN 'CVSS:3.1/AV:P' ELSE vector END AS vector FROM adv
  WHERE base_score IS NOT NULL""", ["adv"])
def best_cvss(spark, sf):
    best = parse.best_cvss(F.col("score_sets"))
    return (vulnerabilities(spark, sf, "cve", "score_sets").select("cve", best.alias("b")).where("b is not null")
            .select("cve", F.col("b.BaseScore").alias("score"), F.col("b.Vector").alias("vector")))


@register("p5_vector_fields", "SELECT cve, av, pr, ui FROM facts", ["facts"])
def vector_fields(spark, sf):
    a = parse.vector_fields(F.col("vector"))
    return B.advisories(spark, sf).select("cve", a["vector"].alias("av"), a["privileges_required"].alias("pr"),
                                          a["user_interaction"].alias("ui"))


@register("p6_cvss_version", "SELECT cve, CASE WHEN vector LIKE 'CVSS:3.1%' THEN '3.1' ELSE 'unknown' END AS version FROM adv", ["adv"])
def cvss_version(spark, sf):
    return B.advisories(spark, sf).select("cve", parse.cvss_version(F.col("vector")).alias("version"))


@register("p8_exploitation_assessment", "SELECT cve, exa FROM facts", ["facts"])
def exploitation(spark, sf):
    return B.advisories(spark, sf).select("cve", parse.exploitation_assessment(F.col("exploit_text")).alias("exa"))


@register("p9_disclosure_flags", """SELECT cve, det, CASE WHEN exploit_text <> '' THEN exploit_text LIKE '%Disclosed:Yes%' END AS disclosed FROM facts""", ["facts"])
def disclosure(spark, sf):
    return B.advisories(spark, sf).select("cve", parse.exploitation_detected(F.col("exploit_text")).alias("det"),
                                          parse.publicly_disclosed(F.col("exploit_text")).alias("disclosed"))


@register("p10_notes_and_remediations", """SELECT cve, car AS action_required, 1 + CASE WHEN customer_action_note IS NULL THEN 0 ELSE 2 END AS notes, k % 3 + 1 AS fixed FROM facts""", ["facts"])
def notes(spark, sf):
    v = vulnerabilities(spark, sf, "cve", "notes", "remediations")
    rows = v.select("cve", parse.note_rows(F.col("notes")).alias("notes"),
                    parse.remediation_rows(F.col("remediations")).alias("remediations"))
    return rows.select("cve", parse.customer_action(F.col("notes")).alias("action_required"),
                       F.size("notes").alias("notes"), F.size(F.col("remediations")[0]["product_ids"]).alias("fixed"))


@register("p11_product_tags", "SELECT cve, string_agg(tag, '|' ORDER BY tag) AS tags FROM ltag GROUP BY 1", ["ltag"])
def product_tags(spark, sf):
    titles = B.advisories(spark, sf).select("cve", "title")
    return parse.product_tags_by_cve(B.adv_product(spark, sf), titles).select(
        "cve", flat(F.col("product_tags")).alias("tags"))


@register("p11_product_tags_nested", "SELECT cve, string_agg(tag, '|' ORDER BY tag) AS tags FROM ptag GROUP BY 1", ["ptag"])
def product_tags_nested(spark, sf):
    tags = parse.product_tags(F.transform("products", lambda p: p["name"]), F.col("title"))
    return B.records(spark, sf).select("cve", flat(tags).alias("tags"))


@register("p12_title_component", f"SELECT cve, CASE WHEN k % 17 <> 0 THEN {pick(B.COMPONENTS, 'k % 12')} END AS component FROM adv", ["adv"])
def title_component(spark, sf):
    return B.advisories(spark, sf).select("cve", parse.title_component(F.col("title")).alias("component"))


@register("p13_workload_tags", "SELECT a.cve, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS tags FROM adv a LEFT JOIN comptag c ON c.k = a.k GROUP BY 1", ["adv", "comptag"])
def workload_tags(spark, sf):
    return B.advisories(spark, sf).select("cve", flat(F.coalesce(
        parse.workload_tags(F.col("title")), words([]))).alias("tags"))


def tree_names(rows):
    """A name of each listed product, made of its id and its document: no two documents agree."""
    listed = rows.select("doc_id", F.explode("product_ids").alias("product_id")).distinct()
    return listed.where("product_id <> 'P7'").withColumn("name", F.concat_ws(" of ", "product_id", "doc_id"))


@register("p14_assemble_records", """SELECT f.cve, f.title, sev_word AS severity, sev_basis AS basis, base_score AS score, CASE WHEN base_score IS NULL THEN 'unknown' WHEN base_score = 0 THEN 'physical' ELSE av END AS av, kev, det,
  CASE WHEN k % 8 <> 0 THEN 'unlikely' ELSE exa END AS exa, round(epss, 6) AS epss, car AS action_required, k % 3 + 1 AS n_products, k % 3 + 1 AS own_names,
  '1.0' AS schema_version, '2026-Sep' AS month, CASE WHEN k % 8 <> 0 THEN 'web' ELSE '' END AS tags, CASE WHEN k % 8 <> 0 THEN 'assessor-2' ELSE 'none' END AS model,
  'MSRC CVRF' AS source_type, '2026-09-08' AS revision, 1 + CASE WHEN customer_action_note IS NULL THEN 0 ELSE 2 END AS notes, 1 AS remediations, 'feed' AS provenance
  FROM sev f""", ["sev"])
def assemble(spark, sf):
    from advislake.plans.assemble import build_records
    documents = vendor_documents(spark, sf)  # landed once
    rows = readers.vulnerability_rows(documents)
    listed = readers.vulnerability_rows(documents, "cve", "product_ids")
    overlay = B.records(spark, sf, "k", "cve", "mitigation_candidates").where("k % 8 <> 0").select(
        "cve", words(["web", "web"]).alias("o_tags"), F.col("mitigation_candidates").alias("o_candidates"),
        F.struct(F.lit("assessor-2").alias("model")).alias("o_inference"),
        F.struct(F.lit("unlikely").alias("exploitation_assessment")).alias("o_threat"))
    out = build_records(rows, tree_names(listed), B.kev(spark, sf), B.epss(spark, sf), "2026-Sep", overlay,
                        F.parse_json(F.lit('{"source": "feed"}')), listed)
    own = F.filter("products", lambda p: (p["name"] == F.concat_ws(" of ", p["product_id"], F.col("cve"))) | (p["product_id"] == "P7"))
    return out.select(
        "cve", "title", F.col("severity_word").alias("severity"), F.col("severity_basis").alias("basis"),
        F.col("cvss.base_score").alias("score"), F.col("attack.vector").alias("av"), "threat.kev",
        F.col("threat.exploitation_detected").alias("det"), F.col("threat.exploitation_assessment").alias("exa"),
        F.round("threat.epss", 6).alias("epss"), F.col("customer_action_required").alias("action_required"),
        F.size("products").alias("n_products"), F.size(own).alias("own_names"), "schema_version", "month",
        flat(F.col("tags")).alias("tags"), "inference.model", F.col("source.type").alias("source_type"), "source.revision",
        F.size("vendor_guidance.notes").alias("notes"), F.size("vendor_guidance.remediations").alias("remediations"),
        F.try_variant_get("dataset_provenance", "$.source", "string").alias("provenance"))


@register("p15_tag_refresh", """SELECT count(*) AS records, count(*) FILTER (k % 5 = 0) AS changed, count(*) FILTER (n = 1) AS generic
  FROM (SELECT k, count(*) AS n FROM ptag GROUP BY 1)""", ["ptag"])
def tag_refresh(spark, sf):
    old = B.records(spark, sf).withColumn("product_tags", F.when(
        F.col("k") % 5 == 0, words(["stale"])).otherwise(F.col("product_tags")))
    return parse.tag_refresh(old).agg(F.count("*").alias("records"), F.count_if("tags_changed").alias("changed"),
                                      F.count_if("generic_only").alias("generic"))


def program_documents(spark, sf):
    """CVE program documents as JSON text derived from the advisories."""
    k = F.col("k")
    metric = F.struct(F.struct(F.col("cna_band").alias("baseSeverity"), ((k * 31) % 101 / F.lit(10.0)).alias("baseScore"),
                               F.lit("V").alias("vectorString")).alias("cvssV3_1"))
    text = F.concat("title", F.when(k % 11 == 0, F.concat(
        F.lit(" (Chromium security severity: "), F.coalesce("cna_band", F.lit("Low")), F.lit(")"))).otherwise(""))
    versions = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: F.struct(
        i.cast("string").alias("version"), F.lit("affected").alias("status")))
    option = lambda name, v: F.create_map(F.lit(name), v)
    ssvc = lambda e, at: F.struct(F.struct(F.lit("ssvc").alias("type"), F.struct(F.lit(at).alias("timestamp"), F.array(
        option("Exploitation", e), option("Automatable", F.when(k % 4 == 0, "yes").otherwise("no")),
        option("Technical Impact", F.lit("total"))).alias("options")).alias("content")).alias("other"))
    from advislake.functions.exprs import label_of
    bare = F.struct(F.struct(F.lit("BARE").alias("shortName")).alias("providerMetadata"),
                    F.lit(None).cast(parse.ADP_METRICS).alias("metrics"))
    adp = F.array(bare, F.struct(F.struct(F.lit("OTHER").alias("shortName")).alias("providerMetadata"),
                           F.array(ssvc(F.lit("none"), "t0")).alias("metrics")),
                  F.struct(F.struct(F.lit("CISA-ADP").alias("shortName")).alias("providerMetadata"),
                           F.array(ssvc(label_of(["none", "poc", "active"], k % 3), "t1")).alias("metrics")))
    cna = F.struct(
        F.array(F.struct(F.lit("de").alias("lang"), F.lit("fremd").alias("value")),
                F.struct(F.lit("en-US").alias("lang"), text.alias("value"))).alias("descriptions"),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), (k % 50).cast("string")).alias("description"))).alias("descriptions"))).alias("problemTypes"),
        F.array(F.struct(F.lit("https://a.example").alias("url"), F.array(F.lit("patch")).alias("tags")),
                F.struct(F.lit("").alias("url"), words([]).alias("tags"))).alias("references"),
        F.transform(F.sequence(F.lit(0), (k % 8).cast("int")), lambda i: F.struct(
            F.lit("v").alias("vendor"), i.cast("string").alias("product"), versions.alias("versions"))).alias("affected"),
        F.when(k % 7 == 0, F.array(metric)).alias("metrics"))
    doc = F.struct(
        F.struct(F.col("cve").alias("cveId"), F.lit("PUBLISHED").alias("state"), F.col("assigner").alias("assignerShortName"),
                 F.lit("2026-01-01").alias("datePublished"), F.lit("2026-02-01").alias("dateUpdated")).alias("cveMetadata"),
        F.struct(cna.alias("cna"), F.when(k % 10 != 5, adp).alias("adp")).alias("containers"))
    return B.advisories(spark, sf).select("k", "cve", F.to_json(doc).alias("text"))


def parsed_programs(spark, sf):
    docs = program_documents(spark, sf).withColumn("doc", F.from_json("text", parse.PROGRAM_SCHEMA))
    return docs.select("k", "cve", *[c.alias(n) for n, c in parse.program_facts().items()])


@register("p16_program_facts", """SELECT cve, assigner, title || CASE WHEN k % 11 = 0 THEN ' (Chromium security severity: ' || coalesce(cna_band, 'Low') || ')' ELSE '' END AS description,
  'CWE-' || (k % 50) AS problem_types, 1 AS refs, least(k % 8 + 1, 6) AS affected, least(k % 9 + 1, 6) AS versions FROM adv""", ["adv"])
def program_facts(spark, sf):
    return parsed_programs(spark, sf).select(
        "cve", "assigner", "description", flat(F.col("problem_types")).alias("problem_types"),
        F.size("references").alias("refs"), F.size("affected").alias("affected"),
        F.size(F.col("affected")[0]["versions"]).alias("versions"))


@register("p17_cna_severity", """SELECT cve, CASE WHEN k % 7 = 0 THEN cna_band ELSE cna_band END AS band, CASE WHEN k % 7 = 0 THEN 'cvss-qualitative' ELSE 'chromium' END AS scale,
  CASE WHEN k % 7 = 0 THEN '3.1' END AS version FROM adv WHERE k % 7 = 0 OR k % 11 = 0""", ["adv"])
def cna_severity(spark, sf):
    return parsed_programs(spark, sf).where("vendor_severity is not null").select(
        "cve", "vendor_severity.band", "vendor_severity.scale", F.col("vendor_severity.cvss_version").alias("version"))


@register("p18_ssvc_points", f"""SELECT cve, {pick(['none', 'poc', 'active'], 'k % 3')} AS exploitation, CASE WHEN k % 4 = 0 THEN 'yes' ELSE 'no' END AS automatable,
  'total' AS technical_impact, 'CISA-ADP' AS provider FROM adv WHERE k % 10 <> 5""", ["adv"])
def ssvc_points(spark, sf):
    return parsed_programs(spark, sf).where("ssvc is not null").select(
        "cve", "ssvc.exploitation", "ssvc.automatable", "ssvc.technical_impact", F.col("ssvc_provider").alias("provider"))


@register("p19_record_url", f"""SELECT id, CASE WHEN id LIKE 'CVE-2026-%' THEN '{parse.RAW_BASE}/2026/' || CASE WHEN length(s) <= 3 THEN '0' ELSE substr(s, 1, length(s) - 3) END
   || 'xxx/' || id || '.json' END AS url FROM (SELECT k, CASE WHEN k % 9 = 4 THEN 'GHSA-' || k ELSE 'CVE-2026-' || k END AS id, CAST(k AS VARCHAR) AS s FROM adv)""", ["adv"])
def record_url(spark, sf):
    ids = B.advisories(spark, sf).select(F.when(F.col("k") % 9 == 4, F.concat(F.lit("GHSA-"), F.col("k").cast("string")))
                                         .otherwise(F.concat(F.lit("CVE-2026-"), F.col("k").cast("string"))).alias("id"))
    return ids.select("id", parse.record_url(F.col("id")).alias("url"))


@register("p20_evidence_facts", """SELECT cve, CASE WHEN base_score IS NULL THEN 'CVE|Notes|ProductStatuses|Remediations|Threats|Title'
  ELSE 'CVE|CVSSScoreSets|Notes|ProductStatuses|Remediations|Threats|Title' END AS members FROM adv""", ["adv"])
def evidence_facts(spark, sf):
    facts = parse.evidence_facts(F.col("raw"), "vendor")
    return vulnerabilities(spark, sf, "cve").select("cve", flat(F.array_sort(F.map_keys(facts))).alias("members"))


@register("p20_cna_evidence", """SELECT cve, CASE WHEN k % 7 = 0 THEN 'affected|descriptions|metrics|problemTypes|references'
  ELSE 'affected|descriptions|problemTypes|references' END AS members FROM adv""", ["adv"])
def cna_evidence(spark, sf):
    docs = program_documents(spark, sf).select("cve", F.try_variant_get(
        F.parse_json("text"), "$.containers.cna", "variant").alias("cna"))
    return docs.select("cve", flat(F.array_sort(F.map_keys(parse.evidence_facts(F.col("cna"), "cna")))).alias("members"))


@register("p20_program_evidence", """SELECT cve, md5('{"containers":{' || CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN '"adp":{"title":"one"},' ELSE
   '"adp":[{"metrics":[{"score":' || k % 10 || '}],"providerMetadata":{"shortName":"ADP"},"title":"adp ' || k % 3 || '"},{}],' END
   || '"cna":{"affected":[{"contact":"inside","product":"p' || k % 5 || '"}],"providerMetadata":{"dateUpdated":"d1","shortName":"' || assigner || '"},"title":"' || title
   || '"}},"cveMetadata":{"cveId":"' || cve || '","datePublished":"2026-09-01"' || CASE WHEN k % 9 = 4 THEN '' ELSE ',"state":"PUBLISHED"' END || '}}') AS digest FROM adv""", ["adv"])
def program_evidence(spark, sf):
    """Digests of rebuilt program records; a member that must go is planted at every level."""
    k, one = F.col("k"), F.array(F.lit("jane"))
    adp = F.array(
        struct_of(title=F.concat(F.lit("adp "), (k % 3).cast("string")), providerMetadata=struct_of(shortName="ADP", orgId="o"),
                  metrics=F.array(struct_of(score=k % 10)), x_tool=F.lit("t")),
        struct_of(title=F.lit(None).cast("string"), providerMetadata=F.lit(None).cast("struct<shortName:string,orgId:string>"),
                  metrics=F.lit(None).cast("array<struct<score:bigint>>"), x_tool=F.lit("only this")))
    doc = struct_of(
        dataType="CVE_RECORD",
        cveMetadata=struct_of(cveId=F.col("cve"), state=F.when(k % 9 != 4, "PUBLISHED"), assignerOrgId="a", datePublished="2026-09-01", requester="u"),
        containers=struct_of(
            cna=struct_of(title=F.col("title"), credits=one, x_generator=struct_of(engine="e"),
                          affected=F.array(struct_of(product=F.concat(F.lit("p"), (k % 5).cast("string")), contact="inside")),
                          providerMetadata=struct_of(orgId="o", shortName=F.col("assigner"), dateUpdated="d1")),
            adp=F.when(k % 4 == 1, F.parse_json(F.lit('{"title": "one", "credits": ["x"]}'))).when(k % 4 > 1, F.parse_json(F.to_json(adp))),
            other=struct_of(title="not a container")))
    docs = B.advisories(spark, sf).select("cve", F.parse_json(F.to_json(doc)).alias("doc"))
    return docs.select("cve", F.md5(F.to_json(parse.program_evidence(F.col("doc")))).alias("digest"))


@register("p21_string_leaves", """SELECT event_id, '/props~1raw' AS pointer, event_type AS text FROM events
  UNION ALL SELECT event_id, '/inner/0/a~0b', CAST(user_id AS VARCHAR) FROM events""")
def string_leaves(spark, sf):
    doc = F.struct(F.col("event_type").alias("props/raw"), F.array(F.struct(
        F.col("user_id").cast("string").alias("a~b"), F.col("value").alias("n"))).alias("inner"))
    rows = B.table(spark, sf, "events").select("event_id", F.parse_json(F.to_json(doc)).alias("doc"))
    return parse.string_leaves(rows)


@register("c9_text_value_as_list", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type ELSE '' END AS text,
  CASE event_id % 3 WHEN 2 THEN 2 ELSE 1 END AS items FROM events""")
def coercions(spark, sf):
    i = F.col("event_id") % 3
    text = (F.when(i == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("Value")).alias("v"))))
            .when(i == 1, F.to_json(F.struct(F.col("event_type").alias("v"))))
            .otherwise(F.to_json(F.struct(F.array("event_type", "event_type").alias("v")))))
    v = F.try_variant_get(F.parse_json(text), "$.v", "variant")
    rows = B.table(spark, sf, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", F.when(F.col("event_id") % 3 == 2, "").otherwise(scalar.text_value(F.col("v"))).alias("text"),
                       F.size(scalar.as_list(F.col("v"))).alias("items"))


@register("p22_source_packet", """SELECT r.cve, r.title, coalesce(string_agg(DISTINCT name, '|' ORDER BY name), '') AS products FROM adv r LEFT JOIN recprod p ON p.k = r.k GROUP BY 1, 2""", ["adv", "recprod"])
def source_packet(spark, sf):
    return B.records(spark, sf).select(parse.source_packet().alias("p")).select(
        "p.cve", "p.title", flat(F.col("p.products")).alias("products"))


@register("p23_record_view", "SELECT cve, concat_ws('|', CASE WHEN pub_band IS NOT NULL THEN sev_word END, CASE WHEN cna_nband IS NOT NULL THEN cna_band END) AS stated FROM rec", ["rec"])
def record_view(spark, sf):
    return B.records(spark, sf, "cve", "title", "products", "cvss", "attack", "severity", "vendor_guidance").select(parse.record_view().alias("v")).select(
        "v.cve", flat(F.transform("v.severity", lambda a: a["value"])).alias("stated"))


@register("p24_supplied_view", "SELECT cve, title, av FROM facts", ["facts"])
def supplied_view(spark, sf):
    view = parse.supplied_view(B.records(spark, sf))
    assert not set(view.columns) & set(parse.MODEL_AUTHORED)
    return view.select("cve", "title", F.col("attack.vector").alias("av"))


@register("p25_issuing_cna", "SELECT cve, CASE WHEN k % 13 = 0 THEN NULL WHEN assigner = 'microsoft' THEN 'Microsoft' ELSE assigner END AS cna FROM adv", ["adv"])
def issuing_cna(spark, sf):
    return B.records(spark, sf).select("cve", parse.issuing_cna(F.col("vendor_guidance.notes")).alias("cna"))


@register("p26_ssvc", "SELECT cve, ssvc_e AS e, ssvc_a AS a, ssvc_t AS t FROM rec", ["rec"])
def ssvc(spark, sf):
    return B.records(spark, sf).select("cve", parse.ssvc().alias("s")).select(
        "cve", F.col("s.exploitation").alias("e"), F.col("s.automatable").alias("a"), F.col("s.technical_impact").alias("t"))


@register("p27_source_content", """SELECT cve, 'summary' AS kind, 'Microsoft description' AS label, 'Plain text of the advisory.' AS text, 1 AS rank FROM adv
  UNION ALL SELECT cve, 'summary', 'Microsoft executive summary', 'A flaw in ' || title || ' & related parts.', 0 FROM adv WHERE k % 4 <> 0
  UNION ALL SELECT cve, 'faq', NULL, 'How could an attacker use this?' || chr(10) || chr(10) || 'Case ' || (k % 10) || ' of ' || chr(8220) || title || chr(8221) || '.', 1 FROM adv""", ["adv"])
def source_content(spark, sf):
    return parse.source_content(B.records(spark, sf, "cve", "vendor_guidance")).select("cve", "kind", "label", "text", "rank")


@register("p27_source_url", f"SELECT cve, '{parse.GUIDE_URL}' || cve AS url FROM adv", ["adv"])
def source_url(spark, sf):
    return B.records(spark, sf).select("cve", parse.source_url().alias("url"))


@register("p28_faq_parts", """SELECT cve, 'How could an attacker use this?' AS question, 'Case ' || (k % 10) || ' of ' || chr(8220) || title || chr(8221) || '.' AS answer,
  false AS long_faq FROM adv""", ["adv"])
def faq_parts(spark, sf):
    content = parse.source_content(B.records(spark, sf, "cve", "vendor_guidance"))
    parts = content.where("kind = 'faq'").select("cve", parse.faq_parts(F.col("text")).alias("p"))
    return parts.join(parse.faq_length(content), "cve").select("cve", "p.question", "p.answer", "long_faq")


@register("p29_asserted_tags", "SELECT cve, tag, CASE WHEN k % 8 <> 0 AND k % 4 <> 0 THEN title ELSE '' END AS evidence FROM advtag JOIN adv USING (k, cve)", ["advtag", "adv"])
def asserted_tags(spark, sf):
    rows = B.records(spark, sf).withColumn("tag_evidence", F.col("inference.framework_assessment.tag_evidence"))
    return parse.asserted_tags(rows)


@register("p29_evidence_shape", """SELECT CASE WHEN k % 8 = 0 THEN 'bare' ELSE 'structured' END AS shape, count(*) AS records FROM adv GROUP BY 1""", ["adv"])
def evidence_shape(spark, sf):
    shown = F.col("inference.framework_assessment.tag_evidence")
    bare = F.when(shown.isNull(), F.col("tags"))
    return B.records(spark, sf).groupBy(parse.evidence_shape(shown, bare).alias("shape")).agg(F.count("*").alias("records"))


# --- feed joins ------------------------------------------------------------------------
@register("j1_kev_flag", "SELECT a.cve, kev.cve IS NOT NULL AS kev FROM adv a LEFT JOIN kev ON kev.cve = a.cve", ["adv", "kev"])
def kev_flag(spark, sf):
    return joins.kev_flag(B.advisories(spark, sf).select("cve"), B.kev(spark, sf))


@register("j2_epss_score", "SELECT a.cve, epss FROM adv a LEFT JOIN epss e ON e.cve = a.cve", ["adv", "epss"])
def epss_score(spark, sf):
    return joins.epss_score(B.advisories(spark, sf).select("cve"), B.epss(spark, sf))


@register("j3_apply_overlay", """SELECT cve, CASE WHEN k % 8 <> 0 THEN 'email|web' ELSE '' END AS tags, CASE WHEN k % 8 <> 0 THEN 'assessor-2' ELSE 'none' END AS model,
  CASE WHEN k % 8 <> 0 THEN 'unlikely' ELSE exa END AS exa, kev FROM facts""", ["facts"])
def apply_overlay(spark, sf):
    overlay = B.records(spark, sf, "k", "cve", "mitigation_candidates").where("k % 8 <> 0").select(
        "cve", words(["web", "email", "web"]).alias("o_tags"), F.col("mitigation_candidates").alias("o_candidates"),
        F.struct(F.lit("assessor-2").alias("model")).alias("o_inference"),
        F.struct(F.lit("unlikely").alias("exploitation_assessment")).alias("o_threat"))
    out = joins.apply_overlay(B.records(spark, sf).select("cve", "threat"), overlay)
    return out.select("cve", flat(F.col("tags")).alias("tags"), "inference.model",
                      F.col("threat.exploitation_assessment").alias("exa"), "threat.kev")


@register("j4_resolve_products", """SELECT cve, product_id, CASE WHEN substr(product_id, 2)::INT % 2 = 0 THEN name ELSE product_id END AS name FROM lineprod""", ["lineprod"])
def resolve_products(spark, sf):
    names = B.table(spark, sf, "part").where("p_partkey % 2 = 0").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
        B._at(B.PRODUCT_NAMES, F.col("p_partkey") % 16).alias("name"))
    return joins.resolve_products(B.adv_product(spark, sf).select("cve", "product_id"), names)


def sidecar(spark, sf):
    facts = parsed_programs(spark, sf)
    return facts.where("k % 10 <> 1").select(
        "cve", F.when(F.col("k") % 10 == 0, "not-published").otherwise("found").alias("status"),
        "assigner", parse.record_url(F.col("cve")).alias("url"), F.sha2("cve", 256).alias("sha256"), "date_updated", "ssvc",
        "ssvc_provider", "vendor_severity", F.struct(F.concat(F.lit("Text of "), "cve").alias("description")).alias("cna"))


@register("j5_apply_program", """SELECT cve, CASE WHEN k % 10 = 1 THEN 'not-fetched' WHEN k % 10 = 0 THEN 'not-published' ELSE 'found' END AS status,
  CASE WHEN k % 10 > 1 THEN assigner END AS assigner, CASE WHEN k % 10 < 2 THEN 'no CVE Program record was retrieved for this CVE'
  WHEN k % 10 = 5 THEN 'the CVE Program record carries no CISA-ADP SSVC assessment' END AS reason, CASE WHEN k % 10 > 1 THEN sha256(cve) END AS sha256,
  CASE WHEN k % 10 > 1 THEN '2026-02-01' END AS date_updated, CASE WHEN k % 10 > 1 AND k % 10 <> 5 THEN 'CISA-ADP' END AS provider,
  CASE WHEN k % 10 > 1 THEN 'Text of ' || cve END AS cna FROM adv""", ["adv"])
def apply_program(spark, sf):
    return joins.apply_program(B.advisories(spark, sf).select("cve", F.lit(1).alias("cve_program")), sidecar(spark, sf)).select(
        "cve", "cve_program.status", "cve_program.assigner", F.col("cve_program.ssvc_absent_reason").alias("reason"),
        "cve_program.sha256", "cve_program.date_updated", F.col("cve_program.ssvc_provider").alias("provider"),
        F.col("cve_program.cna.description").alias("cna"))


@register("j5_program_counts", """SELECT count(*) FILTER (k % 10 > 1 AND k % 10 <> 5) AS applied, count(*) FILTER (k % 10 = 5) AS without_ssvc,
  count(*) FILTER (k % 10 < 2) AS missing FROM adv""", ["adv"])
def program_counts(spark, sf):
    return joins.program_counts(joins.apply_program(
        B.advisories(spark, sf).select("cve", F.lit(1).alias("cve_program")), sidecar(spark, sf)))


def fresh_scores(spark, sf):
    """A newer feed: drops every fifth id, raises every fourth score."""
    k = F.regexp_extract("cve", r"(\d+)$", 1).cast("bigint")
    return B.epss(spark, sf).where(k % 5 != 0).withColumn("epss", F.when(k % 4 == 0, F.col("epss") + 0.1).otherwise(
        F.col("epss"))).withColumn("score_date", F.lit("2026-09-11"))


_REFRESH = """SELECT cve, month, k, CASE WHEN e.epss IS NOT NULL AND k % 5 <> 0 THEN 'scored' WHEN e.epss IS NOT NULL THEN 'stale' ELSE 'pending' END AS status,
  round(e.epss + CASE WHEN k % 5 <> 0 AND k % 4 = 0 THEN 0.1 ELSE 0 END, 6) AS epss, CASE WHEN e.epss IS NOT NULL AND k % 5 = 0 THEN '2026-09-10' ELSE '2026-09-11' END AS epss_date,
  NOT (e.epss IS NOT NULL AND k % 5 = 0 AND k % 27 = 1) AS score_changed FROM adv a LEFT JOIN epss e USING (cve)"""


@register("j6_refresh_scores", f"SELECT cve, status, epss, epss_date, score_changed FROM ({_REFRESH})", ["adv", "epss"])
def refresh_scores(spark, sf):
    return joins.refresh_scores(B.records(spark, sf, "cve", "threat"), fresh_scores(spark, sf), "2026-09-11").select(
        "cve", F.col("threat.epss_status").alias("status"), F.round("threat.epss", 6).alias("epss"),
        F.col("threat.epss_date").alias("epss_date"), "score_changed")


@register("j6_refresh_provenance", f"SELECT month, count(*) AS stamped FROM ({_REFRESH}) GROUP BY 1", ["adv", "epss"])
def refresh_provenance(spark, sf):
    fresh = joins.refresh_scores(B.records(spark, sf, "month", "cve", "threat"), fresh_scores(spark, sf), "2026-09-11")
    return (joins.stamp_provenance(fresh, "https://feed.example", "0" * 64, "2026-09-11")
            .where("epss_source is not null").groupBy("month").agg(F.count("*").alias("stamped")))


@register("j7_two_tier_scores", """SELECT cve, CASE WHEN k % 9 <> 0 THEN 'bulk' ELSE 'fallback' END AS tier FROM adv WHERE k % 9 <> 0 OR k % 2 = 0""", ["adv"])
def two_tier(spark, sf):
    bulk = B.epss(spark, sf).select("cve", F.lit("bulk").alias("tier"))
    fallback = B.advisories(spark, sf).where("k % 2 = 0").select("cve", F.lit("fallback").alias("tier"))
    return joins.two_tier_scores(B.advisories(spark, sf), bulk, fallback)
