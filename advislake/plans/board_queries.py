"""Review, update, board and ordering queries."""
from pyspark.sql import functions as F

from advislake.functions import vocab
from advislake.operators import board, ordering, parse, review, risk
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import SELECTION, pick, values

flat = lambda c, sep="|": F.array_join(c, sep)


def assessed(spark, sf, columns=()):
    """Records with their profile under the bench selection and their review status."""
    return review.with_review(risk.with_profile(B.records(spark, sf, *columns), SELECTION))


# --- updates and review --------------------------------------------------------------
_STATUS = """WITH rem AS (SELECT *, CASE WHEN type IN ('3', '6') THEN label END AS kb FROM linerem),
 f AS (SELECT cve, product_id, min_by(kb, p1 * 1000000 + p2) FILTER (kb IS NOT NULL) AS kb,
   min_by(url, p1 * 1000000 + p2) FILTER (kb IS NOT NULL) AS url, bool_or(type = '2') AS available FROM rem GROUP BY 1, 2)"""


@register("r7_update_status", _STATUS + """ SELECT p.cve, p.product_id, p.name, f.available,
  CASE WHEN f.available THEN 'Security Update' END AS kind, f.kb, f.url
  FROM lineprod p JOIN f ON f.cve = p.cve AND f.product_id = p.product_id""", ["lineprod", "linerem"])
def update_status(spark, sf):
    return review.update_status(B.adv_product(spark, sf), B.adv_remediation(spark, sf))


@register("r8_update_summary", _STATUS + """, c AS (SELECT p.cve, count(*) AS total, count(*) FILTER (available) AS available, string_agg(p.name, '|' ORDER BY p.name) FILTER (NOT available) AS names
   FROM lineprod p JOIN f ON f.cve = p.cve AND f.product_id = p.product_id GROUP BY 1),
  scope AS (SELECT cve FROM advtag WHERE tag IN ('dns', 'office', 'server-2022') UNION SELECT cve FROM ptag WHERE tag IN ('dns', 'office', 'server-2022'))
  SELECT a.cve, coalesce(total, 0) AS total, coalesce(available, 0) AS available, coalesce(total - available, 0) AS missing,
   a.cve IN (SELECT cve FROM scope) AND coalesce(total - available, 0) > 0 AS flag, coalesce(names, '') AS missing_names FROM adv a LEFT JOIN c ON c.cve = a.cve""",
          ["adv", "lineprod", "linerem", "advtag", "ptag"])
def update_summary(spark, sf):
    status = review.update_status(B.adv_product(spark, sf), B.adv_remediation(spark, sf))
    out = review.update_summary(status, B.records(spark, sf, "cve", "tags", "product_tags"),
                                ["dns", "office", "server-2022"])
    return out.withColumn("missing_names", F.array_join("missing_names", "|"))


@register("w7_pending_first", _STATUS + """ SELECT p.cve, row_number() OVER (PARTITION BY p.cve ORDER BY f.available, p.product_id) AS place,
   p.product_id FROM lineprod p JOIN f ON f.cve = p.cve AND f.product_id = p.product_id""", ["lineprod", "linerem"])
def pending_first(spark, sf):
    rows = review.pending_first(review.update_status(B.adv_product(spark, sf), B.adv_remediation(spark, sf)))
    # places follow the order that the operator gave
    placed = ordering.number_rows(rows).select("cve", "rank", "product_id")
    first = placed.groupBy("cve").agg(F.min("rank").alias("first"))
    return placed.join(first, "cve").select("cve", (F.col("rank") - F.col("first") + 1).alias("place"), "product_id")


@register("r9_review_status", "SELECT cve, required, codes FROM review", ["review"])
def review_status(spark, sf):
    return review.with_review(B.records(spark, sf)).select(
        "cve", "review.required", flat(F.transform("review.reasons", lambda r: r.code)).alias("codes"))


@register("r9_review_evidence", "SELECT cve, code, info, evidence FROM reasons", ["reasons"])
def review_evidence(spark, sf):
    return (review.with_review(B.records(spark, sf)).select("cve", F.explode("review.reasons").alias("r"))
            .select("cve", "r.code", F.col("r.informational").alias("info"), "r.evidence"))


# --- board ---------------------------------------------------------------------------
_TILE = """count(*) AS total, count(*) FILTER (required) AS review_count, count(*) FILTER (res_a = 0) AS n0,
  count(*) FILTER (res_a = 1) AS n1, count(*) FILTER (res_a = 2) AS n2, count(*) FILTER (res_a = 3) AS n3, max(res_a) AS worst"""
_STATE = f"""{pick(vocab.ACTIONS, 'worst')} AS worst_action, coalesce(worst_count, 0) AS worst_count, coalesce(worst IN (0, 1) AND NOT any_rated, false) AS unverified,
  CASE WHEN worst IS NULL THEN 'empty' WHEN worst IN (0, 1) AND NOT any_rated THEN 'unverified'
  ELSE {pick([vocab.TILE_STATES[a] for a in vocab.ACTIONS], 'worst')} END AS state"""


@register("a1_tile_summary", f"""WITH t AS (SELECT month, {_TILE} FROM fullrec GROUP BY 1),
  w AS (SELECT f.month, count(*) AS worst_count, bool_or(f.band <> 'unknown') AS any_rated FROM fullrec f JOIN t ON t.month = f.month AND f.res_a = t.worst GROUP BY 1)
  SELECT t.month, total, review_count, n0, n1, n2, n3, {_STATE} FROM t LEFT JOIN w ON w.month = t.month""", ["fullrec"])
def tile_summary(spark, sf):
    return board.tile_summary(assessed(spark, sf, B.ASSESSED), "month")


_OPTIONS = [(g, t, label, shown) for g, _, opts in vocab.FILTER_GROUPS for t, label, shown in opts]


@register("a2_overview_board", f"""WITH o AS (SELECT * FROM (VALUES {values(_OPTIONS)}) AS t(grp, tag, label, shown) WHERE shown),
  x AS (SELECT o.grp, o.tag, f.* FROM o JOIN ptag p ON p.tag = o.tag JOIN fullrec f ON f.k = p.k),
  t AS (SELECT grp, tag, {_TILE} FROM x GROUP BY 1, 2),
  w AS (SELECT x.grp, x.tag, count(*) AS worst_count, bool_or(x.band <> 'unknown') AS any_rated FROM x JOIN t ON t.grp = x.grp AND t.tag = x.tag AND x.res_a = t.worst GROUP BY 1, 2)
  SELECT o.grp AS "group", o.tag, o.label, coalesce(total, 0) AS total, coalesce(review_count, 0) AS review_count, coalesce(n0, 0) AS n0,
   coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, {_STATE}
  FROM o LEFT JOIN t ON t.grp = o.grp AND t.tag = o.tag LEFT JOIN w ON w.grp = o.grp AND w.tag = o.tag""", ["fullrec", "ptag"])
def overview_board(spark, sf):
    return board.overview_board(assessed(spark, sf)).drop("source", "position")


@register("a3_month_totals", """SELECT month, count(*) AS total, count(*) FILTER (res_a = 0) AS n0, count(*) FILTER (res_a = 1) AS n1,
  count(*) FILTER (res_a = 2) AS n2, count(*) FILTER (res_a = 3) AS n3, count(*) FILTER (required) AS review_count FROM fullrec GROUP BY 1""", ["fullrec"])
def month_totals(spark, sf):
    return board.month_totals(assessed(spark, sf, B.ASSESSED))


@register("a4_option_counts", f"""WITH o AS (SELECT * FROM (VALUES {values(_OPTIONS)}) AS t(grp, tag, label, shown))
  SELECT o.grp AS "group", o.tag, o.label, count(p.k) AS records FROM o LEFT JOIN ptag p ON p.tag = o.tag GROUP BY 1, 2, 3""", ["ptag"])
def option_counts(spark, sf):
    return board.option_counts(B.records(spark, sf))


@register("a5_visible_summary", """SELECT count(*) AS total, count(*) FILTER (res_a = 0) AS n0, count(*) FILTER (res_a = 1) AS n1,
  count(*) FILTER (res_a = 2) AS n2, count(*) FILTER (res_a = 3) AS n3, count(*) FILTER (required) AS review_count,
  count(epss) AS epss_scored FROM fullrec WHERE av = 'network'""", ["fullrec"])
def visible_summary(spark, sf):
    return board.visible_summary(assessed(spark, sf).where("attack.vector = 'network'"))


@register("a6_enrichment_coverage", """SELECT count(*) AS requested, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS not_published,
  0 AS failed, count(ssvc_e) AS with_ssvc, count(*) FILTER (found AND cna_band IS NOT NULL) AS with_cna_severity,
  round(count(ssvc_e)::DOUBLE / count(*), 4) AS ssvc_coverage FROM rec""", ["rec"])
def enrichment_coverage(spark, sf):
    return board.enrichment_coverage(B.records(spark, sf))


@register("a6_exploitation_histogram", "SELECT ssvc_e AS exploitation, count(*) AS records FROM rec WHERE ssvc_e IS NOT NULL GROUP BY 1", ["rec"])
def exploitation_histogram(spark, sf):
    return board.exploitation_histogram(B.records(spark, sf))


# --- orderings -----------------------------------------------------------------------
def placed(df, columns):
    """Every row with its 1-based place in the frame's order."""
    return ordering.number_rows(df.select(*columns), "place").withColumn("place", F.col("place") + 1)


@register("w1_publication_order", f"""SELECT cve, row_number() OVER (ORDER BY NOT (kev OR det),
   CASE band WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, av <> 'network', cve) AS place
   FROM rec""", ["rec"])
def publication_order(spark, sf):
    return placed(B.records(spark, sf).orderBy(*ordering.publication_order()), ["cve"])


def _sort_query(name, key, direction, order):
    @register(name, f"SELECT cve, row_number() OVER (ORDER BY {order}, k) AS place FROM prof", ["prof"])
    def run(spark, sf):
        df = B.records(spark, sf, "cve") if key == "cve" else risk.with_profile(B.records(spark, sf), SELECTION)
        return placed(ordering.advisory_sort(df, key, direction), ["cve"])


_THREAT = "CASE WHEN kev OR det THEN 3 ELSE base_l END"
_sort_query("w2_sort_cve_desc", "cve", "desc", "k DESC")
_sort_query("w2_sort_cve_asc", "cve", "asc", "k")
_sort_query("w2_sort_threat_desc", "threat", "desc",
            f"{_THREAT} DESC, epss DESC NULLS LAST, base_score DESC NULLS LAST")
_sort_query("w2_sort_threat_asc", "threat", "asc",
            f"{_THREAT}, epss ASC NULLS LAST, base_score ASC NULLS LAST")
_sort_query("w2_sort_baseline_desc", "baseline", "desc", "base_a DESC, base_l DESC")
_sort_query("w2_sort_predicted_asc", "predicted", "asc", "res_a, res_l")


@register("w3_shards", """WITH r AS (SELECT cve, row_number() OVER (ORDER BY cve) - 1 AS rank FROM adv)
  SELECT cve, rank, rank % 3 AS shard, (rank // 3) // 15 AS batch FROM r""", ["adv"])
def shard_rows(spark, sf):
    return ordering.shards(B.advisories(spark, sf).select("cve"), 3, 15)


@register("w9_batches", "SELECT cve, (row_number() OVER (ORDER BY cve) - 1) // 10 AS batch FROM adv", ["adv"])
def batch_rows(spark, sf):
    return ordering.batches(B.advisories(spark, sf).select("cve"), 10).select("cve", "batch")


_WORST = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY res_a ORDER BY res_l DESC, coalesce(base_score, 0) DESC, cve) AS rn,
   count(*) FILTER (res_a = 3) OVER () AS n3 FROM {src})
  SELECT cve, res_a, res_l FROM r WHERE res_a = 3 OR (res_a = 2 AND n3 < 8 AND rn <= least(8, 8 - n3))"""


@register("w4_worst_first", _WORST.format(src="prof"), ["prof"])
def worst_first(spark, sf):
    return ordering.worst_first(risk.with_profile(B.records(spark, sf), SELECTION)).select(
        "cve", F.col("resid_action").alias("res_a"), F.col("resid_likelihood").alias("res_l"))


@register("w4_worst_first_top_up", _WORST.format(src="(SELECT * FROM prof WHERE res_a <> 3)"), ["prof"])
def worst_first_top_up(spark, sf):
    """Once the emergencies are dealt with, the list is all top-up."""
    return ordering.worst_first(risk.with_profile(B.records(spark, sf), SELECTION).where("resid_action <> 3")).select(
        "cve", F.col("resid_action").alias("res_a"), F.col("resid_likelihood").alias("res_l"))


def manifest(spark, sf):
    """Release manifest of the months in the table, with a demo beside each January."""
    months = B.advisories(spark, sf).groupBy("month").agg(F.count("*").alias("record_count"))
    demo = months.where(F.col("month").endswith("-Jan")).withColumn(
        "month", F.concat("month", F.lit("-demo")))
    return months.unionByName(demo).withColumn("file", F.concat("month", F.lit(".jsonl")))


_MANIFEST = """m0 AS (SELECT month, count(*) AS record_count FROM adv GROUP BY 1),
  m AS (SELECT month, record_count FROM m0 UNION ALL SELECT month || '-demo', record_count FROM m0 WHERE month LIKE '%-Jan'),
  o AS (SELECT *, row_number() OVER (ORDER BY split_part(month, '-', 1)::INT DESC,
   list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], split_part(month, '-', 2)) DESC, month LIKE '%-demo') AS place FROM m)"""


@register("w5_release_order", f"WITH {_MANIFEST} SELECT month, place FROM o", ["adv"])
def release_order(spark, sf):
    return placed(ordering.release_order(manifest(spark, sf)), ["month"])


@register("w6_default_release", f"WITH {_MANIFEST} SELECT month, record_count FROM o WHERE month NOT LIKE '%-demo' ORDER BY place LIMIT 1", ["adv"])
def default_release(spark, sf):
    return ordering.default_release(manifest(spark, sf)).select("month", "record_count")


@register("w8_first_few", "SELECT cve, (SELECT count(*) FROM rec WHERE band = 'unknown') AS total FROM rec WHERE band = 'unknown' ORDER BY cve LIMIT 10", ["rec"])
def first_few(spark, sf):
    unknown = B.records(spark, sf).where("severity.normalized_band = 'unknown'").select("cve")
    return ordering.first_few(unknown, ["cve"], 10)
