"""Citation, tag check and privacy queries."""
from pyspark.sql import functions as F

from advislake.functions import scalar, vocab
from advislake.functions.exprs import struct_of
from advislake.operators import citation, joins, parse, privacy, tagcheck
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import inlist, pick, values, view
from advislake.sources import sinks

flat = lambda c, sep="|": F.array_join(c, sep)
_TOK = "regexp_extract_all(lower(replace(replace(replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '&quot;', ' '), '&amp;', ' '), '&#8217;', chr(39))), '[a-z0-9]+')"
view("doctok", [], f"SELECT doc_id, {_TOK.format(t='text')} AS t FROM documents")


# --- citations ---------------------------------------------------------------------------
@register("t1_tokenise", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM doctok", ["doctok"])
def tokenise(spark, sf):
    t = citation.tokens(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def spans(spark, sf):
    """Composite citations made of two words-of-six pieces of a benchmark item."""
    words = F.split(F.regexp_replace("text", "[^A-Za-z ]+", " "), " +")
    piece = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    return B.table(spark, sf, "benchmark").select("item_id", F.concat(
        F.lit('"Title: '), piece(2, 7), F.lit('" ; "'), piece(12, 6), F.lit('" ... '), piece(3, 2), F.lit(" | faq - "), piece(20, 4)).alias("span"))


_W = "list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' +'), lambda x: true)"
_PIECE = "trim(array_to_string(list_slice(w, {a}, {b}), ' '))"
view("spans", [], f"""SELECT item_id, {_PIECE.format(a=2, b=8)} AS p1, {_PIECE.format(a=12, b=17)} AS p2, {_PIECE.format(a=3, b=4)} AS p3, {_PIECE.format(a=20, b=23)} AS p4
  FROM (SELECT item_id, {_W} AS w FROM benchmark)""")


@register("t2_components", f"""SELECT item_id, concat_ws('|', p1, CASE WHEN len({_TOK.format(t='p2')}) >= 3 THEN p2 END,
  CASE WHEN len({_TOK.format(t='p4')}) >= 3 THEN p4 END) AS parts FROM spans""", ["spans"])
def components(spark, sf):
    return spans(spark, sf).select("item_id", flat(citation.components(F.col("span"))).alias("parts"))


view("pairs", ["doctok"], f"""SELECT d.doc_id, b.item_id, b.text AS span, ' ' || array_to_string(d.t, ' ') || ' ' AS line, {_TOK.format(t='b.text')} AS need
  FROM doctok d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")


def with_item(spark, sf):
    """Every document with one benchmark item; all items are dealt out in turn."""
    items = B.table(spark, sf, "benchmark").agg(F.count("*")).scalar()
    return B.table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % items)


def pairs(spark, sf):
    items = B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("span"))
    return with_item(spark, sf).join(items, "item_id")


@register("t3_contains_run", """SELECT doc_id, len(list_filter(range(1, greatest(len(need) - 4, 1)::BIGINT), lambda i:
   contains(line, ' ' || array_to_string(list_slice(need, i, i + 5), ' ') || ' '))) > 0 AS hit FROM pairs""", ["pairs"])
def contains_run(spark, sf):
    return pairs(spark, sf).select("doc_id", F.coalesce(citation.contains_run(
        citation.token_line(F.col("text")), citation.tokens(F.col("span")), F.lit(6)), F.lit(False)).alias("hit"))


def _runs(need, run):
    return (f"len(list_filter(range(1, greatest(len({need}) - {run} + 2, 1)::BIGINT), lambda i: contains(line, ' ' || "
            f"array_to_string(list_slice({need}, i, i + {run} - 1), ' ') || ' '))) > 0")


@register("t4_verify", f"""WITH d AS (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS line FROM doctok),
  p AS (SELECT d.doc_id, s.part, d.line, {_TOK.format(t='s.body')} AS need FROM d JOIN (SELECT item_id, 1 AS part, p1 AS body FROM spans UNION ALL SELECT item_id, 2, p2 FROM spans
    UNION ALL SELECT item_id, 3, p4 FROM spans) s ON s.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
  h AS (SELECT doc_id, part, CASE WHEN len(need) >= 6 THEN {_runs('need', 6)} ELSE {_runs('need', 3)} END AS hit FROM p WHERE len(need) >= 3)
  SELECT doc_id, bool_or(hit) AS verified, bool_and(hit) AS fully, count(*) AS components, count(*) FILTER (hit) AS matched FROM h GROUP BY 1""", ["doctok", "spans"])
def verify(spark, sf):
    out = citation.verify_pairs(with_item(spark, sf).join(spans(spark, sf), "item_id"), "span", "text")
    return out.select("doc_id", "citation.verified", F.col("citation.fully_verified").alias("fully"),
                      "citation.components", "citation.matched")


@register("t4_verify_in_corpus", f"""WITH parts AS (SELECT item_id, 1 AS part, p1 AS body FROM spans UNION ALL SELECT item_id, 2, p2 FROM spans UNION ALL SELECT item_id, 3, p4 FROM spans),
  n AS (SELECT item_id, part, {_TOK.format(t='body')} AS need FROM parts),
  g AS (SELECT item_id, part, unnest(list_transform(range(1, (len(need) - run + 2)::BIGINT), lambda i: ' ' || array_to_string(list_slice(need, i, i + run - 1), ' ') || ' ')) AS gram
    FROM (SELECT *, CASE WHEN len(need) >= 6 THEN 6 ELSE 3 END AS run FROM n)),
  h AS (SELECT g.item_id, g.part, bool_or(d.doc_id IS NOT NULL) AS hit FROM g LEFT JOIN (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS line FROM doctok) d ON contains(d.line, g.gram) GROUP BY 1, 2)
  SELECT item_id, count(*) AS components, count(*) FILTER (hit) AS matched FROM h GROUP BY 1""", ["doctok", "spans"])
def verify_in_corpus(spark, sf):
    return citation.verify_in_corpus(spans(spark, sf), B.table(spark, sf, "documents"), "item_id", "span", "text")


# --- tag checks --------------------------------------------------------------------------
CHECKED = ("k", "cve", "title", "tags", "products", "cvss", "attack", "vendor_guidance")  # what the checks read


def checkable(spark, sf, columns=CHECKED):
    """Records with asserted tags in every state the checks know; whole ones where ``columns`` is empty."""
    k = F.col("k")
    said = F.when(k % 4 == 0, "").when(k % 9 == 0, "totally unrelated prose quoted").otherwise(F.col("title"))
    tags = F.transform("tags", lambda t: struct_of(tag=t, evidence=F.when(k % 8 == 0, "").otherwise(said)))
    return B.records(spark, sf, *columns).withColumns({
        "asserted": F.when(k % 19 != 0, tags),
        "shape": F.when(F.size("tags") < 1, "empty").when(k % 8 == 0, "bare").otherwise("structured")})


_TERMS = [(t, term, i) for t, ts in vocab.WORKLOAD_TERMS.items() for i, term in enumerate(ts)]
view("terms", [], f"SELECT * FROM (VALUES {values(_TERMS)}) AS t(tag, term, ord)")
view("srctext", ["adv", "recprod"], """SELECT a.k, lower(title || ' ' || coalesce((SELECT string_agg(name, ' ') FROM recprod p WHERE p.k = a.k), '')) AS text FROM adv a""")
view("named", ["srctext", "terms"], """SELECT k, tag, min_by(term, ord) AS term FROM srctext JOIN terms ON regexp_matches(text, '\\b' || replace(term, '.', '\\.')) GROUP BY 1, 2""")
view("asserted", ["advtag", "rec"], """SELECT t.k, t.cve, t.tag, CASE WHEN r.k % 4 = 0 OR r.k % 8 = 0 THEN '' WHEN r.k % 9 = 0 THEN 'totally unrelated prose quoted' ELSE r.title END AS evidence
  FROM advtag t JOIN rec r ON r.k = t.k WHERE r.k % 19 <> 0""")
_WL, _JT = inlist(vocab.NAMESPACES["workload"]), inlist(vocab.JUDGEMENT_TAGS)
view("tagfind", ["asserted", "named", "rec"], f"""
SELECT n.k, r.cve, 'workload_recall' AS "check", 'workload-recall-miss' AS code, n.tag FROM named n JOIN rec r ON r.k = n.k
  WHERE r.k % 19 <> 0 AND NOT EXISTS (SELECT 1 FROM asserted a WHERE a.k = n.k AND a.tag = n.tag)
UNION ALL SELECT a.k, a.cve, 'workload_precision', 'workload-uncorroborated', a.tag FROM asserted a WHERE a.tag IN {_WL} AND NOT EXISTS (SELECT 1 FROM named n WHERE n.k = a.k AND n.tag = a.tag)
UNION ALL SELECT a.k, a.cve, 'delivery_consistency', 'delivery-contradicts-cvss', a.tag FROM asserted a JOIN rec r ON r.k = a.k WHERE a.tag = 'user-content' AND r.ui = 'none'
UNION ALL SELECT a.k, a.cve, 'evidence_present', 'evidence-missing', a.tag FROM asserted a WHERE a.tag IN {_JT} AND a.evidence = '' AND a.k % 8 <> 0
UNION ALL SELECT a.k, a.cve, 'evidence_grounded', 'evidence-ungrounded', a.tag FROM asserted a WHERE a.tag IN {_JT} AND a.evidence LIKE 'totally%'
UNION ALL SELECT a.k, a.cve, 'citation_verification', 'citation-unverified', a.tag FROM asserted a WHERE a.tag IN {_JT} AND a.evidence LIKE 'totally%'""")


@register("t5_source_text", """SELECT a.cve, rtrim(s.text) AS head, 2 + (a.k % 4 <> 0)::INT + (a.k % 6 = 0)::INT + (customer_action_note IS NOT NULL)::INT + 1 AS notes
  FROM adv a JOIN srctext s ON s.k = a.k""", ["adv", "srctext"])
def source_text(spark, sf):
    """The plain head of the text, and how many notes its structured part names."""
    text = tagcheck.source_text()
    return B.records(spark, sf).select("cve", F.rtrim(F.substring_index(text, " [", 1)).alias("head"),
                                       F.regexp_count(text, F.lit('"title":')).alias("notes"))


def _check_query(name, check):
    @register(name, f'SELECT cve, code, tag FROM tagfind WHERE "check" = \'{check}\'', ["tagfind"])
    def run(spark, sf):
        return tagcheck.finding_rows(tagcheck.with_checks(checkable(spark, sf), (check,))).select("cve", "code", "tag")


_check_query("t6_workload_recall", "workload_recall")
_check_query("t7_workload_precision", "workload_precision")
_check_query("t8_delivery_consistency", "delivery_consistency")
_check_query("t9_evidence_present", "evidence_present")
_check_query("t10_evidence_grounded", "evidence_grounded")


@register("t11_review_record", 'SELECT cve, "check", code, tag FROM tagfind', ["tagfind"])
def review_record(spark, sf):
    return tagcheck.finding_rows(tagcheck.with_checks(checkable(spark, sf))).select("cve", "check", "code", "tag")


view("checkstate", ["asserted", "rec"], f"""
WITH r AS (SELECT k, cve, k % 19 <> 0 AS has_tags, k % 8 = 0 AS bare, has_uc, (k % 4 = 0 OR k % 8 = 0) AS silent FROM rec)
SELECT k, cve, c AS "check", CASE WHEN NOT has_tags THEN 'unchecked' WHEN c IN ('workload_recall', 'workload_precision') THEN 'checked'
  WHEN c = 'delivery_consistency' THEN CASE WHEN has_uc THEN 'checked' ELSE 'not-applicable' END
  WHEN bare THEN 'unchecked' WHEN c = 'citation_verification' AND silent THEN 'unchecked' ELSE 'checked' END AS state FROM r, (SELECT unnest({tagcheck.CHECKS}) AS c)""")


@register("t12_check_states", 'SELECT "check", state, count(*) AS records FROM checkstate GROUP BY 1, 2', ["checkstate"])
def check_states(spark, sf):
    rows = tagcheck.with_checks(checkable(spark, sf), made=("states",)).select(F.explode("states").alias("s"))
    return rows.groupBy("s.check", "s.state").agg(F.count("*").alias("records"))


@register("a7_check_summary", """WITH n AS (SELECT "check", count(*) AS findings, count(DISTINCT k) AS offenders FROM tagfind GROUP BY 1),
  s AS (SELECT "check", count(*) FILTER (state = 'checked') AS records_checked, count(*) FILTER (state = 'unchecked') AS records_unchecked,
    count(*) FILTER (state = 'not-applicable') AS records_not_applicable FROM checkstate GROUP BY 1)
  SELECT s."check", records_checked, records_unchecked, records_not_applicable, coalesce(offenders, 0) AS records_with_findings, coalesce(findings, 0) AS findings,
   round(coalesce(offenders, 0) / records_checked, 6) AS record_finding_rate, round(coalesce(findings, 0) / records_checked, 6) AS findings_per_checked_record
  FROM s LEFT JOIN n USING ("check")""", ["tagfind", "checkstate"])
def check_summary(spark, sf):
    return tagcheck.check_summary(tagcheck.with_checks(checkable(spark, sf)))


@register("a7_code_histogram", 'SELECT "check", code, count(*) AS findings FROM tagfind GROUP BY 1, 2', ["tagfind"])
def code_histogram(spark, sf):
    return tagcheck.code_histogram(tagcheck.with_checks(checkable(spark, sf), made=("findings",)))


@register("t12_partial_citations", f"""SELECT count(*) AS citations, count(*) FILTER (t.k % 6 = 1 AND n < {citation.MIN_PART}) AS unverified,
  count(*) FILTER (t.k % 6 = 1 AND n >= {citation.MIN_PART}) AS partially, count(*) FILTER (t.k % 6 <> 1) AS fully
  FROM advtag t JOIN (SELECT k, len(regexp_extract_all(lower(title), '[a-z0-9]+')) AS n FROM rec) r ON r.k = t.k WHERE tag IN {_JT}""", ["advtag", "rec"])
def partial_citations(spark, sf):
    """Citations of which one record in six quotes the title beside words that occur nowhere."""
    said = F.when(F.col("k") % 6 == 1, F.concat("title", F.lit(" | totally unrelated prose quoted"))).otherwise(F.col("title"))
    rows = B.records(spark, sf).withColumns({"asserted": F.transform("tags", lambda t: struct_of(tag=t, evidence=said)), "shape": F.lit("structured")})
    return tagcheck.citation_counts(tagcheck.with_checks(rows, ("citation_verification",)))


@register("a7_reason_histogram", f"""SELECT "check", state, CASE WHEN k % 19 = 0 THEN {"'" + tagcheck.NO_TAG_SET + "'"} WHEN state = 'not-applicable' THEN '{tagcheck.NO_DELIVERY_TAG}'
   WHEN k % 8 = 0 THEN '{tagcheck.NO_EVIDENCE_FIELD}' ELSE '{tagcheck.NO_CITATION}' END AS reason, count(*) AS records FROM checkstate WHERE state <> 'checked' GROUP BY 1, 2, 3""", ["checkstate"])
def reason_histogram(spark, sf):
    return tagcheck.reason_histogram(tagcheck.with_checks(checkable(spark, sf), made=("states",)))


@register("a8_month_report", """SELECT count(*) AS records_total, (SELECT count(DISTINCT k) FROM tagfind) AS records_flagged,
  count(*) - (SELECT count(DISTINCT k) FROM tagfind) AS records_without_findings, (SELECT count(*) FROM tagfind) AS findings_total FROM rec""", ["rec", "tagfind"])
def month_report(spark, sf):
    return tagcheck.month_report(tagcheck.with_checks(checkable(spark, sf), made=("findings",)))


@register("t12_citation_counts", f"""SELECT count(*) AS citations, count(*) FILTER (evidence LIKE 'totally%') AS unverified, 0 AS partially,
  count(*) FILTER (evidence NOT LIKE 'totally%') AS fully FROM asserted WHERE tag IN {_JT} AND evidence <> ''""", ["asserted"])
def citation_counts(spark, sf):
    return tagcheck.citation_counts(tagcheck.with_checks(checkable(spark, sf)))


@register("k6_tier1_annotation", """WITH s AS (SELECT k, count(*) FILTER (state = 'unchecked') AS unchecked, count(*) FILTER (state = 'not-applicable') AS off FROM checkstate GROUP BY 1)
  SELECT r.cve, string_agg(DISTINCT "check", '|' ORDER BY "check") AS failed, count(f.code) AS findings, string_agg(code || ':' || tag, '|' ORDER BY code || ':' || tag) AS codes,
   CASE WHEN count(f.code) > 0 THEN max(unchecked) END AS unchecked, CASE WHEN count(f.code) > 0 THEN max(off) END AS not_applicable, r.title, true AS untouched
  FROM rec r JOIN s ON s.k = r.k LEFT JOIN tagfind f ON f.k = r.k GROUP BY r.cve, r.title""", ["rec", "tagfind", "checkstate"])
def tier1_annotation(spark, sf):
    given = checkable(spark, sf, ())
    out = sinks.annotate_tier1(tagcheck.with_checks(given), "2026-09-12T00:00:00Z")
    t = F.col("tier1_review")
    return out.select(
        "cve", flat(t["failed_checks"]).alias("failed"), F.coalesce(F.size(t["findings"]), F.lit(0)).alias("findings"),
        flat(F.array_sort(F.transform(t["findings"], lambda f: F.concat_ws(":", f["code"], f["tag"])))).alias("codes"),
        F.size(t["unchecked"]).alias("unchecked"), F.size(t["not_applicable"]).alias("not_applicable"), "title",
        F.lit(set(given.columns) <= set(out.columns)).alias("untouched"))


@register("j18_scoring_jobs", f"SELECT cve, tag FROM advtag WHERE k % 6 <> 1 AND tag IN {_JT}", ["advtag"])
def scoring_jobs(spark, sf):
    tags = B.records(spark, sf).select("cve", F.explode("tags").alias("tag"))
    return joins.scoring_jobs(tags, B.advisories(spark, sf).where("k % 6 <> 1"), vocab.JUDGEMENT_TAGS)


def verdicts(spark, sf):
    k = F.col("k")
    rows = B.records(spark, sf, "k", "cve", "title", "tags").select("k", "cve", "title", F.explode("tags").alias("tag"))
    return citation.scorer_failures(rows.select(
        "k", "cve", "tag", F.when(k % 5 == 0, "source-ambiguous").when(k % 3 == 0, "unsupported").otherwise("supported").alias("verdict"),
        F.when(k % 7 == 0, "").when(k % 11 == 0, "not in the text").otherwise(F.upper(F.replace(F.col("title"), F.lit(" "), F.lit("  ")))).alias("span"),
        F.concat(F.lit("view of "), "title").alias("view")))


view("verdict", ["advtag"], """SELECT k, cve, tag, CASE WHEN k % 5 = 0 THEN 'source-ambiguous' WHEN k % 3 = 0 THEN 'unsupported' ELSE 'supported' END AS verdict,
  CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 'verdict asserted without a source span' WHEN k % 7 <> 0 AND k % 11 = 0 THEN 'source_span not found in the supplied record' END AS failure FROM advtag""")


@register("t13_scorer_failures", "SELECT cve, tag, failure FROM verdict WHERE failure IS NOT NULL", ["verdict"])
def scorer_failures(spark, sf):
    return verdicts(spark, sf).where("failure is not null").select("cve", "tag", "failure")


@register("a9_scorer_summary", "SELECT verdict, count(*) AS scored, count(failure) AS failures, count(*) FILTER (k % 7 = 0) AS unspanned FROM verdict GROUP BY 1", ["verdict"])
def scorer_summary(spark, sf):
    return citation.scorer_summary(verdicts(spark, sf))


@register("a9_rejection_rates", f"""SELECT CASE WHEN tag IN {inlist(vocab.IMPACT_TAGS)} THEN 'impact' WHEN tag IN {_WL} THEN 'workload' ELSE 'delivery' END AS namespace, count(*) AS scored,
  count(*) FILTER (verdict = 'unsupported') AS rejected, round(count(*) FILTER (verdict = 'unsupported') / count(*), 6) AS rate FROM verdict WHERE failure IS NULL GROUP BY 1""", ["verdict"])
def rejection_rates(spark, sf):
    return citation.rejection_rates(verdicts(spark, sf), vocab.NAMESPACES)


# --- privacy -----------------------------------------------------------------------------
view("priv", [], f"SELECT doc_id, text || chr(10) || {pick(B.PLANTED, 'doc_id % 14')} AS text FROM documents")


_DOUBLED = r"WITH d AS (SELECT doc_id, text, regexp_replace(text, '(\s)', '\1\1', 'g') AS t FROM priv)"
_DETECTED = []


def _detector(name, build, sql, category=None):
    """Every finding of a detector (of one category, where it tells several apart) with its span.

    Oracles take spans between consumed borders; white space is doubled first, so that two spans
    never share one.
    """
    _DETECTED.append(sql)

    @register(name, f"{_DOUBLED} {sql}", ["priv"])
    def run(spark, sf):
        found = B.priv_text(spark, sf).select("doc_id", F.explode(build(F.col("text"))).alias("f"))
        found = found if category is None else found.where(F.col("f.category") == category)
        return found.select("doc_id", "f.span")


def _spans(before, span, after):
    quoted = f"(?:^|{before})({span})(?:$|{after})".replace("'", "''")
    return f"SELECT doc_id, text, unnest(regexp_extract_all(t, '{quoted}', 1)) AS span FROM d"


_HEX, _GUID = "[0-9A-Fa-f]{1,4}", "[{]?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}[}]?"
_guids = lambda t: privacy.guid(t, privacy.allowed_url_spans(t))
_GUIDS = _spans(r"[^\w-]", _GUID, r"[^\w-]")
_VERSION = [p.replace("'", "''").replace("(?U)", "") for p in (scalar.VERSION_BEFORE, scalar.VERSION_AFTER)]
_detector("d1_ipv4_reserved", privacy.ipv4, f"""SELECT doc_id, span FROM ({_spans('[^0-9.]', r'[0-9]{1,3}(?:[.][0-9]{1,3}){3}', '[^0-9.]')})
  WHERE list_max(list_transform(string_split(span, '.'), lambda x: x::INT)) <= 255 AND NOT regexp_matches(span, '(^|[.])0[0-9]')
  AND (regexp_matches(span, '^(10|127)[.]|^192[.]168[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]') OR NOT (
    regexp_matches(substr(text, greatest(strpos(text, span) - {vocab.CONTEXT_WINDOW}, 1), least(strpos(text, span) - 1, {vocab.CONTEXT_WINDOW})), '{_VERSION[0]}')
    OR regexp_matches(substr(text, strpos(text, span) + length(span), {vocab.CONTEXT_WINDOW}), '{_VERSION[1]}')))""")
_detector("d2_ipv6", privacy.ipv6, f"SELECT doc_id, span FROM ({_spans(r'[^\w:.]', f'(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,7}}:(?:{_HEX}(?::{_HEX}){{0,6}})?|::(?:{_HEX}:){{0,6}}{_HEX}', r'[^\w:.]')})")
_detector("d3_email", privacy.email, f"""SELECT doc_id, span FROM ({_spans(r'[^\w.+-]', r'[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', r'[^\w-]')})
  WHERE NOT (split_part(span, '@', 1) IN {inlist(vocab.ROLE_LOCAL_PARTS)} AND (split_part(span, '@', 2) IN ('microsoft.com', 'example.com', 'example.org', 'example.net')))""")
_detector("d4_guid", _guids, f"SELECT doc_id, span FROM ({_GUIDS}) WHERE NOT contains(text, 'Tenant ID: ' || span) AND NOT contains(text, '?id=' || span)", "guid")
_detector("d5_tenant", _guids, f"SELECT doc_id, span FROM ({_GUIDS}) WHERE contains(text, 'Tenant ID: ' || span)", "tenant_identifier")
_detector("d6_hostname", lambda t: privacy.hostname(t, privacy.allowed_url_spans(t)), f"""SELECT doc_id, span FROM ({_spans('', r"(?:https?|ftps?)://(?:[^\s/?#@\"'<>]+@)?([A-Za-z0-9._-]+)", '')}) WHERE false
  UNION ALL SELECT doc_id, host FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:https?|ftps?)://(?:[^\\s/?#@"<>]+@)?([A-Za-z0-9._-]+)', 1)) AS host FROM d)
  WHERE NOT regexp_matches(host, '(^|[.])(microsoft[.]com|example[.](com|org|net))$')""")
_detector("d7_unc_path", privacy.paths, "SELECT doc_id, unnest(regexp_extract_all(text, '\\\\\\\\[A-Za-z0-9._$-]{1,63}\\\\[^\\s\"''<>|]{1,120}')) AS span FROM d", "unc_path")
_detector("d8_filesystem_path", privacy.paths, f"""SELECT doc_id, span FROM ({_spans(r'[^\w\\:]', r"[A-Za-z]:\\[^\s\"'<>|]{0,200}", '')}) WHERE NOT regexp_matches(lower(span), '^.:[\\\\]+(windows|program files)')
  UNION ALL SELECT doc_id, span FROM ({_spans(r'[^\w~.]', r"(?:~|/(?:home|Users|root|mnt|media|srv|export|Volumes|net))/[A-Za-z0-9._+-][^\s\"'<>|]{0,180}", '')})""", "filesystem_path")
_detector("d9_security_identifier", privacy.sid_and_mac, f"SELECT doc_id, span FROM ({_spans(r'[^\w-]', 'S-1-[0-9]{1,10}(?:-[0-9]{1,10}){1,15}', r'[^\w-]')})", "security_identifier")
_detector("d10_mac_address", privacy.sid_and_mac, f"SELECT doc_id, span FROM ({_spans(r'[^\w:.-]', '(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{4}[.]){2}[0-9A-Fa-f]{4}', r'[^\w:.-]')})", "mac_address")
_detector("d11_asset_inventory", privacy.inventory, r"""SELECT doc_id, substr(trim(line), 1, 160) AS span FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE len(list_distinct(list_filter(regexp_extract_all(line, '\b[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9]+)+\b'), lambda a: regexp_matches(a, '[0-9]')))) >= 3""")


_CATEGORIES = ["ipv4_address", "ipv6_address", "email_address", "guid", "tenant_identifier", "hostname", "unc_path", "filesystem_path",
               "security_identifier", "mac_address", "asset_inventory"]
_ALL_SPANS = f"{_DOUBLED}, f AS ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS category, span FROM ({q})" for c, q in zip(_CATEGORIES, _DETECTED))})"


@register("d12_scan_text", f"{_ALL_SPANS} SELECT * FROM f", ["priv"])
def scan_text(spark, sf):
    return privacy.scan_text(B.priv_text(spark, sf), "text", ["doc_id"]).select("doc_id", "category", "span")


@register("d12_offsets_hold", f"{_ALL_SPANS} SELECT category, count(*) AS findings, 0 AS misplaced FROM f GROUP BY 1", ["priv"])
def offsets(spark, sf):
    """Findings whose span isn't at its place, by category; an inventory's span is trimmed and cut."""
    rows = privacy.scan_text(B.priv_text(spark, sf), "text", ["doc_id", "text"])
    there = F.expr("substr(text, start + 1, end - start)")
    same = (there == F.col("span")) | ((F.col("category") == "asset_inventory") & F.startswith(F.trim(there), F.col("span")))
    return rows.groupBy("category").agg(F.count("*").alias("findings"), F.count_if(~same).alias("misplaced"))


def planted_documents(spark, sf):
    """Event documents with a host as the name of a string, of a number, of an object and in a list."""
    i = F.col("event_id")
    doc = F.struct(
        F.col("event_type").alias("kind"),
        F.struct(F.when(i % 5 == 0, "mail to jane.doe@contoso-corp.com").otherwise("fine").alias("portal.contoso-corp.com")).alias("inner"),
        F.when(i % 7 == 0, F.struct(F.lit(5).alias("files.contoso-corp.com"))).alias("numbers"),
        F.when(i % 11 == 0, F.array(F.struct(F.struct(F.lit(True).alias("on")).alias("vpn.contoso-corp.com")))).alias("list"),
        F.when(i % 13 == 0, F.struct(F.lit("from 10.20.30.40 on").alias("2024"))).alias("years"))
    return B.table(spark, sf, "events").select("event_id", F.parse_json(F.to_json(doc)).alias("doc"))


_FOUND = """SELECT event_id, 'inner.portal.contoso-corp.com' AS field, 'email_address' AS category FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 'inner.portal.contoso-corp.com<key>', 'hostname' FROM events
  UNION ALL SELECT event_id, 'numbers.files.contoso-corp.com<key>', 'hostname' FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT event_id, 'list[0].vpn.contoso-corp.com<key>', 'hostname' FROM events WHERE event_id % 11 = 0
  UNION ALL SELECT event_id, 'years.2024', 'ipv4_address' FROM events WHERE event_id % 13 = 0"""


@register("d12_scan_documents", _FOUND)
def scan_documents(spark, sf):
    return privacy.scan_documents(planted_documents(spark, sf), ["event_id"], "doc").select("event_id", "field", "category")


@register("d13_clean_rows", "SELECT event_id FROM events WHERE event_id % 5 <> 0")
def clean_rows(spark, sf):
    rows = B.table(spark, sf, "events").select("event_id", F.when(
        F.col("event_id") % 5 == 0, F.concat("event_type", F.lit(" by jane.doe@contoso-corp.com"))).otherwise(F.col("event_type")).alias("note"))
    return privacy.clean_rows(rows, "note").select("event_id")


@register("d13_clean_documents", "SELECT event_id FROM events WHERE event_id % 3 <> 1 AND event_id % 4 <> 1")
def clean_documents(spark, sf):
    i = F.col("event_id")
    doc = F.struct(F.col("event_type").alias("kind"), F.when(i % 3 == 1, F.struct(F.array(F.lit("10.20.30.40")).alias("at"))).alias("deep"),
                   F.when(i % 4 == 1, F.struct(F.lit(1).alias("portal.contoso-corp.com"))).alias("keyed"))
    rows = B.table(spark, sf, "events").select("event_id", F.parse_json(F.to_json(doc)).alias("doc"))
    return privacy.clean_documents(rows, "event_id", "doc").select("event_id")


@register("d14_packet_strings", """SELECT cve, 2 + 2 * (2 + (k % 4 <> 0)::INT + (k % 6 = 0)::INT + (customer_action_note IS NOT NULL)::INT + 1) - 0 + k % 4
   + 3 * (k % 4 + (CASE WHEN k % 4 > 0 AND k % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 > 1 AND (k + 1) % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 > 2 AND (k + 2) % 3 <> 0 THEN 1 ELSE 0 END))
   + 3 * (k % 9 = 4)::INT + (SELECT count(*) FROM advtag t WHERE t.k = adv.k) AS fields FROM adv""", ["adv", "advtag"])
def packet_strings(spark, sf):
    return privacy.packet_strings(B.records(spark, sf)).groupBy("cve").agg(F.count("*").alias("fields"))


_QUADS = _spans('[^0-9.]', r'[0-9]{1,3}(?:[.][0-9]{1,3}){3}', '[^0-9.]')


@register("c7_version_and_identifier", f"""{_DOUBLED} SELECT doc_id, 'version' AS kind, span AS token,
    regexp_matches(substr(text, greatest(strpos(text, span) - {vocab.CONTEXT_WINDOW}, 1), least(strpos(text, span) - 1, {vocab.CONTEXT_WINDOW})), '{_VERSION[0]}')
    OR regexp_matches(substr(text, strpos(text, span) + length(span), {vocab.CONTEXT_WINDOW}), '{_VERSION[1]}') AS verdict FROM ({_QUADS})
  UNION ALL SELECT doc_id, 'identifier', token, upper(split_part(token, '-', 1)) IN {inlist(vocab.PUBLIC_IDENTIFIER_PREFIXES)}
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_-])([A-Z]{{2,}}[A-Z0-9]*(?:-[A-Z0-9]+)+)(?:$|[^A-Za-z0-9_-])', 1)) AS token FROM d)""", ["priv"])
def version_context(spark, sf):
    """Every dotted quad of the texts with its surroundings, and every identifier-shaped token."""
    docs = B.priv_text(spark, sf)
    quads = docs.select("doc_id", "text", F.explode(privacy.matches(F.col("text"), privacy.IPV4)).alias("m"))
    window = lambda at, n: F.substr("text", at + 1, n)
    begin = F.greatest(F.col("m.start") - vocab.CONTEXT_WINDOW, F.lit(0))
    versions = quads.select("doc_id", F.lit("version").alias("kind"), F.col("m.span").alias("token"), scalar.looks_like_version(
        window(begin, F.col("m.start") - begin), window(F.col("m.end"), F.lit(vocab.CONTEXT_WINDOW))).alias("verdict"))
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(privacy.ASSET), 0)).alias("token"))
    return versions.unionByName(tokens.select("doc_id", F.lit("identifier").alias("kind"), "token", scalar.is_public_identifier(F.col("token")).alias("verdict")))


@register("a11_scan_report", """SELECT 'record' AS scope, 'hostname' AS category, count(*) AS findings FROM adv WHERE k % 7 = 3""", ["adv"])
def scan_report(spark, sf):
    """What goes into a packet, and every value and key of the whole record."""
    records = B.records(spark, sf)
    packet = privacy.scan_text(privacy.packet_strings(records), "text", ["cve", "field"])
    documents = records.select("cve", F.parse_json(F.to_json(F.struct(*[c for c in records.columns if c != "k"]))).alias("doc"))
    return privacy.scan_report(packet, privacy.scan_documents(documents, ["cve"], "doc"))


def _proof(spark, sf):
    """Findings of whole documents against the source values of their document, each listed twice."""
    docs = B.priv_text(spark, sf)
    found = privacy.scan_text(docs, "text", ["doc_id"]).select(
        F.col("doc_id").alias("cve"), "category", F.lit("/note").alias("field"), F.col("span").alias("value"))
    sources = found.select("cve", F.when(F.col("cve") % 4 != 3, F.col("value")).otherwise("other").alias("value"),
                           F.lit("file").alias("location"), F.lit("/Notes/0").alias("pointer")).distinct()
    twice = sources.unionByName(sources.withColumn("pointer", F.lit("/Notes/1")))
    return joins.proof_of_findings(found, twice, F.lit(True))


@register("j15_proof_of_findings", f"""{_ALL_SPANS} SELECT DISTINCT doc_id AS cve, category, span AS value, CASE WHEN doc_id % 4 <> 3 THEN '/Notes/0' END AS pointer,
  doc_id % 4 <> 3 AS proved FROM f""", ["priv"])
def proof(spark, sf):
    return _proof(spark, sf).select("cve", "category", "value", "pointer", "proved")


@register("j15_unproved", f"{_ALL_SPANS} SELECT DISTINCT doc_id AS cve, category, span AS value FROM f WHERE doc_id % 4 = 3", ["priv"])
def unproved(spark, sf):
    return _proof(spark, sf).where("not proved").select("cve", "category", "value")


# pointer, text, source differs, and the findings of the text: category, span, proved
PROOF_CASES = [
    ("/containers/cna/affected/0/versions/0/lessThan", "built as 10.20.30.<n>", False, [("ipv4_address", "10.20.30.<n>", True)]),
    ("/containers/cna/descriptions/0/value", "built as 10.20.30.<n>", False, [("ipv4_address", "10.20.30.<n>", False)]),
    ("/Vulnerability/3/Remediations/1/FixedBuild", "10.0.17.<n>", False, [("ipv4_address", "10.0.17.<n>", True)]),
    ("/Vulnerability/3/Remediations/1/FixedBuilds", "10.0.17.<n>", False, [("ipv4_address", "10.0.17.<n>", False)]),
    ("/Notes/0", "it was Reproduced  on 8.8.4.<n> by us", False, [("ipv4_address", "8.8.4.<n>", True)]),
    ("/Notes/0", "it was reproduced on 192.168.4.<n> by us", False, [("ipv4_address", "192.168.4.<n>", False)]),
    ("/Notes/0", "see <https://files<n>.contoso-corp.com/a> now", False, [("hostname", "files<n>.contoso-corp.com", True)]),
    ("/Notes/0", "see https://Files<n>.contoso-corp.com.:8443/a now", False, [("hostname", "Files<n>.contoso-corp.com.", True)]),
    ("/Notes/0", "connect to files<n>.contoso-corp.com now", False, [("hostname", "files<n>.contoso-corp.com", False)]),
    ("/Notes/0", "at https://a.contoso-corp.com/?to=db<n>.contoso-corp.com now", False,
     [("hostname", "a.contoso-corp.com", True), ("hostname", "db<n>.contoso-corp.com", False)]),
    ("/References/0/URL", "https://a.contoso-corp.com/?id=0f8fad5b-d9cb-469f-a165-70867728950e&n=<n>", False,
     [("hostname", "a.contoso-corp.com", True), ("guid", "0f8fad5b-d9cb-469f-a165-70867728950e", True)]),
    ("/references/0/url", "https://a.contoso-corp.com/?id=0f8fad5b-d9cb-469f-a165-70867728950e&n=<n>", False,
     [("hostname", "a.contoso-corp.com", True), ("guid", "0f8fad5b-d9cb-469f-a165-70867728950e", False)]),
    ("/References/0/URL", "0f8fad5b-d9cb-469f-a165-70867728950e beside https://learn.microsoft.com/<n>", False,
     [("guid", "0f8fad5b-d9cb-469f-a165-70867728950e", False)]),
    ("/references/0/url", "https://lore.kernel.org/all/<n>.abc@mail.contoso-corp.com/", False,
     [("email_address", "<n>.abc@mail.contoso-corp.com", True)]),
    ("/references/0/url", "https://lists.contoso-corp.com/all/<n>.abc@mail.contoso-corp.com/", False,
     [("hostname", "lists.contoso-corp.com", True), ("email_address", "<n>.abc@mail.contoso-corp.com", False)]),
    ("/references/0/url", "https://files<n>.contoso-corp.com/b", True, [("hostname", "files<n>.contoso-corp.com", False)]),
    ("/Notes/version", "owner S-1-5-21-1-2-<n> of it", False, [("security_identifier", "S-1-5-21-1-2-<n>", False)]),
    ("/Notes/URL", "https://x.example.com 00:1A:2B:3C:4D:5E <n>", False, [("mac_address", "00:1A:2B:3C:4D:5E", False)]),
    ("/Notes/URL", "kept in /home/jane/<n>", False, [("filesystem_path", "/home/jane/<n>", False)]),
    ("/Notes/version", "tenant id: 0f8fad5b-d9cb-469f-a165-70867728950e <n>", False,
     [("tenant_identifier", "0f8fad5b-d9cb-469f-a165-70867728950e", False)]),
    ("/Notes/version", r"copied to \\fs01\share<n>", False, [("unc_path", r"\\fs01\share<n>", False)]),
    ("/Notes/version", "address fe80:1:2:3:4:5:6:7 <n>", False, [("ipv6_address", "fe80:1:2:3:4:5:6:7", False)])]


@register("j15_syntax_proof", f"""SELECT event_id AS cve, c.category, replace(c.span, '<n>', (event_id % 200)::VARCHAR) AS span,
  CASE WHEN c.proved THEN c.pointer END AS pointer, c.proved
  FROM events JOIN (VALUES {values([(k, p, c, s, ok) for k, (p, _, _, found) in enumerate(PROOF_CASES) for c, s, ok in found])}) AS c(k, pointer, category, span, proved)
  ON event_id % {len(PROOF_CASES)} = c.k""")
def syntax_proof(spark, sf):
    """Findings of a text of every event against its source; proved where the category's rule says so."""
    case = F.get(F.array(*[struct_of(pointer=p, text=t, other=o) for p, t, o, _ in PROOF_CASES]), (F.col("event_id") % len(PROOF_CASES)).cast("int"))
    rows = B.table(spark, sf, "events").select(F.col("event_id").alias("cve"), case.alias("c")).select(
        "cve", "c.pointer", "c.other", F.replace("c.text", F.lit("<n>"), (F.col("cve") % 200).cast("string")).alias("value"))
    found = privacy.scan_text(rows, "value", ["cve", "value"]).withColumn("field", F.lit("note"))
    sources = rows.select("cve", F.when(F.col("other"), "something else").otherwise(F.col("value")).alias("value"), F.lit("raw").alias("location"), "pointer")
    return joins.proof_of_findings(found, sources).select("cve", "category", "span", "pointer", "proved")
