"""Search language and facet queries."""
from pyspark.sql import functions as F

from advislake.operators import board, review, risk, search
from advislake.plans import bridge as B
from advislake.plans.registry import register
from advislake.plans.sql_views import SELECTION, pick
from advislake.functions import vocab

_HAY = """hay AS (SELECT r.k, lower(concat_ws(' ', cve, title, band, av, pr, ui, exa,
   (SELECT string_agg(tag, ' ') FROM advtag t WHERE t.k = r.k), (SELECT string_agg(tag, ' ') FROM ptag t WHERE t.k = r.k),
   (SELECT string_agg(name || ' ' || product_id, ' ') FROM recprod t WHERE t.k = r.k),
   (SELECT string_agg(id || ' ' || evidence, ' ') FROM cand t WHERE t.k = r.k), 'faq description plain text of the advisory.')) AS h FROM rec r)"""


def _search(name, text, where, needs, with_=""):
    @register(name, f"{with_} SELECT f.cve FROM fullrec f WHERE {where}", ["fullrec", *needs])
    def run(spark, sf):
        return search.search(B.records(spark, sf), text, SELECTION).select("cve")


_search("f1_search_tokens", '"windows" dns -exchange',
        "f.k IN (SELECT k FROM hay WHERE contains(h, 'windows') AND contains(h, 'dns') AND NOT contains(h, 'exchange'))",
        ["rec", "advtag", "ptag", "recprod", "cand"], "WITH " + _HAY)
_search("f1_search_language", 'severity:high -vector:network tag:dns cvss:>=5 -colour:red',
        "f.band = 'high' AND f.av <> 'network' AND f.base_score >= 5 AND f.k IN (SELECT k FROM advtag WHERE tag = 'dns' UNION SELECT k FROM ptag WHERE tag = 'dns')",
        ["advtag", "ptag"])
_search("f1_search_profile", 'action:expedited likelihood:elevated -kev:yes review:required',
        "f.res_a = 2 AND f.res_l = 2 AND NOT f.kev AND f.required", [])
_search("f1_search_quoted", '"remote desktop client" -severity:low',
        "f.k IN (SELECT k FROM hay WHERE contains(h, 'remote desktop client')) AND f.band <> 'low'",
        ["rec", "advtag", "ptag", "recprod", "cand"], "WITH " + _HAY)
_search("f4_field_tag", "tag:server", """f.k IN (SELECT k FROM advtag WHERE tag LIKE '%server%' UNION SELECT k FROM ptag WHERE tag LIKE '%server%')""", ["advtag", "ptag"])
_search("f4_field_product", "product:sharepoint", "f.k IN (SELECT k FROM recprod WHERE lower(name) LIKE '%sharepoint%')", ["recprod"])
_search("f4_field_mitigation", "mitigation:waf_virtual", "f.k IN (SELECT k FROM cand WHERE id LIKE '%waf_virtual%')", ["cand"])
_search("f4_field_microsoft", "microsoft:more-likely cve:cve-2026-00001", "f.exa = 'more-likely' AND f.cve LIKE 'CVE-2026-00001%'", [])
_search("f4_field_kev", "kev:maybe action:immediate", "NOT f.kev AND f.res_a = 3", [])
_search("f5_number_epss", "epss:>=2% cvss:<7.5", "f.epss >= 0.02 AND f.base_score < 7.5", [])


@register("f3_haystack", "WITH " + _HAY + " SELECT k FROM hay WHERE contains(h, 'windows server 2022') OR contains(h, 'gdi')",
          ["rec", "advtag", "ptag", "recprod", "cand"])
def haystack(spark, sf):
    h = search.haystack()
    return B.records(spark, sf).where(h.contains("windows server 2022") | h.contains("gdi")).select("k")


@register("f2_synthetic", "SELECT month || (CASE WHEN month LIKE '%-Jan' THEN '-demo' ELSE '' END) AS month, count(*) AS records FROM adv WHERE month LIKE '%-Jan' GROUP BY 1", ["adv"])
def synthetic(spark, sf):
    months = B.advisories(spark, sf).groupBy("month").agg(F.count("*").alias("records"))
    named = months.withColumns({
        "month": F.when(F.col("month").endswith("-Jan"), F.concat("month", F.lit("-demo"))).otherwise(F.col("month")),
        "file": F.concat("month", F.lit(".jsonl")), "synthetic": F.lit(None).cast("boolean")})
    return named.where(search.is_synthetic()).select("month", "records")


@register("f6_facets", """SELECT cve FROM fullrec WHERE band IN ('high', 'critical') AND av IN ('network', 'adjacent') AND (kev OR det) AND required""", ["fullrec"])
def facets(spark, sf):
    return search.facets(B.records(spark, sf, *B.ASSESSED), ["high", "critical"], ["network", "adjacent"],
                         exploited_only=True, review_only=True).select("cve")


@register("f6_facets_likely", """SELECT cve FROM rec WHERE band = 'medium' AND exa = 'more-likely'""", ["rec"])
def facets_likely(spark, sf):
    return search.facets(B.records(spark, sf), ["medium"], likely_only=True).select("cve")


@register("f7_product_facet_or", "SELECT DISTINCT cve FROM ptag WHERE tag IN ('dns', 'office')", ["ptag"])
def facet_or(spark, sf):
    return B.records(spark, sf).where(search.product_facet(["dns", "office", "no-such-tag"], "or")).select("cve")


@register("f7_product_facet_and", "SELECT cve FROM ptag WHERE tag IN ('server-2022', 'sql-server') GROUP BY 1 HAVING count(*) = 2", ["ptag"])
def facet_and(spark, sf):
    return B.records(spark, sf).where(search.product_facet(["server-2022", "sql-server"], "and")).select("cve")


@register("f8_preauth_network_rce", "SELECT cve FROM ev WHERE rce", ["ev"])
def preauth_rce(spark, sf):
    return B.records(spark, sf).where(risk.is_preauth_rce()).select("cve")


@register("f9_missing_impact", "SELECT cve FROM ev WHERE open_path AND NOT has_impact", ["ev"])
def missing_impact(spark, sf):
    return B.records(spark, sf).where(risk.misses_impact_judgement()).select("cve")


@register("f10_usable_assessment", "SELECT cve FROM ev2 WHERE usable_fw", ["ev2"])
def usable(spark, sf):
    return B.records(spark, sf).where(risk.framework_usable()).select("cve")


@register("f11_superseded", "SELECT cve FROM ev WHERE superseded", ["ev"])
def superseded(spark, sf):
    return B.records(spark, sf).where(risk.superseded()).select("cve")


_HOSTS = ["learn.microsoft.com", "microsoft.com.evil.io", "notmicrosoft.com", "GitHub.com.", "extra.vendor.io",
          "docs.python.org", "contoso-corp.com"]


@register("f12_domain_allowed", f"""WITH h AS (SELECT o_orderkey AS k, {pick(_HOSTS, 'o_orderkey % 7')} AS host FROM orders)
  SELECT k, host, host IN ('learn.microsoft.com', 'GitHub.com.', 'extra.vendor.io', 'docs.python.org') AS allowed FROM h""")
def domain_allowed(spark, sf):
    hosts = B.advisories(spark, sf).select("k", B._at(_HOSTS, F.col("k") % 7).alias("host"))
    return search.host_allowed(hosts, "host", extra=[".Vendor.io"])
