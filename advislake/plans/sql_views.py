"""DuckDB views for the oracles, written from the operator definitions.

``compose`` puts the views a query needs in front of it as CTEs.
"""
from advislake.functions import vocab
from advislake.plans import bridge as B


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick(values, index: str) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END)"


def values(rows) -> str:
    def cell(v):
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else q(v)
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def idx(labels, expr: str) -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN {q(v)} THEN {i}" for i, v in enumerate(labels)) + " ELSE -1 END)"


VIEWS: dict = {}


def view(name: str, deps, text: str) -> None:
    VIEWS[name] = (list(deps), text)


def compose(select: str, *needs: str) -> str:
    done: list = []

    def add(name):
        if name in done:
            return
        for dep in VIEWS[name][0]:
            add(dep)
        done.append(name)

    for name in needs:
        add(name)
    if not done:
        return select
    select = select.strip()
    if select.upper().startswith("WITH "):
        select = ", " + select[5:]
    return "WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in done) + "\n" + select


_SEV = {"1": "Critical", "2": "Important", "3": "Moderate", "5": "Low"}
view("adv", [], f"""
SELECT o_orderkey AS k, 'CVE-2026-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS cve,
  strftime(o_orderdate, '%Y-%b') AS month,
  {pick(B.COMPONENTS, 'o_orderkey % 12')} ||
    CASE WHEN o_orderkey % 17 = 0 THEN ' issue'
         ELSE ' ' || {pick(B.IMPACTS, 'o_orderkey % 6')} || ' Vulnerability' END AS title,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'Important'
    WHEN '3' THEN 'Moderate' WHEN '5' THEN 'Low' END AS severity_text,
  CASE WHEN o_orderkey % 13 <> 0 THEN ((o_orderkey * 37) % 101) / 10.0::DOUBLE END AS base_score,
  CASE WHEN o_orderkey % 19 <> 0 THEN 'CVSS:3.1/AV:' || {pick('NNALPN', 'o_orderkey % 6')}
    || '/AC:L/PR:' || {pick('NNLH', 'o_orderkey % 4')} || '/UI:' || {pick('NR', 'o_orderkey % 2')}
    || '/S:U/C:H/I:H/A:H' END AS vector,
  {pick(B.STATEMENTS, '(o_orderkey * 7) % 5')} AS exploit_text,
  CASE WHEN o_orderkey % 29 = 0 THEN 'No' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Yes' END
    AS customer_action_note,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Linux' WHEN o_orderkey % 11 = 0 THEN 'Chrome'
    ELSE 'microsoft' END AS assigner,
  CASE WHEN o_orderkey % 7 = 0 THEN 'cvss-qualitative' WHEN o_orderkey % 11 = 0 THEN 'chromium' END
    AS cna_scale,
  CASE WHEN o_orderkey % 7 = 0 THEN {pick(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE'], 'o_orderkey % 5')}
    WHEN o_orderkey % 11 = 0 THEN {pick(['Critical', 'High', 'Medium', 'Low'], 'o_orderkey % 4')} END
    AS cna_band
FROM orders""")

view("kev", ["adv"], "SELECT cve FROM adv WHERE k % 53 = 0")
view("epss", ["adv"], """
SELECT cve, ((k * 7919) % 1000) / (CASE WHEN k % 20 = 0 THEN 1000.0 ELSE 10000.0 END)::DOUBLE AS epss,
  ((k * 31) % 1000) / 1000.0::DOUBLE AS percentile FROM adv WHERE k % 9 <> 0""")

view("facts", ["adv", "kev", "epss"], """
SELECT a.*,
  coalesce(contains(lower(exploit_text), 'exploitation detected'), false) AS det,
  CASE WHEN lower(exploit_text) LIKE '%exploitation detected%' OR lower(exploit_text) LIKE '%exploited:yes%'
         THEN 'detected'
       WHEN lower(exploit_text) LIKE '%exploitation more likely%' THEN 'more-likely'
       WHEN lower(exploit_text) LIKE '%exploitation less likely%' THEN 'less-likely'
       WHEN lower(exploit_text) LIKE '%exploitation unlikely%' THEN 'unlikely' ELSE 'unknown' END AS exa,
  kev.cve IS NOT NULL AS kev, e.epss, e.percentile,
  CASE WHEN e.epss IS NULL THEN 'pending' WHEN k % 27 = 1 THEN 'stale' ELSE 'scored' END AS epss_status,
  CASE regexp_extract(vector, 'AV:([A-Z])', 1) WHEN 'N' THEN 'network' WHEN 'A' THEN 'adjacent'
    WHEN 'L' THEN 'local' WHEN 'P' THEN 'physical' ELSE 'unknown' END AS av,
  CASE regexp_extract(vector, 'PR:([A-Z])', 1) WHEN 'N' THEN 'none' WHEN 'L' THEN 'low'
    WHEN 'H' THEN 'high' ELSE 'unknown' END AS pr,
  CASE regexp_extract(vector, 'UI:([A-Z])', 1) WHEN 'N' THEN 'none' WHEN 'R' THEN 'required'
    ELSE 'unknown' END AS ui,
  CASE customer_action_note WHEN 'Yes' THEN true WHEN 'No' THEN false END AS car,
  k % 10 <> 0 AS found
FROM adv a LEFT JOIN kev ON a.cve = kev.cve LEFT JOIN epss e ON a.cve = e.cve""")

view("advtag", ["adv"], f"""
SELECT k, cve, {pick(vocab.IMPACT_TAGS, 'k % 6')} AS tag FROM adv WHERE k % 14 <> 0
UNION ALL SELECT k, cve, 'user-content' FROM adv WHERE k % 3 = 0
UNION ALL SELECT k, cve, {pick(vocab.NAMESPACES['workload'], 'k % 21')} FROM adv""")

_SCALE_ROWS = [(s, b, t) for s, bands in vocab.SEVERITY_SCALES.items() for b, t in bands.items()]
view("scale", [], f"SELECT * FROM (VALUES {values(_SCALE_ROWS)}) AS t(scale, band, target)")
view("bandrank", [], f"SELECT * FROM (VALUES {values(vocab.BAND_RANK.items())}) AS t(band, rank)")
view("sev", ["facts", "scale", "bandrank"], """
SELECT f.*, p.target AS pub_band, c.target AS cna_nband,
  CASE WHEN severity_text IS NOT NULL THEN
    CASE WHEN severity_text = 'Critical' OR base_score >= 9 THEN 'Critical'
         WHEN severity_text = 'Important' OR base_score >= 7 THEN 'Important'
         WHEN severity_text = 'Moderate' OR base_score >= 4 THEN 'Moderate' ELSE 'Low' END
    WHEN base_score IS NULL THEN 'Unknown'
    WHEN base_score >= 9 THEN 'Critical' WHEN base_score >= 7 THEN 'Important'
    WHEN base_score >= 4 THEN 'Moderate' ELSE 'Low' END AS sev_word,
  CASE WHEN severity_text IS NOT NULL THEN 'vendor' WHEN base_score IS NOT NULL THEN 'cvss'
    ELSE 'absent' END AS sev_basis,
  CASE WHEN found THEN assigner END AS prog_assigner,
  CASE WHEN k % 7 = 0 AND found THEN ((k * 31) % 101) / 10.0::DOUBLE END AS cna_score
FROM facts f
LEFT JOIN scale p ON f.severity_text IS NOT NULL AND p.scale = 'msrc' AND p.band =
  CASE WHEN severity_text = 'Critical' OR base_score >= 9 THEN 'Critical'
       WHEN severity_text = 'Important' OR base_score >= 7 THEN 'Important'
       WHEN severity_text = 'Moderate' OR base_score >= 4 THEN 'Moderate' ELSE 'Low' END
LEFT JOIN scale c ON f.found AND c.scale = f.cna_scale AND lower(c.band) = lower(f.cna_band)""")

view("rec", ["sev", "bandrank"], f"""
SELECT s.*,
  CASE WHEN pub_band IS NULL AND cna_nband IS NULL THEN
     CASE WHEN base_score BETWEEN 9.0 AND 10.0 THEN 'critical' WHEN base_score BETWEEN 7.0 AND 8.9 THEN 'high'
          WHEN base_score BETWEEN 4.0 AND 6.9 THEN 'medium' WHEN base_score BETWEEN 0.1 AND 3.9 THEN 'low'
          ELSE 'unknown' END
   WHEN cna_nband IS NULL OR coalesce(pr_.rank, -1) >= cr.rank THEN pub_band ELSE cna_nband END AS band,
  CASE WHEN pub_band IS NOT NULL THEN 'microsoft' WHEN cna_nband IS NOT NULL THEN prog_assigner END AS primary_src,
  CASE WHEN pub_band IS NULL AND cna_nband IS NULL THEN
     CASE WHEN base_score BETWEEN 0.1 AND 3.9 OR base_score BETWEEN 4.0 AND 6.9
            OR base_score BETWEEN 7.0 AND 8.9 OR base_score BETWEEN 9.0 AND 10.0 THEN 'cvss-derived' ELSE 'absent' END
   WHEN cna_nband IS NULL OR coalesce(pr_.rank, -1) >= cr.rank THEN 'scale-mapping:msrc:1.0'
   ELSE 'scale-mapping:' || cna_scale || ':1.0' END AS nbasis,
  CASE WHEN pub_band <> cna_nband THEN
     CASE WHEN base_score IS NOT NULL AND cna_score IS NOT NULL THEN 'assessment' ELSE 'scale' END END AS div_kind,
  CASE WHEN pub_band <> cna_nband THEN round(abs(base_score - cna_score), 2) END AS div_spread,
  pub_band IS NULL AND cna_nband IS NOT NULL AS declined,
  k % 8 <> 0 AS has_fw,
  CASE WHEN k % 8 <> 0 THEN {pick(list(vocab.ARCHETYPES), '(k // 7) % 7')} END AS saved_model,
  (k // 3) % 4 AS saved_l, (k // 5) % 4 AS saved_a,
  CASE WHEN k % 23 = 0 THEN '2025.01.0' ELSE '{vocab.RISK_MODEL_VERSION}' END AS model_version,
  {pick(B.CONFIDENCES, 'k % 3')} AS confidence,
  {pick(B.PATHS, '(k // 2) % 6')} AS direction,
  k % 3 = 0 AS has_basis,
  CASE WHEN found AND k % 10 <> 5 THEN {pick(['none', 'poc', 'active'], 'k % 3')} END AS ssvc_e,
  CASE WHEN found AND k % 10 <> 5 THEN CASE WHEN k % 4 = 0 THEN 'yes' ELSE 'no' END END AS ssvc_a,
  CASE WHEN found AND k % 10 <> 5 THEN CASE WHEN k % 2 = 0 THEN 'partial' ELSE 'total' END END AS ssvc_t,
  k % 14 <> 0 AND k % 6 = 0 AS has_rce, k % 14 <> 0 AS has_impact, k % 3 = 0 AS has_uc
FROM sev s LEFT JOIN bandrank pr_ ON pr_.band = s.pub_band LEFT JOIN bandrank cr ON cr.band = s.cna_nband""")

_ARCH = [(m, *v) for m, v in vocab.ARCHETYPES.items()]
view("arch", [], f"SELECT * FROM (VALUES {values(_ARCH)}) AS t(model, action, floor0, floor1, reason)")


def archetype_case(like: str) -> str:
    return f"""CASE WHEN car = false THEN 'no-customer-action' WHEN kev OR det THEN 'active-exploitation'
   WHEN rce AND {like} >= 2 THEN 'critical-preauth-network-rce' WHEN band = 'unknown' THEN 'unknown-severity'
   WHEN band = 'critical' THEN 'critical-technical' WHEN {like} >= 2 AND band = 'high' THEN 'elevated-high-severity'
   ELSE 'standard-remediation' END"""


view("ev", ["rec"], """
SELECT *, CASE WHEN kev OR det THEN 3 ELSE greatest(
    CASE exa WHEN 'detected' THEN 3 WHEN 'more-likely' THEN 2 WHEN 'unlikely' THEN 0 ELSE 1 END,
    CASE WHEN epss >= 0.10 THEN 2 WHEN epss >= 0.01 THEN 1 ELSE 0 END) END AS ev_l,
  coalesce(base_score >= 9 AND av = 'network' AND pr = 'none' AND ui = 'none', false) AS open_path,
  coalesce(base_score >= 9 AND av = 'network' AND pr = 'none' AND ui = 'none', false) AND has_rce AS rce,
  CASE WHEN has_basis THEN k % 15 = 0 AND band <> 'low'
       WHEN div_kind IS NOT NULL THEN true ELSE declined END AS superseded
FROM rec""")
view("ev2", ["ev"], f"""
SELECT *, has_fw AND model_version = '{vocab.RISK_MODEL_VERSION}' AS usable_fw,
  has_fw AND model_version = '{vocab.RISK_MODEL_VERSION}' AND NOT superseded AS use_fw,
  {archetype_case('ev_l')} AS fallback, {archetype_case('saved_l')} AS determined FROM ev""")
view("ev3", ["ev2", "arch"], """
SELECT e.*, af.action AS fallback_a, ad.action AS determined_a, af.reason AS fallback_reason,
  use_fw AND ev_l > saved_l AS exceeds, use_fw AND determined <> saved_model AS mismatch,
  use_fw AND determined <> saved_model AND ad.action > saved_a AS understates
FROM ev2 e JOIN arch af ON af.model = e.fallback JOIN arch ad ON ad.model = e.determined""")
view("base", ["ev3"], """
WITH a AS (SELECT *,
  CASE WHEN kev OR det THEN 3 WHEN use_fw THEN greatest(ev_l, saved_l) ELSE ev_l END AS l1,
  CASE WHEN kev OR det THEN 3 WHEN use_fw THEN greatest(saved_a, CASE WHEN exceeds THEN fallback_a ELSE 0 END,
     CASE WHEN understates THEN determined_a ELSE 0 END) ELSE fallback_a END AS a1,
  CASE WHEN kev OR det THEN 'active-exploitation' WHEN use_fw AND NOT exceeds THEN saved_model ELSE fallback END AS m1
  FROM ev3)
SELECT *, CASE WHEN car = false THEN 0 ELSE l1 END AS base_l,
  CASE WHEN car = false THEN 0 ELSE greatest(a1, CASE WHEN rce THEN 2 ELSE 1 END) END AS base_a,
  CASE WHEN car = false THEN 'no-customer-action'
       WHEN rce AND l1 >= 2 AND m1 <> 'active-exploitation' THEN 'critical-preauth-network-rce' ELSE m1 END AS base_m
FROM a""")

view("cand", ["adv"], f"""
WITH j AS (SELECT range AS j FROM range(17)),
c AS (SELECT k, cve, j AS pos, {pick(vocab.CONTROL_IDS, 'j')} AS id, {pick(B.RELEVANCES, '(k + j) % 4')} AS relevance,
  {pick(B.CONFIDENCES, '(k + j) % 3')} AS confidence, (k * j) % 3 AS ls, (k + 2 * j) % 3 AS cs,
  (k + j) % 11 = 0 AS block, CASE WHEN (k + j) % 13 <> 0 THEN 'evidence for ' || {pick(vocab.CONTROL_IDS, 'j')} ELSE '' END AS evidence
  FROM adv, j WHERE (k + 3 * j) % 5 = 0)
SELECT * FROM c UNION ALL
SELECT k, cve, 17, min_by(id, pos), 'relevant', 'high', 1, 1, false, 'repeated' FROM c WHERE k % 31 = 0 GROUP BY k, cve""")
view("elig", ["cand", "rec"], f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY pos) AS rn FROM cand)
SELECT f.k, f.cve, f.pos, f.id, f.ls, f.cs, f.block, f.confidence, f.relevance,
  relevance = 'relevant' AND f.confidence IN ('medium', 'high') AS rel,
  (ls > 0 AND id IN {inlist(vocab.NETWORK_CONTROLS)} AND av NOT IN ('network', 'adjacent'))
  OR (ls > 0 AND id IN {inlist(vocab.RESPONSE_CONTROLS)})
  OR (ls > 0 AND id IN {inlist(vocab.CONTENT_CONTROLS)} AND NOT has_uc)
  OR (ls > 0 AND id IN {inlist(vocab.IDENTITY_CONTROLS)} AND pr NOT IN ('low', 'high'))
  OR (block AND NOT (f.confidence = 'high' AND id IN {inlist(vocab.PATH_BLOCK_CONTROLS)}))
  OR (ls = 2 AND NOT block) AS incompatible
FROM f JOIN rec r ON r.k = f.k WHERE rn = 1""")


def profile_view(name: str, selection) -> str:
    """Registers a view with the residual profile under a fixed selection."""
    view(name, ["base", "elig", "arch"], f"""
WITH s AS (SELECT k, sum(ls) FILTER (rel AND NOT incompatible) AS ls, sum(cs) FILTER (rel AND NOT incompatible) AS cs,
   coalesce(bool_or(block AND confidence = 'high') FILTER (rel AND NOT incompatible), false) AS blk,
   count(*) FILTER (rel AND NOT incompatible) AS n_applied,
   string_agg(id, '|' ORDER BY pos) FILTER (rel AND NOT incompatible) AS applied,
   string_agg(id || CASE WHEN rel THEN ': effect is incompatible with source prerequisites or mitigation guardrails'
     ELSE ': inference did not establish exploit-path relevance' END, '|' ORDER BY pos)
     FILTER (NOT rel OR incompatible) AS ignored
   FROM elig WHERE id IN {inlist(selection or ['-'])} GROUP BY k),
c AS (SELECT b.*, coalesce(blk, false) AS blk, coalesce(n_applied, 0) AS n_applied, coalesce(applied, '') AS applied,
   coalesce(ignored, '') AS ignored,
   least(coalesce(ls, 0), CASE WHEN blk THEN 2 ELSE 1 END) AS lc, least(coalesce(cs, 0), 1) AS cc,
   greatest(1, CASE WHEN blk THEN floor1 ELSE floor0 END) AS flr, a.reason AS base_reason
   FROM base b LEFT JOIN s ON s.k = b.k JOIN arch a ON a.model = b.base_m)
SELECT c.* EXCLUDE (applied, ignored, n_applied),
  CASE WHEN car = false THEN '' ELSE applied END AS applied, CASE WHEN car = false THEN '' ELSE ignored END AS ignored,
  CASE WHEN car = false THEN 0 ELSE n_applied END AS n_applied,
  CASE WHEN car = false THEN base_l ELSE greatest(0, base_l - lc) END AS res_l,
  CASE WHEN car = false THEN base_a ELSE greatest(flr, base_a - (CASE WHEN lc >= 1 OR cc >= 1 THEN 1 ELSE 0 END)
     - (CASE WHEN lc >= 2 AND cc >= 1 THEN 1 ELSE 0 END)) END AS res_a
FROM c""")
    return name


SELECTION = ["segmentation_acl", "vendor_workaround", "strong_authentication", "edr_detection_response",
             "email_web_filtering"]
profile_view("prof", SELECTION)
profile_view("prof0", [])

# product tags of the nested records, one row per (k, tag)
view("recprod", ["adv"], f"""
SELECT k, cve, i, 'P' || ((k * 3 + i * 7) % 200) AS product_id,
  {pick(B.PRODUCT_NAMES, '((k * 3 + i * 7) % 200) % 16')} AS name
FROM adv, (SELECT range AS i FROM range(3)) WHERE i < k % 4""")
view("comptag", ["adv"], """
WITH c AS (SELECT k, cve, lower(CASE WHEN k % 17 <> 0 THEN trim(regexp_replace(title,
   '\\s+(Remote Code Execution|Elevation of Privilege|Security Feature Bypass|Information Disclosure|Denial of Service|Spoofing) Vulnerability$', '')) END) AS comp
   FROM adv)
SELECT k, cve, t.tag FROM c JOIN (VALUES ('identity', 'active directory'), ('identity', 'kerberos'),
  ('remote-desktop', 'remote desktop'), ('dns', 'dns'), ('dhcp', 'dhcp'), ('hyper-v', 'hyper-v'),
  ('exchange', 'exchange'), ('web-server', 'internet information services')) AS t(tag, phrase)
ON regexp_matches(comp, '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])')
WHERE NOT (tag = 'exchange' AND comp LIKE '%key exchange%') GROUP BY ALL""")
view("prodrule", [], f"SELECT * FROM (VALUES {values(vocab.PRODUCT_TAG_RULES)}) AS t(tag, needle)")


def product_tag_view(name: str, source: str) -> None:
    """(k, cve, tag) from a (k, cve, name) product view."""
    view(name, [source, "comptag", "prodrule", "adv"], f"""
WITH n AS (SELECT k, cve, lower(name) AS n FROM {source}),
hits AS (SELECT k, cve, tag FROM n JOIN prodrule ON contains(n, needle) GROUP BY ALL),
ide AS (SELECT k FROM n WHERE contains(replace(n, 'visual studio code', ''), 'microsoft visual studio') GROUP BY k),
kept AS (SELECT h.* FROM hits h WHERE NOT (tag = 'visual-studio'
   AND k IN (SELECT k FROM hits WHERE tag = 'vscode') AND k NOT IN (SELECT k FROM ide)))
SELECT k, cve, 'microsoft' AS tag FROM adv UNION SELECT k, cve, tag FROM kept UNION SELECT k, cve, tag FROM comptag
UNION SELECT k, cve, 'windows' FROM n WHERE n LIKE '%windows%'
UNION SELECT k, cve, 'server' FROM n WHERE n LIKE '%windows server%'
UNION SELECT k, cve, 'endpoint' FROM n WHERE n LIKE '%windows 10%' OR n LIKE '%windows 11%'
   OR n LIKE '%microsoft 365 apps%' OR n LIKE '%microsoft office%'""")


product_tag_view("ptag", "recprod")
view("lineprod", ["adv"], f"""
SELECT DISTINCT l_orderkey AS k, 'CVE-2026-' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0') AS cve,
  'P' || l_partkey AS product_id, {pick(B.PRODUCT_NAMES, 'l_partkey % 16')} AS name FROM lineitem""")
product_tag_view("ltag", "lineprod")
view("linerem", [], """
SELECT 'CVE-2026-' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0') AS cve, l_linenumber AS p1, l_suppkey AS p2,
  CASE l_returnflag WHEN 'R' THEN '2' WHEN 'A' THEN '3' ELSE '6' END AS type,
  CASE WHEN l_returnflag = 'R' THEN 'Security Update' ELSE CAST(l_suppkey AS VARCHAR) END AS label,
  'https://example.com/' || l_suppkey AS url, 'P' || l_partkey AS product_id FROM lineitem""")


_REASONS = [
    ("missing-vendor-severity", "band = 'unknown'", "CASE WHEN third THEN cna_where ELSE 'No vendor severity and no CVSS score on the source record.' END"),
    ("third-party-cna", "band <> 'unknown' AND third", "cna_where"),
    ("severity-divergence", "div_kind IS NOT NULL", "'microsoft ' || sev_word || ' against ' || prog_assigner || ' ' || cna_band || CASE WHEN div_spread IS NOT NULL THEN ' (CVSS spread ' || CASE WHEN div_spread = floor(div_spread) THEN CAST(div_spread::BIGINT AS VARCHAR) ELSE CAST(div_spread AS VARCHAR) END || ')' ELSE '' END"),
    ("missing-impact-judgement", "open_path AND NOT has_impact", "'base_score=' || CASE WHEN base_score = floor(base_score) THEN CAST(base_score::BIGINT AS VARCHAR) ELSE CAST(base_score AS VARCHAR) END || ' vector=network privileges_required=none user_interaction=none'"),
    ("attack-path-unknown", "direction = 'unknown'", "'Path for ' || cve"),
    ("source-assessment-uncertainty", "has_fw AND k % 10 = 3", "''"),
    ("missing-assessment", "NOT has_fw", "''"),
    ("superseded-assessment", "has_fw AND superseded", "'normalized_band=' || band || ' basis=' || nbasis"),
    ("unusable-assessment", "has_fw AND NOT superseded AND NOT usable_fw", "'risk_model_version=' || model_version || ' baseline_model=' || saved_model"),
    ("low-confidence", "use_fw AND confidence = 'low'", "doubt"),
    ("guidance-discrepancy", "use_fw AND k % 5 IN (0, 3)", "doubt"),
    ("no-update-available", "use_fw AND total > 0 AND available = 0", "'0 of ' || total || ' affected products have a listed update'"),
    ("archetype-contradicts-severity", "mismatch", "'saved baseline_model=' || saved_model || ', severity band=' || band || ' selects ' || determined"),
    ("changed-threat-evidence", "use_fw AND base_l > saved_l", "''"),
    ("workload-priority", "use_fw AND base_a = 3 AND base_l < 2", "'Server role'"),
    ("incomplete-prerequisites", "base_score IS NULL OR vector IS NULL", "''"),
    ("stale-threat-data", "epss_status = 'stale'", "''"),
    ("public-exploit-evidence", "ssvc_e IN ('poc', 'active') AND NOT kev AND NOT det", "'CISA-ADP SSVC Exploitation: ' || ssvc_e || '. Automatable: ' || ssvc_a || '. Technical Impact: ' || ssvc_t || '.'"),
    ("automatable", "ssvc_a = 'yes'", "'CISA-ADP SSVC Automatable: yes'"),
    ("ssvc-technical-impact", "band = 'unknown' AND ssvc_t IS NOT NULL", "'CISA-ADP SSVC Technical Impact: ' || ssvc_t"),
    ("ssvc-absent", "ssvc_e IS NULL", "CASE WHEN found THEN 'the CVE Program record carries no CISA-ADP SSVC assessment' ELSE 'no CVE Program record was retrieved for this CVE' END"),
]
_INFO = ("third-party-cna", "automatable", "ssvc-technical-impact", "ssvc-absent")
_RAW = "https://raw.githubusercontent.com/CVEProject/cvelistV5/main/cves/2026/"
view("reasons", ["base"], f"""
WITH b AS (SELECT *, k % 13 <> 0 AND assigner <> 'microsoft' AS third, k % 4 AS total,
  (CASE WHEN k % 4 > 0 AND k % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 > 1 AND (k + 1) % 3 <> 0 THEN 1 ELSE 0 END)
   + (CASE WHEN k % 4 > 2 AND (k + 2) % 3 <> 0 THEN 1 ELSE 0 END) AS available,
  {pick(B.UNCERTAINTIES, 'k % 5')} AS doubt,
  'Issuing CNA: ' || assigner || '. Rating: {_RAW}' || substr(lpad(CAST(k AS VARCHAR), 7, '0'), 1, 4) || 'xxx/' || cve || '.json' AS cna_where
  FROM base)
""" + " UNION ALL ".join(
    f"SELECT k, cve, {i} AS ord, '{code}' AS code, {str(code in _INFO).lower()} AS info, {evidence} AS evidence "
    f"FROM b WHERE car IS DISTINCT FROM false AND ({cond})" for i, (code, cond, evidence) in enumerate(_REASONS)))
view("review", ["reasons", "adv"], """
SELECT a.k, a.cve, coalesce(bool_or(NOT info), false) AS required, coalesce(string_agg(code, '|' ORDER BY ord), '') AS codes
FROM adv a LEFT JOIN reasons r ON r.k = a.k GROUP BY 1, 2""")
view("fullrec", ["prof", "review"], "SELECT p.*, r.required, r.codes FROM prof p JOIN review r ON r.k = p.k")
