"""Parsing raw advisory and program documents into columns."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import (any_of, attach, filled, has, lookup, overlaps, struct_of, truthy, within,
                                       words)
from advislake.functions.scalar import as_list, strip_markup, source_plain_text, text_value

RAW_BASE = "https://raw.githubusercontent.com/CVEProject/cvelistV5/main/cves"
GUIDE_URL = "https://msrc.microsoft.com/update-guide/vulnerability/"


# --- score sets and vectors ------------------------------------------------------
def best_cvss(sets: Column) -> Column:
    """Highest base score, the first on ties; a null score counts as 0."""
    keyed = F.transform(sets, lambda s, i: F.struct(
        F.coalesce(s["BaseScore"], F.lit(0.0)).alias("score"), (-i).alias("order"), s.alias("set")))
    # a struct sorts by its fields in order, so array_max picks score then lowest position
    best = F.array_max(F.transform(keyed, lambda e: F.struct(e.score.alias("score"), e.order.alias("order"))))
    return F.try_element_at(sets, 1 - best["order"])


def _metric(vector: Column, name: str) -> Column:
    """Value of a vector metric; the last one where it repeats."""
    found = F.regexp_extract_all(F.coalesce(vector, F.lit("")),
                                 F.lit(r"(?:^|/)" + name + r":([A-Z])"), 1)
    return F.try_element_at(found, F.lit(-1))


def vector_fields(vector: Column) -> Column:
    return F.struct(
        lookup({"N": "network", "A": "adjacent", "L": "local", "P": "physical"},
               _metric(vector, "AV"), "unknown").alias("vector"),
        lookup({"N": "none", "L": "low", "H": "high"},
               _metric(vector, "PR"), "unknown").alias("privileges_required"),
        lookup({"N": "none", "R": "required", "P": "required", "A": "required"},
               _metric(vector, "UI"), "unknown").alias("user_interaction"))


def cvss_version(vector: Column) -> Column:
    v = F.coalesce(vector, F.lit(""))
    return (F.when(v.startswith("CVSS:4.0"), "4.0").when(v.startswith("CVSS:3.1"), "3.1")
            .when(v.startswith("CVSS:3.0"), "3.0").otherwise("unknown"))


# --- threat prose ----------------------------------------------------------------
def threat_description(threats: Column, kind: str) -> Column:
    """Description of the first threat of a type; the type ignores case; absent is empty."""
    hits = F.filter(threats, lambda t: F.lower(t["Type"]) == kind.lower())
    return F.coalesce(F.get(hits, F.lit(0))["Description"], F.lit(""))


def exploitation_assessment(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(t.contains("exploitation detected") | t.contains("exploited:yes"), "detected")
            .when(t.contains("exploitation more likely"), "more-likely")
            .when(t.contains("exploitation less likely"), "less-likely")
            .when(t.contains("exploitation unlikely"), "unlikely").otherwise("unknown"))


def exploitation_detected(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).contains("exploitation detected")


def publicly_disclosed(statement: Column) -> Column:
    """Null when the vendor made no statement at all."""
    return F.when(F.coalesce(statement, F.lit("")) != "",
                  F.lower(statement).contains("publicly disclosed:yes"))


# --- notes and remediations --------------------------------------------------------
def note_rows(notes: Column) -> Column:
    """Notes with a value as struct<title, type, value>."""
    kept = F.filter(notes, lambda n: F.coalesce(n["Value"], F.lit("")) != "")
    return F.transform(kept, lambda n: F.struct(
        F.coalesce(n["Title"], F.lit("")).alias("title"), n["Type"].alias("type"),
        n["Value"].alias("value")))


def remediation_rows(items: Column) -> Column:
    return F.transform(items, lambda r: F.struct(
        r["Type"].alias("type"), F.coalesce(r["SubType"], F.lit("")).alias("subtype"),
        F.coalesce(r["URL"], F.lit("")).alias("url"),
        F.coalesce(r["Description"], F.lit("")).alias("description"),
        F.coalesce(r["ProductID"], words([])).alias("product_ids")))


def customer_action(notes: Column) -> Column:
    """The last matching note decides; null when there is none."""
    hits = F.filter(notes, lambda n: F.lower(n.title) == "customer action required")
    value = F.lower(F.trim(F.try_element_at(hits, F.lit(-1))["value"]))
    return F.when(F.size(hits) > 0, value.isin("yes", "true", "required"))


def issuing_cna(notes: Column) -> Column:
    hits = F.filter(notes, lambda n: truthy(n["type"] == 8) & filled(n["title"]))
    return F.trim(F.get(hits, F.lit(0))["title"])


# --- product and workload tags -------------------------------------------------------
def title_component(title: Column) -> Column:
    """Component half of a '<component> <impact class> Vulnerability' title, else null."""
    text = F.trim(F.coalesce(title, F.lit("")))
    shape = r"(?is)^(.+?)\s+(?:" + "|".join(vocab.IMPACT_CLASSES) + r")\s+vulnerabilit(?:y|ies)\s*$"
    return F.nullif(F.trim(F.regexp_extract(text, shape, 1)), F.lit(""))


def workload_tags(title: Column) -> Column:
    component = F.lower(title_component(title))

    def mentions(phrases):
        body = "|".join(p.replace(".", r"\.") for p in phrases)
        return F.rlike(component, F.lit(f"(?<![a-z0-9])(?:{body})(?![a-z0-9])"))

    found = []
    for tag, (needed, excluded) in vocab.COMPONENT_RULES.items():
        hit = mentions(needed)
        found.append(F.when(hit & ~mentions(excluded) if excluded else hit, tag))
    return F.array_sort(F.array_compact(F.array(*found)))


def _name_flags(name: Column) -> dict:
    """Per-product-name facts the tag rules need; each can be OR-ed over names."""
    n = F.lower(F.coalesce(name, F.lit("")))
    flags = {}
    for tag in dict.fromkeys(t for t, _ in vocab.PRODUCT_TAG_RULES):
        flags[tag] = any_of([n.contains(needle) for t, needle in vocab.PRODUCT_TAG_RULES
                             if t == tag])
    # the IDE tag needs a name that still says it once the editor's name is cut out
    flags["_ide"] = F.replace(n, F.lit("visual studio code"), F.lit("")).contains(
        "microsoft visual studio")
    flags["_windows"] = n.contains("windows")
    flags["_server"] = n.contains("windows server")
    flags["_endpoint"] = n.contains("microsoft 365 apps") | n.contains("microsoft office")
    return flags


def _assemble_tags(flag, title: Column) -> Column:
    """Tag array from flag(name) -> boolean Column."""
    base = list(dict.fromkeys(t for t, _ in vocab.PRODUCT_TAG_RULES))
    picks = [F.lit("microsoft")]
    for tag in base:
        keep = flag(tag)
        if tag == "visual-studio":
            keep = keep & (~flag("vscode") | flag("_ide"))
        picks.append(F.when(keep, tag))
    picks += [F.when(flag("_windows"), "windows"),
              F.when(any_of([flag(t) for t in vocab.SERVER_RELEASES]) | flag("_server"), "server"),
              F.when(any_of([flag(t) for t in vocab.ENDPOINT_RELEASES]) | flag("_endpoint"),
                     "endpoint")]
    return F.array_sort(F.array_distinct(F.concat(
        F.array_compact(F.array(*picks)), F.coalesce(workload_tags(title), words([])))))


def product_tags(names: Column, title: Column) -> Column:
    """Product tags of one record from its array of product names (row-local)."""
    joined = F.lower(F.array_join(F.coalesce(names, words([])), " | "))
    flags = _name_flags(joined)
    return _assemble_tags(lambda t: flags[t], title)


def product_tags_by_cve(products: DataFrame, titles: DataFrame) -> DataFrame:
    """Product tags from long (cve, name) rows.

    Each name becomes a fixed set of booleans that combine map-side, so one advisory
    with very many products never gathers its rows in one place.
    """
    flags = _name_flags(F.col("name"))
    ored = (products.select("cve", *[f.alias(t) for t, f in flags.items()])
            .groupBy("cve").agg(*[F.bool_or(F.col(f"`{t}`")).alias(t) for t in flags]))
    joined = titles.join(ored, "cve", "left")
    tags = _assemble_tags(lambda t: truthy(F.col(f"`{t}`")), F.col("title"))
    return joined.select(*titles.columns, tags.alias("product_tags"))


def tag_refresh(df: DataFrame) -> DataFrame:
    """Re-derive product tags; adds tags_changed and generic_only."""
    fresh = product_tags(F.transform("products", lambda p: p["name"]), F.col("title"))
    return df.withColumn("_old", F.coalesce("product_tags", words([]))).withColumn(
        "product_tags", fresh).withColumns({
            "tags_changed": ~F.col("_old").eqNullSafe(F.col("product_tags")),
            "generic_only": F.size(F.array_except("product_tags", words(["microsoft"]))) == 0,
        }).drop("_old")


# --- product tree ----------------------------------------------------------------
_NODE = "struct<node:variant,path:string,sub:int,product_id:string,name:string>"


def product_names(trees: DataFrame) -> DataFrame:
    """Flatten (doc_id, tree VARIANT) to (doc_id, product_id, name); the last write wins.

    One chain over one scan: at each level a node gives the names it writes beside itself, and what is still
    to be opened gives its children, while written names pass through. There are as many levels as the
    deepest tree has.
    """
    depth = document_depth(trees, "tree")
    level = trees.select("doc_id", F.inline(F.array(struct_of(
        node=F.col("tree"), path="", sub=F.lit(None), product_id=F.lit(None), name=F.lit(None)).cast(_NODE))))
    pick = lambda v, *names: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])
    node = F.col("node")

    def write(sub, at):
        """What a node's own or full product name writes; in that order."""
        id_, name = pick(at, "ProductID", "product_id"), pick(at, "Value", "value")
        return F.when(id_.isNotNull() & name.isNotNull(), struct_of(
            node=F.lit(None), path=F.col("path"), sub=F.lit(sub), product_id=id_, name=name).cast(_NODE))

    full = F.coalesce(F.try_variant_get(node, "$.FullProductName", "variant"), F.try_variant_get(node, "$.full_product_name", "variant"))
    self = struct_of(node=node, path=F.col("path"), sub=F.col("sub"), product_id=F.col("product_id"), name=F.col("name")).cast(_NODE)
    is_object = F.startswith(F.schema_of_variant(node), F.lit("OBJECT"))
    for step in range(depth + 1):
        told = F.when(is_object, F.array_compact(F.array(self, write(0, node), write(1, full)))).otherwise(F.array(self))
        level = level.select("doc_id", F.inline(told))
        if step == depth:
            break
        kids = level.lateralJoin(_tvf(level).variant_explode_outer(node.outer()))
        child = F.when(F.rlike(F.schema_of_variant("value"), F.lit("^(OBJECT|ARRAY)")), F.col("value"))
        # zero-padded positions keep document order under plain string order
        path = F.when(F.col("pos").isNull(), F.col("path")).otherwise(F.concat("path", F.lpad(F.col("pos").cast("string"), 9, "0")))
        level = kids.select("doc_id", child.alias("node"), path.alias("path"), "sub", "product_id", "name") \
            .where("node is not null or name is not null")
    last = F.max_by("name", F.struct("path", "sub"))
    return level.where("name is not null").groupBy("doc_id", "product_id").agg(last.alias("name"))


def _tvf(df: DataFrame):
    return df.sparkSession.tvf


# --- program records ---------------------------------------------------------------
def record_url(cve: Column) -> Column:
    """Published location of a CVE record; null for a malformed id."""
    year = F.regexp_extract(cve, r"^CVE-(\d{4})-(\d+)$", 1)
    serial = F.regexp_extract(cve, r"^CVE-(\d{4})-(\d+)$", 2)
    bucket = F.regexp_extract(serial, r"^(\d*)\d{3}$", 1)
    bucket = F.when(bucket == "", "0").otherwise(bucket)
    return F.when(F.coalesce(serial, F.lit("")) != "", F.concat(
        F.lit(f"{RAW_BASE}/"), year, F.lit("/"), bucket, F.lit("xxx/CVE-"), year, F.lit("-"),
        serial, F.lit(".json")))


def ssvc() -> Column:
    return F.when(F.col("cve_program.status") == "found", F.col("cve_program.ssvc"))


CVSS_KEYS = ["cvssV4_0", "cvssV3_1", "cvssV3_0", "cvssV2_0"]
_CVSS = "struct<baseSeverity:string,baseScore:double,vectorString:string>"
_VERSIONS = "array<struct<version:string,status:string,lessThan:string>>"
ADP_METRICS = ("array<struct<other:struct<type:string,content:struct<timestamp:string,"
                "options:array<map<string,string>>>>>>")
PROGRAM_SCHEMA = (
    "cveMetadata struct<cveId:string,state:string,assignerShortName:string,"
    "datePublished:string,dateUpdated:string>, "
    "containers struct<"
    "cna:struct<descriptions:array<struct<lang:string,value:string>>,"
    "problemTypes:array<struct<descriptions:array<struct<description:string>>>>,"
    "references:array<struct<url:string,tags:array<string>>>,"
    f"affected:array<struct<vendor:string,product:string,versions:{_VERSIONS}>>,"
    f"metrics:array<struct<{','.join(f'{k}:{_CVSS}' for k in CVSS_KEYS)}>>>,"
    f"adp:array<struct<providerMetadata:struct<shortName:string>,metrics:{ADP_METRICS}>>>")


def program_facts(document: str = "doc") -> dict:
    """Columns extracted from a parsed CVE program document struct."""
    cna = F.col(f"{document}.containers.cna")
    none = lambda kind: F.array().cast(kind)
    english = F.filter(cna["descriptions"], lambda d: F.startswith(
        F.coalesce(d.lang, F.lit("en")), F.lit("en")))
    joined = lambda arr: F.array_join(F.transform(arr, lambda d: F.coalesce(
        d["value"], F.lit(""))), " ")
    problem = F.filter(F.flatten(F.filter(F.transform(
        cna["problemTypes"], lambda p: F.transform(p.descriptions, lambda d: d.description)),
        lambda a: a.isNotNull())), lambda d: F.coalesce(d, F.lit("")) != "")
    references = F.transform(F.filter(cna["references"], lambda r: F.coalesce(
        r.url, F.lit("")) != ""), lambda r: F.struct(
            r.url.alias("url"), F.coalesce(r.tags, words([])).alias("kinds")))
    affected = F.slice(F.transform(cna["affected"], lambda a: F.struct(
        a.vendor.alias("vendor"), a["product"].alias("product"),
        F.slice(F.coalesce(a.versions, none(_VERSIONS)), 1, 6).alias("versions"))), 1, 6)
    return {
        "assigner": F.col(f"{document}.cveMetadata.assignerShortName"),
        "date_published": F.col(f"{document}.cveMetadata.datePublished"),
        "date_updated": F.col(f"{document}.cveMetadata.dateUpdated"),
        "description": F.nullif(F.trim(joined(english)), F.lit("")),
        "problem_types": F.coalesce(problem, words([])),
        "references": references,
        "affected": affected,
        "vendor_severity": cna_severity(cna),
        **ssvc_facts(F.col(f"{document}.containers.adp")),
    }


def cna_severity(cna: Column) -> Column:
    """First cvssV* metric, else the tier a description states in parentheses."""
    scored = F.flatten(F.transform(cna["metrics"], lambda m: F.array_compact(F.array(*[
        F.when(m[key].isNotNull(), F.struct(
            m[key]["baseSeverity"].alias("band"), F.lit("cvss-qualitative").alias("scale"),
            F.lit("cna-cvss").alias("basis"),
            F.lit(key.replace("cvssV", "").replace("_", ".")).alias("cvss_version"),
            m[key]["baseScore"].alias("base_score"),
            m[key]["vectorString"].alias("vector"))) for key in CVSS_KEYS]))))
    text = F.array_join(F.transform(cna["descriptions"], lambda d: F.coalesce(
        d["value"], F.lit(""))), " ")
    tier = F.regexp_extract(text, r"(?i)\((?:Chromium|Chrome) security severity:\s*(\w+)\)", 1)
    stated = F.when(F.coalesce(tier, F.lit("")) != "", F.struct(
        tier.alias("band"), F.lit("chromium").alias("scale"),
        F.lit("description-parenthetical").alias("basis"),
        F.lit(None).cast("string").alias("cvss_version"),
        F.lit(None).cast("double").alias("base_score"),
        F.lit(None).cast("string").alias("vector")))
    return F.coalesce(F.try_element_at(scored, F.lit(1)), stated)


def ssvc_facts(adp: Column) -> dict:
    """Decision points of the last ADP metric that states any; containers without metrics are passed over."""
    blocks = F.flatten(F.transform(adp, lambda c: F.transform(
        F.filter(F.coalesce(c.metrics, F.array().cast(ADP_METRICS)), lambda m: truthy(m.other.type == "ssvc")),
        lambda m: F.struct(c.providerMetadata.shortName.alias("provider"),
                           m.other.content.timestamp.alias("timestamp"),
                           m.other.content.options.alias("options")))))
    stated = F.filter(blocks, lambda b: F.exists(b.options, lambda o: F.exists(
        F.map_keys(o), lambda key: key.isin("Exploitation", "Automatable", "Technical Impact"))))
    last = F.try_element_at(stated, F.lit(-1))

    def point(name):
        held = F.filter(last["options"], lambda o: F.map_contains_key(o, name))
        return F.try_element_at(F.try_element_at(held, F.lit(-1)), F.lit(name))

    return {
        "ssvc": F.when(last.isNotNull(), F.struct(
            point("Exploitation").alias("exploitation"), point("Automatable").alias("automatable"),
            point("Technical Impact").alias("technical_impact"))),
        "ssvc_provider": last["provider"],
        "ssvc_timestamp": last["timestamp"],
    }


# --- projections of an assembled record ----------------------------------------------
MODEL_AUTHORED = ["inference", "mitigation_candidates", "priority", "review", "tags",
                  "tier1_review"]


def supplied_view(df: DataFrame) -> DataFrame:
    """The advisory as supplied: source facts only."""
    return df.drop(*MODEL_AUTHORED)


def published_severity() -> Column:
    """Each party's own statement, without the bands derived from it or its URL."""
    return F.transform("severity.assessments", lambda a: a.dropFields("url"))


def record_view() -> Column:
    """What a citation may rely on."""
    return F.struct(
        F.col("cve"), F.col("title"), F.transform("products", lambda p: p["name"]).alias("products"),
        F.col("cvss"), F.col("attack"), published_severity().alias("severity"),
        F.col("vendor_guidance"))


def source_packet() -> Column:
    """Assessor packet: urls and product ids dropped, notes stripped of markup."""
    remedies = F.array_distinct(F.transform(
        "vendor_guidance.remediations", lambda r: r.dropFields("product_ids")))
    notes = F.transform("vendor_guidance.notes", lambda n: F.struct(
        n["title"].alias("title"), n["type"].alias("type"), strip_markup(n["value"]).alias("text")))
    return F.struct(
        F.col("cve"), F.col("title"),
        F.col("severity").withField("assessments", published_severity()).alias("severity"),
        F.col("customer_action_required"), F.col("cvss"), F.col("attack"), F.col("threat"),
        F.col("tags"), F.col("source"),
        F.array_sort(F.array_distinct(F.transform("products", lambda p: p["name"]))).alias("products"),
        notes.alias("notes"), remedies.alias("remediations"))


# fixed values: members of a source document that bear on an assessment
VENDOR_EVIDENCE = ["CVE", "Title", "Notes", "Threats", "CVSSScoreSets", "ProductStatuses",
                   "Remediations", "RevisionHistory", "DiscoveryDate", "ReleaseDate",
                   "DiscoveryDateSpecified", "ReleaseDateSpecified", "CWE", "References",
                   "Flags", "Involvements"]
CNA_EVIDENCE = ["providerMetadata", "title", "descriptions", "affected", "problemTypes",
                "references", "metrics", "configurations", "workarounds", "solutions",
                "exploits", "timeline", "impacts", "tags", "dateAssigned", "datePublic",
                "rejectedReasons", "cpeApplicability"]
PROGRAM_METADATA = ["cveId", "state", "datePublished", "dateUpdated"]
PROVIDER_METADATA = ["shortName", "dateUpdated"]
PROGRAM_CONTAINERS = ["cna", "adp"]


def _members(value: Column, names) -> Column:
    """The named members of a VARIANT object as map<string, variant>; null for anything but an object."""
    return F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: F.array_contains(words(names), k))


def _pruned_container(value: Column) -> Column:
    provider = lambda v: F.coalesce(F.to_variant_object(_members(v, PROVIDER_METADATA)), v)
    return F.to_variant_object(F.transform_values(
        _members(value, CNA_EVIDENCE), lambda k, v: F.when(k == "providerMetadata", provider(v)).otherwise(v)))


def program_evidence(document: Column) -> Column:
    """A program record (VARIANT) rebuilt from what bears on an assessment, as VARIANT.

    Kept: four members of ``cveMetadata``, the container of the assigner and every one of the enrichers, each
    with its whitelisted members and a provider's name and date. A container may be an object or a list of
    objects. What is left out anywhere (contacts, credits, unknown members) is not read into the result;
    absent blocks are empty objects, and a null document gives null.
    """
    def container(value):
        listed = F.try_variant_get(value, "$", "array<variant>")
        return F.when(listed.isNotNull(), F.to_variant_object(F.transform(listed, _pruned_container))).otherwise(_pruned_container(value))

    containers = _members(F.try_variant_get(document, "$.containers", "variant"), PROGRAM_CONTAINERS)
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<variant>))")
    rebuilt = struct_of(
        cveMetadata=F.to_variant_object(F.coalesce(_members(F.try_variant_get(document, "$.cveMetadata", "variant"), PROGRAM_METADATA), none)),
        containers=F.to_variant_object(F.coalesce(F.transform_values(containers, lambda k, v: container(v)), none)))
    return F.when(document.isNotNull(), F.to_variant_object(rebuilt))


def evidence_facts(document: Column, family: str) -> Column:
    """Whitelisted members of a VARIANT document as map<name, variant>.

    ``vendor`` takes top-level members, ``cna`` one container's members.
    """
    names = VENDOR_EVIDENCE if family == "vendor" else CNA_EVIDENCE
    # each member is looked up once; a missing one has no text, one that holds null has the text null
    text = lambda n: F.to_json(F.try_variant_get(document, f"$.{n}", "variant"))
    facts = F.map_filter(F.create_map(*[part for n in names for part in (F.lit(n), text(n))]), lambda k, v: v.isNotNull())
    if family == "vendor":
        return facts
    provider = F.to_json(F.struct(
        F.try_variant_get(document, "$.providerMetadata.shortName", "string").alias("shortName"),
        F.try_variant_get(document, "$.providerMetadata.dateUpdated", "string").alias("dateUpdated")))
    return F.transform_values(facts, lambda k, v: F.when(
        k == "providerMetadata", provider).otherwise(v))


PEELED = 8  # levels counted by taking bracket pairs away


def document_depth(df: DataFrame, value: str) -> int:
    """Levels of the deepest VARIANT of a column, from the brackets of its JSON text; one pass.

    A document's own levels bound how often it has to be opened, so none is given beforehand.
    """
    bare = F.regexp_replace(F.regexp_replace(F.to_json(F.col(value)), r"\\.", ""), '"[^"]*"', "")
    marks = df.select(F.regexp_replace(bare, r"[^\[\]{}]", "").alias("m0"))
    # each round takes the innermost pairs away, one level; only what is deeper is walked mark by mark
    for n in range(PEELED):
        marks = marks.withColumn(f"m{n + 1}", F.regexp_replace(f"m{n}", r"\[\]|\{\}", ""))
    peeled = sum((F.col(f"m{n}") != "").cast("int") for n in range(PEELED))
    step = lambda a, m: F.struct(
        (a["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("now"),
        F.greatest(a["most"], a["now"] + F.when(m.isin("[", "{"), 1).otherwise(0)).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    rest = F.when(F.col(f"m{PEELED}") != "", F.aggregate(F.split(f"m{PEELED}", ""), start, step, lambda a: a["most"])).otherwise(0)
    return marks.agg(F.max(peeled + rest)).first()[0] or 0


def string_leaves(df: DataFrame, value: str = "doc", with_keys: bool = False, dotted: bool = False) -> DataFrame:
    """Every string of a VARIANT as (.., pointer, text), at any depth, in one scan.

    Each level opens what is left; finished leaves pass through. ``with_keys`` also gives every key
    name of every object, whatever it holds, at its path with ``<key>`` behind it. Pointers are
    escaped per RFC 6901, or written a.b[0] where ``dotted``.
    """
    keys = [c for c in df.columns if c != value]
    level = df.select(*keys, F.col(value).alias("node"), F.lit("").alias("pointer"))
    for _ in range(document_depth(df, value)):
        kids = level.lateralJoin(_tvf(df).variant_explode_outer(F.col("node").outer()))
        escaped = F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        place = F.col("pos").cast("string")
        if dotted:
            path = F.when(F.col("key").isNull(), F.concat("pointer", F.lit("["), place, F.lit("]"))).when(
                F.col("pointer") == "", F.col("key")).otherwise(F.concat("pointer", F.lit("."), "key"))
        else:
            path = F.concat("pointer", F.lit("/"), F.coalesce(escaped, place))
        child = F.struct(F.coalesce("value", "node").alias("node"),
                         F.when(F.col("pos").isNull(), F.col("pointer")).otherwise(path).alias("pointer"))
        if with_keys:
            named = F.struct(F.col("key").cast("variant").alias("node"), F.concat(path, F.lit("<key>")).alias("pointer"))
            opened = F.explode(F.when(F.col("key").isNull(), F.array(child)).otherwise(F.array(child, named)))
        else:
            opened = F.explode(F.array(child))
        level = kids.select(*keys, opened.alias("o")).select(*keys, "o.node", "o.pointer")
    return level.where(F.schema_of_variant("node") == "STRING").select(
        *keys, "pointer", F.try_variant_get("node", "$", "string").alias("text"))



def source_content(df: DataFrame) -> DataFrame:
    """Vendor text of each record as rows (cve, kind, label, text, position).

    Duplicate texts of a kind keep the first; executive summaries come first.
    """
    notes = df.select("cve", F.posexplode("vendor_guidance.notes").alias("pos", "note"))
    kind = F.lower(F.regexp_replace(F.trim(F.coalesce("note.title", F.lit(""))), r"[\s_-]+", ""))
    wanted = notes.select("cve", "pos", kind.alias("k"), F.col("note.value").alias("value")).where(
        F.col("k").isin("executivesummary", "description", "faq"))
    # the plain text is made once for each wanted note, behind a barrier, and not again for the test of it
    rows = attach(wanted, struct_of(text=source_plain_text(F.col("value")))).where("text <> ''")
    rows = rows.withColumn("kind", F.when(F.col("k") == "faq", "faq").otherwise("summary"))
    # the text itself is the key, so equal texts meet without gathering a record's notes
    first = rows.groupBy("cve", "kind", "text").agg(F.min_by("k", "pos").alias("k"),
                                                    F.min("pos").alias("pos"))
    label = F.when(F.col("k") == "executivesummary", "Microsoft executive summary").when(
        F.col("k") == "description", "Microsoft description")
    rank = F.when(F.col("k") == "executivesummary", 0).otherwise(1)
    return first.select("cve", "kind", label.alias("label"), "text", "pos", rank.alias("rank"))


def source_url(df_source: str = "source") -> Column:
    url = F.col(f"{df_source}.url")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    trusted = F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https")
                         & host.isin("msrc.microsoft.com", "api.msrc.microsoft.com"), F.lit(False))
    return F.when(trusted, url).when(F.rlike("cve", F.lit(r"(?i)^CVE-\d{4}-\d+$")),
                                     F.concat(F.lit(GUIDE_URL), F.col("cve"))).otherwise("")


def faq_parts(text: Column) -> Column:
    """struct<question, answer>: a short first paragraph ending in '?' is the question."""
    parts = F.split(text, r"\n\n+")
    first = F.get(parts, F.lit(0))
    asked = first.endswith("?") & (F.length(first) <= 500) & (F.size(parts) > 1)
    return F.struct(
        F.when(asked, first).alias("question"),
        F.when(asked, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
                                   "\n\n")).otherwise(text).alias("answer"))


def faq_length(content: DataFrame) -> DataFrame:
    """Per record FAQ count and the long flag (over 2500 characters in all)."""
    return (content.where("kind = 'faq'").groupBy("cve")
            .agg(F.count("*").alias("faqs"), F.sum(F.length("text")).alias("chars"))
            .withColumn("long_faq", F.col("chars") > 2500))


def asserted_tags(df: DataFrame, structured: str = "tag_evidence", bare: str = "tags") -> DataFrame:
    """(cve, tag, evidence) rows from structured or bare tag lists; the last evidence wins."""
    pairs = F.when(F.size(F.coalesce(F.col(structured), F.array().cast(
        "array<struct<tag:string,evidence:string>>"))) > 0, F.col(structured)).otherwise(
        F.transform(bare, lambda t: F.struct(t.alias("tag"), F.lit("").alias("evidence"))))
    # the list sits inside one row, so keeping the last of each tag is row-local
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.size(pairs)), lambda later: later.tag == p.tag))
    return df.select("cve", F.explode(last).alias("p")).select(
        "cve", F.coalesce("p.tag", F.lit("")).alias("tag"),
        F.coalesce("p.evidence", F.lit("")).alias("evidence"))


def evidence_shape(structured: Column, bare: Column) -> Column:
    """structured / bare / empty form of a record's tag list."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.when(n(bare) > 0, "bare").when(n(structured) > 0, "structured").otherwise("empty")
