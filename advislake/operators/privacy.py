"""Privacy detectors over whole texts: every finding keeps its span and offsets.

Each detector is one compiled pattern whose matches are marked, split out and positioned
inside the row, so a scan needs no shuffle and no Python worker.
"""

from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import any_of, branches, has, let, prefix_sums, reusable, struct_of, truthy, within, words
from advislake.functions.scalar import is_public_identifier, looks_like_version, strip_markup
from advislake.operators.parse import string_leaves
from advislake.operators.search import domain_allowed

# fixed values: the shapes of identifiers, as (before)(span)(after) groups
URL = r"""(?U)(\b)((?i:https?|ftps?)://(?:[^\s/?#@"'<>]+@)?[A-Za-z0-9._-]+(?::\d{1,5})?[^\s"'<>)\]]*)()"""
URL_HOST = r"""(?U)(\b(?i:https?|ftps?)://(?:[^\s/?#@"'<>]+@)?)([A-Za-z0-9._-]+)((?::\d{1,5})?[^\s"'<>)\]]*)"""
IPV4 = r"()(?<![\d.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\d.])()"
IPV6 = (r"(?U)()(?<![\w:.])((?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
        r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?:%[A-Za-z0-9_.-]{1,16})?)(?![\w:.])()")
MAC = (r"(?U)()(?<![\w:.-])((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"
       r"|(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4})(?![\w:.-])()")
GUID = (r"(?U)()(?<![\w-])(\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-"
        r"[0-9A-Fa-f]{12}\}?)(?![\w-])()")
TENANT_CUE = (r"(?i)\b(?:tenant|directory|subscription|aad|entra|azure ad|object)"
              r"[ _-]?(?:id|ids|identifier|guid)\b[\s:=\"']*$")
SID = r"(?U)()(?<![\w-])(S-1-\d{1,10}(?:-\d{1,10}){1,15})(?![\w-])()"
EMAIL = (r"(?U)()(?<![\w.+-])([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?![\w-])()")
FQDN = (r"(?U)()(?<![\w.@:/-])((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})"
        r"(?![\w-])()")
HOST_LABEL = (r"(?U)(\b(?i:host ?name|computer ?name|machine ?name|node ?name|device ?name|dns ?name"
              r"|netbios ?name|fqdn|host|server|computer|machine|node|endpoint|asset)\s*[:=]\s*)"
              r"([A-Za-z0-9][A-Za-z0-9._-]{2,62})()")
HOST_LABEL_NOT = r"(?i)^(?:yes|no|none|n/?a|unknown|true|false|required|not ?required)$"
UNC = r"()(\\\\(?:\?\\UNC\\)?[A-Za-z0-9._$-]{1,63}\\[^\s\"'<>|]{1,120})()"
WINDOWS_PATH = r"(?U)()(?<![\w\\:])([A-Za-z]:\\(?!\\)[^\s\"'<>|]{0,200})()"
POSIX_PATH = (r"(?U)()(?<![\w~.])((?:~|/(?:home|Users|root|mnt|media|srv|export|Volumes|net))"
              r"/[A-Za-z0-9._+-][^\s\"'<>|]{0,180})()")
ASSET = r"(?U)(?<![\w-])[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9]+)+(?![\w-])"
LINE_ENDS = r"(?<=[\n\u000b\u000c\u001c-\u001e\u0085\u2028\u2029])|(?<=\r)(?!\n)"

FINDING = "array<struct<start:int,category:string,end:int,span:string,detail:string>>"
_OPEN, _CLOSE = "\u0001", "\u0002"


_PLACED = "struct<span:string,start:int,end:int>"

# fixed values: what a text must hold before a pattern can match; cheap to look for
GUARDS = {
    URL: ["://"], URL_HOST: ["://"], EMAIL: ["@"], SID: ["S-1-"], UNC: ["\\\\"], WINDOWS_PATH: [":\\"], POSIX_PATH: ["/"],
    HOST_LABEL: [":", "="], IPV6: [":"], GUID: ["-"]}
SHAPES = {
    IPV4: r"\d\.\d{1,3}\.\d{1,3}\.", MAC: r"(?:[0-9A-Fa-f]{2}[:-]){5}|(?:[0-9A-Fa-f]{4}\.){2}",
    GUID: r"[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-", FQDN: r"[A-Za-z0-9]\.[A-Za-z]",
    IPV6: "::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]",
    HOST_LABEL: r"(?Ui)(?:name|fqdn|host|server|computer|machine|node|endpoint|asset)\s*[:=]",
    POSIX_PATH: "(?:~|home|Users|root|mnt|media|srv|export|Volumes|net)/"}
# every pattern and every list of assets needs one of these
SPECIAL = r"[.:@/\\=-]"
# beginning of an asset name; a text has at least as many as asset names
ASSET_SHAPE = "[A-Z]{2}[A-Z0-9]*-[A-Z0-9]"


def _possible(text: Column, pattern: str) -> Column:
    """Whether a text can hold a match at all; most can't, and then the pattern isn't run."""
    out = any_of([F.contains(text, F.lit(part)) for part in GUARDS[pattern]]) if pattern in GUARDS else F.lit(True)
    return out & F.rlike(text, F.lit(SHAPES[pattern])) if pattern in SHAPES else out


def matches(text: Column, pattern: str) -> Column:
    """array<struct<span, start, end>> of a pattern's second group, 0-based offsets; linear in the matches."""
    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    marked = F.regexp_replace(clean, pattern, f"$1{_OPEN}$2{_CLOSE}$3")

    def locate(parts):
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        # a part holds one closing mark; its text begins where the parts before it end
        ends = prefix_sums(F.transform(rest, lambda p: F.length(p) - 1))
        base = F.length(F.get(parts, F.lit(0)))

        def placed(part, end):
            span = F.substring_index(part, _CLOSE, 1)
            start = base + end - F.length(part) + 1
            return struct_of(span=span, start=start, end=start + F.length(span))

        return F.zip_with(rest, ends, placed).cast(f"array<{_PLACED}>")

    none = F.expr(f"cast(array() as array<{_PLACED}>)")
    found = let(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), let(F.split(m, _OPEN), locate)).otherwise(none))
    return F.when(_possible(text, pattern), found).otherwise(none)


def _before(text: Column, m: Column, window: int = vocab.CONTEXT_WINDOW) -> Column:
    low = F.greatest(m["start"] - window, F.lit(0))
    return F.substr(text, low + 1, m["start"] - low)


def _after(text: Column, m: Column) -> Column:
    return F.substr(text, m["end"] + 1, F.lit(vocab.CONTEXT_WINDOW))


def _found(m: Column, category: str, detail) -> Column:
    return struct_of(start=m["start"], category=category, end=m["end"], span=m["span"], detail=detail)


def _emit(found: Column, category: str, detail, keep=None) -> Column:
    kept = found if keep is None else F.filter(found, keep)
    say = detail if callable(detail) else (lambda m: F.lit(detail))
    return F.transform(kept, lambda m: _found(m, category, say(m))).cast(FINDING)


def allowed_url_spans(text: Column, extra=()) -> Column:
    host = lambda m: F.regexp_extract(m["span"], r"(?i)^[a-z]+://(?:[^\s/?#@\"'<>]+@)?([A-Za-z0-9._-]+)", 1)
    return F.filter(matches(text, URL), lambda m: domain_allowed(host(m), extra))


def _inside(spans: Column, m: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= m["start"]) & (m["end"] <= s["end"]))


def ipv4_number(literal: Column) -> Column:
    """32-bit value of a dotted quad; null when an octet is over 255 or zero-padded."""
    octets = F.transform(F.split(literal, r"\."), lambda o: o.cast("bigint"))
    valid = F.forall(octets, lambda o: o <= 255) & ~F.rlike(literal, F.lit(r"(?:^|\.)0\d"))
    return F.when(valid, F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o))


def _reserved(address: Column) -> Column:
    def number(text):
        a, b, c, d = (int(p) for p in text.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d
    out = F.lit(False)
    for low, high in vocab.RESERVED_IPV4:
        out = out | address.between(number(low), number(high))
    return out


def ipv4(text: Column) -> Column:
    keep = lambda m: let(ipv4_number(m["span"]), lambda a: a.isNotNull() & (
        _reserved(a) | ~looks_like_version(_before(text, m), _after(text, m))))
    return _emit(matches(text, IPV4), "ipv4_address", lambda m: F.when(
        _reserved(ipv4_number(m["span"])), "RFC1918/reserved address").otherwise("public IPv4 address"), keep)


def ipv6(text: Column) -> Column:
    def valid(m):
        probe = F.substring_index(m["span"], "%", 1)
        groups = F.size(F.filter(F.split(probe, ":"), lambda g: g != ""))
        return F.when(probe.contains("::"), groups <= 7).otherwise(groups == 8)
    return _emit(matches(text, IPV6), "ipv6_address", "IPv6 address literal", valid)


def email(text: Column, extra=()) -> Column:
    role = lambda m: within(F.lower(F.substring_index(m["span"], "@", 1)), vocab.ROLE_LOCAL_PARTS)
    return _emit(matches(text, EMAIL), "email_address", "email address", lambda m: ~(
        role(m) & domain_allowed(F.substring_index(m["span"], "@", -1), extra)))


def guid(text: Column, allowed: Column) -> Column:
    cue = lambda m: F.rlike(_before(text, m), F.lit(TENANT_CUE))
    found = F.filter(matches(text, GUID), lambda m: cue(m) | ~_inside(allowed, m))
    return F.transform(found, lambda m: struct_of(
        start=m["start"], category=F.when(cue(m), "tenant_identifier").otherwise("guid"), end=m["end"], span=m["span"],
        detail=F.when(cue(m), "GUID labelled as a tenant/subscription/directory identifier").otherwise(
            "GUID outside a vendor advisory URL (Entra tenant, subscription or object id)"))).cast(FINDING)


def hostname(text: Column, allowed: Column, extra=()) -> Column:
    tld = lambda m: F.lower(F.substring_index(m["span"], ".", -1))
    urls = _emit(matches(text, URL_HOST), "hostname", "URL host is not an allowlisted vendor domain",
                 lambda m: ~domain_allowed(m["span"], extra))
    names = _emit(
        matches(text, FQDN), "hostname",
        lambda m: F.concat(F.lit("FQDN with non-allowlisted registrable domain (."), tld(m), F.lit(")")),
        lambda m: within(tld(m), vocab.HOSTNAME_TLDS) & ~within(F.lower(m["span"]), vocab.PRODUCT_TOKENS)
        & ~domain_allowed(m["span"], extra) & ~_inside(allowed, m))
    labelled = _emit(
        matches(text, HOST_LABEL), "hostname", "value labelled as a host",
        lambda m: ~F.rlike(m["span"], F.lit(HOST_LABEL_NOT)) & F.rlike(m["span"], F.lit("[A-Za-z]"))
        & F.rlike(m["span"], F.lit(r"[\d-]")) & ~is_public_identifier(m["span"]))
    return F.concat(urls, names, labelled)


def paths(text: Column) -> Column:
    inside = lambda m: F.ltrim(F.lower(F.substr(m["span"], F.lit(4))), F.lit("\\"))
    system = lambda m: F.exists(words(vocab.SYSTEM_ROOTS), lambda r: F.startswith(inside(m), r))
    return F.concat(
        _emit(matches(text, UNC), "unc_path", "UNC path names a file server and share"),
        _emit(matches(text, WINDOWS_PATH), "filesystem_path",
              "absolute local filesystem path outside the system roots", lambda m: ~system(m)),
        _emit(matches(text, POSIX_PATH), "filesystem_path", "absolute home/mount path"))


def sid_and_mac(text: Column) -> Column:
    return F.concat(_emit(matches(text, SID), "security_identifier", "Windows SID"),
                    _emit(matches(text, MAC), "mac_address", "MAC address"))


def inventory(text: Column) -> Column:
    """Lines shaped like an asset list: two inventory terms, or three asset names."""

    def listed(line):
        lowered = F.lower(line)
        terms = F.filter(words(sorted(vocab.INVENTORY_TERMS)), lambda t: F.contains(lowered, t))
        assets = F.array_sort(F.array_distinct(F.filter(
            F.regexp_extract_all(line, F.lit(ASSET), 0),
            lambda a: F.rlike(a, F.lit(r"\d")) & ~is_public_identifier(a))))
        return F.when(F.size(terms) >= 2, F.concat(
            F.lit("line carries "), F.size(terms).cast("string"), F.lit(" inventory column names: "),
            F.array_join(terms, ", "))).when(F.size(assets) >= 3, F.concat(
                F.lit("line lists "), F.size(assets).cast("string"), F.lit(" asset-shaped names: "),
                F.array_join(assets, ", ")))

    def found(lines):
        ends = prefix_sums(F.transform(lines, lambda line: F.length(line)))
        each = F.zip_with(lines, ends, lambda line, end: struct_of(
            start=end - F.length(line), category="asset_inventory", end=end, span=F.substr(F.trim(line), F.lit(1), F.lit(160)), detail=listed(line)))
        return F.filter(each, lambda f: f["detail"].isNotNull()).cast(FINDING)

    lowered = F.lower(text)
    two = F.size(F.filter(words(sorted(vocab.INVENTORY_TERMS)), lambda t: F.contains(lowered, t))) >= 2
    # a line can't hold what the whole text doesn't
    possible = F.rlike(text, F.lit(r"[A-Z]{2}[A-Z0-9]*-[A-Z0-9]")) | two
    return F.when(possible, let(F.split(text, LINE_ENDS), found)).otherwise(F.array().cast(FINDING))


@reusable
def scan(column: str, extra=()) -> Column:
    """All findings of a text column, ordered by start and category."""
    text = F.col(column)
    return F.array_sort(let(allowed_url_spans(text, extra), lambda allowed: F.concat(
        ipv4(text), ipv6(text), email(text, extra), guid(text, allowed), hostname(text, allowed, extra),
        paths(text), sid_and_mac(text), inventory(text))))


def _joined(a: str, b: str) -> int:
    """Length of the shortest text that holds both."""
    if a in b or b in a:
        return max(len(a), len(b))
    return len(a) + len(b) - max(k for k in range(min(len(a), len(b))) if a.endswith(b[:k]))


# a line is listed for two terms, so a shorter text can't be
LEAST_LISTED = min(_joined(a, b) for a in vocab.INVENTORY_TERMS for b in vocab.INVENTORY_TERMS if a != b)


@reusable
def suspect(column: str) -> Column:
    """Whether any detector can find anything in a text; most short texts hold nothing any pattern needs."""
    text = F.col(column)
    patterns = [IPV4, IPV6, EMAIL, GUID, URL_HOST, FQDN, HOST_LABEL, UNC, WINDOWS_PATH, POSIX_PATH, SID, MAC]
    terms = sorted(vocab.INVENTORY_TERMS)
    begin = "".join(sorted({t[0] for t in terms}))
    listed = (F.length(text) >= LEAST_LISTED) & F.rlike(F.lower(text), F.lit(f"(?=[{begin}]){branches(terms)}"))
    assets = F.regexp_count(text, F.lit(ASSET_SHAPE)) >= 3
    return (F.rlike(text, F.lit(SPECIAL)) & (any_of([_possible(text, p) for p in patterns]) | assets)) | listed


def scan_text(df: DataFrame, column: str, keys, extra=()) -> DataFrame:
    """Finding rows (keys, category, span, start, end, detail) of a text column."""
    # behind a barrier, or every look for a pattern would make the text anew
    texts = df.select(*keys, F.inline(F.array(struct_of(_scanned=F.col(column))))).where((F.col("_scanned") != "") & suspect("_scanned"))
    rows = texts.select(*keys, F.explode(scan("_scanned", tuple(extra))).alias("f"))
    return rows.select(*keys, "f.category", "f.span", "f.start", "f.end", "f.detail")


def scan_documents(df: DataFrame, keys, document: str, extra=()) -> DataFrame:
    """Findings in every string value and every key name of a VARIANT document, fields as a.b[0]."""
    leaves = string_leaves(df.select(*keys, F.col(document).alias("doc")), "doc", with_keys=True, dotted=True)
    return scan_text(leaves.withColumnRenamed("pointer", "field"), "text", [*keys, "field"], extra)


def clean_documents(df: DataFrame, key: str, document: str, extra=()) -> DataFrame:
    """Rows whose whole document holds no finding; the others are withheld whole, never redacted."""
    found = scan_documents(df, [key], document, extra).select(key).distinct()
    return df.join(found, key, "left_anti")


def clean_rows(df: DataFrame, column: str, extra=()) -> DataFrame:
    """Rows without any finding; the others are withheld whole, never redacted."""
    return df.where(F.coalesce(F.size(scan(column, tuple(extra))) < 1, F.lit(True)))


def refuse(df: DataFrame, column: str, key: str, extra=()) -> DataFrame:
    """Fails the job on the first row with a finding."""
    found = scan(column, tuple(extra))
    message = F.concat(F.lit("refusing to send: identifying data in "), F.col(key).cast("string"))
    return df.withColumn(column, F.when(F.size(found) > 0, F.raise_error(message).cast("string")).otherwise(F.col(column)))


def packet_strings(df: DataFrame) -> DataFrame:
    """(cve, field, text) of everything a packet carries."""
    one = lambda field, text: F.array(struct_of(field=field, text=F.coalesce(text, F.lit(""))))
    at = lambda name, i, part="": F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"]{part}"))
    notes, fixes = "vendor_guidance.notes", "vendor_guidance.remediations"
    lists = [
        one("title", F.col("title")),
        F.transform("products", lambda p, i: struct_of(field=at("products", i, ".name"), text=p["name"])),
        F.transform(notes, lambda n, i: struct_of(field=at("notes", i, ".title"), text=n["title"])),
        F.transform(notes, lambda n, i: struct_of(field=at("notes", i, ".text"), text=strip_markup(n["value"]))),
        *[_parts(fixes, part) for part in ("url", "description", "subtype")],
        F.transform("tags", lambda t, i: struct_of(field=at("tags", i), text=t)),
        one("cvss.vector", F.col("cvss.vector"))]
    empty = F.array().cast("array<struct<field:string,text:string>>")
    return df.select("cve", F.explode(F.concat(*[F.coalesce(c, empty) for c in lists])).alias("s")).select("cve", "s.*")


def _parts(array: str, part: str) -> Column:
    return F.transform(array, lambda r, i: struct_of(field=F.concat(
        F.lit("remediations["), i.cast("string"), F.lit(f"].{part}")), text=r[part]))


def scan_report(packet: DataFrame, whole: DataFrame) -> DataFrame:
    """Findings per scope and category."""
    both = packet.select(F.lit("packet").alias("scope"), "category").unionByName(
        whole.select(F.lit("record").alias("scope"), "category"))
    return both.groupBy("scope", "category").agg(F.count("*").alias("findings"))
