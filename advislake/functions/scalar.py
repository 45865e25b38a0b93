"""Display, text clean-up and digest functions as Column builders."""
from html.entities import html5

from pyspark.sql import Column, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import let, lookup

_ENTITY = r"^&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"
_JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def format_priority(action: Column) -> Column:
    return F.coalesce(lookup(vocab.PRIORITY_LABELS, action), action)


def format_priority_text(text: Column) -> Column:
    """Rewrites internal action words in prose to their display labels."""
    followers = ("remediation|patching|patch|action|handling|cadence|updating|updates?|rather|"
                 "because|while|given|pending|despite")
    out = F.coalesce(text, F.lit(""))
    for pattern, label in [
            (r"(?i)\bdefer and review\b", "No customer action"),
            (r"(?i)\bout[- ]of[- ]cycle\b", "Expedited"),
            (r"(?i)\bimmediate\b", "Emergency"),
            (r"(?i)\b(?<!normal )scheduled\b(?=\s+(?:" + followers + r")|\s*[.;,]|\z)",
             "Normal scheduled")]:
        out = F.regexp_replace(out, pattern, label)
    return out


def format_vendor_assessment(value: Column) -> Column:
    return lookup(vocab.VENDOR_LIKELIHOOD_LABELS, value, "Not published")


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of the exact double, halves up (only exact halves are ties)."""
    # a tie has an exact binary form, and a power of two scales without rounding
    scaled = value * float(2 ** (digits + 1))
    tie = (scaled == F.floor(scaled)) & (F.pmod(F.floor(scaled), F.lit(2)) == 1)
    nudged = F.when(tie, value + 2.0 ** -(digits + 6)).otherwise(value)
    return F.regexp_replace(F.format_number(nudged, digits), ",", "")


def format_epss(value: Column) -> Column:
    """Probability as a percent text that never rounds across 1 % or 10 %."""
    pct = value.cast("double") * 100
    two, one, three = to_fixed(pct, 2), to_fixed(pct, 1), to_fixed(pct, 3).cast("double")

    def edge(limit):
        return F.when(three < limit, F.concat(three.cast("string"), F.lit("%"))).otherwise(
            f"<{limit}%")

    finite = value.isNotNull() & ~F.isnan(pct) & (F.abs(pct) != float("inf"))
    return (F.when(~finite, "Not yet scored")
            .when((pct > 0) & (pct < 0.01), "<0.01%")
            .when((pct < 1) & (two.cast("double") >= 1), edge(1))
            .when((pct < 10) & (one.cast("double") >= 10), edge(10))
            .when(pct < 1, F.concat(two, F.lit("%")))
            .otherwise(F.concat(one, F.lit("%"))))


def epss_display(threat: str = "threat") -> Column:
    t = lambda name: F.col(f"{threat}.{name}")
    score = format_epss(t("epss"))
    dated = F.when(F.coalesce(t("epss_date"), F.lit("")) != "",
                   F.concat(F.lit(" · feed "), t("epss_date"))).otherwise("")
    return (F.when(t("epss_status") == "pending", F.concat(score, dated))
            .when(t("epss_status") == "stale", F.concat(score, F.lit(" · previous published value")))
            .when(t("epss_percentile").isNotNull(), F.concat(
                score, F.lit(" · "), to_fixed(t("epss_percentile") * 100, 1),
                F.lit("th percentile")))
            .otherwise(score))


def epss_band(score: Column) -> Column:
    return (F.when(score.isNull(), "absent").when(score >= vocab.EPSS_ELEVATED, "elevated")
            .when(score >= vocab.EPSS_PLAUSIBLE, "plausible").otherwise("low"))


def is_public_identifier(token: Column) -> Column:
    return F.upper(F.substring_index(token, "-", 1)).isin(vocab.PUBLIC_IDENTIFIER_PREFIXES)


# fixed values: words around a dotted quad that make it a version number
VERSION_BEFORE = (r"(?i)(?:\bversions?|\bver\.?|\bv|\bbuild|\brelease[ds]?|\brev\.?|\bupdates?"
                  r"|\bpatch(?:es|ed)?|\bthrough|\bprior to|\bbefore|\bearlier than|\bup to"
                  r"|\bsince|\bkernel|\bfirmware|\bpackage|\blibrary)\s*[:=]?\s*$")
VERSION_AFTER = (r"(?i)^(?:[-_+~][0-9A-Za-z]|\s*(?:through|to|and earlier|and later|or earlier"
                 r"|or later|and below|and above|and prior|inclusive)\b)")


def looks_like_version(before: Column, after: Column) -> Column:
    """Context test on the text either side of a dotted quad."""
    return F.rlike(before, F.lit(VERSION_BEFORE)) | F.rlike(after, F.lit(VERSION_AFTER))


def _code_point(code: Column) -> Column:
    raw = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.decode(raw, "UTF-32")


def decode_entities(text: Column, names: dict, fold: bool = True) -> Column:
    """Named and numeric character references; unknown ones stay literal.

    Names are taken in lower case, or as written without ``fold``.
    """

    def one(part: Column) -> Column:
        entity = F.regexp_extract(part, _ENTITY, 1)
        rest = F.substr(part, F.length(entity) + 3)
        digits = F.regexp_replace(F.regexp_replace(entity, "^#[xX]?", ""), "^0+(?=.)", "")
        code = (F.when(F.length(digits) > 8, None)
                .when(F.rlike(entity, F.lit("^#[xX]")), F.conv(digits, 16, 10))
                .when(F.rlike(entity, F.lit("^#")), digits)).try_cast("bigint")
        valid = (code > 0) & (code <= 0x10FFFF) & ~((code >= 0xD800) & (code <= 0xDFFF))
        named = lookup(names, F.lower(entity) if fold else entity)
        value = F.when(F.startswith(entity, F.lit("#")), F.when(valid, _code_point(code))).otherwise(named)
        return F.when(entity == "", part).otherwise(
            F.coalesce(F.concat(value, rest), part))

    return F.when(F.contains(text, F.lit("&")), F.array_join(
        F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def source_plain_text(value: Column) -> Column:
    """Vendor HTML to readable plain text."""
    out = F.coalesce(value, F.lit(""))
    block = "p|div|li|h[1-6]"
    for pattern, replacement in [
            (r"(?s)<!--.*?-->", ""),
            (r"(?is)<(script|style|template|iframe)\b[^>]*>.*?</\1\s*>", ""),
            (r">\s*\\[rn]\s*<", ">\n<"),
            (r"(?i)(</(?:" + block + r")>)[ \t]*\\[rn]\s*\z", "$1"),
            (r"(?i)<br\s*/?>|</(?:" + block + r"|tr|section|blockquote)\s*>", "\n\n"),
            (r"(?i)<li\b[^>]*>", "• "),
            (r"<[^>]*>", "")]:
        out = F.regexp_replace(out, pattern, replacement)
    # bound, as it is looked at thrice below
    out = let(out, lambda t: decode_entities(t, vocab.ENTITIES))
    for pattern, replacement in [
            (r"[\u0000-\u0008\u000b\u000c\u000e-\u001f]", ""),
            (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
            (f"^{_JS_SPACE}+|{_JS_SPACE}+\\z", "")]:
        out = F.regexp_replace(out, pattern, replacement)
    return out


# the whole table of the standard, as the language's library has it
HTML_ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}


def strip_markup(value: Column) -> Column:
    """Tags to blanks and all entities of the standard decoded, nothing else changed."""
    return decode_entities(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", " "), HTML_ENTITIES, fold=False)


def text_value(value: Column) -> Column:
    """A VARIANT scalar, or its Value/value member, as text; absent is empty."""
    member = lambda path: F.try_variant_get(value, path, "string")
    whole = member("$")
    # only a text that looks like an object needs the costly type test
    nameless = F.startswith(whole, F.lit("{")) & F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return F.coalesce(F.nullif(member("$.Value"), F.lit("")), member("$.value"),
                      F.when(nameless, F.lit("")).otherwise(whole), F.lit(""))


def as_list(value: Column, path: str = "$") -> Column:
    """A VARIANT scalar or array, or the member at ``path``, as array<variant>; absent is empty.

    A member that is a list is opened in place: as a VARIANT of its own it would be built anew first.
    """
    single = value if path == "$" else F.try_variant_get(value, path, "variant")
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"),
                      F.filter(F.array(single), lambda v: v.isNotNull() & ~F.is_variant_null(v)))


def is_variant_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def canonical_json(fields: dict) -> Column:
    """Key-sorted compact JSON of name -> Column, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]),
                     {"ignoreNullFields": "false"})


def canonical_sha256(fields: dict) -> Column:
    return F.sha2(canonical_json(fields), 256)
