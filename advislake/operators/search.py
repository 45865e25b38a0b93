"""Search language and facet filters, compiled to one Column on the driver."""
import re

from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import all_of, any_of, has, label_of, overlaps, truthy, within, words
from advislake.functions.scalar import format_priority
from advislake.operators.review import with_review
from advislake.operators.risk import exploited, with_profile
from advislake.operators.severity import severity_band

PROFILE_FIELDS = {"action", "likelihood"}


def query_tokens(query: str) -> list:
    """Quoted phrases or runs without blanks."""
    return [quoted or bare for quoted, bare in re.findall(r'"([^"]+)"|(\S+)', query or "")]


def haystack() -> Column:
    """Lower-cased text of a record that free words search."""
    none = words([])
    parts = F.concat(
        F.array("cve", "title", severity_band(), "attack.vector", "attack.privileges_required",
                "attack.user_interaction", "threat.exploitation_assessment"),
        F.coalesce("tags", none), F.coalesce("product_tags", none),
        F.coalesce(F.flatten(F.transform("products", lambda p: F.array(p["name"], p["product_id"]))), none),
        F.coalesce(F.flatten(F.transform("mitigation_candidates", lambda c: F.array(c.id, c.evidence))), none),
        F.coalesce(F.flatten(F.transform("vendor_guidance.notes", lambda n: F.array(n["title"], n["value"]))), none))
    return F.lower(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " "))


def compare_number(actual: Column, expression: str) -> Column:
    """``>=0.5``, ``<9``, ``10%``, ``7.5``; anything else, and a null, is false."""
    m = re.fullmatch(r"(>=|<=|>|<|=)?\s*([0-9.]+)(%)?", expression)
    try:
        bound = float(m.group(2)) / (100 if m.group(3) else 1)
    except (AttributeError, ValueError):
        return F.lit(False)
    value = actual.cast("double")
    test = {">=": value >= bound, "<=": value <= bound, ">": value > bound, "<": value < bound,
            "=": value == bound}[m.group(1) or "="]
    return truthy(test & ~F.isnan(value))


def _slug(column: Column) -> Column:
    return F.replace(F.lower(column), F.lit(" "), F.lit("-"))


def field_predicate(field: str, value: str):
    """Column for ``field:value``; None when the field is not one of the language's."""
    query, slug = value.lower(), value.lower().replace(" ", "-")
    yes = query in ("true", "yes", "1")
    none = words([])
    if field == "cve":
        return F.lower("cve").contains(query)
    if field == "tag":
        tags = F.concat(F.coalesce("tags", none), F.coalesce("product_tags", none))
        return F.exists(tags, lambda t: F.lower(t).contains(query))
    if field == "product":
        return truthy(F.exists("products", lambda p: F.lower(
            F.concat_ws(" ", p["name"], p["product_id"])).contains(query)))
    if field == "severity":
        return severity_band() == query
    if field == "vector":
        return truthy(F.lower("attack.vector") == query)
    if field == "microsoft":
        return truthy(F.lower("threat.exploitation_assessment") == slug)
    if field == "mitigation":
        return truthy(F.exists("mitigation_candidates", lambda c: F.lower(
            F.concat_ws(" ", c.id, c.evidence)).contains(query)))
    if field == "kev":
        return truthy(F.col("threat.kev")) == F.lit(yes)
    if field == "cvss":
        return compare_number(F.col("cvss.base_score"), query)
    if field == "epss":
        return compare_number(F.col("threat.epss"), query)
    if field == "action":
        action = label_of(vocab.ACTIONS, F.col("resid_action"))
        return (_slug(action) == slug) | (_slug(format_priority(action)) == slug)
    if field == "likelihood":
        return _slug(label_of(vocab.LIKELIHOODS, F.col("resid_likelihood"))) == slug
    if field == "review":
        return F.col("review.required") == F.lit(yes or query == "required")
    return None


def parse_token(token: str):
    """(negated, field or None, word)"""
    negated = token.startswith("-") and len(token) > 1
    body = token[1:] if negated else token
    field, colon, value = body.partition(":")
    return (negated, field.lower(), value, body) if colon and field else (negated, None, "", body)


def search_predicate(query: str) -> Column:
    return _all_tokens(query_tokens(query))


def _all_tokens(tokens) -> Column:
    tests = []
    for token in tokens:
        negated, field, value, body = parse_token(token)
        test = field_predicate(field, value) if field else None
        if test is None:
            test = haystack().contains(body.lower())
        tests.append(~test if negated else test)
    return all_of(tests) if tests else F.lit(True)


def search(df: DataFrame, query: str, selection=()) -> DataFrame:
    """Filter by the search language; profile and review run only for queries that ask.

    Tests that need no profile are applied first, so fewer records are profiled.
    """
    cheap, costly = [], []
    for token in query_tokens(query):
        field = parse_token(token)[1]
        (costly if field in PROFILE_FIELDS | {"review"} else cheap).append(token)
    out, columns = df.where(_all_tokens(cheap)), df.columns
    if not costly:
        return out
    asked = {parse_token(t)[1] for t in costly}
    if asked & PROFILE_FIELDS:
        out = with_profile(out, selection)
    if "review" in asked and "review" not in columns:
        out = with_review(out)
    return out.where(_all_tokens(costly)).select(*columns)


def is_synthetic() -> Column:
    """Demo releases of a manifest (month, file, synthetic)."""
    return (truthy(F.col("synthetic")) | truthy(F.col("file").startswith("demo-"))
            | truthy(F.col("month").endswith("-demo")))


# --- facets ------------------------------------------------------------------------------
OPTION_SOURCE = {tag: source for _, source, options in vocab.FILTER_GROUPS for tag, _, _ in options}


def filter_tags(source: str) -> Column:
    """Tags a filter option reads. Only ``tags`` reads judgement tags; every other
    source, the combined one too, reads product tags."""
    return F.coalesce(F.col("tags" if source == "tags" else "product_tags"), words([]))


def product_facet(selected, mode: str = "or") -> Column:
    """Selected products in OR or AND mode; an unknown tag never hits."""
    if not selected:
        return F.lit(True)
    hits = [has(filter_tags(OPTION_SOURCE[t]), t) if t in OPTION_SOURCE else F.lit(False)
            for t in selected]
    return all_of(hits) if mode == "and" else any_of(hits)


def facets(df: DataFrame, severities=None, vectors=None, products=(), mode="or",
           exploited_only=False, likely_only=False, review_only=False) -> DataFrame:
    tests = [product_facet(list(products), mode)]
    if severities is not None:
        tests.append(within(severity_band(), severities) if severities else F.lit(False))
    if vectors is not None:
        tests.append(within(F.col("attack.vector"), vectors) if vectors else F.lit(False))
    if exploited_only:
        tests.append(exploited())
    if likely_only:
        tests.append(truthy(F.col("threat.exploitation_assessment") == "more-likely"))
    out, columns = df.where(all_of(tests)), df.columns
    if not review_only:
        return out
    out = out if "review" in columns else with_review(out)
    return out.where("review.required").select(*columns)


def host_allowed(df: DataFrame, host: str, extra=()) -> DataFrame:
    """Adds ``allowed``: the host or one of its parents is on the allow-list.

    The list is a short literal, so each host tests its own suffixes with an array
    intersection instead of a non-equi join.
    """
    return df.withColumn("allowed", domain_allowed(F.col(host), extra))


def domain_allowed(host: Column, extra=()) -> Column:
    listed = list(vocab.ALLOWED_DOMAINS) + [d.strip().lower().lstrip(".") for d in extra if d.strip()]
    parts = F.split(F.rtrim(F.lower(host), F.lit(".")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, i, F.size(parts) - i + 1), "."))
    return overlaps(suffixes, listed)
