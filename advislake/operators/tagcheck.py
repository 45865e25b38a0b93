"""Deterministic checks of judgement tags against the supplied record; findings only."""
import re

from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import (branches, filled, has, let, overlaps, reusable, settle, struct_of, truthy,
                                       within, words)
from advislake.operators.citation import token_line, verify

CHECKS = ["workload_recall", "workload_precision", "delivery_consistency", "evidence_present",
          "evidence_grounded", "citation_verification"]
# fixed values: why a check did not run
NO_TAG_SET = "record carries no tag set"
NO_SOURCE_TEXT = "record carries no source text"
NO_EVIDENCE_FIELD = "tags carry no evidence field (pre-2026-09-11 bare-string tag shape)"
NO_CITATION = "every judgement tag was asserted with an empty citation"
NO_WORKLOAD_TAG = "record asserts no workload tag"
NO_DELIVERY_TAG = "record asserts no delivery tag that presupposes a CVSS value"
NO_JUDGEMENT_TAG = "record asserts no judgement tag"


def source_text() -> Column:
    """Lower-cased advisory text; structured guidance counts as its JSON text."""
    names = F.coalesce(F.transform("products", lambda p: p["name"]), words([]))
    return F.lower(F.array_join(F.concat(
        F.array("title"), names, F.array(F.to_json("vendor_guidance.notes"),
                                         F.to_json("vendor_guidance.remediations"))), " "))


def no_source_text() -> Column:
    """Whether ``source_text`` is blank, told without making it; a structured part that is there is never blank."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    unnamed = F.coalesce(F.forall("products", lambda p: blank(p["name"])), F.lit(True))
    return blank(F.col("title")) & unnamed & F.col("vendor_guidance.notes").isNull() & F.col("vendor_guidance.remediations").isNull()


def terms_at_words(terms: dict) -> Column:
    """For a dict of tags and their ordered terms, the first term of each tag that the lower-cased column
    ``_text`` holds at a left word boundary: array<struct<tag, term>> in the order of the tags.

    One pattern reads the text once: at every word boundary it looks ahead for the longest listed term,
    which also tells the shorter terms that begin it. What is found is mapped to tags and ranks.
    """
    listed = [(rank, tag, at, term) for rank, (tag, ts) in enumerate(terms.items()) for at, term in enumerate(ts)]
    every = sorted({term for *_, term in listed})
    begin = "".join(sorted({term[0] for term in every}))  # seen before the branches are tried one by one
    found = F.array_distinct(F.regexp_extract_all("_text", F.lit(rf"\b(?=[{re.escape(begin)}])(?=({branches(every)}))"), 1))
    begun = {hit: [entry for entry in listed if hit.startswith(entry[3])] for hit in every}
    kind = "array<struct<rank:int,at:int,tag:string,term:string>>"
    entries = F.create_map(*[x for hit in every for x in (F.lit(hit), F.array(*[
        struct_of(rank=rank, at=at, tag=tag, term=term) for rank, tag, at, term in begun[hit]]).cast(kind))])
    none = F.array().cast("array<struct<tag:string,term:string>>")

    def named(hits):
        told = F.array_sort(F.flatten(F.transform(hits, lambda hit: F.try_element_at(entries, hit))))
        first = let(told, lambda ts: F.filter(ts, lambda t, i: (i == 0) | (F.get(ts, i - 1)["rank"] != t["rank"])))
        return F.when(F.size(hits) > 0, F.transform(first, lambda t: struct_of(tag=t["tag"], term=t["term"]))).otherwise(none)

    return let(found, named)  # bound, as the test for none would run the pattern a second time


def _words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), 0))


def _finding(check: str, code: str, tag: Column, detail: Column = None) -> Column:
    return struct_of(check=check, code=code, tag=tag,
                     detail=F.lit(None).cast("string") if detail is None else detail)


@reusable
def _stages(wanted: tuple) -> list:
    """Projections from asserted tags (array<struct<tag, evidence>>) to findings and states.

    Only what the wanted checks read is referred to at the end, so the optimizer drops the rest.
    """
    text, a = F.col("_text"), F.col("asserted")
    tags = F.col("asserted.tag")
    has_tags = a.isNotNull()
    named = terms_at_words(vocab.WORKLOAD_TERMS)
    judged = F.filter(a, lambda x: within(x["tag"], vocab.JUDGEMENT_TAGS))
    cited = F.filter(F.col("_judged"), lambda x: filled(x["evidence"]))
    recall = F.transform(F.filter("_named", lambda n: ~has(F.col("_tags"), n["tag"])),
                         lambda n: _finding("workload_recall", "workload-recall-miss", n["tag"], n["term"]))
    corroborated = F.transform("_named", lambda n: n["tag"])
    precision = F.transform(
        F.filter(a, lambda x: within(x["tag"], vocab.NAMESPACES["workload"])
                 & ~has(F.col("_corroborated"), x["tag"])),
        lambda x: _finding("workload_precision", "workload-uncorroborated", x["tag"], x["evidence"]))
    delivery = F.transform(
        F.filter(a, lambda x: (within(x["tag"], vocab.NEEDS_USER_INTERACTION)
                               & truthy(F.col("attack.user_interaction") == "none"))
                 | (within(x["tag"], vocab.NEEDS_NON_NETWORK) & truthy(F.col("attack.vector") == "network"))),
        lambda x: _finding("delivery_consistency", "delivery-contradicts-cvss", x["tag"], x["evidence"]))
    absent = F.transform(F.filter("_judged", lambda x: ~filled(x["evidence"])),
                         lambda x: _finding("evidence_present", "evidence-missing", x["tag"]))

    def thin(x):
        own = F.array_except(_words_of(F.lower(x["evidence"])), words(vocab.STOP_WORDS))
        return let(own, lambda w: (F.size(w) > 0) & (F.size(F.array_intersect(w, F.col("_text_words"))) < 2))

    grounded = F.transform(F.filter("_cited", thin), lambda x: _finding(
        "evidence_grounded", "evidence-ungrounded", x["tag"], x["evidence"]))
    verdicts = F.transform("_cited", lambda x: struct_of(
        tag=x["tag"], evidence=x["evidence"], v=verify(x["evidence"], F.col("_line"))))
    unverified = F.transform(F.filter("_verdicts", lambda x: ~x["v"]["verified"]), lambda x: _finding(
        "citation_verification", "citation-unverified", x["tag"], x["evidence"]))

    silent = no_source_text()
    none_judged = F.coalesce(F.size("_judged"), F.lit(0)) < 1
    bare = F.col("shape") == "bare"
    needs_ui, needs_path = overlaps(tags, vocab.NEEDS_USER_INTERACTION), overlaps(tags, vocab.NEEDS_NON_NETWORK)
    no_ui = needs_ui & F.col("attack.user_interaction").isNull()
    no_path = needs_path & F.col("attack.vector").isNull()
    lacking = F.concat(F.lit("record carries no "), F.concat_ws(" or ", F.when(
        no_ui, "attack.user_interaction"), F.when(no_path, "attack.vector")))
    off = lambda why: struct_of(state="unchecked", reason=why)
    skip = lambda why: struct_of(state="not-applicable", reason=why)
    on = struct_of(state="checked", reason=F.lit(None).cast("string"))
    start = F.when(~has_tags, off(NO_TAG_SET))
    state = {
        "workload_recall": start.when(silent, off(NO_SOURCE_TEXT)).otherwise(on),
        "workload_precision": start.when(~overlaps(tags, vocab.NAMESPACES["workload"]), skip(NO_WORKLOAD_TAG))
        .when(silent, off(NO_SOURCE_TEXT)).otherwise(on),
        "delivery_consistency": start.when(~needs_ui & ~needs_path, skip(NO_DELIVERY_TAG))
        .when(no_ui | no_path, off(lacking)).otherwise(on),
        "evidence_present": start.when(none_judged, skip(NO_JUDGEMENT_TAG)).when(bare, off(NO_EVIDENCE_FIELD)).otherwise(on),
        "evidence_grounded": start.when(none_judged, skip(NO_JUDGEMENT_TAG)).when(bare, off(NO_EVIDENCE_FIELD))
        .when(silent, off(NO_SOURCE_TEXT)).otherwise(on),
        "citation_verification": start.when(none_judged, skip(NO_JUDGEMENT_TAG)).when(bare, off(NO_EVIDENCE_FIELD))
        .when(silent, off(NO_SOURCE_TEXT)).when(F.size("_cited") < 1, off(NO_CITATION)).otherwise(on),
    }
    states = F.array(*[struct_of(check=c, state=F.col("_state")[c]["state"], reason=F.col("_state")[c]["reason"])
                       for c in wanted])
    gate = lambda check, rows: F.when(F.col("_state")[check]["state"] == "checked", F.col(rows))
    empty = F.array().cast("array<struct<check:string,code:string,tag:string,detail:string>>")
    lists = dict(zip(CHECKS, ["_recall", "_precision", "_delivery", "_absent", "_grounded", "_unverified"]))
    lists = {c: lists[c] for c in wanted}
    return [
        {"_text": source_text(), "_tags": tags, "_judged": judged},
        {"_named": named, "_cited": cited},
        # read for citations alone
        {"_text_words": F.when(F.size("_cited") > 0, _words_of(text)),
         "_line": F.when(F.size("_cited") > 0, token_line(F.to_json(F.struct("cve", "title", "products", "cvss", "attack", "vendor_guidance"))))},
        {"_corroborated": corroborated, "_verdicts": verdicts, "_state": struct_of(**{c: state[c] for c in wanted})},
        {"_recall": recall, "_precision": precision, "_delivery": delivery, "_absent": absent,
         "_grounded": grounded, "_unverified": unverified},
        {"_findings": F.concat(*[F.coalesce(gate(c, rows), empty) for c, rows in lists.items()]),
         "_states": states},
    ]


def with_checks(df: DataFrame, checks=tuple(CHECKS), made=("findings", "states", "verdicts")) -> DataFrame:
    """Adds findings and states of the given checks, and the verdicts of citations where those are checked.

    Needs asserted and shape columns. They stand behind a barrier, so a reader of some of them names these in ``made``.
    """
    out = df
    for stage in _stages(tuple(checks)):
        out = out.withColumns(stage)
    named = [name for name in made if name != "verdicts" or "citation_verification" in checks]
    return settle(out.select(*df.columns, *[f"_{name}" for name in named]), df.columns, {name: F.col(f"_{name}") for name in named})


def finding_rows(checked: DataFrame) -> DataFrame:
    return checked.select("cve", F.explode("findings").alias("f")).select("cve", "f.*")


def check_summary(checked: DataFrame) -> DataFrame:
    """Per check: records checked / unchecked / not applicable / with findings, and rates.

    Counts come from row-local states, so nothing is collected per check.
    """
    per = F.transform("states", lambda s: struct_of(
        check=s["check"], state=s["state"],
        n=F.size(F.filter("findings", lambda f: f["check"] == s["check"]))))
    rows = checked.select(F.explode(per).alias("s")).select("s.*")
    out = rows.groupBy("check").agg(
        F.count_if(F.col("state") == "checked").alias("records_checked"),
        F.count_if(F.col("state") == "unchecked").alias("records_unchecked"),
        F.count_if(F.col("state") == "not-applicable").alias("records_not_applicable"),
        F.count_if(F.col("n") > 0).alias("records_with_findings"), F.sum("n").alias("findings"))
    rate = lambda c: F.round(F.try_divide(c, "records_checked"), 6)
    return out.withColumns({"record_finding_rate": rate("records_with_findings"),
                            "findings_per_checked_record": rate("findings")})


def reason_histogram(checked: DataFrame) -> DataFrame:
    return (checked.select(F.explode("states").alias("s")).where("s.reason is not null")
            .groupBy("s.check", "s.state", "s.reason").agg(F.count("*").alias("records")))


def code_histogram(checked: DataFrame) -> DataFrame:
    return (checked.select(F.explode("findings").alias("f")).groupBy("f.check", "f.code")
            .agg(F.count("*").alias("findings")))


def month_report(checked: DataFrame) -> DataFrame:
    n = F.size("findings")
    return checked.agg(F.count("*").alias("records_total"), F.count_if(n > 0).alias("records_flagged"),
                       F.count_if(n < 1).alias("records_without_findings"), F.sum(n).alias("findings_total"))


def citation_counts(checked: DataFrame) -> DataFrame:
    v = F.col("v.v")
    return (checked.where(F.exists("states", lambda s: (s["check"] == "citation_verification") & (s["state"] == "checked")))
            .select(F.explode("verdicts").alias("v")).agg(
        F.count("*").alias("citations"), F.count_if(~v["verified"]).alias("unverified"),
        F.count_if(v["verified"] & ~v["fully_verified"]).alias("partially"),
        F.count_if(v["fully_verified"]).alias("fully")))
