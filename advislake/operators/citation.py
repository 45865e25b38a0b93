"""Citation checks: does quoted evidence occur in the text it cites?"""
from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions.exprs import attach, let, struct_of, truthy

LONG_RUN = 6       # consecutive tokens that must match
SHORT_RUN = 3      # for parts too short for a long run
MIN_PART = 3       # shorter fragments are ignored
# fixed values: what parts the quotes of a composite citation, and labels before a quote
SEPARATORS = r'"\s*[;+,]\s*"|\s*\.\.\.\s*|\s*\|\s*|\n+|;\s(?=[A-Z])|\s\+\s'
LABELS = r"(?i)^\s*(?:title|description|faq|notes?|vendor guidance|cvss|attack)\s*[:\-]\s*"


def _plain(text: Column) -> Column:
    """Lower-case text; tags and common entities are blanks."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>|&(?:quot|amp|#8217);", " "))


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs, tags and common entities removed."""
    return F.regexp_extract_all(_plain(text), F.lit("[a-z0-9]+"), 0)


def token_line(text: Column) -> Column:
    """Tokens joined by blanks with a blank at both ends, so a run is a substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(_plain(text), "[^a-z0-9]+", " ")), F.lit(" "))


def _parts(span: Column) -> Column:
    """array<struct<part, words>>: parts of a composite citation with at least three tokens; else the whole of it."""
    trim = lambda c, chars: F.trim(c, F.lit(chars))
    blanks = " \t\n\x0b\f\r"
    given = F.coalesce(span, F.lit(""))
    # a pattern to split at is compiled for every row, one that is looked for is not
    cut = F.when(F.rlike(given, F.lit(SEPARATORS)), F.split(given, SEPARATORS)).otherwise(F.array(given))
    parts = F.transform(cut, lambda p: F.regexp_replace(trim(trim(p, blanks), "\"' "), LABELS, ""))
    worded = lambda p: struct_of(part=p, words=tokens(p))
    long = F.filter(F.transform(parts, worded), lambda p: F.size(p["words"]) >= MIN_PART)
    whole = trim(given, blanks)
    return let(long, lambda ps: F.when(F.size(ps) > 0, ps).when(whole != "", F.array(worded(whole))).otherwise(ps))


def components(span: Column) -> Column:
    """Parts of a composite citation with at least three tokens; else the whole of it."""
    return F.transform(_parts(span), lambda p: p["part"])


def run_length(size: Column) -> Column:
    return F.when(size >= LONG_RUN, LONG_RUN).otherwise(SHORT_RUN)


def _starts(need: Column, run: Column) -> Column:
    count = F.size(need) - run + 1
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _run_at(need: Column, at: Column, run: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.slice(need, at, run), " "), F.lit(" "))


def runs(need: Column, run: Column) -> Column:
    """Every run of ``run`` consecutive tokens, as blank-delimited text; the tokens are made once."""
    return let(need, lambda tokens: F.transform(_starts(tokens, run), lambda i: _run_at(tokens, i, run)))


def contains_run(line: Column, need: Column, run: Column) -> Column:
    """Whether any run of ``need`` is in ``line``; both are made once and not for each run, of which none is made
    behind one that is found."""
    return let(struct_of(line=line, need=need), lambda x: F.exists(
        _starts(x["need"], run), lambda i: F.contains(x["line"], _run_at(x["need"], i, run))))


def verify(span: Column, line: Column) -> Column:
    """struct<verified, fully_verified, components, matched, unmatched> of one citation.

    ``line`` is the token_line of the text the citation may rely on.
    """

    def judge(s):
        whole, size = s["whole"], F.size(s["whole"])
        exact = contains_run(line, whole, size)
        short = (size >= 2) & (size < MIN_PART) & exact
        held = lambda p: contains_run(line, p["words"], run_length(F.size(p["words"])))
        judged = F.transform(s["parts"], lambda p: struct_of(part=p["part"], hit=held(p)))  # each part is looked for once

        def settle(j):
            v = {"hits": F.filter(j, lambda x: x["hit"]), "misses": F.transform(F.filter(j, lambda x: ~x["hit"]), lambda x: x["part"])}
            none = F.size(v["hits"]) == 0
            rescued = none & (size >= 2) & (size <= 8) & exact
            left = F.when(short | rescued, F.array().cast("array<string>")).otherwise(v["misses"])
            matched = F.when(short | rescued, 1).otherwise(F.size(v["hits"]))
            count = F.when(short, 1).otherwise(F.size(s["parts"]))
            return struct_of(verified=matched > 0, fully_verified=(count > 0) & (F.size(left) == 0),
                             components=count, matched=matched, unmatched=F.slice(left, 1, 2))

        return let(judged, settle)

    return let(struct_of(whole=tokens(span), parts=_parts(span)), judge)


def verify_pairs(df: DataFrame, span: str, text: str) -> DataFrame:
    """Verdict of each row's own citation against its own text; row-local."""
    lined = df.withColumn("_line", token_line(F.col(text)))
    return lined.withColumn("citation", verify(F.col(span), F.col("_line"))).drop("_line")


MOST_RUNS = 200_000  # asked runs that are broadcast, 16 bytes of hashes each
_SALT = "again"


def run_rows(df: DataFrame, keep, words: str, lengths) -> DataFrame:
    """(keep, n, h1, h2): a row for each run of ``n`` tokens, with two hashes that together stand for its text.

    ``words`` holds the hashes of the tokens. A row gets the tokens that follow it from shifted copies of
    the array, so runs are hashed in compiled code, cost the same however long their words are, and no
    text of a run is made.
    """
    most = max(lengths)
    w = F.col(words)
    shifted = F.arrays_zip(*[F.slice(w, F.lit(k + 1), F.size(w)).alias(f"w{k}") for k in range(most)])
    at = df.select(*keep, F.inline(shifted).alias(*[f"w{k}" for k in range(most)]))

    def hashed(n):
        held = [F.col(f"w{k}") for k in range(n)]
        return F.struct(F.lit(n).alias("n"), F.when(held[-1].isNotNull(), F.xxhash64(*held)).alias("h1"),
                        F.xxhash64(F.lit(_SALT), *held).alias("h2"))

    return at.select(*keep, F.inline(F.array(*[hashed(n) for n in lengths]))).where("h1 is not null")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def verify_in_corpus(citations: DataFrame, documents: DataFrame, key: str, span: str, text: str) -> DataFrame:
    """How many parts of each citation occur in any document: (key, components, matched).

    Runs of both sides meet on two hashes of their tokens. Corpus runs are hashed as they are met and
    reduced at once to those any citation asks for, so what is shuffled are hits, 16 bytes each, and no
    citation-document pairs are formed. Up to MOST_RUNS asked runs are broadcast, so that common runs of the
    corpus are not shuffled to one task; more of them are joined by shuffle.
    """
    parts = citations.select(key, F.posexplode(components(F.col(span))).alias("part", "body"))
    need = parts.select(key, "part", token_hashes(F.col("body")).alias("w"))
    sized = need.select(key, "part", "w", run_length(F.size("w")).alias("_run"))
    asked = run_rows(sized, [key, "part", "_run"], "w", (SHORT_RUN, LONG_RUN)).where("n = _run").drop("_run", "n").distinct()
    wanted = asked.select("h1", "h2").distinct()
    wanted = wanted if wanted.limit(MOST_RUNS + 1).count() > MOST_RUNS else F.broadcast(wanted)
    words = attach(documents.select(F.col(text).alias("_text")), struct_of(w=token_hashes(F.col("_text")))).select("w")
    seen = run_rows(words, [], "w", (SHORT_RUN, LONG_RUN)).drop("n").join(wanted, ["h1", "h2"], "left_semi").distinct()
    met = asked.join(seen.withColumn("hit", F.lit(True)), ["h1", "h2"], "left").groupBy(key, "part").agg(F.max("hit").alias("hit"))
    # parts too short for a run have none; they count, unmatched
    found = need.select(key, "part").join(met, [key, "part"], "left")
    return found.groupBy(key).agg(F.count("*").alias("components"), F.count_if(truthy(F.col("hit"))).alias("matched"))


def scorer_failures(df: DataFrame, view: str = "view") -> DataFrame:
    """Adds failure to verdict rows (verdict, span, view text).

    Every verdict but source-ambiguous must quote, and a quote must occur in the view.
    """
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    span = F.trim(F.coalesce("span", F.lit("")))
    ambiguous = truthy(F.col("verdict") == "source-ambiguous")
    return df.withColumn("failure", F.when(~ambiguous & (span == ""), "verdict asserted without a source span")
                         .when((span != "") & ~F.contains(flat(F.col(view)), flat(span)),
                               "source_span not found in the supplied record"))


def scorer_summary(df: DataFrame) -> DataFrame:
    """Per verdict: rows, failures and rows without a span."""
    return df.groupBy("verdict").agg(
        F.count("*").alias("scored"), F.count_if(F.col("failure").isNotNull()).alias("failures"),
        F.count_if(F.trim(F.coalesce("span", F.lit(""))) == "").alias("unspanned"))


def rejection_rates(df: DataFrame, namespaces: dict) -> DataFrame:
    """Rejection rate per tag namespace over the rows without a scorer failure."""
    from advislake.functions.exprs import lookup
    by_tag = {t: n for n, tags in namespaces.items() for t in tags}
    ok = df.where("failure is null").groupBy(lookup(by_tag, F.col("tag")).alias("namespace")).agg(
        F.count("*").alias("scored"), F.count_if(F.col("verdict") == "unsupported").alias("rejected"))
    return ok.withColumn("rate", F.round(F.try_divide("rejected", "scored"), 6))
