"""Phrase collocations from a weighted de Bruijn graph of word runs.

Nodes are runs of three words, edges runs of four. Each block of texts makes its own graph: equal edges
are summed, and unary paths, along which every occurrence goes on alike, are compacted to one row of words
with one weight. In Spark the paths are opened into edges, equal edges of all blocks meet, and the counts
of shorter runs follow from the flow out of their nodes plus the runs that a piece's end cuts short.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from advislake.llm import words as W
from advislake.llm.components import written
from advislake.llm.registry import register

LONGEST = 4
LEAST_COUNT, CONTAINED, TOP = 30, 80, 2000
MOST_CODES = 1 << 20  # words whose codes go along with the tasks: 16 MB at most
COMMON, SALTS = 1024, 64  # pairs of the COMMON commonest words are dealt out by their third word
BLOCK_BYTES = 4 << 20
BREAK = np.zeros(256, bool)  # ends a piece
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[9, 32]] = True


class _Words:
    """Words of a block: key of (language, word) and whether a piece begins at the word."""

    def __init__(self, data, at, low, high, lang):
        self.w = w = W.Words(data, at, low, high, OUTSIDE)
        self.key = W.mix(w.hashes(fold=True) ^ lang[low:high].view(np.uint64)[w.row])
        a, b = int(at[low]), int(at[high])
        breaks = np.append(0, np.cumsum(BREAK[data[a:b]], dtype=np.int32))
        self.begins = np.ones(len(w.start), bool)
        self.begins[1:] = (w.row[1:] != w.row[:-1]) | (breaks[w.start[1:] - a] != breaks[w.end[:-1] - a])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all members of runs, run after run."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Lower-cased strings of byte spans."""
    size = end - start
    flat = W.LOWER[data[_spans(start, size)]]
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def _slim(docs: DataFrame, text: str, group: str) -> DataFrame:
    lang = F.coalesce(docs[f"`{group}`"].cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lkey"), docs[f"`{text}`"].alias("text"))


def vocabulary(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    """(lang, word, kw, c): every word of each language, its 64-bit key and its number of occurrences."""
    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, "text"))
            lang = batch.column("lkey").to_numpy()
            for low, high in W.blocks(at, BLOCK_BYTES):
                block = _Words(data, at, low, high, lang)
                key, first, count = np.unique(block.key, return_index=True, return_counts=True)
                rows = pa.array(block.w.row[first] + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(rows), _strings(data, block.w.start[first], block.w.end[first]),
                     pa.array(key.view(np.int64)), pa.array(count)], names=["lang", "word", "kw", "c"])

    words = _slim(docs, text, group).mapInArrow(run, "lang string, word string, kw long, c long")
    return words.groupBy("lang", "word", "kw").agg(F.sum("c").alias("c"))


def _dictionary(heavy: DataFrame, most: int) -> tuple[np.ndarray, bool]:
    """Keys of the commonest words, commonest first, ``most`` at most, and whether these are all of them.

    A histogram of counts says from which count on the words are few enough to be fetched."""
    step = F.floor(F.log2("c") * 16)
    found = sorted(heavy.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, least = 0, None
    for row in found:
        if total + row["n"] > most:
            break
        total, least = total + row["n"], row["step"]
    if least is None:
        return np.zeros(0, np.uint64), not found
    table = heavy.where(step >= least).select("kw", "c").toArrow()
    kw, c = table["kw"].to_numpy(), table["c"].to_numpy()
    return kw[np.lexsort((kw, -c))].view(np.uint64), least == found[-1]["step"]


def _outside_code(kw: Column) -> Column:
    """Code of a word beyond the dictionary: negative, from its key."""
    return -F.shiftrightunsigned(kw, 1) - 1


def _encoded(key: np.ndarray, sorted_keys: np.ndarray, codes: np.ndarray, complete: bool) -> np.ndarray:
    """The code of each word; 0 for words that are surely below the least count."""
    if not len(sorted_keys):
        code, hit = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    else:
        at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
        hit = sorted_keys[at] == key
        code = np.where(hit, codes[at], 0)
    return code if complete else np.where(hit, code, -(key >> np.uint64(1)).astype(np.int64) - 1)


def compacted(code: np.ndarray, begins: np.ndarray):
    """The graph of a block as paths: first place, number of words, weight and whether pieces end there.

    ``code`` holds the words of all pieces one after another, ``begins`` where pieces begin. A path is a
    longest chain of edges of one weight through nodes that have one edge in, one edge out and no piece's
    end. Every occurrence of such an edge goes on alike, so the first occurrences of a chain's edges follow
    each other in the text and a cycle is broken at its first edge.
    """
    n = len(code)
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, n))
    left = np.repeat(first + size, size) - np.arange(n)  # words from here to the piece's end
    c = code.view(np.uint64)
    pair = np.zeros(n, np.uint64)
    pair[:-1] = W.mix(c[:-1] * W.BASE + c[1:]) if n > 1 else 0
    at3, at4 = np.flatnonzero(left >= 3), np.flatnonzero(left >= 4)
    h3 = W.mix(pair[at3] * W.BASE + c[at3 + 2])
    h4 = W.mix(pair[at4] * W.BASE + pair[at4 + 2])
    nodes, of3 = np.unique(h3, return_inverse=True)
    node = np.full(n, -1)
    node[at3] = of3
    _, rep, weight = np.unique(h4, return_index=True, return_counts=True)
    order = np.argsort(rep)
    edge, weight = at4[rep[order]], weight[order]  # first place and weight of each edge, in text order
    out, into = (np.bincount(node[edge + k], minlength=len(nodes)) for k in (0, 1))
    tail = np.flatnonzero(left == 3)
    ends = np.bincount(node[tail], minlength=len(nodes))
    linked = np.zeros(len(edge), bool)  # to the edge before
    via = node[edge[1:]]
    linked[1:] = (edge[1:] == edge[:-1] + 1) & (out[via] == 1) & (into[via] == 1) & (ends[via] == 0) & (weight[1:] == weight[:-1])
    head = np.flatnonzero(~linked)
    edges = np.diff(np.append(head, len(edge)))
    start, last, w = edge[head], edge[head + edges - 1], weight[head]
    stop = node[last + 1]
    closed = (ends[stop] == w) & (out[stop] == 0) & (into[stop] == 1)
    open_end = ends > 0
    open_end[stop[closed]] = False
    tail_nodes, tail_at = np.unique(node[tail], return_index=True)
    some = open_end[tail_nodes]
    two = first[size == 2]
    _, two_at, two_w = np.unique(pair[two], return_index=True, return_counts=True)
    return (np.concatenate([start, tail[tail_at[some]], two[two_at]]),
            np.concatenate([edges + 3, np.full(int(some.sum()), 3), np.full(len(two_at), 2)]),
            np.concatenate([w, ends[tail_nodes[some]], two_w]),
            np.concatenate([closed, np.ones(int(some.sum()) + len(two_at), bool)]))


def _paths(docs: DataFrame, text: str, group: str, keys: np.ndarray, complete: bool) -> DataFrame:
    """(words, grams, weight): compacted paths of all blocks; a path has a run of words at its first ``grams`` places."""
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], order + 1))

    def run(batches):
        sorted_keys, codes = shared.value
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, "text"))
            lang = batch.column("lkey").to_numpy()
            for low, high in W.blocks(at, BLOCK_BYTES):
                block = _Words(data, at, low, high, lang)
                code = _encoded(block.key, sorted_keys, codes, complete)
                known = code != 0
                piece = np.cumsum(block.begins | ~known)[known]  # a rare word ends a piece
                code = code[known]
                begins = np.ones(len(code), bool)
                begins[1:] = piece[1:] != piece[:-1]
                start, size, weight, ended = compacted(code, begins)
                words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(code[_spans(start, size)]))
                yield pa.RecordBatch.from_arrays(
                    [words, pa.array(np.where(ended, size - 1, size - 3).astype(np.int32)), pa.array(weight)],
                    names=["words", "grams", "weight"])

    return _slim(docs, text, group).mapInArrow(run, "words array<long>, grams int, weight long")


def gram_counts(paths: DataFrame, least: int) -> DataFrame:
    """(g, f): the runs of two to four words with at least ``least`` occurrences.

    Paths are opened into edges, or shorter runs at a piece's end, and dealt out by their first two words,
    so the flow of every node is summed where its edges are. Only pairs of the commonest words are dealt by
    their third word too, and their sums are added up afterwards.
    """
    at = paths.where("grams > 0").select("words", "weight", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("p"))
    runs = at.select(*[F.get("words", F.col("p") + k).alias(f"w{k + 1}") for k in range(LONGEST)], "weight")
    common = F.col("w1").between(1, COMMON) & F.col("w2").between(1, COMMON)
    runs = runs.withColumn("salt", F.when(common & F.col("w3").isNotNull(), F.pmod("w3", F.lit(SALTS)) + 1).otherwise(0)).repartition("w1", "w2", "salt")
    depth = F.when(F.col("w4").isNotNull(), 4).when(F.col("w3").isNotNull(), 3).otherwise(2)
    flows = runs.select("*", F.explode(F.sequence(F.lit(2), depth)).alias("m"))
    flows = flows.select("w1", "w2", "salt", *[F.when(F.col("m") >= k, F.col(f"w{k}")).alias(f"x{k}") for k in (3, 4)], "weight") \
        .groupBy("w1", "w2", "salt", "x3", "x4").agg(F.sum("weight").alias("f"))
    flows = flows.where((F.col("f") >= least) | (F.col("x3").isNull() & common))
    return flows.groupBy("w1", "w2", "x3", "x4").agg(F.sum("f").alias("f")).where(F.col("f") >= least) \
        .select(F.filter(F.array("w1", "w2", "x3", "x4"), lambda w: w.isNotNull()).alias("g"), "f")


def _scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(g, a, l, r, score) of each gram at its lowest-scoring cut, ties to the first."""
    counts = grams.unionByName(words.select(F.array("code").alias("g"), F.col("f1").alias("f"))).select(F.col("g").alias("part"), "f")
    cuts = grams.select("g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    sides = cuts.select("g", "a", "k", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.slice("g", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), F.slice("g", F.col("k") + 1, F.size("g")).alias("part")))))
    both = sides.join(counts, "part").groupBy("g", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    return both.groupBy("g", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")) \
        .select("g", "a", "s.l", "s.r", "s.score")


def _largest_container(grams: DataFrame) -> DataFrame:
    """(g, longer): the largest count of a longer gram around each gram that has one."""
    size = F.size("g")
    inner = grams.where(size > 2).select("g", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("g", "f", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("from"))
    return inner.groupBy(F.slice("g", F.col("from"), F.col("m")).alias("g")).agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST_COUNT,
                 contained: int = CONTAINED, most_codes: int = MOST_CODES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of two to four words with at least ``least`` occurrences.

    Texts are cut into pieces at ``.,;:!?`` and line ends, A-Z lower-cased; words are what spaces and tabs
    part. All counts are per value of ``group`` (null: und): ``a`` of the phrase, ``l`` and ``r`` of its two
    parts at the cut with the lowest score floor(2000000 a / (l + r)), ties to the first cut; ``n`` counts
    all words. A phrase inside a longer one that has ``contained`` in 100 of its occurrences or more is left
    out. Null and empty texts hold nothing, equal rows count each, an empty table gives no rows, and other
    columns are not read. Words below ``least`` end pieces, as no phrase can hold them. The ``most_codes``
    commonest words are small numbers in every task; words beyond go by 64-bit keys. Exact to such keys.
    """
    spark = docs.sparkSession
    vocab = written(vocabulary(docs, text, group), "phrase-words")
    heavy = vocab.where(F.col("c") >= least)
    keys, complete = _dictionary(heavy, most_codes)
    codes = spark.createDataFrame(pa.table({"kw": pa.array(keys.view(np.int64)), "code": pa.array(np.arange(1, len(keys) + 1))}),
                                  "kw long, code long")
    words = written(heavy.join(codes, "kw", "left").select(
        F.coalesce("code", _outside_code(F.col("kw"))).alias("code"), "lang", "word", F.col("c").alias("f1")), "phrase-codes")
    grams = written(gram_counts(_paths(docs, text, group, keys, complete), least), "phrase-grams")
    kept = _scored(grams, words).join(_largest_container(grams), "g", "left")
    kept = kept.where(F.expr(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {contained} * cast(a as decimal(20, 0))"))
    spelled = kept.select("g", "a", "l", "r", "score", F.posexplode("g").alias("at", "code")).join(words.drop("f1"), "code")
    spelled = spelled.groupBy("g", "a", "l", "r", "score").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    totals = vocab.groupBy("lang").agg(F.sum("c").alias("n"))
    return spelled.join(totals, "lang").select("lang", F.array_join(F.col("w")["word"], " ").alias("phrase"), "a", "l", "r", "n", "score")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their rank; parts of a language are ranked first."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    part = Win.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = phrases.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    whole = few.withColumn("rank", F.row_number().over(Win.partitionBy("lang").orderBy(*order)).cast("long"))
    return whole.where(F.col("rank") <= top)


SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
o as (select lang, w, unnest(range(len(w))) as i from w where len(w) > 0),
g as (select lang, w[i + 1:i + m] as g, count(*) as f from o, (values (1), (2), (3), (4)) t(m) where i + m <= len(w) group by all),
n as (select lang, sum(f)::bigint as n from g where len(g) = 1 group by lang),
h as (select lang, g, f, array_to_string(g, ' ') as s from g where f >= 30),
c as (select * from h where len(g) > 1),
k as (select c.lang, c.g, c.s, c.f as a, k, l.f as l, r.f as r, 2000000::hugeint * c.f // (l.f + r.f) as score
  from c, (values (1), (2), (3)) t(k), h l, h r
  where k < len(c.g) and l.lang = c.lang and l.g = c.g[1:k] and r.lang = c.lang and r.g = c.g[k + 1:]),
b as (select *, row_number() over (partition by lang, g order by score, k) as best from k),
x as (select lang, g[j:j + m - 1] as g, max(f) as longer from c, (values (2), (3)) t(m), (values (1), (2), (3)) u(j)
  where m < len(g) and j + m - 1 <= len(g) group by all),
z as (select b.lang, b.s as phrase, a, l, r, n.n, score from b join n on n.lang = b.lang
  left join x on x.lang = b.lang and x.g = b.g where best = 1 and (longer is null or 100 * longer::hugeint < 80 * a::hugeint)),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from q where rank <= 2000"""


@register("op12_phrase_graph", SQL)
def op12_phrase_graph(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return ranked(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
