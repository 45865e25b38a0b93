"""Substring dedup by seed and extend: winnowed anchors are joined and groups of matches grow both ways.

Every window of ``window`` words has one seed: the SEED-word run of smallest hash in it (the first of
equal ones). The seed depends on the window's words alone, so equal windows have equal seeds, and only
occurrences of one seed need comparing. The windows that share one seed occurrence follow each other;
together they are its stretch, the seed grown as far as it stays the smallest on both sides.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.components import written
from advislake.llm.registry import register

SEED = 8
MOST_WINDOWS = 62  # windows of one seed fit the bits of a long


def _sliding_first_min(g: np.ndarray, size: int) -> np.ndarray:
    """Place of the first smallest value in each run of ``size`` values."""
    value, place, width = g, np.arange(len(g)), 1

    def merge(value, place, step):
        n = len(value) - step
        right = value[step:] < value[:n]
        return np.where(right, value[step:], value[:n]), np.where(right, place[step:], place[:n])

    while 2 * width <= size:
        value, place = merge(value, place, width)
        width *= 2
    if width < size:
        value, place = merge(value, place, size - width)
    return place


def _stretches(h: np.ndarray, row: np.ndarray, window: int):
    """Seed hash, stretch hash, row, first window and number of windows of each seed occurrence."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    g = W.windows_hash(h, SEED)
    seed = _sliding_first_min(g, window - SEED + 1)[:n]
    ok = np.flatnonzero(row[window - 1:] == row[:n])
    if not len(ok):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    at = seed[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(ok)))
    first, at = ok[begin], at[begin]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * W.powers(W.BASE, len(h)))])
    stop = first + count + window - 1
    whole = (sums[stop] - sums[first]) * W.powers(W.INVERSE, len(h) + 1)[first]
    whole = W.mix(whole + (stop - first).astype(np.uint64)) + (at - first).astype(np.uint64)
    return g[at], whole, row[first], first, count


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """seed, stretch, doc_id, tkey and pos (first window << 6 | windows) of each seed occurrence."""
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("stretch", T.LongType()),
                           docs.schema["doc_id"], T.StructField("tkey", T.LongType()),
                           T.StructField("pos", T.LongType())])

    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, "text"))
            for low, high in W.blocks(at):
                w = W.Words(data, at, low, high)
                seed, whole, row, first, count = _stretches(w.hashes(), w.row, window)
                pos = ((first - w.first[row]) << 6) | count
                take = pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("doc_id").take(take),
                     batch.column("tkey").take(take), pa.array(pos)], names=schema.names)

    return docs.select("doc_id", "tkey", "text").mapInArrow(run, schema)


def _window_rows(texts: DataFrame, window: int) -> DataFrame:
    """A row for each window of the listed stretches: window hash, seed, stretch, offset and weight."""
    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, "text"))
            lists = batch.column("stretches")
            cut = lists.offsets.to_numpy()
            flat = lists.values
            fields = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("seed", "stretch", "pos", "n")}
            for low, high in W.blocks(at):
                w = W.Words(data, at, low, high)
                keys = W.windows_hash(w.hashes(), window)
                span = slice(cut[low], cut[high])
                owner = np.repeat(np.arange(high - low), np.diff(cut[low:high + 1]))
                count = fields["pos"][span] & 63
                first = (fields["pos"][span] >> 6) + w.first[owner]
                which = np.repeat(np.arange(len(count)), count)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first[which] + offset].view(np.int64)), pa.array(fields["seed"][span][which]),
                     pa.array(fields["stretch"][span][which]), pa.array(offset.astype(np.int32)),
                     pa.array(fields["n"][span][which])], names=["window", "seed", "stretch", "offset", "n"])

    return texts.mapInArrow(run, "window long, seed long, stretch long, offset int, n long")


def _cover(lists: pa.ListArray, low: int, high: int, w: W.Words, window: int) -> np.ndarray:
    """Marks of the words that repeated windows cover, for the rows of a block."""
    cut = lists.offsets.to_numpy()
    span = slice(cut[low], cut[high])
    pos, mask = (lists.values.field(n).to_numpy(zero_copy_only=False)[span].astype(np.int64) for n in ("pos", "mask"))
    owner = np.repeat(np.arange(high - low), np.diff(cut[low:high + 1]))
    starts = []
    base = (pos >> 6) + w.first[owner]
    for bit in range(int((pos & 63).max()) if len(pos) else 0):
        starts.append(base[(mask >> bit) & 1 > 0] + bit)
    return W.covered(np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64), window, len(w.start))


def repeated_marks(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tkey and marks (pos, mask) of the documents that have repeated windows.

    Seeds that occur once are done. Where all stretches of a seed are equal, the match grows to the whole
    stretch in one step. Else one occurrence of each distinct stretch is grown word by word: its windows
    are counted, each with the number of occurrences of its stretch, and those counted twice are repeats.
    """
    seeds = _seeds(docs, window)
    groups = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    # written, so that the join's own shuffle can split a seed that many documents share
    groups = written(groups.where("n > 1").select("seed", (F.col("low") == F.col("high")).alias("whole")), "repeat-groups")
    found = written(seeds.join(groups, "seed"), "repeat-seeds")
    split = found.where("not whole").groupBy("seed", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tkey", "pos")).alias("one"))
    listed = split.groupBy(F.col("one.doc_id").alias("d"), F.col("one.tkey").alias("t")).agg(
        F.collect_list(F.struct("seed", "stretch", F.col("one.pos").alias("pos"), "n")).alias("stretches"))
    texts = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))) \
        .select("text", "stretches")
    windows = written(_window_rows(texts, window), "repeat-windows")
    again = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    masks = windows.join(again, "window").groupBy("seed", "stretch").agg(
        F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    full = F.expr("shiftleft(1L, cast(pos & 63 as int)) - 1")
    marks = found.where("whole").select("doc_id", "tkey", "pos", full.alias("mask")).union(
        found.where("not whole").join(masks, ["seed", "stretch"]).select("doc_id", "tkey", "pos", "mask"))
    return marks.distinct().groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(
        F.collect_list(F.struct("pos", "mask")).alias("marks"))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256, removed_spans and, if asked for, ``clean_text``.

    A word goes if a run of ``window`` words that covers it also starts elsewhere, in the same document or
    another; runs are judged on the input. ``removed_spans`` are the maximal repeats as [first, last] word
    numbers. ``clean_text`` is the text without those words and the spaces behind them, unchanged where
    nothing goes. kept_sha256 is of the kept words joined by one space.

    Documents are matched by doc_id and a hash of the text, so null and repeated ids are fine; repeated
    rows repeat each other's words. Null, empty and shorter texts lose nothing; null text stays null. Other
    columns pass through; columns named as added ones are replaced.
    """
    if window - SEED + 1 > MOST_WINDOWS or window < SEED:
        raise ValueError(f"window must be {SEED}..{MOST_WINDOWS + SEED - 1} words")
    added = {"n_words", "n_removed", "kept_sha256", "removed_spans", "clean_text"}
    docs = docs.select(*[c for c in docs.columns if c not in added])
    keyed = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("tkey"))
    marks = repeated_marks(keyed, window)
    whole = docs.select(F.struct(*docs.columns).alias("row") if with_text else F.struct("doc_id").alias("row"),
                        F.col("doc_id").alias("key_id"), F.col(text).alias("key_text"), F.xxhash64(text).alias("key_hash"))
    joined = whole.join(marks, F.col("key_id").eqNullSafe(F.col("d")) & (F.col("key_hash") == F.col("t")), "left") \
        .select("row", "key_text", "marks")
    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
                           T.StructField("clean_text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("key_text")
            data, at = W.text_bytes(W.column(batch, "key_text"))
            lists = batch.column("marks")
            lists = lists if not lists.null_count else pa.concat_arrays([lists.fill_null([])])
            for low, high in W.blocks(at):
                w = W.Words(data, at, low, high)
                gone = _cover(lists, low, high, w, window)
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[w.first[1:]] - lost[w.first[:-1]]
                digests, spans, clean = [], [], []
                for i in range(high - low):
                    a, b = w.first[i], w.first[i + 1]
                    raw = data[at[low + i]:at[low + i + 1]].tobytes()
                    if not removed[i]:
                        digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                        spans.append([])
                        clean.append(raw.decode() if with_text and texts[low + i].is_valid else None)
                        continue
                    kept = [data[w.start[j]:w.end[j]].tobytes() for j in a + np.flatnonzero(~gone[a:b])]
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    step = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                    spans.append(np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1], 1).tolist())
                    if with_text:
                        ends = np.append(w.start[a + 1:b], at[low + i + 1])
                        clean.append(b"".join(data[w.start[j]:ends[j - a]].tobytes()
                                              for j in a + np.flatnonzero(~gone[a:b])).decode())
                    else:
                        clean.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(low, high - low), pa.array(w.count.astype(np.int64)),
                     pa.array(removed.astype(np.int64)), pa.array(digests, pa.string()),
                     pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(clean, pa.string())], names=schema.names)

    out = joined.mapInArrow(run, schema)
    last = ["n_words", "n_removed", "kept_sha256", "removed_spans"] + ["clean_text"] * with_text
    return out.select("row.*", *last)


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, p, array_to_string(ws[p:p+34], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as p from w where len(ws) >= 35)),
r as (select doc_id, p from (select doc_id, p, count(*) over (partition by g) as c from g) where c > 1),
c as (select distinct doc_id, unnest(range(p, p + 35)) as q from r),
n as (select doc_id, list(q) as qs from c group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(qs), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string([ws[i] for i in range(1, len(ws) + 1) if not list_contains(coalesce(qs, []), i)], ' '), '')) as kept_sha256
from w left join n using (doc_id)"""


@register("op3_substring_dedup", SQL)
def op3_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, window=35, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
