"""Near-duplicate documents by min-max hashing: both ends of every permutation go into the bands."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.components import connected, forest, written
from advislake.llm.registry import register

BANDS = 48
PERMUTATIONS_A_BAND = 3  # 6 values a band: a pair of similarity s is missed with (1 - s**6)**48, 5e-7 at 0.8
TILE_ROWS = 256
COLUMNS = 4096
_RANDOM = np.random.RandomState(60606)
FLIPS, FACTORS = (_RANDOM.randint(0, 1 << 62, (BANDS, PERMUTATIONS_A_BAND)).astype(np.uint64) * np.uint64(4)
                  + np.uint64(k) for k in (3, 1))


def shingle_sets(data, at, low, high, size: int, fold: bool = True):
    """Distinct shingle hashes of the rows of a block, row after row, and the n + 1 first places."""
    w = W.Words(data, at, low, high)
    h = w.hashes(fold)
    runs, ok = W.windows_hash(h, size), W.windows_valid(w.row, size)
    place = np.flatnonzero(ok)
    row, value = w.row[place], runs[place]
    short = np.flatnonzero((w.count > 0) & (w.count < size))  # the whole sequence is one shingle
    if len(short):
        extra = np.array([int(W.mix(np.add.reduce(W.mix(h[w.first[i]:w.first[i + 1]] + np.arange(w.count[i], dtype=np.uint64)), dtype=np.uint64, keepdims=True))[0])
                          for i in short], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, extra])
    bits = np.uint64(max(1, int(high - low).bit_length()))
    order = np.argsort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits), kind="stable")
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(high - low + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class (hash of the set) and band keys of each non-empty set."""
    starts = first[:-1][first[1:] > first[:-1]]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64)
    whole = W.mix(np.add.reduceat(W.mix(values ^ W.BASE), starts))
    bands = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for k in range(PERMUTATIONS_A_BAND):
            v = (values ^ FLIPS[b, k]) * FACTORS[b, k]
            key = W.mix(key * W.BASE + np.minimum.reduceat(v, starts))
            key = W.mix(key * W.BASE + np.maximum.reduceat(v, starts))
        bands[:, b] = key
    return whole, bands


def _signed(docs: DataFrame, text: str, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class and bands of every row; class and bands are null for an empty set."""
    docs = docs.select("doc_id", text, F.xxhash64(text).alias("text_key"))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_key"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("class", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, text))
            for low, high in W.blocks(at):
                values, first = shingle_sets(data, at, low, high, size)
                n = np.diff(first)
                whole, bands = signatures(values, first)
                full = n > 0
                classes = np.zeros(len(n), np.uint64)
                classes[full] = whole
                flat = pa.array(bands.view(np.int64).ravel())
                offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("text_key").slice(low, high - low),
                     pa.array(n.astype(np.int64)), pa.array(classes.view(np.int64), mask=~full),
                     pa.ListArray.from_arrays(pa.array(offsets), flat)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity.

    Every pair takes the text of its a by one join and meets the text of its b by another, so a class
    that many others are held against is moved once.
    """
    left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("b_text")), "b")

    def run(batches):
        for batch in batches:
            a_side, (b_data, b_at) = (W.text_bytes(W.column(batch, n)) for n in ("a_text", "b_text"))
            linked, last, known = np.zeros(batch.num_rows, bool), None, None
            for low, high in W.blocks(a_side[1]):
                values, first = shingle_sets(*a_side, low, high, size)
                for i in range(low, high):
                    raw = b_data[b_at[i]:b_at[i + 1]].tobytes()
                    if raw != last:  # rows of one b come together
                        last, known = raw, shingle_sets(b_data, b_at, i, i + 1, size)[0]
                    own = values[first[i - low]:first[i - low + 1]]
                    both = np.sort(np.concatenate([own, known]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    linked[i] = 100 * common >= percent * (len(own) + len(known) - common)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(linked)) for n in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def _common_counts(a: list, b: list) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of COLUMNS shingles at a time."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for sets in (a, b):
        row, value = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, value), max(len(shared) - 1, 0))
        hit = shared[at] == value if len(shared) else np.zeros(len(value), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order]))
    for low in range(0, len(shared), COLUMNS):
        parts = []
        for sets, (row, at) in zip((a, b), sides, strict=True):
            span = slice(*np.searchsorted(at, [low, low + COLUMNS]))
            dense = np.zeros((len(sets), COLUMNS), np.float32)
            dense[row[span], at[span] - low] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _between_tiles(asking: pa.Table, others: pa.Table, size: int, percent: int) -> pa.Table:
    """A spanning forest of the links between two tiles of one hub's classes."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not asking.num_rows or not others.num_rows:
        return kind.empty_table()
    sides = []
    for table in (asking, others):
        table = table.combine_chunks()
        text = table.column("text").combine_chunks()
        data, at = W.text_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        values, first = shingle_sets(data, at, 0, table.num_rows, size)
        sides.append((table.column("class").to_numpy(), [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]))
    (a_class, a), (b_class, b) = sides
    common = _common_counts(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - common
    p, q = np.nonzero((100 * common >= percent * union) & (a_class[:, None] != b_class))
    nodes = np.concatenate([a_class, b_class])
    label = forest(nodes, p, q + len(a_class))
    moved = label != nodes
    return pa.table([nodes[moved], label[moved]], schema=kind)


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (hash of the text) and root (the component) of every row.

    Rows of equal shingle sets form a class, and classes are compared, so copies cost nothing more. Each
    bucket of a band first holds its members against its hub, the member that meets the most others over
    all bands; confirmed links give components. Two members of a bucket share its hub. So where a hub's
    classes fall into several components, those outside the largest one are compared with all classes of
    the hub, in tiles of about TILE_ROWS that give a spanning forest and never their pairs. Then every
    pair that a band proposes is compared or inside one component.

    Texts of fewer words than ``size`` are one shingle; null, empty and blank texts are empty sets, linked
    with nothing, and kept. Repeated doc_ids are told apart by their sets. A null doc_id takes part and is
    kept only if its whole component has no other id. Extra columns are ignored.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    signed = written(_signed(docs, "text", size), "minmax-signatures")
    classes = signed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("one"))
    spread = signed.where("class is not null").select(F.explode("bands").alias("key"), "class")
    buckets = spread.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"))
    members = written(spread.join(buckets.where("low < high").select("key", "n"), "key").distinct(), "minmax-buckets")
    weight = members.groupBy("class").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "class").groupBy("key").agg(F.max(F.struct("weight", "class"))["class"].alias("hub"))
    pairs = written(members.join(hubs, "key").where("class <> hub").select(
        F.col("class").alias("a"), F.col("hub").alias("b")).distinct(), "minmax-pairs")
    named = members.select("class").distinct().join(classes, "class").select("class", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("id_key"))
    texts = written(_texts_of(docs, named, size), "minmax-texts")
    links = written(_verified(pairs, texts, size, percent), "minmax-links")
    roots = connected(links)
    found = written(_open_links(pairs, roots, texts, size, percent), "minmax-open")
    if not found.isEmpty():
        roots = connected(links.union(found))
    labelled = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left") \
        .withColumn("root", F.coalesce("root", "class"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = labelled.join(least, "root").select(F.col("class").alias("of"), "component_id", "root")
    out = signed.select("doc_id", "text_key", "n_shingles", "class").join(of_class, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", "root")


def _open_links(pairs: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the classes of hubs whose classes are in several components so far."""
    group = pairs.select(F.col("b").alias("hub"), F.col("a").alias("class")) \
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    parts = group.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    tiles = lambda n: F.ceil(n / TILE_ROWS).cast("int")
    largest = F.max(F.struct("n", "root"))
    split = parts.groupBy("hub").agg(largest.alias("s"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = split.select("hub", F.col("s.root").alias("largest"), tiles(F.col("all") - F.col("s.n")).alias("rows"),
                         tiles(F.col("all")).alias("columns"))
    open_ = written(group.join(split, "hub").select("hub", "class", (F.col("root") != F.col("largest")).alias("asks"), "rows", "columns"),
                    "minmax-open-classes")
    full = open_.join(texts, "class")
    deal = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = full.where("asks").select("hub", deal("rows").alias("i"), every("columns").alias("j"), "class", "text")
    others = full.select("hub", every("rows").alias("i"), deal("columns").alias("j"), "class", "text")
    asking, others = asking.toDF("hub", "i", "j", "class", "text"), others.toDF("hub2", "i2", "j2", "class", "text")

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        return _between_tiles(one, other, size, percent)

    return asking.groupBy("hub", "i", "j").cogroup(others.groupBy("hub2", "i2", "j2")).applyInArrow(compare, "a long, b long")


def _texts_of(docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(class, text) of each named class, from one document of it.

    Rows are met by id and hash of the text together, so many texts of one id, or without ids, meet their
    own class only; what the text gives is compared with the class all the same.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = keyed.join(named.select("id", "id_key", "class"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("id_key"))) \
        .select("class", "text")

    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, "text"))
            want = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for low, high in W.blocks(at):
                values, first = shingle_sets(data, at, low, high, size)
                full = np.diff(first) > 0
                starts = first[:-1][full]
                got = np.zeros(high - low, np.uint64)
                if len(starts):
                    got[full] = W.mix(np.add.reduceat(W.mix(values ^ W.BASE), starts))
                yield batch.slice(low, high - low).filter(pa.array(full & (got == want[low:high])))

    return found.mapInArrow(run, found.schema).dropDuplicates(["class"])


SQL = r"""
with recursive d as (select doc_id, [x for x in regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')] as ws from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
  else [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] end) as g from d)),
n as (select d.doc_id, count(g) as n from d left join s on s.doc_id = d.doc_id group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
reach(id, r) as (select doc_id, doc_id from n union select reach.id, e.b from reach join e on e.a = reach.r),
m as (select id, min(r) as component_id from reach group by 1)
select n.doc_id, n.n as n_shingles, m.component_id, m.component_id = n.doc_id as kept from n join m on m.id = n.doc_id"""


@register("op6_minmax_dedup", SQL)
def op6_minmax_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
