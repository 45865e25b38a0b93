"""Near-duplicate vectors by PCA-ordered tiled comparison with suffix-norm bounds.

Unit vectors are rotated to their principal axes, so that the leading coordinates carry most of a product.
Two tiles of vectors are compared coordinate group by coordinate group: the products so far plus the
product of the norms of what is left (Cauchy-Schwarz) bound the cosine from above, and a pair is given up
as soon as that bound is under the threshold. The rest are confirmed on the vectors as they came.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advislake.llm.components import connected, forest, written
from advislake.llm.registry import register

TILE_ROWS = 2048  # rows that are compared at a time
BLOCK_BYTES = 32 << 20  # of the doubles of a block; blocks are what is shuffled, tile by tile they are compared
SHIPS = 4  # times that a block is shuffled in one round, on an average; shuffle files go after each round
MOST_CELLS = 1000  # along the first axis
GROUPS = (0.25, 0.5)  # shares of the coordinates after which pairs are given up
PART = 200_000  # pairs that are finished at a time
SLACK = 1e-9
SLACK32 = 1e-6  # for each coordinate of a first look in single precision


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros to ``size``."""
    cut = col.offsets.to_numpy()
    n = np.diff(cut)
    out = np.zeros((len(col), size))
    flat = col.values.to_numpy(zero_copy_only=False)[cut[0]:cut[-1]]
    out[np.repeat(np.arange(len(col)), n), np.arange(len(flat)) - np.repeat(cut[:-1] - cut[0], n)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # a large scale must not overflow the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Columns are the axes of the second moments of the unit vectors, largest first.

    Each task gives one matrix of size x size sums, added up by coordinate before they come to the driver.
    """
    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            u = _unit(_matrix(batch.column("v"), size))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["k", "s"])

    rows = vectors.select("v").mapInArrow(moments, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(size * size)
    for k, s in rows:
        total[k] = s
    return np.linalg.eigh(total.reshape(size, size))[1][:, ::-1]


def _rest(rotated: np.ndarray, stop: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (rotated[:, stop:] ** 2).sum(1)))


class _Side:
    """Vectors of a tile: unit, rotated, and in single precision the first coordinates with the norm of what is left."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.unit = _unit(x)
        self.rotated = self.unit @ axes
        size = self.rotated.shape[1]
        self.cuts = [max(1, int(size * g)) for g in GROUPS] + [size]
        first = self.cuts[0]
        self.first = np.column_stack([self.rotated[:, :first], _rest(self.rotated, first)]).astype(np.float32)
        self.low, self.high = self.rotated.min(0), self.rotated.max(0)

    def apart(self, other: _Side, threshold: float) -> bool:
        """Whether the boxes of two tiles are farther apart than two vectors within the threshold can be."""
        gap = np.maximum(0.0, np.maximum(self.low - other.high, other.low - self.high))
        return (gap ** 2).sum() > 2 - 2 * threshold + SLACK


def _pairs(a: _Side, b: _Side, threshold: float):
    """Places (i, j) of the rows of two tiles whose cosine reaches the threshold."""
    i, j = np.nonzero(a.first @ b.first.T >= np.float32(threshold - SLACK32 * (a.cuts[0] + 2)))
    found = []
    for low in range(0, len(i), PART):
        p, q = i[low:low + PART], j[low:low + PART]
        so_far, start = np.zeros(len(p)), 0
        for stop in a.cuts:
            so_far = so_far + np.einsum("ij,ij->i", a.rotated[p, start:stop], b.rotated[q, start:stop])
            keep = so_far + _rest(a.rotated, stop)[p] * _rest(b.rotated, stop)[q] >= threshold - SLACK
            p, q, so_far, start = p[keep], q[keep], so_far[keep], stop
        keep = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= threshold
        found.append((p[keep], q[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _close(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float):
    """Places (i, j) of the rows of a and b whose cosine reaches the threshold."""
    return _pairs(_Side(a, axes), _Side(b, axes), threshold)


def _tiles(x: np.ndarray, axes: np.ndarray) -> list[tuple[np.ndarray, _Side]]:
    """Rows of a block in tiles of near vectors: halved along the axis on which they spread most."""
    rotated = (_unit(x) @ axes).astype(np.float32)

    def halved(rows):
        if len(rows) <= TILE_ROWS:
            return [rows]
        widest = rotated[rows].var(0).argmax()
        half = len(rows) // 2
        order = np.argpartition(rotated[rows, widest], half)
        return halved(rows[order[:half]]) + halved(rows[order[half:]])

    return [(rows, _Side(x[rows], axes)) for rows in halved(np.arange(len(x)))]


def _block_links(left: pa.Table, right: pa.Table, size: int, axes: np.ndarray, threshold: float) -> pa.Table:
    """For the vectors of a pair of blocks: links counted with the copies of the other end, and a reached root.

    The links of a pair of tiles are counted and reduced to a spanning forest before the next one is compared.
    """
    out = {"cid": pa.int64(), "links": pa.int64(), "root": pa.int64()}
    if not left.num_rows or not right.num_rows:
        return pa.table({k: pa.array([], t) for k, t in out.items()})
    same = left.column("block")[0].as_py() == right.column("block")[0].as_py()
    sides = [(t.column("cid").to_numpy(), t.column("copies").to_numpy(),
              _tiles(_matrix(t.column("v").combine_chunks(), size), axes)) for t in ((left,) if same else (left, right))]
    nodes = np.concatenate([ids for ids, _, _ in sides])
    copies = np.concatenate([n for _, n, _ in sides])
    mine = sides[0][2]
    others = mine if same else [(rows + len(sides[0][0]), side) for rows, side in sides[1][2]]
    links, ends = np.zeros(len(nodes), np.int64), [(np.zeros(0, np.int64),) * 2]
    for k, (a_rows, a) in enumerate(mine):
        for b_rows, b in others[k:] if same else others:
            if a.apart(b, threshold):
                continue
            i, j = _pairs(a, b, threshold)
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                p, q = a_rows[i], b_rows[j]
                links += np.bincount(p, copies[q], len(nodes)).astype(np.int64) + np.bincount(q, copies[p], len(nodes)).astype(np.int64)
                met = np.unique(np.concatenate([p, q]))
                root = forest(met, np.searchsorted(met, p), np.searchsorted(met, q))
                ends.append((met[met != root], root[met != root]))
    p, q = (np.concatenate(e) for e in zip(*ends, strict=True))
    label = forest(nodes, p, q)
    linked = links > 0
    return pa.table({"cid": nodes[linked].astype(np.int64), "links": links[linked], "root": label[linked].astype(np.int64)})


def near_vectors(rows: DataFrame, vector: str = "embedding", vector_id: str = "vec_id", threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors form a class that is compared once and counts as often as it occurs. Classes are dealt to
    cells along the first principal axis, as wide as two vectors within the threshold can be apart there;
    cells are split by a hash into blocks of about BLOCK_BYTES, and each block meets those of its own and of the
    next cell, tile by tile of near vectors. A pair of blocks gives counts and a spanning forest, never its links,
    so a dense group of n vectors costs comparisons but no n * n rows. That all blocks of near cells meet is the
    cost of exact answers: work grows with the square of the rows of near cells. Disk does not: pairs of blocks
    go in rounds, in each of which a block is shuffled SHIPS times, and each round's shuffle is given back.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
    shorter vectors count as padded with zeros. Repeated ids keep one row each; a null id takes part, and
    is kept only where its component has no other id. Other columns and labels are ignored.
    """
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"  # single precision needs half the room
    given = rows.select(F.col(vector_id).alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    good = given.where(F.coalesce(usable, F.lit(False)))
    classes = written(good.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                      .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    size = classes.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    axes = principal_axes(classes, size)
    # |x - y|**2 = 2 - 2 cos bounds the gap on any axis
    width = max(np.sqrt(2 - 2 * threshold) + SLACK, 2 / MOST_CELLS)

    def cells(batches):
        for batch in batches:
            first = _unit(_matrix(batch.column("v"), size)) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.floor(first / width).astype(np.int64))],
                                             names=["cid", "copies", "v", "cell"])

    placed = classes.select("cid", "copies", "v").mapInArrow(cells, f"cid long, copies long, v {kind}, cell long")
    most = max(TILE_ROWS, BLOCK_BYTES // (8 * size))
    splits = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("splits")), "vector-cells")
    block_of = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("cid"), F.col("splits"))
    placed = placed.join(F.broadcast(splits), "cell").withColumn("block", block_of)  # MOST_CELLS + 2 rows at most
    blocks = splits.select("cell", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("k")) \
        .select("cell", (F.col("cell") * (1 << 32) + F.col("k")).alias("block"))
    near = blocks.select(F.col("block").alias("a"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = written(near.join(blocks.withColumnRenamed("block", "b"), "cell").where("a <= b").select("a", "b"), "vector-blocks")
    names = ["a", "b", "block", "cid", "copies", "v"]

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        return _block_links(one.rename_columns(names), other.rename_columns(names), size, axes, threshold)

    def linked(some: DataFrame) -> DataFrame:
        left, right = (some.join(placed, F.col(side) == F.col("block")).select(*names).toDF(*[f"{side}_{n}" for n in names])
                       for side in ("a", "b"))
        return left.groupBy("a_a", "a_b").cogroup(right.groupBy("b_a", "b_b")).applyInArrow(
            compare, "cid long, links long, root long")

    rounds = max(1, -(-2 * pairs.count() // (SHIPS * blocks.count())))
    found = None
    for k in range(rounds):
        part = written(linked(pairs.where(F.pmod(F.col("a") + F.col("b"), F.lit(rounds)) == k)), "vector-links")
        found = part if found is None else found.union(part)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("cid", "v", "first_id", "copies") \
        .join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("root", F.coalesce("root", "cid"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("least"))
    labelled = labelled.join(least, "root").select(
        F.col("v").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "least")
    out = given.join(labelled, F.col("v") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
n as (select a, count(*) as n from l group by 1),
reach(id, r) as (select distinct a, a from l union select reach.id, l.b from reach join l on l.a = reach.r),
m as (select id, min(r) as component_id from reach group by 1)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(m.component_id, vec_id) as component_id,
  coalesce(m.component_id, vec_id) = vec_id as kept
from embeddings left join n on n.a = vec_id left join m on m.id = vec_id"""


@register("op8_embedding_dedup", SQL)
def op8_embedding_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
