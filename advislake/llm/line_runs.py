"""Line dedup with DataFrame functions only: levelled sorted runs of line hashes.

Documents come in batches of falling ids. A run is a bucketed, sorted table of line hashes with the
number of documents that hold them and the largest of their ids. A batch's own hashes are merge-anti-joined
with the runs, which leaves out every hash that is settled there, and the rest becomes a run of level 0;
``fanout`` runs of a level are compacted into one of the next.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advislake.llm.components import written
from advislake.llm.registry import register
from advislake.sources.scratch import fresh_path

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 20, 3, 8, 4


class LineRuns:
    """Runs of (h, n, top): a line hash, documents counted for it, their largest id.

    Batches must come in falling order of ids, equal ids together. A hash with ``least`` documents in one
    run is settled: its ``top`` is final, as later batches hold smaller ids only, and later batches leave it
    out. Runs are external tables of the session's catalog with files in the shared folder; each has
    ``spark.sql.shuffle.partitions`` buckets, so a batch is shuffled once to meet all of them.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # name and path of each run

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, f"line-run-{level}")
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._drop(full)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Sums of the runs. Their files are read by path: over a union of bucketed tables Spark 4.1.2 takes
        the buckets of each for those of all and leaves out the exchange, so equal hashes stay apart."""
        rows = self.spark.read.schema("h binary, n long, top long").parquet(*[path for _, path in runs])
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (h, doc_id), one row for each document and hash."""
        own = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        for run in self.tables():
            own = own.join(run.where(F.col("n") >= self.least).select("h"), "h", "left_anti")
        self._write(own, 0)

    def settled(self) -> DataFrame:
        """(h, top) of the hashes that at least ``least`` documents hold."""
        return self._merged([run for level in self.levels for run in level]).where(F.col("n") >= self.least).select("h", "top")

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"drop table if exists {name}")

    def close(self) -> None:
        """Takes the runs out of the catalog."""
        self._drop([run for level in self.levels for run in level])
        self.levels = []


def line_keys(text: Column, least_chars: int) -> Column:
    """(h, pos) of each line of at least ``least_chars`` code points, stripped and with A-Z lower-cased."""
    lines = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    keys = F.transform(lines, lambda line, i: F.struct(F.btrim(line, F.lit(SPACES)).alias("k"), i.alias("pos")))
    keys = F.filter(keys, lambda x: F.char_length(x["k"]) >= least_chars)
    return F.transform(keys, lambda x: F.struct(F.unhex(F.md5(x["k"])).alias("h"), x["pos"].alias("pos")))


def _batched(docs: DataFrame, batches: int) -> DataFrame:
    """``docs`` with the number of their batch: falling ids, equal ids together, no id last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"] if shares else None
    number = sum((F.when(F.col("doc_id") > F.lit(c), 0).otherwise(1) for c in sorted(set(cuts or []))), F.lit(0))
    return docs.withColumn("batch", number)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS,
                least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, into: str = "lines") -> DataFrame:
    """All columns of ``docs`` and a struct ``into`` of n_lines, n_dropped and clean_text.

    A line's key is the line stripped of white space, A-Z lower-cased. Keys of ``least_chars`` code points
    and more that ``least_docs`` documents hold lose all their lines but those in the largest id; a key met
    twice in one document counts once. A document is a row: rows of one id count apart, and all rows of the
    largest id keep their lines. A null id is below every other, and rows without ids keep the lines that
    only they hold. Ids are integers. A null text is an empty one, which is one empty line. Hashes are
    MD5, 128 bits. A column named ``into`` is replaced; an empty table gives no rows. A line of a third of
    all documents is counted before the shuffle and meets its documents in a join that can be split.
    """
    spark = docs.sparkSession
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != into])
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    slim = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tkey"))
    lines = _batched(slim, batches).select("batch", "doc_id", "tkey", F.sort_array(line_keys(F.col("text"), least_chars)).alias("keys"))
    first = F.transform("keys", lambda x, i: F.struct(
        x["h"].alias("h"), x["pos"].alias("pos"), ((i == 0) | (F.get("keys", i - 1)["h"] != x["h"])).alias("first")))
    lines = lines.select("batch", "doc_id", "tkey", F.inline(first))
    path = fresh_path(spark, "line-hashes")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, least_docs, fanout)
    for b in range(batches):
        runs.add(lines.where((F.col("batch") == b) & F.col("first")).select("h", "doc_id"))
    frequent = written(runs.settled(), "line-frequent")
    runs.close()
    marks = lines.select("doc_id", "tkey", "h", "pos").join(frequent, "h") \
        .where(~F.col("doc_id").eqNullSafe(F.col("top"))).groupBy(F.col("doc_id").alias("m_id"), F.col("tkey").alias("m_key")) \
        .agg(F.collect_list("pos").alias("dropped"))
    rows = docs.select(row.alias("row"), docs[f"`{key}`"].cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tkey"))
    rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tkey") == F.col("m_key")), "left")
    rows = rows.select("row", "text", "dropped", F.split("text", "\n", -1).alias("all"))
    n = F.size("all")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped"))
    rows = rows.select("row", "text", "all", n.cast("long").alias("n_lines"), F.when(F.col("dropped").isNotNull(), kept).alias("kept"))
    clean = F.when(F.col("kept").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get("all", i)), "\n"))
    left = F.when(F.col("kept").isNull(), F.col("n_lines")).otherwise(F.size("kept"))
    return rows.select("row.*", F.struct("n_lines", (F.col("n_lines") - left).cast("long").alias("n_dropped"),
                                         clean.alias("clean_text")).alias(into))


SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, f.key is not null and k.doc_id <> f.top as gone from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""


@register("op13_line_runs", SQL)
def op13_line_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines.n_lines", "lines.n_dropped",
                                    F.sha2(F.col("lines.clean_text").cast("binary"), 256).alias("kept_sha256"))
