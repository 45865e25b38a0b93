"""Working folder on shared storage, for written tables that cut lineage."""
import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: dict = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    A machine-local temporary folder serves only where the executors run on this
    machine too, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="advislake-")  # tests: the executors run in this process
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/advislake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_given_back(spark: SparkSession):
    """Shuffle files of a table that is written in this block go as soon as it stands.

    Otherwise they stay until the driver happens to collect its garbage, beside those of all later steps.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def is_stored(spark: SparkSession, sf: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf, name) in _STORED


def stored(spark: SparkSession, sf: str, name: str, build, rows_per_file: int = 10_000) -> DataFrame:
    """``build(spark, sf)`` written once per application as Parquet, then read back.

    The written files survive executor loss, and readers prune columns and push
    filters into them. A file holds ``rows_per_file`` rows at most, so readers share the work.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        digest = hashlib.sha256(sf.encode()).hexdigest()[:8]
        path = fresh_path(spark, f"{name}-{digest}")
        table = build(spark, sf)
        with shuffle_given_back(spark):
            table.write.options(maxRecordsPerFile=rows_per_file, compression="zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
