"""Readers of vendor documents, feeds, sidecars, overlays and releases."""
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from advislake import schema
from advislake.functions import vocab
from advislake.functions.exprs import attach, struct_of, words
from advislake.functions.scalar import as_list, is_variant_object, text_value
from advislake.operators.search import is_synthetic

BAD = "_bad_line"


def _json_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return (spark.read.schema(f"{fields}, {BAD} string").option("columnNameOfCorruptRecord", BAD)
            .option("mode", "PERMISSIVE").json(path))


def _refuse(test: Column, message: str, shown: Column, value: Column) -> Column:
    """``value``, or a failed job where ``test`` holds."""
    kind = F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(shown, F.lit("")))).cast("string")
    return F.when(test, kind).otherwise(value)


def _refuse_rows(df: DataFrame, test: Column, message: str, shown: Column) -> DataFrame:
    """``df``, or a failed job where ``test`` holds, whatever columns the plan reads.

    The test decides how often a row is generated, so pruning cannot leave it out.
    """
    fail = F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(shown, F.lit("")))).cast("array<int>")
    return df.select("*", F.explode(F.when(test, fail).otherwise(F.array(F.lit(1)))).alias("_sound")).drop("_sound")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisory JSONL with per-field defaults; a broken line fails the job and shows itself."""
    raw = _json_lines(spark, path, schema.RECORD_SCHEMA)
    # the reader fills the broken line only where another column is read with it
    broken = F.col(BAD).isNotNull() | F.col("cve").eqNullSafe("\u0000")
    raw = _refuse_rows(raw, broken, "invalid JSON line", F.col(BAD))
    text = lambda n, default: F.coalesce(F.nullif(n, F.lit("")), F.lit(default))
    none = lambda n: F.coalesce(n, F.array().cast(schema.RECORD_FIELDS[n]))
    unknown = F.lit("unknown")
    return raw.withColumns({
        "cve": text("cve", "UNKNOWN"),
        "schema_version": text("schema_version", "1.0"), "month": text("month", "unknown"),
        "title": text("title", "Untitled vulnerability"),
        "severity": F.when(F.col("severity").startswith("{"), F.from_json("severity", schema.SEVERITY)),
        "severity_basis": text("severity_basis", "absent"),
        "cvss": F.coalesce("cvss", F.struct(
            F.lit(None).cast("double").alias("base_score"), F.lit(None).cast("double").alias("temporal_score"),
            F.lit(None).cast("string").alias("vector"), unknown.alias("version"))),
        "products": none("products"), "tags": none("tags"), "product_tags": none("product_tags"),
        "mitigation_candidates": none("mitigation_candidates"),
        "attack": F.coalesce("attack", F.struct(unknown.alias("vector"), unknown.alias("privileges_required"),
                                                unknown.alias("user_interaction"))),
    }).drop(BAD)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are not valid records, as rows."""
    return (spark.read.text(path).where(F.trim("value") != "")
            .where(F.try_parse_json("value").isNull()).select(F.col("value").alias("line")))


def read_vendor_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Vendor documents: (doc_id, revision, tree VARIANT, vulnerabilities array<variant>).

    One document per line, or per file with ``multi_line``; a byte-order mark is fine.
    """
    names = ["Vulnerability", "Vulnerabilities", "vulnerabilities"]
    # keys that differ only by case cannot be struct fields, so the document is one VARIANT
    raw = spark.read.option("singleVariantColumn", "doc").option("multiLine", multi_line).json(path).select(
        "doc", F.col("_metadata.file_path").alias("_file"))
    get = lambda p: F.try_variant_get("doc", f"$.{p}", "variant")
    # the first list that is not empty; each is made once
    held = F.filter(F.array(*[as_list(F.col("doc"), f"$.{name}") for name in names]), lambda items: F.size(items) > 0)
    listed = F.coalesce(F.get(held, F.lit(0)), F.array().cast("array<variant>"))
    # behind a barrier, as the test for empty lists that an explode brings along would make each list thrice
    return attach(raw, struct_of(_listed=listed)).select(
        F.coalesce(F.nullif(text_value(get("DocumentTracking.ID")), F.lit("")), F.col("_file")).alias("doc_id"),
        text_value(get("DocumentTracking.CurrentReleaseDate")).alias("revision"),
        F.coalesce(get("ProductTree"), get("product_tree")).alias("tree"),
        F.col("_listed").alias("vulnerabilities"))


def vulnerability_rows(documents: DataFrame, *fields: str) -> DataFrame:
    """One row per vulnerability with typed notes, threats, score sets and remediations.

    With ``fields``, these of the typed columns; the others stand behind a barrier and would be made unread.
    """
    rows = documents.select("doc_id", "revision", F.explode("vulnerabilities").alias("v"))
    get = lambda p, kind="variant": F.try_variant_get("v", f"$.{p}", kind)
    of = lambda x, p, kind="string": F.try_variant_get(x, f"$.{p}", kind)
    objects = lambda p: F.filter(as_list(F.col("v"), f"$.{p}"), is_variant_object)
    strings = lambda x: F.transform(as_list(x), lambda e: F.try_variant_get(e, "$", "string"))
    cve = F.coalesce(get("CVE", "string"), get("cve", "string"), F.lit("UNKNOWN"))
    ids = F.flatten(F.transform(objects("ProductStatuses"), lambda s: F.concat(
        strings(of(s, "ProductID", "variant")), strings(of(s, "product_id", "variant")))))
    facts = dict(
        cve=cve,
        title=F.coalesce(F.nullif(text_value(get("Title")), F.lit("")), cve),
        notes=F.transform(objects("Notes"), lambda n: F.struct(
            of(n, "Title").alias("Title"), of(n, "Type", "int").alias("Type"),
            text_value(n).alias("Value"))),
        threats=F.transform(objects("Threats"), lambda t: F.struct(
            of(t, "Type").alias("Type"),
            text_value(of(t, "Description", "variant")).alias("Description"))),
        score_sets=F.transform(objects("CVSSScoreSets"), lambda s: F.struct(
            of(s, "BaseScore", "double").alias("BaseScore"),
            of(s, "TemporalScore", "double").alias("TemporalScore"),
            of(s, "Vector").alias("Vector"))),
        remediations=F.transform(objects("Remediations"), lambda r: F.struct(
            of(r, "Type").alias("Type"), of(r, "SubType").alias("SubType"), of(r, "URL").alias("URL"),
            text_value(of(r, "Description", "variant")).alias("Description"),
            strings(of(r, "ProductID", "variant")).alias("ProductID"))),
        product_ids=F.array_sort(F.array_distinct(ids)))
    # parsed once here, however often the columns are used or filtered later
    return attach(rows, struct_of(**{n: facts[n] for n in fields or facts})).withColumnRenamed("v", "raw")


def read_kev(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Distinct ids of the known-exploited catalogue."""
    raw = spark.read.schema("vulnerabilities array<struct<cveID:string>>").option(
        "multiLine", multi_line).json(path)
    return (raw.select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"))
            .where("cve <> ''").distinct())


def _file_order() -> Column:
    """Reading order: file, block inside the file, row inside the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id())


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """Score CSV (cve, epss, percentile, score_date); the last line of an id wins, with its file's date."""
    raw = (spark.read.option("header", True).option("comment", "#").csv(path)
           .withColumn("_at", _file_order()))
    percentile = (F.col("percentile").try_cast("double") if "percentile" in raw.columns
                  else F.lit(None).cast("double"))
    rows = raw.where("cve <> '' and epss <> ''")
    last = rows.groupBy("cve").agg(F.max_by(F.struct(
        F.col("epss").cast("double").alias("epss"), percentile.alias("percentile"),
        F.col("_at.file").alias("file")), "_at").alias("s"))
    dates = spark.read.text(path).where("value like '#%'").select(F.col("_metadata.file_path").alias("file"), F.nullif(
        F.substring(F.regexp_extract("value", r"score_date:([^,\s]+)", 1), 1, 10), F.lit("")).alias("d"))
    stamps = dates.groupBy("file").agg(F.max("d").alias("score_date"))
    return last.select("cve", "s.*").join(stamps, "file", "left").select("cve", "epss", "percentile", "score_date")


def read_overlay(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Overlay JSONL; a broken line or a line without an id fails; the last of an id wins."""
    raw = _json_lines(spark, path, fields).withColumn("_at", _file_order())
    named = raw.withColumn("cve", _refuse(
        F.col(BAD).isNotNull() | F.col("cve").isNull() | (F.col("cve") == ""),
        "overlay line is broken or has no cve", F.col(BAD), F.col("cve")))
    others = [c for c in raw.columns if c not in ("cve", BAD, "_at")]
    last = named.groupBy("cve").agg(F.max_by(F.struct(*others), "_at").alias("o"))
    return last.select("cve", "o.*")


def file_provenance(spark: SparkSession, path: str, base_url: str = "") -> DataFrame:
    """url, file, bytes and sha256 of every landed file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), F.concat(F.lit(base_url), name).alias("url"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def published_datasets(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest against the files present: rows (file, month, state).

    States: refresh, synthetic, no-file-named, missing-file, not-in-manifest.
    """
    entries = manifest.withColumn("file", F.nullif("file", F.lit("")))
    present = files.select(F.col("file").alias("_f")).distinct()
    joined = entries.join(present, F.col("file") == F.col("_f"), "full_outer")
    state = (F.when(F.col("month").isNull() & F.col("file").isNull(), "not-in-manifest")
             .when(F.col("file").isNull(), "no-file-named").when(is_synthetic(), "synthetic")
             .when(F.col("_f").isNull(), "missing-file").otherwise("refresh"))
    return joined.select(F.coalesce("file", "_f").alias("file"), "month", state.alias("state"))


# --- dimension files (small JSON documents) ------------------------------------------------
def _document(spark, path):
    return spark.read.option("multiLine", True).option("singleVariantColumn", "doc").json(path)


def read_scales(spark: SparkSession, path: str) -> DataFrame:
    """(scale, band, target); a target outside the vocabulary fails."""
    kind = "map<string,struct<bands:map<string,struct<maps_to:string>>>>"
    rows = (_document(spark, path).select(F.explode(F.try_variant_get("doc", "$.scales", kind)).alias("scale", "s"))
            .select("scale", F.explode("s.bands").alias("band", "e")))
    target = F.col("e.maps_to")
    bad = ~F.coalesce(F.array_contains(words(vocab.BANDS), target), F.lit(False))
    return rows.select("scale", "band", _refuse(bad, "band maps outside the vocabulary", F.concat(
        "scale", F.lit(":"), "band"), target).alias("target"))


MOST_RANGES = 1_000


def read_score_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(scale, low, high, band) of the numeric cut-offs of a scales file, closed at both ends.

    Refused: a band outside the vocabulary, a range without ends or with its ends swapped, ranges of one
    scale that overlap, and more than MOST_RANGES ranges, as they go along with every row. Gaps are allowed.
    """
    kind = "map<string,struct<ranges:array<struct<min:double,max:double,maps_to:string>>>>"
    rows = (_document(spark, path).select(F.explode(F.try_variant_get("doc", "$.scales", kind)).alias("scale", "s"))
            .select("scale", F.explode("s.ranges").alias("r"))
            .select("scale", F.col("r.min").alias("low"), F.col("r.max").alias("high"), F.col("r.maps_to").alias("band")))
    before = Window.partitionBy("scale").orderBy("low", "high")
    rows = rows.withColumns({"_end": F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                             "_n": F.row_number().over(before)})
    whole = F.coalesce((F.col("low") <= F.col("high")) & ~F.isnan("low") & ~F.isnan("high"), F.lit(False))
    bad = (F.when(~F.coalesce(F.array_contains(words(vocab.BANDS), F.col("band")), F.lit(False)), "band outside the vocabulary")
           .when(~whole, "range without proper ends").when(F.col("low") <= F.col("_end"), "overlapping ranges")
           .when(F.col("_n") > MOST_RANGES, "too many ranges"))
    named = F.concat("scale", F.lit(" "), F.coalesce(F.col("low").cast("string"), F.lit("?")))
    return _refuse_rows(rows, bad.isNotNull(), "score ranges refused", F.concat(named, F.lit(": "), bad)).select("scale", "low", "high", "band")


def scales_version(spark: SparkSession, path: str) -> str:
    """The version that a scales file states; null when it states none."""
    return _document(spark, path).select(F.try_variant_get("doc", "$.version", "string")).first()[0]


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, tag)"""
    return (_document(spark, path).select(F.explode(F.try_variant_get(
        "doc", "$.namespaces", "map<string,array<string>>")).alias("namespace", "tags"))
        .select("namespace", F.explode("tags").alias("tag")))


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(tag, definition); names starting with an underscore are remarks."""
    return (_document(spark, path).select(F.explode(F.try_variant_get(
        "doc", "$.definitions", "map<string,string>")).alias("tag", "definition"))
        .where(~F.col("tag").startswith("_")))


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, category, directions); a control without directions acts on all."""
    kind = "array<struct<id:string,name:string,category:string,applies_to_direction:array<string>>>"
    return (_document(spark, path).select(F.explode(F.try_variant_get("doc", "$", kind)).alias("c"))
            .select("c.id", "c.name", "c.category", F.coalesce(
                "c.applies_to_direction", words(vocab.DIRECTIONS)).alias("directions")))


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """(group, source, tag, label, overview) of the board configuration."""
    kind = ("array<struct<id:string,source:string,"
            "options:array<struct<tag:string,label:string,overview:boolean>>>>")
    return (_document(spark, path).select(F.explode(F.try_variant_get("doc", "$.groups", kind)).alias("g"))
            .select(F.col("g.id").alias("group"), "g.source", F.explode("g.options").alias("o"))
            .select("group", "source", "o.tag", "o.label", F.coalesce("o.overview", F.lit(True)).alias("overview")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    kind = ("array<struct<month:string,label:string,file:string,record_count:long,"
            "published_at:string,synthetic:boolean>>")
    return _document(spark, path).select(F.explode(F.try_variant_get("doc", "$", kind)).alias("m")).select("m.*")
