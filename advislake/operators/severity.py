"""Vendor-plural severity: every party's own band, mapped onto one vocabulary."""
from pyspark.sql import Column, DataFrame, functions as F

from advislake.functions import vocab
from advislake.functions.exprs import attach, filled, let, lookup, struct_of, within

CVSS_FACTS = "struct<version:string,base_score:double,vector:string>"
ASSESSMENT = (f"struct<source:string,role:string,scale:string,value:string,basis:string,"
              f"cvss:{CVSS_FACTS},url:string>")

_SCALE_KEYS = {f"{scale}|{band.lower()}": target
               for scale, bands in vocab.SEVERITY_SCALES.items()
               for band, target in bands.items()}


def mapped_band(scale: Column, band: Column) -> Column:
    """A vendor band on the target vocabulary, ignoring case; null when the scale has none."""
    return lookup(_SCALE_KEYS, F.concat(scale, F.lit("|"), F.lower(band)))


def with_mapped_band(df: DataFrame, scales: DataFrame, scale: str, band: str, into: str = "mapped_band") -> DataFrame:
    """As ``mapped_band``, for scales of a file: (scale, band, target) as ``readers.read_scales`` gives them."""
    rows = scales.select(F.col("scale").alias("_scale"), F.lower("band").alias("_band"), F.col("target").alias(into)).distinct()
    return df.join(rows, (F.col(scale) == F.col("_scale")) & (F.lower(F.col(band)) == F.col("_band")), "left").drop("_scale", "_band")


def unmapped_bands(df: DataFrame, scale: str, band: str, scales: DataFrame = None) -> DataFrame:
    """Gate: rows whose band their own scale does not define."""
    if scales is not None:
        return with_mapped_band(df, scales, scale, band, "_target").where(
            F.col(band).isNotNull() & F.col("_target").isNull()).drop("_target")
    return df.where(F.col(band).isNotNull() & mapped_band(F.col(scale), F.col(band)).isNull())


def band_from_score(score: Column) -> Column:
    """Closed score ranges; null and the gaps between ranges are unknown."""
    out = F.lit("unknown")
    for low, high, band in vocab.SCORE_BANDS:
        out = F.when((score >= low) & (score <= high), band).otherwise(out)
    return out


def severity_band(severity: str = "severity") -> Column:
    return F.coalesce(F.when(F.col(f"{severity}.normalized_band") != "",
                             F.col(f"{severity}.normalized_band")), F.lit("unknown"))


def resolve_severity(text: Column, score: Column) -> Column:
    """Vendor severity text and score -> struct<severity, basis>; text and score are OR-ed."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def says(*names):
        hit = lowered.contains(names[0])
        for name in names[1:]:
            hit = hit | lowered.contains(name)
        return hit

    def at_least(value):
        return F.coalesce(score >= value, F.lit(False))

    stated = says("critical", "important", "high", "moderate", "medium", "low")
    band = (F.when(~stated & score.isNull(), "Unknown")
            .when(says("critical") | at_least(9), "Critical")
            .when(says("important", "high") | at_least(7), "Important")
            .when(says("moderate", "medium") | at_least(4), "Moderate")
            .otherwise("Low"))
    basis = F.when(stated, "vendor").when(score.isNotNull(), "cvss").otherwise("absent")
    return F.struct(band.alias("severity"), basis.alias("basis"))


def publisher_assessment(value: Column, basis: Column, cvss: str) -> Column:
    facts = F.when(F.col(f"{cvss}.base_score").isNotNull(),
                   F.struct(F.col(f"{cvss}.version").alias("version"),
                            F.col(f"{cvss}.base_score").alias("base_score"),
                            F.col(f"{cvss}.vector").alias("vector")))
    made = F.struct(F.lit("microsoft"), F.lit("publisher"), F.lit("msrc"), value,
                    F.lit("vendor"), facts, F.lit(None).cast("string")).cast(ASSESSMENT)
    return F.when((basis == "vendor") & filled(value) & (value != "Unknown"), made)


def cna_assessment(program: str, publisher: str = "microsoft") -> Column:
    p = lambda name: F.col(f"{program}.{name}")
    facts = F.when(p("vendor_severity.base_score").isNotNull(),
                   F.struct(p("vendor_severity.cvss_version"), p("vendor_severity.base_score"),
                            p("vendor_severity.vector")).cast(CVSS_FACTS))
    made = F.struct(p("assigner"), F.lit("assigning-cna"), p("vendor_severity.scale"),
                    p("vendor_severity.band"), F.lit("vendor"), facts,
                    F.when(p("url") != "", p("url"))).cast(ASSESSMENT)
    other_party = (F.coalesce(p("assigner"), F.lit("")) != "") & (
        F.lower(F.trim(p("assigner"))) != publisher.lower())
    return F.when(other_party & (F.coalesce(p("vendor_severity.band"), F.lit("")) != ""), made)


MOST_BANDS = 10_000


class Rules:
    """What bands and scores mean: the package's own constants, or the tables of a scales file.

    ``scales``: (scale, band, target) of ``readers.read_scales``; ``ranges``: (scale, low, high, band) of
    ``readers.read_score_ranges``, of which ``score_scale`` counts. The tables are small and bounded
    (MOST_BANDS; the reader bounds ranges): each becomes one value that goes along with every row, so
    records are neither joined nor shuffled.
    """

    def __init__(self, scales: DataFrame = None, ranges: DataFrame = None, version: str = vocab.SCALES_VERSION,
                 score_scale: str = "cvss-score"):
        self.version, self.columns = version, {}
        if scales is not None:
            keyed = F.collect_set(F.struct(F.concat("scale", F.lit("|"), F.lower("band")), "target"))
            many = F.raise_error(F.lit("a scales file with too many bands")).cast("map<string,string>")
            self.columns["_scale_targets"] = scales.agg(F.when(F.count("*") > MOST_BANDS, many).otherwise(F.map_from_entries(keyed))).scalar()
        if ranges is not None:
            own = ranges.where(F.col("scale") == score_scale)
            self.columns["_score_ranges"] = own.agg(F.array_sort(F.collect_list(F.struct("low", "high", "band")))).scalar()

    def attached(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns) if self.columns else df

    def band(self, scale: Column, band: Column) -> Column:
        """A vendor band on the target vocabulary, ignoring case; null when its scale has none."""
        if "_scale_targets" not in self.columns:
            return mapped_band(scale, band)
        return F.try_element_at("_scale_targets", F.coalesce(F.concat(scale, F.lit("|"), F.lower(band)), F.lit("\0")))

    def score(self, score: Column) -> Column:
        """The band whose closed range holds the score; null scores and gaps are unknown."""
        if "_score_ranges" not in self.columns:
            return band_from_score(score)
        held = F.get(F.filter("_score_ranges", lambda r: (score >= r["low"]) & (score <= r["high"])), F.lit(0))
        return F.coalesce(held["band"], F.lit("unknown"))


def with_score_band(df: DataFrame, score: str, rules: Rules, into: str = "band") -> DataFrame:
    """Adds the band of a score column under the given rules."""
    return rules.attached(df).withColumn(into, rules.score(F.col(score))).drop(*rules.columns)


FIXED = Rules()


def build_severity(value: Column, basis: Column, cvss: str, program: str,
                   strict: bool = True, rules: Rules = FIXED) -> Column:
    """The severity struct. The highest mapped band wins, the publisher on ties.

    ``strict`` fails the job on a band its scale does not define, as guessing one
    would invent a rating. ``rules`` of a file need their columns attached.
    """
    missing = F.raise_error(F.lit("a scale does not define a band it was given")).cast("string")
    rank = lambda c: lookup(vocab.BAND_RANK, c, 0)

    def band(side):
        target = rules.band(side["scale"], side["value"])
        return F.when(side.isNotNull(), F.coalesce(target, missing) if strict else target)

    def assemble(s):
        pub, cna = s["pub"], s["cna"]
        has_party = pub.isNotNull() | cna.isNotNull()
        cna_wins = pub.isNull() | (cna.isNotNull() & (rank(s["cna_band"]) > rank(s["pub_band"])))
        pub_score, cna_score = pub["cvss"]["base_score"], cna["cvss"]["base_score"]
        comparable = pub_score.isNotNull() & cna_score.isNotNull()
        differ = pub.isNotNull() & cna.isNotNull() & (s["pub_band"] != s["cna_band"])
        scale = F.when(cna_wins, cna["scale"]).otherwise(pub["scale"])
        return struct_of(
            assessments=F.array_compact(F.array(pub, cna)),
            primary=F.coalesce(pub["source"], cna["source"]),
            normalized_band=F.when(~has_party, s["derived"]).when(cna_wins, s["cna_band"])
            .otherwise(s["pub_band"]),
            normalized_basis=F.when(has_party, F.concat(
                F.lit("scale-mapping:"), scale, F.lit(f":{rules.version}")))
            .when(s["derived"] != "unknown", "cvss-derived").otherwise("absent"),
            divergence=F.when(differ, struct_of(
                kind=F.when(comparable, "assessment").otherwise("scale"),
                spread=F.when(comparable, F.round(F.abs(pub_score - cna_score), 2)))),
            publisher_declined=F.when(pub.isNull() & cna.isNotNull(), struct_of(
                source="microsoft", reason=vocab.DECLINED_REASON)))

    parties = struct_of(pub=publisher_assessment(value, basis, cvss), cna=cna_assessment(program))
    return let(parties, lambda p: let(
        struct_of(pub=p["pub"], cna=p["cna"], pub_band=band(p["pub"]), cna_band=band(p["cna"]),
                  derived=rules.score(F.col(f"{cvss}.base_score"))), assemble))


def with_severity(df: DataFrame, value="severity_text_band", basis="severity_basis",
                  cvss="cvss", program="cve_program", into="severity",
                  strict: bool = True, rules: Rules = FIXED) -> DataFrame:
    severity = build_severity(F.col(value), F.col(basis), cvss, program, strict, rules)
    return attach(rules.attached(df.drop(into)), struct_of(**{into: severity})).drop(*rules.columns)


def renormalise(df: DataFrame, rules: Rules = FIXED) -> DataFrame:
    """Re-derive severity of a release from its source facts (idempotent), under a file's rules if given.

    Adds ``band_before`` so callers can count what moved.
    """
    publisher = F.try_element_at(
        F.filter("severity.assessments", lambda a: a.role == "publisher"), F.lit(1))
    text = F.coalesce(publisher["value"], F.lit("Unknown"))
    basis = F.when(publisher.isNotNull(), "vendor").otherwise(
        F.coalesce(F.col("severity_basis"), F.lit("absent")))
    return (df.withColumns({"_text": text, "_basis": basis, "band_before": severity_band()})
            .transform(with_severity, value="_text", basis="_basis", rules=rules)
            .drop("_text", "_basis"))


def band_moves(df: DataFrame) -> DataFrame:
    """Before/after record counts per band of a re-normalised release."""
    sides = F.explode(F.array(
        F.struct(F.col("band_before").alias("band"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(severity_band().alias("band"), F.lit(0).alias("b"), F.lit(1).alias("a"))))
    return (df.select(sides.alias("s")).groupBy("s.band")
            .agg(F.sum("s.b").alias("before"), F.sum("s.a").alias("after")))
