"""Rules of files, credit states and re-used assessments on literal fixtures."""
import json
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from advislake.functions import vocab
from advislake.operators import reconcile, risk, severity
from advislake.plans import bridge as B
from advislake.sources import readers

SF = "/root/testdata/sf0.001"


def filed(tmp_path, document):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps(document))
    return str(path)


def ranges(*rows):
    return {"scales": {"cvss-score": {"ranges": [{"min": a, "max": b, "maps_to": c} for a, b, c in rows]}}}


def test_score_ranges_of_a_file(spark, tmp_path):
    path = filed(tmp_path, ranges((5.0, 10, "high"), (0, 0, "unknown"), (0.1, 4.5, "low")) | {"version": "9"})
    read = readers.read_score_ranges(spark, path)
    assert sorted(tuple(r)[1:] for r in read.collect()) == [(0.0, 0.0, "unknown"), (0.1, 4.5, "low"), (5.0, 10.0, "high")]
    assert readers.scales_version(spark, path) == "9"
    scores = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 0.05, 0.1, 4.5, 4.7, 5.0, 10.0, 10.1, float("nan"))], "s double")
    got = severity.with_score_band(scores, "s", severity.Rules(ranges=read))
    assert got.columns == ["s", "band"]
    assert [r["band"] for r in got.collect()] == ["unknown", "unknown", "unknown", "unknown", "low", "low", "unknown", "high", "high", "unknown", "unknown"]
    empty = severity.with_score_band(scores, "s", severity.Rules(ranges=read.limit(0)))
    assert {r["band"] for r in empty.collect()} == {"unknown"}


@pytest.mark.parametrize("rows,why", [
    ([(0, 5, "low"), (5, 10, "high")], "overlapping"), ([(0, 10, "low"), (2, 3, "high"), (4, 5, "high")], "overlapping"),
    ([(5, 4, "low")], "proper ends"), ([(None, 4, "low")], "proper ends"), ([(0, 4, "awful")], "vocabulary"), ([(0, 4, None)], "vocabulary")])
def test_broken_score_ranges_are_refused(spark, tmp_path, rows, why):
    with pytest.raises(PySparkException, match=why):
        readers.read_score_ranges(spark, filed(tmp_path, ranges(*rows))).select("low").collect()


def test_scales_of_a_file(spark, tmp_path):
    path = filed(tmp_path, {"scales": {"own": {"bands": {"Red": {"maps_to": "critical"}, "RED": {"maps_to": "critical"}, "Blue": {"maps_to": "low"}}}}})
    rules = severity.Rules(readers.read_scales(spark, path))
    df = spark.createDataFrame([("own", "red"), ("own", "BLUE"), ("own", "green"), ("msrc", "Critical"), (None, "red"), ("own", None)], "s string, b string")
    got = rules.attached(df).select(rules.band(F.col("s"), F.col("b")).alias("t")).collect()
    assert [r["t"] for r in got] == ["critical", "low", None, None, None, None]


def with_controls(spark, controls):
    row = B.records(spark, SF).where("customer_action_required and attack.vector = 'network'").limit(1)
    kind = row.schema["mitigation_candidates"].dataType
    made = [{"id": i, "relevance": "relevant", "confidence": c, "evidence": "e", "direction_override": None,
             "effect": {"likelihood_steps": ls, "consequence_steps": cs, "path_block": block}} for i, c, ls, cs, block in controls]
    return row.withColumn("mitigation_candidates", F.from_json(F.lit(json.dumps(made)), kind))


def test_states_cover_all_subsets(spark):
    ids = vocab.CONTROL_IDS
    block = next(i for i in ids if i in vocab.PATH_BLOCK_CONTROLS)
    others = [i for i in ids if i != block][:6]
    controls = [(block, "high", 2, 0, True)] + [(x, "high", k % 2, (k + 1) % 2 + (k % 3 == 0), False) for k, x in enumerate(others)]
    df = with_controls(spark, controls)
    held = risk.with_profile(risk.selection_states(df), "selection").select("mask", "cases", "resid_likelihood", "resid_action", F.size("applied").alias("n")).collect()
    every = risk.subset_sweep(df).select("mask", "resid_likelihood", "resid_action").collect()
    assert len(every) == 2 ** len([c for c in controls if c[2] or c[3]]) == sum(r["cases"] for r in held)
    counted = Counter()
    for r in held:
        counted[r["resid_likelihood"], r["resid_action"]] += r["cases"]
    assert counted == Counter((r["resid_likelihood"], r["resid_action"]) for r in every)
    by_mask = {r["mask"]: (r["resid_likelihood"], r["resid_action"]) for r in every}
    assert all(by_mask[r["mask"]] == (r["resid_likelihood"], r["resid_action"]) for r in held)
    assert len(held) <= len(risk.STATES)


def test_all_catalogue_controls_stay_a_few_rows(spark):
    df = with_controls(spark, [(x, "high", 1, 1, False) for x in vocab.CONTROL_IDS])
    rows = risk.selection_states(df).select("cases", F.size("selection").alias("n")).collect()
    assert sum(r["cases"] for r in rows) == 2 ** len(vocab.CONTROL_IDS) and len(rows) <= len(risk.STATES)
    none = risk.selection_states(with_controls(spark, [])).select("cases", "mask").collect()
    assert [tuple(r) for r in none] == [(1, 0)]


def release(spark, rows):
    return spark.createDataFrame(rows, "cve string, title string")


def test_settled_release(spark):
    none = spark.createDataFrame([], "cve string, fingerprint string, made string")
    asked = []

    def assess(df):
        asked.append(sorted(r["cve"] for r in df.collect()))
        return df.select("cve", F.lit(f"pass {len(asked)}").alias("made"))

    first, second = [("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]
    readings = iter([first, second, second])
    records, done = reconcile.settle_release(lambda: release(spark, next(readings)), assess, none)
    assert asked == [["a", "b", "c"], ["b", "d"]] and records.count() == 3
    assert sorted((r["cve"], r["made"]) for r in done.collect()) == [("a", "pass 1"), ("b", "pass 2"), ("d", "pass 2")]
    # earlier rows serve again, also repeated ones and those of another revision
    again = done.union(done).union(done.withColumns({"fingerprint": F.lit("old"), "made": F.lit("never")}))
    asked.clear()
    _, same = reconcile.settle_release(lambda: release(spark, second), assess, again)
    assert asked == [[]] and same.count() == 3 and {r["made"] for r in same.collect()} == {"pass 1", "pass 2"}
    for broken, why in ((lambda df: df.where("cve <> 'b'"), "missing"), (lambda df: df.union(df.limit(1)), "repeated"),
                        (lambda df: df.union(df.limit(1).withColumn("cve", F.lit("z"))), "extra")):
        with pytest.raises(ValueError, match=why):
            reconcile.settle_release(lambda: release(spark, first), lambda df: broken(df.select("cve", F.lit("x").alias("made"))), none)
    changing = iter(range(9))
    with pytest.raises(ValueError, match="all 3 passes"):
        reconcile.settle_release(lambda: release(spark, [("a", str(next(changing)))]), lambda df: df.select("cve", F.lit("x").alias("made")), none)
