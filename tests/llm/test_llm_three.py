"""Fill-in-middle, phrase collocations and line dedup against brute force on small tables."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from advislake.llm import fill_in_middle, line_runs, phrase_graph
from advislake.llm.boundary_set import ARRAY, BITMAP, RUNS, BoundarySet
from advislake.llm.registry import findable

SCHEMA = """doc_id long, text string, lang string, row string, fim int, lines string, key int, n_lines string, keys double,
            dropped int, kept string, tkey long, batch int, code string, words int"""
OTHERS = ("r", 1, "l", 2, "n", 0.5, 3, "k", 4, 5, "c", 6)


def table(spark, rows):
    findable(spark)
    return spark.createDataFrame([r + OTHERS for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("values,kind", [
    ([], None), ([0], {ARRAY}), (np.arange(7, 200_000), {RUNS}), (np.arange(0, 300_000, 3), {BITMAP}),
    (np.arange(65_535, 66_000, 100), {ARRAY}),
    (np.concatenate([np.arange(65_536), np.arange(65_536, 131_072, 4), [400_000, 400_007]]), {ARRAY, BITMAP, RUNS})])
def test_boundary_set(values, kind):
    values = np.asarray(values, np.int64)
    held = BoundarySet(values)
    assert len(held) == len(values) and (kind is None or set(held.kind.tolist()) == kind)
    ranks = np.random.RandomState(3).permutation(len(values))
    assert (held.select(ranks) == values[ranks]).all()


def brute_fim(doc_id, text, unit=r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(unit, text, re.S)
    n = len(units)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    pool = ["a", "Bä", "wörd", "漢字", "<", "<S", "P>", "😀x", "longer-word"]
    gaps = [" ", "\n", "\t ", "\x0b\x0c\r", "  "]
    out = [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "a <M> b", "é" * 50]
    out += ["".join(r.choice(pool) + r.choice(gaps) for _ in range(r.randint(1, 60)))[r.randint(0, 1):] for _ in range(150)]
    return out + ["w " * 40_000 + "end", "y" * 70_000]


def test_fill_in_middle(spark, texts):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (20, "other text here", "en"), (None, "no id at all", None), (None, None, None), (-7, "a b c d", "en")]
    docs = table(spark, rows)
    made = fill_in_middle.fill_in_middle(docs)
    assert made.columns == [c for c in docs.columns if c != "fim"] + ["fim"]
    got = made.withColumn("back", fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert Counter((r["doc_id"], r["text"], *r["fim"]) for r in got) == Counter((i, t, *brute_fim(i, t)) for i, t, _ in rows)
    assert all(r["back"] == (r["text"] or "") and r["row"] == "r" and r["tkey"] == 4 for r in got)
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    letters = fill_in_middle.fill_in_middle(docs, unit="character", into="cut").collect()
    assert Counter((r["doc_id"], r["text"], *r["cut"]) for r in letters) == Counter((i, t, *brute_fim(i, t, ".")) for i, t, _ in rows)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def brute_lines(rows, least_chars=20, least_docs=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held, top = Counter(), {}
    order = lambda i: float("-inf") if i is None else i
    for i, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            top[k] = max(top.get(k, i), i, key=order)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or held[key(x)] < least_docs or top[key(x)] == i]
        out.append((i, t, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def test_line_runs(spark):
    r = random.Random(9)
    pool = [f"a line of some length that is number {k} ä" for k in range(60)] + ["short", "", "  ", "exactly twenty chars"]
    common = "This very common line stands in a third of all documents"
    rows = []
    for i in range(160):
        lines = [r.choice([str, str.upper, lambda x: f" \t{x}\r", str])(r.choice(pool)) for _ in range(r.randint(0, 9))]
        lines += [common] * (i % 3 == 0)
        rows.append((i - 5, "\n".join(lines) if lines else r.choice([None, "", "\n"]), "en"))
    rows += [rows[9], rows[9], (7, common + "\nother words of the same id here", "en"), (None, common, None),
             *[(None, f"{common}\nonly rows without ids hold this line", None)] * 3, (400, "\n".join(f"line number {k} of a very long text" for k in range(9000)), "en")]
    docs = table(spark, rows)
    made = line_runs.dedup_lines(docs)
    assert made.columns == [c for c in docs.columns if c != "lines"] + ["lines"]
    want = brute_lines(rows)
    got = made.collect()
    assert Counter((x["doc_id"], x["text"], *x["lines"]) for x in got) == want and {x["row"] for x in got} == {"r"}
    for batches, fanout in ((1, 2), (3, 2), (9, 2)):
        other = line_runs.dedup_lines(docs, batches=batches, fanout=fanout).select("doc_id", "text", "lines.*").collect()
        assert Counter(tuple(x) for x in other) == want
    few = line_runs.dedup_lines(docs, least_chars=5, least_docs=1).select("doc_id", "text", "lines.*").collect()
    assert Counter(tuple(x) for x in few) == brute_lines(rows, 5, 1)
    assert line_runs.dedup_lines(docs.limit(0)).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_runs_compact_and_settle(spark):
    runs = line_runs.LineRuns(spark, least=2, fanout=2)
    for top in (9, 7, 5, 3, 1):
        runs.add(spark.createDataFrame([(bytes([k]), top) for k in range(top, top + 3)] + [(b"\xff", top)], "h binary, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # five runs as 4 + 1
    n = Counter(k for top in (9, 7, 5, 3, 1) for k in range(top, top + 3))
    top = {k: max(t for t in (9, 7, 5, 3, 1) if t <= k < t + 3) for k in n}
    assert {(r["h"][0], r["top"]) for r in runs.settled().collect()} == {(k, top[k]) for k in n if n[k] > 1} | {(255, 9)}
    # settled after two batches: the last three did not write the common hash again
    assert sum(r["n"] for t in runs.tables() for r in t.where(F.col("h") == F.lit(b"\xff")).collect()) < 5
    runs.close()
    assert runs.tables() == []


def brute_phrases(rows, least, contained=80):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    f = {}
    for _, t, lang in rows:
        c = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i:i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cands = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        around = {}
        for g, v in cands.items():
            for m in range(2, len(g)):
                for j in range(len(g) - m + 1):
                    around[g[j:j + m]] = max(around.get(g[j:j + m], 0), v)
        for g, a in cands.items():
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            if 100 * around.get(g, 0) < contained * a:
                out.add((lang, " ".join(g), a, c[g[:k]], c[g[k:]], n, score))
    return out


@pytest.fixture(scope="module")
def prose():
    r = random.Random(11)
    word = [f"w{k}" for k in range(12)] + ["Ä", "the", "THE"]
    license_text = "permission is hereby granted free of charge to any person"
    rows = [(0, None, "en"), (1, "", None), (2, " . ,; ", "en"), (3, "again " * 3000, "en"), (None, "x", None), (4, "a b a b a b a b", "de")]
    for i in range(5, 120):
        body = " ".join(r.choice(word) + r.choice(["", "", "", ".", ",", "\n", "\t", "!"]) for _ in range(r.randint(1, 60)))
        rows.append((i, body + ("\n" + license_text) * (i % 2), r.choice(["en", "en", "de", None, "und"])))
    return rows + [rows[30]] * 5 + [(7, "repeated id " * 20, "en")]


@pytest.mark.parametrize("codes", [1 << 20, 9, 0])
def test_phrases(spark, prose, codes, monkeypatch):
    monkeypatch.setattr(phrase_graph, "COMMON", 6)
    docs = table(spark, prose)
    got = phrase_graph.collocations(docs, least=5, most_codes=codes)
    assert {tuple(r) for r in got.collect()} == brute_phrases(prose, 5)
    if codes == 9:
        top = phrase_graph.ranked(got, top=7).orderBy("lang", "rank").collect()
        for lang in ("en", "de", "und"):
            best = sorted((x for x in brute_phrases(prose, 5) if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:7]
            assert [(r["rank"], r["phrase"]) for r in top if r["lang"] == lang] == [(k + 1, x[1]) for k, x in enumerate(best)]
        assert phrase_graph.collocations(docs.limit(0)).count() == 0


def test_compaction_keeps_every_run():
    r = random.Random(2)
    for size in (2, 3, 5, 40):
        pieces = [[r.randint(1, size) for _ in range(r.choice([1, 2, 3, 4, 5, 9, 30]))] for _ in range(60)]
        pieces += [pieces[0]] * 3 + [[7] * 50, [1, 2, 3] * 9]
        code = np.array([w for p in pieces for w in p], np.int64)
        begins = np.array([i == 0 for p in pieces for i in range(len(p))])
        start, count, weight, ended = phrase_graph.compacted(code, begins)
        got, rows = Counter(), 0
        for s, n, w, e in zip(start, count, weight, ended):
            words = code[s:s + n].tolist()
            rows += n
            for p in range(n - 1 if e else n - 3):
                for m in range(2, min(4, n - p) + 1):
                    got[tuple(words[p:p + m])] += int(w)
        want = Counter(tuple(p[i:i + m]) for p in pieces for m in (2, 3, 4) for i in range(len(p) - m + 1))
        assert got == want
    lone = np.arange(1, 1001)  # a text of different words is one path
    assert len(phrase_graph.compacted(lone, lone == 1)[0]) == 1


def test_products_beyond_64_bits(spark):
    big = 5_000_000_000_000_000
    grams = spark.createDataFrame([([1, 2], big)], "g array<long>, f long")
    words = spark.createDataFrame([(1, big + 1), (2, big)], "code long, f1 long")
    row = phrase_graph._scored(grams, words).first()
    assert (row["a"], row["l"], row["r"], row["score"]) == (big, big + 1, big, 2_000_000 * big // (2 * big + 1))
