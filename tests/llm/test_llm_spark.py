"""Training-data operators on small tables with nulls, repeats, ties, long texts and clashing columns."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from advislake.llm import components, embedding_dedup, kneser_ney, language_crf, minmax_dedup, quality_rules, recurrent_lm
from advislake.llm import sentence_pieces, source_mix, substring_dedup, url_filters
from advislake.llm.registry import findable, load

SF = "/root/testdata/sf0.001"
SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, class int, row string, key int, size int,
            marks string, bits double, kept string, n_words string, rank int, text_key string, h string, k int"""
OTHERS = (1, "r", 2, 3, "m", 0.5, "k", "w", 4, "t", "h", 5)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3)))
    passage = [word() for _ in range(70)]
    texts = [None, "", " \n\t", "x", "one two"]
    for k in range(40):
        body = [word() for _ in range(r.randint(30, 150))]
        if k % 3 == 0:
            at = r.randint(0, len(body))
            body[at:at] = passage[r.randint(0, 20):r.randint(40, 70)]
        if k % 7 == 0:
            body = body + body[5:60]
        texts.append(" ".join(body))
    base = texts[6].split(" ")
    for k in range(12):  # near copies and copies
        copy = list(base)
        for _ in range(k // 2):
            copy[r.randint(0, len(copy) - 1)] = word()
        texts.append("\n".join(copy) if k % 2 else " ".join(copy).upper())
    texts.append(" ".join(["again"] * 4000))
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s", "s", "t", ""][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[10], out[10], (10, texts[11], "en", "s", 5), (None, texts[12], "en", "s", 5), (None, "y z", "de", None, 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    findable(spark)
    return spark.createDataFrame([r + OTHERS for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_rules(docs, empty, rows):
    got = quality_rules.line_first_clean(docs).collect()
    assert len(got) == len(rows) and quality_rules.line_first_clean(empty).count() == 0
    assert {r["n_words"] for r in got if r["text"] is None} == {0} and all(isinstance(r["kept"], bool) for r in got)
    spoiled = docs.sparkSession.createDataFrame(
        [(1, "\n".join([" ".join(f"w{k}x{j}" for j in range(10)) + "." for k in range(9)] + ["home | news | about | more"]))],
        "doc_id long, text string")
    row = quality_rules.line_first_clean(spoiled).first()
    assert row["kept"] and row["n_lines_removed"] == 1 and "|" not in row["clean_text"] and row["clean_text"].count("\n") == 8
    shouted = spoiled.withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 80), i -> concat('LOUD', i, '!!')))"))
    assert not quality_rules.line_first_clean(shouted).first()["kept"]


def test_url_filters(spark):
    findable(spark)
    urls = {None: (None, "block"), "": (None, "block"), "no scheme.com/": (None, "block"), "http://a.com": (None, "allow"),
            "http://A.COM/x": ("com/", "allow"), "https://example.com/en/1?x": ("example.com/en/", "block"),
            "https://WWW.example.com/en/1": ("www.example.com/en/", "allow"), "https://m.example.com/en/": ("example.com/en/", "block"),
            "https://com/": ("com/", "allow"), "https://notcom/": (None, "allow"), "a://b.net/es/": ("net/es/", "block"),
            "https://x.org/setup.exe": (None, "block"), "https://x.org/a?b=setup.exe": (None, "allow"),
            "http://m.ads-track.example.org/en/1": (None, "block"), "http://x.org/" + "y" * 3000: (None, "allow"), "http:///com/": (None, "block")}
    pages = spark.createDataFrame([(i, u, "p", 1) for i, u in enumerate(urls)], "page_id long, url string, path string, rule int")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages).collect()}
    assert got == urls
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("window", [12, 35])
def test_substring_dedup(docs, empty, rows, window):
    where = {}
    for i, r in enumerate(rows):
        ws = split(r[1])
        for p in range(len(ws) - window + 1):
            where.setdefault(tuple(ws[p:p + window]), []).append((i, p))
    gone = [set() for _ in rows]
    for at in where.values():
        if len(at) > 1:
            for i, p in at:
                gone[i].update(range(p, p + window))
    want = []
    for r, g in zip(rows, gone, strict=True):
        ws = split(r[1])
        kept = [w for k, w in enumerate(ws) if k not in g]
        want.append((r[0], len(ws), len(g), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    out = substring_dedup.remove_repeats(docs, window=window)
    got = out.collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert sum(b - a + 1 for a, b in r["removed_spans"]) == r["n_removed"]
        assert (r["clean_text"] == r["text"]) if not r["n_removed"] else \
            hashlib.sha256(" ".join(split(r["clean_text"])).encode()).hexdigest() == r["kept_sha256"]
        assert r["row"] == "r" and r["n_chars"] is None or r["n_chars"] >= 0
    assert substring_dedup.remove_repeats(empty, window=window).count() == 0


def components_by_hand(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if c in (x, y) else c for c in label]
    return label


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, empty, rows, size):
    sets = []
    for r in rows:
        ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in split(r[1])]
        sets.append({tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components_by_hand(len(rows), links)
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = [(r[0], len(s), least.get(c) if s else r[0], r[0] == (least.get(c) if s else r[0])) for r, c, s in zip(rows, label, sets, strict=True)]
    got = minmax_dedup.near_duplicates(docs, size=size).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert minmax_dedup.near_duplicates(empty, size=size).count() == 0


def test_buckets_that_fall_apart_are_searched_on(spark):
    """A chain: neighbours are similar, the ends are not, so hubs alone do not link all."""
    findable(spark)
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[k * 12:k * 12 + 200]) for k in range(16)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    got = minmax_dedup.near_duplicates(docs).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 300), (300, 200), (7, 7), (None, 3)] + [(500, k) for k in range(501, 540)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components.connected(df).collect())
    assert all(got[k] == 0 for k in range(61)) and got[200] == got[300] == got[100] == 100 and got[539] == got[500] == 500
    assert components.connected(df.limit(0)).count() == 0


def test_near_vectors(spark):
    findable(spark)
    r = np.random.RandomState(8)
    centre = r.standard_normal((5, 8))
    x = [list(map(float, c + 0.2 * r.standard_normal(8))) for c in centre for _ in range(12)]
    data = [(i, v, "p", 1) for i, v in enumerate(x)]
    data += [(100, x[0], "p", 1), (101, x[0], "p", 1), (101, x[0], "p", 2), (102, [0.0] * 8, "p", 1), (103, None, None, None), (104, [], "p", 1),
             (105, [float("nan")] * 8, "p", 1), (106, [None] + x[0][1:], "p", 1), (107, x[0][:7] + [float("inf")], "p", 1),
             (108, [c * 1e30 for c in x[3]], "p", 1), (109, x[0][:3], "p", 1), (None, x[20], "p", 1), (None, [5.0] * 8, "p", 1)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, cell string, tile int")
    full = [np.array((d[1] or []) + [0.0] * (8 - len(d[1] or [])), float) for d in data]
    ok = [bool(np.isfinite(v).all() and v.any()) if d[1] and None not in d[1] else False for v, d in zip(
        [np.zeros(8) if d[1] is None or None in d[1] else f for f, d in zip(full, data, strict=True)], data, strict=True)]
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) if o else None for v, o in zip(full, ok, strict=True)]
    links = [(a, b) for a in range(len(data)) for b in range(a) if ok[a] and ok[b] and unit[a] @ unit[b] >= 0.95]
    label, n = components_by_hand(len(data), links), [sum(i in e for e in links) for i in range(len(data))]
    least = {}
    for d, c in zip(data, label, strict=True):
        if d[0] is not None:
            least[c] = min(least.get(c, d[0]), d[0])
    want = [(d[0], n[i], least.get(label[i]), d[0] == least.get(label[i])) for i, d in enumerate(data)]
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(map(tuple, embedding_dedup.near_vectors(rows).collect()), key=key) == sorted(want, key=key)
    assert embedding_dedup.near_vectors(rows.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(rows.where("vec_id = 103")).collect()[0]["kept"]


def test_source_mix(docs, empty, rows):
    mixed = source_mix.mix(docs, source_mix.word_count(F.col("text")))
    got, again = mixed.collect(), source_mix.mix(docs.repartition(5), source_mix.word_count(F.col("text"))).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert len(got) == len(rows) and sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    # shared again and again by weight until no target is above three times its size
    target, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 3 * sizes[s]]
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else unit * weight[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and all(abs(r["target"] - target[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.5 and all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert source_mix.mix(empty, source_mix.word_count(F.col("text"))).count() == 0


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 1000, 1), ("b", 10, 1), ("c", 10, 1), (None, 0, 1)], "source string, source_size long, rows long")
    got = {r["source"]: r["target"] for r in source_mix.targets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got[None] == 0 and abs(got["a"] - 960) < 1e-9


def test_sentence_pieces(docs, empty, rows):
    model = sentence_pieces.default_model()
    out = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    got = out.select("text", "decoded", "ids").collect()
    assert len(got) == len(rows) and all(r["text"] == r["decoded"] for r in got)
    assert all((r["ids"] is None) == (r["text"] is None) for r in got)
    assert sentence_pieces.decode(sentence_pieces.encode(empty, model), model).count() == 0


def test_language(spark, docs, empty):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    findable(spark)
    got = load()[0]["op5_language_crf"](spark, SF).join(given.select("doc_id", "lang"), "doc_id").collect()
    away = [r for r in got if r["held_out"]]
    assert len(got) == given.count() and np.mean([r["lang"] == r["lang_pred"] for r in away]) > 0.97
    field = language_crf.fit(docs)
    for r in language_crf.label(docs, field).collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    none = language_crf.fit(empty)
    assert {r["lang_pred"] for r in language_crf.label(docs, none).collect()} == {"und"}
    assert language_crf.label(empty, field).count() == 0


def test_languages_of_long_texts_only_are_labels(spark):
    long, short = "das haus des königs ist rot und alt " * 40, "the house of the king is red and old "
    texts = spark.createDataFrame([(k, long, "de") for k in range(4)] + [(k, short * 5, "en") for k in range(4, 12)]
                                  + [(20, "x" * 900, "xx")], "doc_id long, text string, lang string")
    field = language_crf.fit(texts, sample_chars=300)
    assert field.labels == ["de", "en", "xx"]
    assert {r["lang"] for r in language_crf.label(texts, field).where("lang = lang_pred").collect()} >= {"de", "en"}


def test_language_model(spark, docs, empty, rows):
    import zlib
    got = recurrent_lm.score_texts(docs).collect()
    learn = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = {}
    for r in learn:
        for w in [*(x.translate({c: c + 32 for c in range(65, 91)}) for x in split(r[1])), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*(x.translate({c: c + 32 for c in range(65, 91)}) for x in split(r[1])), None]
        want.append((r[0], r not in learn, len(tokens), sum(t in counts for t in tokens), n,
                     round(sum(np.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens), 6)))
    key = lambda t: tuple(str(x) for x in t)
    mine = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key) and all(r["score"] < 0 for r in got)
    assert recurrent_lm.score_texts(empty).count() == 0
    assert recurrent_lm.score_texts(docs, train=F.lit(False)).count() == len(rows)


def test_language_model_beats_counts_on_texts_it_has_not_seen(spark):
    got = load()[0]["op4_recurrent_lm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_every_training_text_is_trained_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k if k < 40 else None, f"text {k}") for k in range(80)], "doc_id long, text string")
    rounds = []
    monkeypatch.setattr(recurrent_lm, "_averaged", lambda piece, model, rate: rounds.append([r["text"] for r in piece.collect()]))
    recurrent_lm.score_texts(docs)
    learn = docs.where(~recurrent_lm.held_out(F.col("doc_id"))).collect()
    assert sorted(sum(rounds, [])) == sorted(r["text"] for r in learn)
    null = {r["text"] for r in learn if r["doc_id"] is None}
    assert all(0 < len(null & set(x)) < len(null) for x in rounds)  # rows without doc_id are dealt, too


def test_rare_words_meet_their_counts_in_the_join(docs, rows, monkeypatch):
    one = {(r["doc_id"], r["n_tokens"]): r for r in recurrent_lm.score_texts(docs, rounds=0).collect()}
    monkeypatch.setattr(recurrent_lm, "NAMED", 32)
    for r in recurrent_lm.score_texts(docs, rounds=0).collect():
        o = one[(r["doc_id"], r["n_tokens"])]
        assert r["n_known"] == o["n_known"] and abs(r["base_score"] - o["base_score"]) < 1e-6


def test_kneser_ney(spark, docs, empty):
    findable(spark)
    texts = spark.createDataFrame([(k, f"The house number {k} is red, and house {k % 7} is blue.") for k in range(200)], "doc_id long, text string")
    bits = kneser_ney.model(kneser_ney.gram_counts(texts))
    assert np.allclose((2.0 ** -bits.astype(float)).reshape(-1, kneser_ney.SYMBOLS).sum(1), 1, atol=1e-4)
    one = texts.unionByName(spark.createDataFrame([(900, "ZQ|XJ|KV#WQ|" * 20), (901, None), (902, ""), (None, "The house number 5 is red, and house 5 is blue.")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in kneser_ney.classify(one.withColumn("lang", F.lit("en")), texts.select("doc_id")).collect()}
    assert not got[900]["kept"] and not got[901]["kept"] and got[901]["perplexity"] is None and got[5]["kept"] and got[None]["kept"]
    assert got[900]["perplexity"] > 3 * got[5]["perplexity"]
    assert kneser_ney.classify(docs, docs.limit(0)).where("kept").count() == docs.where("text <> ''").count()
    assert kneser_ney.classify(empty, empty).count() == 0


def test_kneser_ney_tells_text_from_gibberish_in_any_script(spark):
    scripts = {"ru": ("старый дом стоит у реки и новый дом тоже", "щъфыж эюх яцчщъ ж ъыьэю ф щюяъы хцж ъфщыя"),
               "el": ("το παλιό σπίτι είναι κοντά στο ποτάμι", "ξψ ωφχψξ ζθξψω ύώΰψζ ξζψωθ φχξ ψωζθξφ"),
               "zh": ("老房子在河边新房子也在河边", "鑫龘靐齉齾爩鱻麤灪籱爨癵驫"), "pl": ("żółta łódź płynie po żółtej wodzie", "źśćńą ęśćź ńąćźśę ćń śźńćąęń ść źńąćś"),
               "up": ("THE OLD HOUSE IS NEAR THE RIVER", "XQJ ZKV QXJZW VK QZXJ XJV KQZXW")}
    good = [(f"{s}{k}", f"{a} {k} " * 5) for s, (a, _) in scripts.items() for k in range(40)]
    texts = spark.createDataFrame(good + [(s, (b + " 7 ") * 5) for s, (_, b) in scripts.items()], "doc_id string, text string")
    got = {r["doc_id"]: r for r in kneser_ney.classify(texts.withColumn("lang", F.substring("doc_id", 1, 2)),
                                                       texts.where("length(doc_id) > 2").select("doc_id")).collect()}
    for s in scripts:
        assert not got[s]["kept"] and got[s]["perplexity"] > 3 * got[f"{s}1"]["perplexity"], s
        assert got[f"{s}1"]["n_symbols"] == len(scripts[s][0] + " 1 ") * 5


def test_trusted_texts_are_drawn_without_steps(spark):
    ids = spark.range(5000).withColumnRenamed("id", "good")
    got = [kneser_ney._drawn(ids, most).count() for most in (5001, 5000, 4999, 3000)]
    assert got[:2] == [5000, 5000] and got[2] > 4950 and abs(got[3] - 3000) < 150


def test_pipeline(spark):
    findable(spark)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "1234 5678", None, None, 9)], given.schema)
    docs = given.unionByName(extra).unionByName(given.where("doc_id = 3")).unionByName(given.where("doc_id = 3"))
    table = components.written(docs, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES:
        out = components.written(stage(spark, table, SF), f"test-{name}")
        if name != "sentence_pieces":
            assert out.columns == docs.columns, name
        if name == "language_id":
            ids = {r[0] for r in out.select("doc_id").collect()}
            assert not ids & {9001, 9002, 9003} and len(ids) >= 0.95 * given.count()
        if name == "near_dedup":
            near = minmax_dedup.near_duplicates(table).collect()
            assert out.count() == len({r["root"] for r in near}) == out.select("doc_id").distinct().count()
        if name == "substring_dedup":
            again = substring_dedup.remove_repeats(table, window=corpus_pipeline.REPEAT_WORDS)
            assert out.count() == again.where("n_removed = 0 or n_removed < n_words").count()
        if name == "source_mix":
            size = source_mix.word_count(F.col("text"))
            want = {r[0]: r[1] for r in source_mix.mix(table, size).groupBy("source").agg(F.sum("taken")).collect()}
            assert {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(size)).collect()} == {k: v for k, v in want.items() if v}
        table = out
    assert table.where("not round_trip").count() == 0 and table.count() > 0
    assert corpus_pipeline.language_id(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0
