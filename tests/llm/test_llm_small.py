"""Parts of the training-data operators that need no Spark session, against brute force."""
import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from advislake.llm import components, embedding_dedup, kneser_ney, language_crf, minmax_dedup, quality_rules, recurrent_lm
from advislake.llm import sentence_pieces as S
from advislake.llm import substring_dedup, url_filters
from advislake.llm import words as W

TEXTS = ["", " ", "one", "a b  c\n", "\tx\x0b\x0c\r\ny ", "é ü z  w", "A a A a", "\x1cq\x85r", "word " * 300,
         "日本 語 😀 test", "Ab aB ab", "no-break space"]


def split(text):
    return [w.decode() for w in text.encode().split()]


def words_of(texts):
    data, at = W.text_bytes(pa.array(texts, pa.string()))
    return W.Words(data, at, 0, len(texts))


def test_words_and_hashes():
    w = words_of(TEXTS)
    got = [[bytes(w.data[w.start[j]:w.end[j]]).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(TEXTS))]
    assert got == [split(t) for t in TEXTS]
    flat = list(itertools.chain(*got))
    assert len(set(w.hashes().tolist())) == len(set(flat))
    fold = {}
    for word, h in zip(flat, w.hashes(True).tolist(), strict=True):
        low = word.translate({c: c + 32 for c in range(65, 91)})
        assert fold.setdefault(low, h) == h
    assert len(set(fold.values())) == len(fold)


def test_words_do_not_cross_rows_and_long_texts_are_sliced():
    w = words_of(["ab", "cd", "", "ef"])
    assert w.count.tolist() == [1, 1, 0, 1]
    long = "x" * 2_500_000 + " y"
    a, b = words_of([long]).hashes(), words_of(["q " + long]).hashes()
    assert a.tolist() == b[1:].tolist()


@pytest.mark.parametrize("seed", range(3))
def test_quality_counts_by_brute_force(seed):
    r = random.Random(seed)
    texts = TEXTS + ["\n".join(" ".join(r.choice(["a", "b", "c|", "D#", "e!", "x."]) for _ in range(r.randint(0, 9)))
                               for _ in range(r.randint(0, 12))) for _ in range(40)]
    data, at = W.text_bytes(pa.array(texts, pa.string()))
    columns, _ = quality_rules.judge(data, at, 0, len(texts), 0.5, 60)
    got = dict(zip([n for n, _ in quality_rules.OUTPUT], columns, strict=True))
    for i, t in enumerate(texts):
        ws = split(t)
        assert got["n_words"][i] == len(ws)
        assert got["word_chars"][i] == sum(map(len, ws))
        assert got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        assert got["n_dup_lines"][i] == dup
        grams = collections.Counter(tuple(ws[k:k + 3]) for k in range(len(ws) - 2))
        covered = {k + j for k in range(len(ws) - 2) if grams[tuple(ws[k:k + 3])] > 1 for j in range(3)}
        assert got["n_repeat_words"][i] == len(covered)
        assert got["base_failed"][i] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def test_wildcards_against_regular_expressions():
    import re
    globs = ["*.com/**", "a*b", "**x", "?b", "**", "*", "*.example.com/en/**", "a**b*c", "é*"] + [f"**{k}{'z' * k}" for k in range(9)]
    urls = [".com/", ".x.com/a/b", "ab", "acb", "a/b", "x", "ax/x", "cb", "/b", "", ".example.com/en/", "aXX/bYc", "aXXbY/c", "éa",
            "8zzzzzzzz", ".m.example.com/en/1.html"]
    raw = [u.encode() for u in urls]
    size = np.array([len(x) for x in raw])
    hits = url_filters.Automaton(globs).run(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
    for j, g in enumerate(globs):
        # the automaton works on bytes, so one ? is one byte
        for i, u in enumerate(urls):
            assert hits[i, j] == bool(re.match(url_filters._regex(g).replace("''", "'"), u)), (g, u)


def test_first_minimum():
    g = np.random.RandomState(1).randint(0, 6, 200).astype(np.uint64)
    for size in (1, 2, 5, 28, 43):
        got = substring_dedup._sliding_first_min(g, size)[:len(g) - size + 1]
        assert got.tolist() == [i + int(np.argmin(g[i:i + size])) for i in range(len(g) - size + 1)]


def test_shingle_sets():
    texts = ["a b a b", "A B", "x", "", "c a b c"]
    data, at = W.text_bytes(pa.array(texts))
    values, first = minmax_dedup.shingle_sets(data, at, 0, len(texts), 2)
    sets = [set(values[first[i]:first[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 3] and sets[1] < sets[0] and len(sets[0] & sets[4]) == 1
    whole, bands = minmax_dedup.signatures(values, first)
    assert len(whole) == 4 and bands.shape == (4, minmax_dedup.BANDS)


def test_common_counts(monkeypatch):
    monkeypatch.setattr(minmax_dedup, "COLUMNS", 5)
    r = np.random.RandomState(2)
    a, b = ([np.unique(r.randint(0, 40, r.randint(0, 30))).astype(np.uint64) for _ in range(n)] for n in (7, 9))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert minmax_dedup._common_counts(a, b).tolist() == want


def test_min_and_max_agree_with_the_similarity():
    r = np.random.RandomState(3)
    base = W.mix(r.randint(0, 1 << 62, 900).astype(np.uint64))
    a, b = base[:800], base[100:]  # similarity 7/9
    hits = []
    for x, y in zip(minmax_dedup.FLIPS.ravel(), minmax_dedup.FACTORS.ravel(), strict=True):
        va, vb = (a ^ x) * y, (b ^ x) * y
        hits += [va.min() == vb.min(), va.max() == vb.max()]
    assert abs(np.mean(hits) - 7 / 9) < 0.08


def test_close_vectors_by_brute_force():
    r = np.random.RandomState(5)
    centres = r.standard_normal((6, 12))
    x = np.concatenate([c + 0.15 * r.standard_normal((25, 12)) for c in centres]) * r.uniform(0.1, 9, (150, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    p, q = embedding_dedup._close(x[:70], x[70:], axes, 0.95)
    want = np.argwhere(u[:70] @ u[70:].T >= 0.95)
    assert sorted(zip(p.tolist(), q.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and len(want)
    label = components.forest(np.array([9, 4, 7, 1, 3]), np.array([0, 1]), np.array([1, 2]))
    assert label.tolist() == [4, 4, 4, 1, 3]


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(S.default_model())


def encoded(encoder, texts):
    data, at = W.text_bytes(pa.array(texts, pa.string()))
    out = []
    for low, high in W.blocks(at, 4000):
        ids, n = encoder.encode(data, at, low, high)
        cut = np.concatenate([[0], np.cumsum(n)])
        out += [ids[cut[i]:cut[i + 1]].tolist() for i in range(high - low)]
    return out


def test_pieces_equal_the_library(pieces):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    r = random.Random(4)
    texts = TEXTS + ["a▁b", "  two  spaces ", "<s> </s> <0x41>", "İstanbul ﬁ Å", "…" * 5, "the" * 90, "\n\n\tx", "\x00"]
    texts += ["".join(r.choice("etaoin shrdlu THE..,é\n▁日") for _ in range(r.randint(1, 200))) for _ in range(300)]
    assert encoded(S.Encoder(pieces), texts) == [lib.encode(t) for t in texts]


def test_known_parts_are_bounded(pieces, monkeypatch):
    monkeypatch.setattr(S, "KNOWN_PARTS", 3)
    one = S.Encoder(pieces)
    texts = [f"word{k} other{k}" for k in range(40)]
    assert encoded(one, texts) == encoded(S.Encoder(pieces), texts[:20]) + encoded(S.Encoder(pieces), texts[20:])
    assert len(one.known) <= 3


def test_unigram_pieces_by_brute_force(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.escape_whitespaces = True
    scores = {"▁": -2.0, "a": -3.0, "b": -3.1, "ab": -4.0, "▁a": -3.9, "aba": -6.5, "ba": -4.4, "bb": -9.0, "▁ab": -5.05}
    for text, kind, score in [("<unk>", 2, 0), ("<s>", 3, 0), ("</s>", 3, 0), *[(t, 1, s) for t, s in scores.items()]]:
        p = model.pieces.add()
        p.piece, p.type, p.score = text, kind, score
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    tables = S.Pieces(path)
    names = [p.piece for p in model.pieces]

    def best(part):
        if not part:
            return 0.0
        return max((s + best(part[len(t):]) for t, s in scores.items() if part.startswith(t)), default=-1e9)

    texts = ["".join(p) for n in range(1, 7) for p in itertools.product("ab", repeat=n)] + ["ab ba", " a", "b  bab"]
    for text, ids in zip(texts, encoded(S.Encoder(tables), texts), strict=True):
        got = [names[i] for i in ids]
        assert "".join(got) == "▁" + text.replace(" ", "▁")
        assert abs(sum(scores[t] for t in got) - best("▁" + text.replace(" ", "▁"))) < 1e-9


def test_language_lanes_are_joined_exactly(monkeypatch):
    field = language_crf.Field(["de", "en"])
    field.fit(["the house of the king is red " * 30, "das haus des königs ist rot und alt " * 30], np.array([1, 0]), 3, 1)
    texts = ["the king is red " * 40 + "das haus ist alt " * 60, "the house", "", "das haus des königs " * 200]
    whole = field.shares(words_of(texts))
    monkeypatch.setattr(language_crf, "LANE", 7)
    assert np.allclose(field.shares(words_of(texts)), whole, rtol=1e-4)
    assert whole[3].argmax() == 0 and whole[1].argmax() == 1 and whole[2].sum() == 0
    # a forward-backward of plain loops on one text
    w = words_of([texts[0]])
    pick, which = language_crf._distinct(w)
    e = field.emissions(*language_crf._features(w, pick))[which].astype(float)
    m = np.exp(field.moves - field.moves.max()).astype(float)
    alpha, beta = [e[0] * np.exp(field.begin)], [np.ones(2)]
    for t in range(1, len(e)):
        a = alpha[-1] @ m * e[t]
        alpha.append(a / a.sum())
    for t in range(len(e) - 2, -1, -1):
        b = m @ (e[t + 1] * beta[0])
        beta.insert(0, b / b.sum())
    p = np.array(alpha) * np.array(beta)
    letters = np.array([sum(c.isalpha() for c in x) for x in split(texts[0])])
    assert np.allclose((p / p.sum(1, keepdims=True) * letters[:, None]).sum(0), whole[0], rtol=1e-3)


def lm_vocabulary(texts):
    w = words_of(texts)
    h, tail = np.append(w.hashes(True), [recurrent_lm.END] * len(texts)), np.append(recurrent_lm._tail(w), [-1] * len(texts))
    keys, first, n = np.unique(h, return_index=True, return_counts=True)
    tails = tail[first]
    order = np.lexsort((keys, -n))
    own = tails >= 0
    return recurrent_lm.Vocabulary(keys[order], tails[order], n[order], int(n.sum()), len(keys),
                                   np.bincount(tails[own], n[own], recurrent_lm.TAILS).astype(np.int64),
                                   np.bincount(tails[own], minlength=recurrent_lm.TAILS))


def test_gradients_of_the_recurrent_model():
    texts = ["a b c a b", "b c a", "c c c b a a b"]
    model = recurrent_lm.Recurrent(lm_vocabulary(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    symbol, _, _, first = model.v.tokens(batch)
    for n in model.p:
        model.p[n] = model.p[n].astype(np.float64) + 0.05 * np.random.RandomState(2).standard_normal(model.p[n].shape)
    before = {n: v.copy() for n, v in model.p.items()}
    loss = lambda: -model.score(symbol, first).sum()
    base = loss()
    trained = recurrent_lm.Recurrent(model.v, {n: v.copy() for n, v in before.items()})
    trained.train(symbol, first, 1e-4)
    assert -trained.score(symbol, first).sum() < base  # a small step goes down
    # numeric check along the step's direction of each parameter
    for n in before:
        step = trained.p[n] - before[n]
        if np.abs(step).sum():
            model.p = {k: (v + 1e-3 * np.sign(step) if k == n else v.copy()) for k, v in before.items()}
            assert loss() < base, n


def test_recurrent_probabilities_sum_to_one():
    model = recurrent_lm.Recurrent(lm_vocabulary(["a b c", "a b", "zeta Zeta, ZETA"]))
    h = np.random.RandomState(1).standard_normal((1, recurrent_lm.UNITS)).astype(np.float32)
    for n in model.p:
        model.p[n] = model.p[n] + 0.1
    words = np.arange(model.v.words)
    common, _ = model.log_probs(np.repeat(h, len(words), 0), words)
    tails, _ = model.log_probs(np.repeat(h, recurrent_lm.TAILS, 0), recurrent_lm.WORDS + np.arange(recurrent_lm.TAILS))
    empty = [k for k in range(recurrent_lm.CLASSES) if model.v.cuts[k] == model.v.cuts[k + 1]]
    logits = h @ model.p["c"] + model.p["cb"]
    share = np.exp(logits - logits.max())
    unused = (share / share.sum())[0, empty].sum()  # classes without words
    assert abs(np.exp(common).sum() + np.exp(tails).sum() + unused - 1) < 1e-4


def test_words_of_two_casings_sum_to_one(monkeypatch):
    monkeypatch.setattr(recurrent_lm, "WORDS", 3)
    texts = ["a a a a b b b b", "Zeta zeta ZETA zeta, Zeta,", "oMEGA Omega omega theta", "Theta Iota iota"]
    v = lm_vocabulary(texts)
    model = recurrent_lm.Recurrent(v)
    batch = pa.RecordBatch.from_arrays([pa.array(sorted({x for t in texts for x in t.split()}))], names=["text"])
    symbol, rank, h, first = v.tokens(batch)
    assert (rank >= 0).all()
    state = np.random.RandomState(1).standard_normal((1, recurrent_lm.UNITS)).astype(np.float32)
    p = np.exp(model.log_probs(np.repeat(state, len(symbol), 0), symbol)[0])
    tail = symbol >= recurrent_lm.WORDS
    p[tail] *= 10 ** (v.log_count[rank[tail]] - v.tail_log[symbol[tail] - recurrent_lm.WORDS])
    by_word = collections.defaultdict(set)
    for word, x in zip(h.tolist(), p.tolist(), strict=True):
        by_word[word].add(round(x, 9))
    assert all(len(x) == 1 for x in by_word.values())  # whatever its casing
    assert sum(map(max, by_word.values())) <= 1 + 1e-5


def test_texts_are_scored_alike_alone_and_together():
    texts = ["a b c a b " * 30, "b", "", "c a " * 50]
    model = recurrent_lm.Recurrent(lm_vocabulary(texts))
    together = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    symbol, _, _, first = model.v.tokens(together)
    scores = model.score(symbol, first)
    for i, t in enumerate(texts):
        symbol, _, _, first = model.v.tokens(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]))
        assert abs(model.score(symbol, first)[0] - scores[i]) < 1e-3


def test_windows_give_every_token_once_and_long_texts_do_not_train_alone(monkeypatch):
    size = [1, 5000, 3, 40, 1, 700, 2]
    first = np.concatenate([[0], np.cumsum(size)])
    symbol = np.arange(first[-1], dtype=np.int32) % 7
    windows = list(recurrent_lm._windows(symbol, first, first, 4))
    assert sorted(np.concatenate([w[0] for w in windows])) == list(range(first[-1]))
    lane = {}
    for at, cut, last, fresh in windows:
        for low, high in zip([0, *cut[:-1]], cut, strict=True):
            for i in range(low, high):  # the next of the lane's text, or a text's first
                assert fresh[i] == (at[i] in first[:-1]) and (fresh[i] or at[i] == lane[i - low] + 1)
                assert last[i] == (recurrent_lm.WORDS + recurrent_lm.TAILS if fresh[i] else symbol[at[i] - 1])
                lane[i - low] = at[i]
    seen, steps = [], []
    monkeypatch.setattr(recurrent_lm, "STRETCH", 64)
    inner = recurrent_lm._windows
    monkeypatch.setattr(recurrent_lm, "_windows", lambda *a: (seen.append(w[0]) or steps.extend(w[1]) or w for w in inner(*a)))
    model = recurrent_lm.Recurrent(lm_vocabulary(["a b c"]))
    assert model.train(np.zeros(first[-1], np.int32), first, 0.1) == first[-1]
    assert sorted(np.concatenate(seen)) == list(range(first[-1])) and len(steps) < 200  # 5,000 and more when it trained alone


def test_states_and_probabilities_are_those_of_a_plain_loop():
    texts = ["a b c a b", "b zeta, c a", "", "c " * 70]
    model = recurrent_lm.Recurrent(lm_vocabulary(texts))
    random = np.random.RandomState(5)
    for big in (0.3, 30.0):  # beyond the range of floats, too
        model.p = {n: (v + big * random.standard_normal(v.shape)).astype(np.float64) for n, v in model.p.items()}
        symbol, _, _, first = model.v.tokens(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
        p, u, log_softmax = model.p, recurrent_lm.UNITS, lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))
        for i, got in enumerate(model.score(symbol, first)):
            h, last, want = np.zeros(u), recurrent_lm.WORDS + recurrent_lm.TAILS, 0.0
            for s in symbol[first[i]:first[i + 1]]:
                x, r = p["x"][last], h @ p["u"]
                z, reset = sigmoid(x[:u] + r[:u]), sigmoid(x[u:2 * u] + r[u:2 * u])
                h = h + z * (np.tanh(x[2 * u:] + reset * r[2 * u:]) - h)
                k = int(model.class_of(np.array([s]))[0])
                want += log_softmax(h @ p["c"] + p["cb"])[k]
                if s < recurrent_lm.WORDS:
                    a, b = model.v.cuts[k], model.v.cuts[k + 1]
                    want += log_softmax(p["w"][a:b] @ h + p["wb"][a:b])[s - a]
                last = s
            assert abs(got - want) < 1e-3 * max(1, abs(want))


def test_grams_begin_after_spaces():
    data, at = W.text_bytes(pa.array(["ab", "", "É1"]))
    gram, first = kneser_ney._grams(data, at, 0, 3)
    s, n = kneser_ney.SPACE, kneser_ney.SYMBOLS
    assert first.tolist() == [0, 2, 2, 4]
    assert gram.tolist() == [((s * n + s) * n + s) * n + 0, ((s * n + s) * n + 0) * n + 1,
                             ((s * n + s) * n + s) * n + kneser_ney.CAPITAL, ((s * n + s) * n + kneser_ney.CAPITAL) * n + kneser_ney.DIGIT]


def test_no_two_characters_are_spelled_alike():
    codes = np.array([c for c in [*range(0x20, 0x3000), 0x4E00, 0x9FFF, 0xAC00, 0x1F600, 0x1F601, 0x20000, 0x10FFFF] if chr(c).isalpha() or c >= 0x300], np.uint32)
    units, first = kneser_ney._spelled(codes)
    assert units.min() >= 0 and units.max() < kneser_ney.SYMBOLS
    spelled = {tuple(units[a:b]) for a, b in itertools.pairwise(first)}
    folded = sum(c < 0x300 and chr(c).isupper() and chr(c).lower() in kneser_ney.ACCENTS for c in codes.tolist()) - 1
    assert len(spelled) == len(codes) - folded
