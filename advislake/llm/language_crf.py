"""Language identification: a linear-chain conditional random field labels the words of a text.

A word's features are itself (the lexicon), its prefixes and suffixes and its byte 2- and 3-grams, hashed
into one weight table; transitions between the labels of neighbouring words are learned with them, on
sequences in which stretches of several languages follow each other. Forward-backward gives each word's
label probabilities, and a document's language is the one with the largest share of its letters.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.components import written
from advislake.llm.registry import register

BUCKETS = 1 << 18
SAMPLE_DOCS = 400  # labelled documents of each language that the model is fitted on
SAMPLE_CHARS = 20_000  # of a longer labelled document a stretch of this size is drawn
SAMPLE_TOTAL = 64_000_000  # characters of the whole sample
MOST_LABELS = 256  # languages a field tells apart; each has a weight for every bucket
FEATURE_WORDS = 8_192
DRAW_PARTS = 64  # parts of a label that are ranked apart
CHAIN = 32  # words of a training sequence
STRETCH = 12  # mean words before a training sequence changes its document
LANE = 256  # words of a text that advance one by one; longer texts are cut and joined exactly

IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True
IS_LETTER[192:256] = True  # lead bytes of two bytes and more


def _features(w: W.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the picked words, and the first place of each word's features.

    FEATURE_WORDS words are handled at a time, as their n-grams take far more room than the result.
    """
    parts, firsts, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for low in range(0, len(pick), FEATURE_WORDS):
        at, first = _features_of(w, pick[low:low + FEATURE_WORDS])
        parts.append(at)
        firsts.append(first + n)
        n += len(at)
    return np.concatenate(parts), np.concatenate(firsts)


def _features_of(w: W.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, size = w.start[pick], (w.end - w.start)[pick]
    owner = np.repeat(np.arange(len(pick)), size)
    base = np.concatenate([[0], np.cumsum(size)])
    spot = np.arange(base[-1]) - base[owner]
    b = W.LOWER[w.data[np.repeat(start, size) + spot]].astype(np.uint64)
    pad = np.concatenate([b, np.zeros(3, np.uint64)])
    two = pad[:-3] | (pad[1:-2] << np.uint64(8))
    three = two | (pad[2:-1] << np.uint64(16))
    four = three | (pad[3:] << np.uint64(24))
    left = size[owner] - spot  # bytes from here to the word's end
    owners, codes = [np.arange(len(pick))], [W.spans_hash(w.data, start, start + size, W.FOLDED)]

    def add(where, code, tag):
        owners.append(owner[where])
        codes.append(code[where] + np.uint64(tag << 40))

    add(left >= 2, two, 1)
    add(left >= 3, three, 2)
    for n, code in ((1, b), (2, two), (3, three)):
        add((spot == 0) & (left >= n), code, 2 + n)
    for n, code in ((1, b), (2, two), (3, three), (4, four)):
        add(left == n, code, 5 + n)
    owners, codes = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(owners, kind="stable")
    at = (W.mix(codes[order]) >> np.uint64(64 - 18)).astype(np.int32)
    return at, np.searchsorted(owners[order], np.arange(len(pick)))


def _distinct(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each distinct spelling, ascending, and the number of the spelling of every word."""
    _, first, which = np.unique(w.hashes(True), return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    return first[order], number[which]


class Field:
    """Weights of a fitted field over ``labels``."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        n = len(labels)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)
        self.begin = np.zeros(n, np.float32)

    def emissions(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.labels)), np.float32)
        s = np.add.reduceat(self.weights[features], first)
        return np.exp(s - s.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-12)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int, seed: int) -> None:
        """AdaGrad on the likelihood of sequences of CHAIN words drawn from labelled texts."""
        random = np.random.RandomState(seed)
        col = pa.array(texts, pa.string())
        data, at = W.text_bytes(col)
        w = W.Words(data, at, 0, len(col))
        if not len(w.start):
            return
        pick, which = _distinct(w)
        features, first = _features(w, pick)
        last = np.append(first[1:], len(features))
        label = labels[w.row]
        grad_w, grad_m = np.full_like(self.weights, 1e-2), np.full_like(self.moves, 1e-2)
        rows = np.arange(CHAIN)
        # a stretch starts anywhere in the sample; label by label, so that all are seen alike
        by_label = [np.flatnonzero(label == k) for k in range(len(self.labels))]
        by_label = [(k, x) for k, x in enumerate(by_label) if len(x)]
        batch = 128
        for _ in range(max(1, epochs * len(w.start) // (batch * CHAIN))):
            at_word = np.empty((batch, CHAIN), np.int64)
            change = random.random_sample((batch, CHAIN)) < 1.0 / STRETCH
            change[:, 0] = True
            for i, t in zip(*np.nonzero(change), strict=True):
                k, own = by_label[random.randint(len(by_label))]
                at_word[i, t:] = own[random.randint(len(own))] + rows[:CHAIN - t]
            np.minimum(at_word, len(w.start) - 1, out=at_word)
            gold, spell = label[at_word], which[at_word]
            used, inverse = np.unique(spell, return_inverse=True)
            n = (last - first)[used]
            flat = features[np.repeat(first[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            cut = np.concatenate([[0], np.cumsum(n)[:-1]])
            e = self.emissions(flat, cut)[inverse.reshape(spell.shape)]
            moves = np.exp(self.moves - self.moves.max())
            alpha, beta = np.empty_like(e), np.ones_like(e)
            a = e[:, 0] * np.exp(self.begin)
            alpha[:, 0] = a / a.sum(1, keepdims=True)
            for t in range(1, CHAIN):
                a = (alpha[:, t - 1] @ moves) * e[:, t]
                alpha[:, t] = a / a.sum(1, keepdims=True)
            for t in range(CHAIN - 2, -1, -1):
                b = (e[:, t + 1] * beta[:, t + 1]) @ moves.T
                beta[:, t] = b / b.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            pair = alpha[:, :-1, :, None] * moves * (e * beta)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            expected = pair.sum((0, 1))
            np.add.at(expected, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1.0)
            g = expected / batch
            grad_m += g * g
            self.moves -= 0.3 * g / np.sqrt(grad_m)
            np.put_along_axis(p, gold[..., None], np.take_along_axis(p, gold[..., None], 2) - 1, 2)
            by_spelling = np.zeros((len(used), p.shape[2]), np.float32)
            np.add.at(by_spelling, inverse.ravel(), p.reshape(-1, p.shape[2]))
            g = np.repeat(by_spelling, n, 0)
            touched, where = np.unique(flat, return_inverse=True)
            total = np.zeros((len(touched), p.shape[2]), np.float32)
            np.add.at(total, where, g)
            grad_w[touched] += total * total
            self.weights[touched] -= 0.15 * total / np.sqrt(grad_w[touched])

    def shares(self, w: W.Words) -> np.ndarray:
        """Letters of each row by label, expected under the field."""
        n = len(self.labels)
        out = np.zeros((w.rows, n))
        if not len(w.start):
            return out
        pick, which = _distinct(w)
        e = self.emissions(*_features(w, pick))[which]
        letters = np.concatenate([[0], np.cumsum(IS_LETTER[w.data[w.start[0]:w.end[-1]]])])
        weight = (letters[w.end - w.start[0]] - letters[w.start - w.start[0]]).astype(np.float32)
        # lanes of LANE words at most
        lanes = -(-w.count // LANE)
        row = np.repeat(np.arange(w.rows), lanes)
        number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = w.first[row] + number * LANE
        size = np.minimum(w.first[row + 1] - begin, LANE)
        order = np.argsort(-size, kind="stable")
        row, number, begin, size = row[order], number[order], begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, LANE + 1), "right")  # lanes that have a t-th word
        moves = np.exp(self.moves - self.moves.max()).astype(np.float32)
        enter = np.tile(np.exp(self.begin), (len(row), 1)).astype(np.float32)
        leave = np.ones((len(row), n), np.float32)
        self._join(e, begin, size, row, number, live, moves, enter, leave)
        alpha = np.empty_like(e)
        for t in range(int(size[0])):
            k = live[t]
            a = enter[:k] if t == 0 else alpha[begin[:k] + t - 1]
            a = (a @ moves if t else np.where(number[:k, None] > 0, a @ moves, a)) * e[begin[:k] + t]
            alpha[begin[:k] + t] = a / a.sum(1, keepdims=True)
        beta = leave.copy()
        total = np.zeros((len(row), n), np.float64)
        for t in range(int(size[0]) - 1, -1, -1):
            k = live[t]
            p = alpha[begin[:k] + t] * beta[:k]
            total[:k] += p / p.sum(1, keepdims=True) * weight[begin[:k] + t, None]
            b = (e[begin[:k] + t] * beta[:k]) @ moves.T
            beta[:k] = b / b.sum(1, keepdims=True)
        np.add.at(out, row, total)
        return out

    def _join(self, e, begin, size, row, number, live, moves, enter, leave):
        """Messages into and out of the lanes of long texts, from each lane's product of matrices."""
        long_rows = np.unique(row[number > 0])
        if not len(long_rows):
            return
        n = len(moves)
        mine = np.flatnonzero(np.isin(row, long_rows))
        through = np.tile(np.eye(n, dtype=np.float32), (len(mine), 1, 1))
        for t in range(int(size[mine].max())):
            k = int(np.searchsorted(-size[mine], -(t + 1), "right"))
            step = through[:k] @ moves
            if t == 0:
                step = np.where((number[mine[:k]] > 0)[:, None, None], step, through[:k])
            step = step * e[begin[mine[:k]] + t][:, None, :]
            through[:k] = step / step.sum((1, 2), keepdims=True)
        place = {(int(row[i]), int(number[i])): (k, int(i)) for k, i in enumerate(mine)}
        for r in long_rows:
            lanes = [place[(int(r), j)] for j in range(int((row == r).sum()))]
            a = enter[lanes[0][1]].copy()
            for k, i in lanes:
                enter[i] = a
                a = a @ through[k]
                a = a / a.sum()
            b = np.ones(n, np.float32)
            for k, i in reversed(lanes):
                leave[i] = b
                b = through[k] @ b
                b = b / b.sum()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _stretch(text: Column, id_: Column, size: int, seed: int) -> Column:
    """The text, or the whole words of a random stretch of ``size`` characters of a longer one (the stretch itself, if
    it has no whole word)."""
    plain = F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")  # a stretch of white space only would have no words
    begin = F.pmod(F.xxhash64(F.lit(seed), F.lit("stretch"), id_, text), F.greatest(F.length(plain) - size + 1, F.lit(1))) + 1
    cut = F.substring(plain, begin.cast("int"), F.lit(size))
    words = F.regexp_extract(cut, r"(?s)^[^ ]* (.*) [^ ]*$", 1)
    return F.when(F.length(text) <= size, text).otherwise(F.when(F.trim(words) == "", cut).otherwise(words))


def _trained(epochs: int, seed: int):
    """Fits one field on all rows (label, draw, sample) of its partition and gives its arrays as one row."""
    def run(batches):
        rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("label", "draw", "sample")), strict=True))
        labels = sorted({r[0] for r in rows})
        field = Field(labels)
        if rows:
            number = {x: k for k, x in enumerate(labels)}
            field.fit([r[2] for r in rows], np.array([number[r[0]] for r in rows]), epochs, seed)
        arrays = [pa.array([x.tobytes()], pa.binary()) for x in (field.weights, field.moves, field.begin)]
        yield pa.RecordBatch.from_arrays([pa.array([labels], pa.list_(pa.string())), *arrays], names=["labels", "weights", "moves", "begin"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", epochs: int = 2, seed: int = 5,
        sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on at most ``sample_docs`` texts of each label; of one of more than ``sample_chars``
    characters, on the words of a random stretch of that size.

    The texts with the lowest hash of doc_id and text are drawn, so rows without ids and different texts of
    one id are drawn like any other and equal rows count once; hashes alone are ranked, then their texts are
    fetched. With many labels the sample shrinks so that it holds SAMPLE_TOTAL characters at most, one text
    a label at least; more than MOST_LABELS labels are refused, as the weights grow with them. The sample
    goes to one task, which fits the field; the driver gets the weights. Rows with null text or label are
    no examples. Without examples the field has no labels.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col("doc_id").alias("id"), F.col(lang).alias("label"), F.col(text).alias("sample")) \
        .withColumn("draw", F.xxhash64(F.lit(seed), "id", "sample"))
    # a label may hold most rows: parts of a label are ranked first, then what is left of all parts
    ids = labelled.select("label", "draw").distinct()
    for by in (["label", F.pmod("draw", F.lit(DRAW_PARTS))], ["label"]):
        rank = F.row_number().over(Win.partitionBy(*by).orderBy("draw"))
        ids = ids.drop("rank").withColumn("rank", rank).where(F.col("rank") <= sample_docs)
    ids = written(ids, "language-draws")
    labels = ids.select("label").distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    each = max(1, SAMPLE_TOTAL // (sample_chars * max(labels, 1)))
    chosen = ids.where(F.col("rank") <= each).select("label", "draw")
    sample = labelled.join(F.broadcast(chosen), ["label", "draw"]).select(
        "label", "draw", _stretch(F.col("sample"), F.col("id"), sample_chars, seed).alias("sample")).dropDuplicates(["label", "draw"])
    row = sample.repartition(1).mapInArrow(_trained(epochs, seed), "labels array<string>, weights binary, moves binary, begin binary").first()
    field = Field(list(row["labels"]) if row else [])
    for name in ("weights", "moves", "begin") if row else ():
        held = getattr(field, name)
        setattr(field, name, np.frombuffer(bytes(row[name]), np.float32).reshape(held.shape))
    return field


def label(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the share of the text's letters in words of that language.

    ``und`` with score 0 for null, empty and letterless texts, and where the field has no labels. One pass
    over whole texts without a shuffle. Ties go to the first label by code point. Other columns pass
    through; columns named as added ones are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, text))
            for low, high in W.blocks(at):
                w = W.Words(data, at, low, high)
                langs, scores = ["und"] * w.rows, np.zeros(w.rows)
                if field.labels:
                    share = field.shares(w)
                    best, whole = share.argmax(1), share.sum(1)
                    for i in np.flatnonzero(whole > 0):
                        raw = data[at[low + i]:at[low + i + 1]]
                        if not IS_LETTER[:128][raw[raw < 128]].any() and not any(c.isalpha() for c in raw.tobytes().decode()):
                            continue
                        langs[i], scores[i] = field.labels[best[i]], min(1.0, share[i, best[i]] / whole[i])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


@register("op5_language_crf")
def op5_language_crf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    field = fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return label(docs.select("doc_id", "text"), field).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
