"""LM scoring: a gated recurrent model with class-factored output over corpus-wide word counts.

Counts of all words are gathered from every training text. The commonest WORDS words have vectors of
their own, grouped into classes by frequency; all other words belong to tail classes by their ending. The network gives P(class | history) and, for common words, P(word | class, history); within a
tail class a word has its corpus-wide count, by a join. So the model is a distribution over all words that
occur, with one unit of count in each tail class for all unseen ones.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.components import written
from advislake.llm.registry import register

WORDS = 2048  # words with vectors of their own
NAMED = 100_000  # commonest words whose counts go along with the tasks; the others' come by a join
CLASSES = 32
TAILS = 64
UNITS = 24
BACK = 16  # steps of a window
LONGER = 16  # times these steps at most, when few texts are left
LANES = 256  # lanes of texts that are trained together
SCORED = 512  # lanes of texts that are scored together
BLOCK = 1024  # tokens whose classes are summed at a time, in the near cache
STRETCH = 2048  # tokens that are trained from one state
RATE = 0.2  # first rate of learning; 0.1 served for windows of a quarter of the tokens
ROUNDS = 2  # each trains on a slice of its own; together they have every training text once
END = np.uint64(0x0E4D0E4D0E4D0E4D)
LEADING = np.uint64(48)  # below the bits by which a search among the named words begins


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tail(w: W.Words) -> np.ndarray:
    """Tail class of every word: punctuation at the end, last two letters. As counts are of lower-cased words,
    it depends on the lower-cased word alone."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    low = W.LOWER[w.data[w.end - 1]]
    mark = (low < 0x80) & ~((low >= 97) & (low <= 122)) & ~((low >= 48) & (low <= 57))
    end = np.maximum(w.end - 1 - mark, w.start)
    one, two = W.LOWER[w.data[end]].astype(np.uint64), W.LOWER[w.data[np.maximum(end - 1, w.start)]].astype(np.uint64)
    ending = W.mix(one | (two << np.uint64(8))) % np.uint64(TAILS // 2)
    return mark.astype(np.int64) * (TAILS // 2) + ending.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, tail, c): hash, tail class and number of each token of ``text``, one end a row included."""
    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, "text"))
            hashes, tails = [], []
            for low, high in W.blocks(at):
                w = W.Words(data, at, low, high)
                hashes.append(w.hashes(True))
                tails.append(_tail(w).astype(np.int8))
            if not batch.num_rows:
                continue
            keys, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            keys, n = np.append(keys, END), np.append(n, batch.num_rows)
            tail = np.append(np.concatenate(tails)[first], 0)  # the class that an end is scored in, if it is rare
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(tail.astype(np.int32)),
                                              pa.array(n.astype(np.int64))], names=["h", "tail", "n"])

    rows = docs.select("text").mapInArrow(run, "h long, tail int, n long")
    return rows.groupBy("h").agg(F.max("tail").alias("tail"), F.sum("n").alias("c"))


class Vocabulary:
    """The commonest words, their classes, and totals of the tail classes."""

    def __init__(self, keys: np.ndarray, tails: np.ndarray, counts: np.ndarray, total: int, types: int,
                 tail_counts: np.ndarray, tail_types: np.ndarray):
        """Words come in falling order of count; tail_* are sums over all words, the commonest included."""
        self.total, self.types = total, types
        n = min(WORDS, len(keys))
        root = np.cumsum(np.sqrt(counts[:n].astype(float)))
        group = np.minimum((root / root[-1] * CLASSES).astype(np.int64), CLASSES - 1) if n else np.zeros(0, np.int64)
        self.cuts = np.searchsorted(group, np.arange(CLASSES + 1))
        self.group = group
        tail_counts, tail_types = tail_counts.copy(), tail_types.copy()
        own = tails[:n] >= 0
        np.subtract.at(tail_counts, tails[:n][own], counts[:n][own])
        np.subtract.at(tail_types, tails[:n][own], 1)
        self.tail_counts = tail_counts
        self.tail_log = np.log10(tail_counts + tail_types + 1.0)
        self.log_count = np.log10(counts + 1.0)
        order = np.argsort(keys)
        # the greatest hash stands at the end, too, so that a search ends; it counts only for a word that has it
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.rank = np.append(order, order[-1] if len(order) and keys[order[-1]] == self.keys[-1] else -1)
        self.begin = np.searchsorted(keys[order], np.arange(1 << 16, dtype=np.uint64) << LEADING).astype(np.int32)
        self.words = n
        self.unigram = counts[:n].astype(float)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash among the named words, -1 for others."""
        # from the first key of the same leading bits on, until all are found or passed
        at = self.begin[h >> LEADING]
        key = self.keys[at]
        open_ = np.flatnonzero(key < h)
        while len(open_):
            at[open_] += 1
            key[open_] = self.keys[at[open_]]
            open_ = open_[key[open_] < h[open_]]
        return np.where(key == h, self.rank[at], -1)

    def tokens(self, batch: pa.RecordBatch):
        """Of the rows of a batch: symbol of every token (word rank, or WORDS + tail class), rank among the
        named words, hash, and the first place of each row; a row's last token is its end."""
        data, at = W.text_bytes(W.column(batch, "text"))
        parts, counts = [], []
        for low, high in W.blocks(at):
            w = W.Words(data, at, low, high)
            stop = w.first[1:]
            h = np.insert(w.hashes(True), stop, END)
            tail = np.insert(_tail(w), stop, 0)
            rank = self.look_up(h)
            symbol = np.where((rank >= 0) & (rank < self.words), rank, WORDS + tail).astype(np.int32)
            parts.append((symbol, rank.astype(np.int32), h))
            counts.append(w.count + 1)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(1, np.int64)
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), first


class Recurrent:
    """Gated recurrent network; ``params`` are float32 arrays of fixed size, whatever the corpus."""

    def __init__(self, vocabulary: Vocabulary, params: dict | None = None):
        self.v = vocabulary
        self.classes = CLASSES + TAILS
        symbols = WORDS + TAILS
        if params is None:
            random = np.random.RandomState(44)
            draw = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
            mass = np.concatenate([np.bincount(vocabulary.group, vocabulary.unigram, CLASSES), vocabulary.tail_counts]) + 1.0
            words = np.zeros(WORDS, np.float32)
            words[:vocabulary.words] = np.log(vocabulary.unigram + 1.0)
            params = {"x": draw(symbols + 1, 3 * UNITS), "u": draw(UNITS, 3 * UNITS), "c": draw(UNITS, self.classes) * 0,
                      "cb": np.log(mass / mass.sum()).astype(np.float32), "w": draw(WORDS, UNITS) * 0, "wb": words}
        self.p = params

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        if not self.v.words:
            return CLASSES + symbol - WORDS
        return np.where(symbol < WORDS, self.v.group[np.minimum(symbol, self.v.words - 1)], CLASSES + symbol - WORDS)

    def states(self, last: np.ndarray, cut: list, fresh: np.ndarray, state: np.ndarray):
        """States after the symbols of a window, from zero where a text begins; the states before, the update gates, the
        reset gates, the candidates and the recurrent parts go back with them."""
        n = len(last)
        three = lambda rows: np.ascontiguousarray(rows.reshape(-1, 3, UNITS).swapaxes(0, 1))
        x, u = three(self.p["x"].take(last, 0)), three(self.p["u"])
        gates = x[:2]
        np.negative(gates, out=gates)
        u[:2] *= -1
        keep = ~fresh[:, None]
        after, before, new = (np.empty((n, UNITS), x.dtype) for _ in range(3))
        r, low = np.empty((3, n, UNITS), x.dtype), 0
        with np.errstate(over="ignore"):  # exp may reach infinity, whose gate is 0
            for high in cut:
                h, gate, part, candidate = before[low:high], gates[:, low:high], r[:, low:high], new[low:high]
                np.multiply(state[:high - low], keep[low:high], out=h)
                np.matmul(h, u, out=part)
                gate += part[:2]
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[1], part[2], out=candidate)
                candidate += x[2, low:high]
                np.tanh(candidate, out=candidate)
                state = np.subtract(candidate, h, out=after[low:high])
                state *= gate[0]
                state += h
                low = high
        return after, before, gates[0], gates[1], new, r[2]

    def log_probs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target symbol after its state; adds gradients if asked for."""
        p = self.p
        kind = self.class_of(target).astype(np.uint8)
        order = np.argsort(kind, kind="stable")  # sorted by counting; states of one class then lie together
        target, kind = target[order], kind[order]
        edge = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        rows = np.arange(len(target))
        # the biases, less the largest, are weights of a constant unit
        h = np.concatenate([h.take(order, 0), np.ones((len(h), 1), h.dtype)], 1)
        joined = lambda w, bias: np.concatenate([w, (bias - bias.max())[:, None]], 1)
        weights = joined(p["w"], p["wb"]), joined(p["c"].T, p["cb"])
        reach = max(np.abs(w[:, :-1]).sum(1).max() for w in weights) * np.abs(h).max(initial=0)

        def softmax(h, weights, at, norm):
            """Logits ``at``, and gradients of the weights and states; sums of the exponentials go to ``norm``."""
            e = weights @ h.T  # a column a token, as sums over rows are quicker
            if not reach < 60:  # else no power leaves the range of floats
                e -= e.max(0)
            at = at, rows[:len(h)]
            got = e[at]
            np.exp(e, out=e)
            np.sum(e, 0, out=norm)
            if grads is None:
                return got, None, None
            e[at] -= norm
            share = (1 / norm)[:, None]
            back = e.T @ weights
            back *= share
            return got, e @ (h * share), back

        norm, within = np.empty(len(h), h.dtype), np.ones(len(h), h.dtype)
        out, back = np.empty(len(h), h.dtype), None if grads is None else np.empty_like(h)
        for low in range(0, len(h), BLOCK):
            s = slice(low, low + BLOCK)
            out[s], d_c, d = softmax(h[s], weights[1], kind[s], norm[s])
            if grads is not None:
                back[s] = d
                grads["c"] += d_c[:, :-1].T
                grads["cb"] += d_c[:, -1]
        for k in range(CLASSES):
            low, high, a, b = edge[k], edge[k + 1], self.v.cuts[k], self.v.cuts[k + 1]
            if low == high or b - a < 2:
                continue
            got, d_w, d = softmax(h[low:high], weights[0][a:b], target[low:high] - a, within[low:high])
            out[low:high] += got
            if grads is not None:
                grads["w"][a:b] += d_w[:, :-1]
                grads["wb"][a:b] += d_w[:, -1]
                back[low:high] += d
        out -= np.log(norm)
        out -= np.log(within)
        place = np.empty_like(order)
        place[order] = rows
        return out[place], None if back is None else back[:, :-1].take(place, 0)

    def score(self, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole text. Lanes of texts advance together, and their states are carried
        from window to window."""
        total = np.zeros(len(first) - 1)
        row = np.repeat(np.arange(len(total)), np.diff(first))
        state = np.zeros((SCORED, UNITS), np.float32)
        for at, cut, last, fresh in _windows(symbol, first, first, SCORED):
            h = self.states(last, cut, fresh, state)[0]
            state = h[cut[-2] if len(cut) > 1 else 0:]
            total += np.bincount(row[at], self.log_probs(h, symbol[at])[0], len(total))
        return total

    def train(self, symbol: np.ndarray, first: np.ndarray, rate: float) -> int:
        """Truncated backpropagation over windows of BACK steps, LANES lanes of texts at a time, states carried; AdaGrad.
        A longer text is dealt out in stretches of STRETCH tokens, so that it does not train alone."""
        p = {k: v.copy() for k, v in self.p.items()}
        self.p = p
        past = {k: np.full_like(v, 1e-3) for k, v in p.items()}
        seen, state = 0, np.zeros((LANES, UNITS), np.float32)
        more = (np.diff(first) - 1) // STRETCH
        k = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        begin = np.sort(np.concatenate([first, np.repeat(first[:-1], more) + k * STRETCH]))
        for at, cut, last, fresh in _windows(symbol, first, begin, LANES):
            n = len(at)
            seen += n
            h, before, z, reset, new, part = self.states(last, cut, fresh, state)
            state = h[cut[-2] if len(cut) > 1 else 0:]
            grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
            _, back = self.log_probs(h, symbol[at], grads)
            # what the gradient of a state is multiplied by on its way to the gates, the candidate and the state before
            stays = 1 - z
            through, to_z, to_reset = z * (1 - new * new), (new - before) * z * stays, part * reset * (1 - reset)
            d_r, d_new = np.empty((3, n, UNITS), h.dtype), np.empty((n, UNITS), h.dtype)
            flow, keep = np.zeros((0, UNITS), h.dtype), ~fresh[:, None]  # nothing goes back into the text before
            u = np.ascontiguousarray(p["u"].reshape(UNITS, 3, UNITS).transpose(1, 2, 0))
            for low, high in zip(reversed([0, *cut[:-1]]), reversed(cut), strict=True):
                d, d_part, d_own = back[low:high], d_r[:, low:high], d_new[low:high]
                d[:len(flow)] += flow
                np.multiply(d, through[low:high], out=d_own)
                np.multiply(d, to_z[low:high], out=d_part[0])
                np.multiply(d_own, to_reset[low:high], out=d_part[1])
                np.multiply(d_own, reset[low:high], out=d_part[2])
                flow = (d_part @ u).sum(0)
                d *= stays[low:high]
                flow += d
                flow *= keep[low:high]
            grads["u"] += np.concatenate([before.T @ d for d in d_r], 1)
            # of the input table only the rows that were read change
            order = np.argsort(last.astype(np.uint16), kind="stable")
            begin = np.flatnonzero(np.diff(last[order], prepend=-1))
            read = last[order[begin]]
            grads["x"] = np.add.reduceat(np.concatenate([d_r[0], d_r[1], d_new], 1).take(order, 0), begin, axis=0)
            for name, g in grads.items():
                g *= n ** -0.5
                np.clip(g, -5, 5, out=g)
                rows_of = read if name == "x" else slice(None)
                past[name][rows_of] += g * g
                g *= rate
                g /= np.sqrt(past[name][rows_of])
                p[name][rows_of] -= g
        return seen


def _windows(symbol: np.ndarray, first: np.ndarray, begins: np.ndarray, lanes: int):
    """Places of BACK tokens of every lane at a time, until each token was given once: the places by step, the end
    of each step, the symbol before each place, and whether a state begins there. When few lanes are left, as with one
    long text, they get up to LONGER times the steps.

    Texts, or their stretches between two of ``begins``, are dealt whole to the lanes, longest first, each to the lane with
    the fewest tokens; lanes come in falling length, so those of a step are the first of the step before.
    """
    size = np.diff(begins)
    load = [(0, lane) for lane in range(min(lanes, len(size)))]
    lane = np.zeros(len(size), np.int64)
    order = np.argsort(-size, kind="stable")
    for row, n in zip(order.tolist(), size[order].tolist(), strict=True):
        have, lane[row] = load[0]
        heapq.heapreplace(load, (have + n, int(lane[row])))
    length = np.array([n for n, _ in sorted(load, key=lambda x: x[1])], np.int64)
    falling = np.argsort(-length, kind="stable")
    length, rank = length[falling], np.argsort(falling)
    order = order[np.argsort(rank[lane[order]], kind="stable")]  # lane by lane
    n = size[order]
    place = np.repeat(begins[:-1][order] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    begin = np.cumsum(length) - length
    before = np.concatenate([[WORDS + TAILS], symbol[:-1]]) if len(symbol) else symbol
    before[first[:-1]] = WORDS + TAILS
    starts = np.zeros(len(symbol), bool)
    starts[begins[:-1]] = True
    low, end = 0, int(length[0]) if len(length) else 0
    while low < end:
        left = int(np.searchsorted(-length, -low, "left"))
        high = min(low + BACK * min(lanes // left, LONGER), end)
        count = np.searchsorted(-length, -np.arange(low, high), "left")
        at = place[np.concatenate([begin[:k] + t for t, k in zip(range(low, high), count.tolist(), strict=True)])]
        yield at, np.cumsum(count).tolist(), before[at], starts[at]
        low = high


def _averaged(docs: DataFrame, model: Recurrent, rate: float, part_floats: int = 4096) -> dict | None:
    """Parameters after every task has trained on its texts, averaged by words seen; None without texts.

    Each task gives one copy of the fixed-size parameters in pieces; pieces are added up in two levels, so
    no task holds more than about the square root of the number of copies, and the driver gets one model.
    """
    names = list(model.p)
    shapes = [model.p[n].shape for n in names]

    def run(batches):
        own, seen = model, 0
        for batch in batches:
            symbol, _, _, first = own.v.tokens(batch)
            n = own.train(symbol, first, rate)
            seen += n
        if seen:
            flat = np.concatenate([own.p[n].ravel() for n in names]).astype(np.float64) * seen
            cuts = range(0, len(flat), part_floats)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([seen] * len(cuts), pa.int64()),
                                              pa.array([flat[c:c + part_floats].tobytes() for c in cuts], pa.binary())],
                                             names=["k", "seen", "blob"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table.column("blob"))
        return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int32()),
                         "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()),
                         "blob": pa.array([total.tobytes()], pa.binary())})

    schema = "k int, seen long, blob binary"
    fan = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    rows = docs.mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
    once = rows.groupBy("k", "salt").applyInArrow(lambda t: added(t), schema)
    parts = sorted(once.groupBy("k").applyInArrow(lambda t: added(t), schema).collect(), key=lambda r: r["k"])
    if not parts:
        return None
    flat = np.concatenate([np.frombuffer(r["blob"]) for r in parts]) / parts[0]["seen"]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return {n: x.reshape(s).astype(np.float32) for n, s, x in zip(names, shapes, np.split(flat, ends[:-1]), strict=True)}


def _commonest(counts: DataFrame) -> list:
    """At most NAMED rows of the highest counts, falling.

    A histogram of the counts' logarithms (a few thousand rows at most) tells from which count on all rows
    fit; a sort with a limit would send that many rows from every task.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    room, least = NAMED, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    return [] if least is None else sorted(counts.where(step >= least).collect(), key=lambda r: (-r["c"], r["h"]))


def score_texts(docs: DataFrame, text: str = "text", train: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``train`` tells the rows to learn from. Counts come from all of them, and the network is trained on all of
    them once: they are dealt to ``rounds`` slices by a hash of doc_id and text, in each round every task trains
    on its texts of one slice, and the tasks' parameters are averaged. Rare words meet their counts in a shuffle join;
    only words beyond the NAMED commonest take part, so no key is hot.

    Null text counts as empty: its one token is the end. A null doc_id is trained on. Repeated rows count as
    often as they occur. Without training rows N and V are 0. Extra columns are ignored.
    """
    train = ~held_out(F.col("doc_id")) if train is None else F.coalesce(train, F.lit(False))
    docs = docs.select("doc_id", F.col(text).alias("text"), train.alias("train"))
    learn = docs.where("train")
    counts = written(word_counts(learn), "lm-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tails = {r["tail"]: r for r in counts.where("tail >= 0").groupBy("tail").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    named = _commonest(counts)
    column = lambda k, kind: np.array([r[k] for r in named], kind)
    per_tail = lambda k: np.array([tails[t][k] if t in tails else 0 for t in range(TAILS)], np.int64)
    vocabulary = Vocabulary(column("h", np.int64).view(np.uint64), column("tail", np.int64), column("c", np.int64),
                            total, types, per_tail("c"), per_tail("n"))
    model = Recurrent(vocabulary)
    for k in range(rounds):
        piece = learn.where(F.pmod(F.xxhash64(F.lit("slice"), "doc_id", "text"), F.lit(rounds)) == k).select("text")
        params = _averaged(piece, model, RATE / (k + 1))
        if params is not None:
            model = Recurrent(vocabulary, params)
    floor = float(np.log10(total + types + 1.0))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")],
                           T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rare", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            symbol, rank, h, first = vocabulary.tokens(batch)
            if not batch.num_rows:
                continue
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            net = model.score(symbol, first) / np.log(10)
            is_named, is_tail = rank >= 0, symbol >= WORDS
            log_count = np.where(is_named, vocabulary.log_count[np.maximum(rank, 0)] if len(vocabulary.log_count) else 0.0, 0.0)
            base = np.bincount(row, log_count, len(n)) - n * floor
            tail = np.where(is_tail, log_count - vocabulary.tail_log[np.where(is_tail, symbol - WORDS, 0)], 0.0)
            rare = np.flatnonzero(~is_named)
            offsets = np.searchsorted(row[rare], np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.logical_not(batch.column("train").to_numpy(zero_copy_only=False).astype(bool))),
                 pa.array(n.astype(np.int64)), pa.array(np.bincount(row, is_named, len(n)).astype(np.int64)), pa.array(base),
                 pa.array(net + np.bincount(row, tail, len(n))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[rare].view(np.int64)))], names=schema.names)

    scored = written(docs.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h")
    rare = rare.groupBy("rid").agg(F.count("c").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    out = scored.drop("rare").join(rare, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                      (F.col("score") + more).alias("score"))


@register("op4_recurrent_lm")
def op4_recurrent_lm(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
