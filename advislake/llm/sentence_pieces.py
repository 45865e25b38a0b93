"""SentencePiece encoding and decoding by batched numpy Viterbi over the words of a block.

The text is cut between any two characters that follow each other in no piece, as no piece can reach
across; so words come apart at their space marks and from most of their punctuation. Each distinct part is segmented once; parts of equal length advance together,
their substring hashes probe the sorted piece keys, and the best piece ending at each place is kept as a
backpointer. For a unigram model the best has the largest sum of scores. For a BPE model it is the piece
that byte-pair merging leaves there: a row of pieces is the merge result exactly if every two neighbours
are, so a place's last piece is the one that stays apart from the last piece before it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.registry import register

SPACE_MARK = 0x2581
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
KNOWN_PARTS = 400_000  # segmented parts that a task keeps; beyond it, parts are segmented again
FILTER_BITS = 20


def _values(codes: np.ndarray) -> np.ndarray:
    return W.mix(codes.astype(np.uint64) + np.uint64(1))


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places start..start+count of each range, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum())) \
        if len(count) else np.zeros(0, np.int64)


class Pieces:
    """Tables of a model file; about a megabyte for 32,000 pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep characters and spaces as they are can be used")
        self.kind, self.prefix = model.trainer_spec.model_type, spec.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be used")
        kinds = [p.type for p in model.pieces]
        self.size = len(kinds)
        texts = {i: p.piece for i, p in enumerate(model.pieces) if p.type in (1, 4)}  # normal, user-defined
        scores = {i: p.score for i, p in enumerate(model.pieces)}
        self.unknown = kinds.index(2) if 2 in kinds else 0
        self.bytes = np.full(256, -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        singles = {t: i for i, t in texts.items() if len(t) == 1}
        inner = sorted({c for t in texts.values() if len(t) > 1 for c in t})
        # characters of longer pieces that are no piece themselves get ids past the end
        lone = [c for c in inner if c not in singles]
        low = min(scores.values(), default=0.0) if self.kind == UNIGRAM else 0.0
        low = min((s for i, s in scores.items() if i in texts), default=0.0) if self.kind == UNIGRAM else low
        for k, c in enumerate(lone):
            texts[self.size + k] = c
            scores[self.size + k] = low - UNKNOWN_PENALTY
        self.lone = lone
        # characters of longer pieces by number, 0 for all others, and which may follow each other in a piece
        self.number = np.zeros(max(map(ord, inner), default=0) + 2, np.uint16)
        self.number[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.follow = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for t in texts.values():
            at = self.number[[ord(c) for c in t]] if len(t) > 1 else np.zeros(0, np.int64)
            self.follow[at[:-1], at[1:]] = True
        self.single_codes = np.array(sorted(ord(t) for t in singles), np.uint32)
        self.single_ids = np.array([singles[chr(c)] for c in self.single_codes], np.int64)
        n = self.size + len(lone)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        if self.kind == BPE:
            self._merges(texts, scores)
        self.score = np.array([scores.get(i, 0.0) for i in range(n)])
        ids = np.array(sorted(texts), np.int64)
        hashes = np.array([self._hash(texts[i]) for i in ids], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], ids[order]
        if np.any(self.keys[1:] == self.keys[:-1]):
            raise ValueError("two pieces are equal")
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.longest = max((len(t) for t in texts.values()), default=1)
        raw = {i: t.replace(chr(SPACE_MARK), " ").encode() for i, t in texts.items() if i < self.size}
        raw |= {int(i): bytes([b]) for b, i in enumerate(self.bytes) if i >= 0}
        if self.size:
            raw.setdefault(self.unknown, " ⁇ ".encode())
        self.raw_count = np.array([len(raw.get(i, b"")) for i in range(self.size)], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_count)])[:-1] if self.size else np.zeros(0, np.int64)
        self.raw = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.size)), np.uint8)

    @staticmethod
    def _hash(text: str) -> int:
        codes = np.array([ord(c) for c in text], np.uint32)
        return int(W.mix(np.add.reduce(_values(codes) * W.powers(W.BASE, len(codes)), keepdims=True) + np.uint64(len(codes)))[0])

    def _merges(self, texts: dict, scores: dict) -> None:
        """Rank of each piece and its two parts at the last merge; pieces that merging never makes are left out."""
        by_text = {t: i for i, t in texts.items()}
        order = {i: r for r, i in enumerate(sorted((i for i, t in texts.items() if len(t) > 1), key=lambda i: (-scores[i], i)))}
        pairs = {}
        for i in list(texts):
            text = texts[i]
            for cut in range(1, len(text)):
                a, b = by_text.get(text[:cut]), by_text.get(text[cut:])
                if a is not None and b is not None:
                    pairs[(a, b)] = i
        for i in list(texts):
            parts, last = [by_text[c] for c in texts[i]], None
            while len(parts) > 1:
                found = [(order[m], k, m) for k in range(len(parts) - 1) if (m := pairs.get((parts[k], parts[k + 1]))) is not None]
                if not found:
                    break
                _, k, m = min(found)
                last = (parts[k], parts[k + 1])
                parts[k:k + 2] = [m]
            if parts != [i]:
                del texts[i]
            elif last:
                self.rank[i], (self.left[i], self.right[i]) = order[i], last
        known = sorted((a * len(self.rank) + b, order[m]) for (a, b), m in pairs.items())
        self.pair_keys = np.array([k for k, _ in known], np.int64)
        self.pair_ranks = np.array([r for _, r in known], np.int64)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the neighbours a and b as they are.

        The merges that made them are undone from the last on. Whenever two border symbols exist together,
        their own merge must not come before the next merge of either.
        """
        never = np.int64(1) << 60
        x, y = a.copy(), b.copy()
        x_end, y_end = np.full(len(a), never), np.full(len(b), never)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            u, v = x[live], y[live]
            key = u * len(self.rank) + v
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never)
            bad = (merge < x_end[live]) & (merge <= y_end[live]) & (merge < never)
            ok[live[bad]] = False
            undo_x = self.rank[u] > self.rank[v]
            done = bad | ((self.rank[u] < 0) & (self.rank[v] < 0))
            go_x, go_y = live[undo_x & ~done], live[~undo_x & ~done]
            x_end[go_x] = self.rank[x[go_x]]
            x[go_x] = self.right[x[go_x]]
            y_end[go_y] = self.rank[y[go_y]]
            y[go_y] = self.left[y[go_y]]
            live = live[~done]
        return ok

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def viterbi(self, sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: int):
        """Pieces of equally long parts: (counts, ids of part after part)."""
        n = len(start)
        back = np.zeros((n, length + 1), np.int64)
        piece = np.full((n, length + 1), -1, np.int64)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, length + 1):
            top = min(end, self.longest)
            if self.kind == UNIGRAM:
                values = np.full((n, top), -np.inf)
                found = np.full((n, top), -1, np.int64)
                for size in range(1, top + 1):
                    a = start + end - size
                    ids = self.probe(W.mix((sums[start + end] - sums[a]) * inverse[a] + np.uint64(size)))
                    hit = ids >= 0
                    found[:, size - 1] = ids
                    values[hit, size - 1] = best[hit, end - size] + self.score[ids[hit]]
                pick = values.argmax(1)
                best[:, end], back[:, end] = values[np.arange(n), pick], pick + 1
                piece[:, end] = found[np.arange(n), pick]
                continue
            open_ = np.arange(n)
            for size in range(top, 0, -1):
                if not len(open_):
                    break
                a = start[open_] + end - size
                ids = self.probe(W.mix((sums[start[open_] + end] - sums[a]) * inverse[a] + np.uint64(size)))
                hit = np.flatnonzero((ids >= 0) & (best[open_, end - size] == 0))
                if size < end and len(hit):
                    hit = hit[self.stay_apart(piece[open_[hit], end - size], ids[hit])]
                rows = open_[hit]
                best[rows, end], back[rows, end], piece[rows, end] = 0, size, ids[hit]
                open_ = np.delete(open_, hit)
        place, rows = np.full(n, length), np.arange(n)
        out, count = np.full((n, length), -1, np.int64), np.zeros(n, np.int64)
        while len(rows):
            at = place[rows]
            if (back[rows, at] == 0).any():
                raise ValueError("a part has no segmentation")
            out[rows, length - 1 - count[rows]] = piece[rows, at]
            count[rows] += 1
            place[rows] = at - back[rows, at]
            rows = rows[place[rows] > 0]
        return count, out[out >= 0]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids; ``ends`` are the n + 1 first places of the rows."""
        known = (ids >= 0) & (ids < self.size)
        at = np.where(known, ids, 0)
        n = np.where(known, self.raw_count[at], 0)
        raw = self.raw[_ragged(self.raw_start[at], n)].tobytes()
        cut = np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        rows = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [r[1:] if r[:1] == b" " else r for r in rows] if self.prefix else rows

    def spelled(self, code: int) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown piece."""
        ids = [int(self.bytes[b]) for b in chr(code).encode()]
        return ids if min(ids) >= 0 else [self.unknown]


class Encoder:
    """Encodes blocks of rows; keeps the pieces of parts it has seen, up to a bound."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.known = np.zeros(0, np.uint64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _segment(self, codes, sums, inverse, start, length):
        """(counts, flat ids) of distinct parts in the given order."""
        p = self.p
        counts, chunks = np.zeros(len(start), np.int64), [None] * len(start)
        alone = (length == 1)
        for i in np.flatnonzero(alone):
            code = codes[start[i]]
            at = int(np.searchsorted(p.single_codes, code))
            hit = at < len(p.single_codes) and p.single_codes[at] == code
            chunks[i] = np.array([p.single_ids[at]] if hit else p.spelled(int(code)), np.int64)
            counts[i] = len(chunks[i])
        for size in np.unique(length[~alone]):
            rows = np.flatnonzero(length == size)
            for part in np.array_split(rows, max(1, len(rows) * int(size) // 500_000)):
                n, ids = p.viterbi(sums, inverse, start[part], int(size))
                cut = np.concatenate([[0], np.cumsum(n)])
                for k, i in enumerate(part):
                    own = ids[cut[k]:cut[k + 1]]
                    if len(p.lone) and (own >= p.size).any():
                        own = np.array([x for t in own for x in (p.spelled(ord(p.lone[t - p.size])) if t >= p.size else [t])])
                    chunks[i], counts[i] = own, len(own)
        return counts, (np.concatenate(chunks) if chunks else np.zeros(0, np.int64)).astype(np.int32)

    def encode(self, data: np.ndarray, at: np.ndarray, low: int, high: int):
        """(ids, number of ids of each row) of the rows low..high."""
        p = self.p
        raw = data[at[low]:at[high]]
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        edge = lead[at[low:high + 1] - at[low]]
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        codes[codes == 32] = SPACE_MARK
        full = np.flatnonzero(np.diff(edge) > 0)
        if p.prefix:
            codes = np.insert(codes, edge[full], SPACE_MARK)
            edge = edge + np.concatenate([[0], np.cumsum(np.diff(edge) > 0)])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(high - low, np.int64)
        number = p.number[np.minimum(codes, len(p.number) - 1)]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~p.follow[number[:-1], number[1:]]
        cut[edge] = True
        start = np.flatnonzero(cut[:-1])
        length = np.diff(np.append(start, len(codes)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values(codes) * W.powers(W.BASE, len(codes)))])
        inverse = W.powers(W.INVERSE, len(codes) + 1)
        h = W.mix((sums[start + length] - sums[start]) * inverse[start] + length.astype(np.uint64))
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, keys)
        have = np.zeros(len(keys), bool)
        if len(self.known):
            have = self.known[np.minimum(place, len(self.known) - 1)] == keys
        new = np.flatnonzero(~have)
        counts, flat = self._segment(codes, sums, inverse, start[first[new]], length[first[new]])
        own_start = len(self.flat) + np.concatenate([[0], np.cumsum(counts)])[:-1] if len(new) else np.zeros(0, np.int64)
        pool = np.concatenate([self.flat, flat])
        part_start, part_count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        part_start[have], part_count[have] = self.start[place[have]], self.count[place[have]]
        part_start[new], part_count[new] = own_start, counts
        if len(self.known) + len(new) <= KNOWN_PARTS:
            self.flat = pool
            self.known = np.concatenate([self.known, keys[new]])
            order = np.argsort(self.known, kind="stable")
            self.known = self.known[order]
            self.start = np.concatenate([self.start, own_start])[order]
            self.count = np.concatenate([self.count, counts])[order]
        n = part_count[which]
        ids = pool[_ragged(part_start[which], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.searchsorted(start, edge)]
        return ids, np.diff(ends)


def encode(docs: DataFrame, model: str, text: str = "text", check: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds ``ids``, the pieces of each whole text as the model's library gives them.

    With ``check``, the ids are decoded again in the same task, and ``round_trip`` tells whether that gives
    the text (null for null). One pass without a shuffle; the tables of ``model`` (bounded by its vocabulary) go along with the
    tasks. Null text has null ids, empty text none. Other columns pass through; columns named as added ones are replaced.
    """
    pieces = Pieces(model)
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "round_trip")])
    passed = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*passed, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    schema = schema.add("round_trip", T.BooleanType()) if check else schema

    def run(batches):
        encoder = Encoder(pieces)
        for batch in batches:
            valid = batch.column(text).is_valid().to_numpy(zero_copy_only=False)
            data, at = W.text_bytes(W.column(batch, text))
            for low, high in W.blocks(at):
                ids, n = encoder.encode(data, at, low, high)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~valid[low:high], False)), pa.array(ids))
                part = batch.slice(low, high - low)
                columns = [part.column(f.name) for f in passed] + [lists]
                if check:
                    back = pieces.decoded(ids.astype(np.int64), offsets)
                    same = [r == data[at[i]:at[i + 1]].tobytes() if valid[i] else None for i, r in zip(range(low, high), back, strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``: piece texts with spaces for marks, bytes for byte pieces, no first space.

    Ids out of range give nothing; bytes that form no character become U+FFFD. Null ids give null.
    """
    pieces = Pieces(model)
    encoded = encoded.select(*[c for c in encoded.columns if c != into])
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            lists = lists if not lists.null_count else pa.concat_arrays([lists.fill_null([])])
            cut = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            texts = []
            for low in range(0, len(lists), 512):
                high = min(low + 512, len(lists))
                rows = pieces.decoded(flat[cut[low]:cut[high]].astype(np.int64), cut[low:high + 1] - cut[low])
                texts += [r.decode("utf-8", "replace") if valid[i] else None for i, r in zip(range(low, high), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def default_model() -> str:
    """Model file of the queries; operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op10_sentence_pieces")
def op10_sentence_pieces(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, default_model(), check=True, keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
