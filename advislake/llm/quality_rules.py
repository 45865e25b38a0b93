"""Line-first quality rules: lines are judged and removed one by one, then documents by what is left."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.registry import register

SYMBOLS = b"#*$%&|<>"
CLOSING = ".!?:;,…\"')]»”’。！？"
BOILERPLATE = ["cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy",
               "lorem ipsum", "subscribe to our", "sign in", "log in", "click here", "read more", "share this",
               "permission is hereby granted", "licensed under", "copyright ("]
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
LETTER_UPPER = np.zeros(256, bool)
LETTER_UPPER[65:91] = True
LETTER_LOWER = np.zeros(256, bool)
LETTER_LOWER[97:123] = True
# the last byte of a closing mark is enough to tell it among UTF-8 endings checked below
_CLOSING = [c.encode() for c in CLOSING]
_PATTERN = re.compile("|".join(re.escape(p) for p in BOILERPLATE).encode())

OUTPUT = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
          ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
          ("n_lines", T.LongType()), ("n_lines_removed", T.LongType()), ("n_words_removed", T.LongType()),
          ("kept", T.BooleanType())]


def _counts(hit: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many marks lie between consecutive edges."""
    sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def judge(data: np.ndarray, at: np.ndarray, low: int, high: int, max_lost: float, boilerplate_words: int):
    """Columns of OUTPUT for the rows low..high, and for each row the byte spans of its kept lines."""
    w = W.Words(data, at, low, high)
    a, b = int(at[low]), int(at[high])
    part = data[a:b]
    edges = at[low:high + 1] - a
    n_words = w.count.astype(np.int64)
    inside = ~W.SPACE[part]
    word_chars = _counts(inside & ((part & 0xC0) != 0x80), edges)
    n_symbols = _counts(IS_SYMBOL[part], edges)

    hashes = w.hashes()
    runs, ok = W.windows_hash(hashes, 3), W.windows_valid(w.row, 3)
    place = np.flatnonzero(ok)
    again = W.repeated(W.mix(runs[place] + w.row[place].astype(np.uint64) * W.BASE)) if len(place) else np.zeros(0, bool)
    n_repeat = _counts(W.covered(place[again], 3, len(w.start)), w.first)

    # lines: they end at \n or at the end of their row
    cuts = part == 10
    stops = np.unique(np.concatenate([np.flatnonzero(cuts) + a, w.row_end]))  # ends of lines, without \n
    begins = np.concatenate([[a], np.where((stops < b) & (data[np.minimum(stops, b - 1)] == 10), stops + 1, stops)])[:-1] \
        if len(stops) else np.zeros(0, np.int64)
    row = np.searchsorted(w.row_end, stops, "left") if len(stops) else np.zeros(0, np.int64)
    begins = np.maximum(begins, w.row_start[np.minimum(row, w.rows - 1)]) if len(stops) else begins
    word_of = np.concatenate([[0], np.searchsorted(w.start, stops)]) if len(stops) else np.zeros(1, np.int64)
    line_words = np.diff(word_of)
    full = line_words > 0
    begins, stops, row, line_words = begins[full], stops[full], row[full], line_words[full]
    last_word = np.searchsorted(w.start, stops) - 1
    first_word = last_word - line_words + 1

    keys = W.mix(W.spans_hash(data, begins, stops) + row.astype(np.uint64) * W.BASE)
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    n_dup = np.bincount(row[later], minlength=w.rows)

    # line rules
    line_edges = np.stack([begins - a, stops - a], 1).ravel() if len(begins) else np.zeros(0, np.int64)
    take = lambda hit: (lambda s: s[line_edges[1::2]] - s[line_edges[::2]])(np.concatenate([[0], np.cumsum(hit)]))
    upper, lower, pipes = take(LETTER_UPPER[part]), take(LETTER_LOWER[part]), take(part == ord("|"))
    shouts = take(part == ord("!"))
    tail = data[w.end[last_word] - 1] if len(last_word) else np.zeros(0, np.uint8)
    closed = np.isin(tail, np.frombuffer(b"".join(c for c in _CLOSING if len(c) == 1), np.uint8))
    for i in np.flatnonzero(tail >= 0x80):
        closed[i] = bytes(data[max(w.end[last_word[i]] - 3, w.start[last_word[i]]):w.end[last_word[i]]]).endswith(tuple(c for c in _CLOSING if len(c) > 1))
    symbols = take(IS_SYMBOL[part])
    punctuation = (~closed & (line_words < 4)) | (shouts * 2 > line_words) | (symbols * 2 > line_words) | ((upper > 4 * lower) & (line_words > 3))
    navigation = pipes * 4 >= line_words
    boilerplate = np.zeros(len(begins), bool)
    for i in np.flatnonzero(line_words <= boilerplate_words):
        boilerplate[i] = _PATTERN.search(bytes(W.LOWER[data[begins[i]:stops[i]]])) is not None
    bad = punctuation | navigation | boilerplate
    lost = np.bincount(row[bad], line_words[bad], minlength=w.rows).astype(np.int64)
    lines = np.bincount(row, minlength=w.rows)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~base_failed & (lost <= max_lost * n_words)
    columns = [n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, lines,
               np.bincount(row[bad], minlength=w.rows), lost, kept]
    return columns, (row[~bad], begins[~bad], stops[~bad])


def line_first_clean(docs: DataFrame, text: str = "text", max_lost: float = 0.5, boilerplate_words: int = 60,
                     with_text: bool = True) -> DataFrame:
    """Adds the counts of OUTPUT, ``kept`` and, if asked for, ``clean_text`` (kept lines joined by \\n).

    A line falls by the punctuation rule (shouted, all capitals, a symbol for every two words, or short
    without a closing mark), the
    navigation rule (a pipe for every four words) or the boilerplate rule (a stock phrase in a line of at
    most ``boilerplate_words`` words). A document is kept if it has 50 words, no more than half of its
    words in repeated 3-word runs, and lost at most ``max_lost`` of its words with its lines. One pass
    without a shuffle. Null and empty texts have no words and fail; all other columns pass through, and
    a column of the same name as an added one is replaced.
    """
    added = {n for n, _ in OUTPUT} | {"clean_text"}
    passed = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*passed.schema.fields, *[T.StructField(n, t) for n, t in OUTPUT]])
    drop_text = not with_text
    if drop_text:
        schema = T.StructType([f for f in schema.fields if f.name != text])
    else:
        schema = schema.add("clean_text", T.StringType())

    def run(batches):
        for batch in batches:
            data, at = W.text_bytes(W.column(batch, text))
            for low, high in W.blocks(at):
                columns, (row, begins, stops) = judge(data, at, low, high, max_lost, boilerplate_words)
                part = batch.slice(low, high - low)
                arrays = [part.column(i) for i, n in enumerate(part.schema.names) if not (drop_text and n == text)]
                arrays += [pa.array(c.astype(bool) if t == T.BooleanType() else c.astype(np.int64))
                           for c, (_, t) in zip(columns, OUTPUT, strict=True)]
                if with_text:
                    cut = np.searchsorted(row, np.arange(high - low + 1))
                    arrays.append(pa.array([b"\n".join(data[begins[i]:stops[i]].tobytes() for i in range(s, e)).decode()
                                            for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return passed.mapInArrow(run, schema)


_LINE_BAD = f"""(regexp_matches(line, '\\|') and 4 * (length(line) - length(replace(line, '|', ''))) >= nw)
  or 2 * (length(line) - length(replace(line, '!', ''))) > nw or 2 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > nw
  or (length(regexp_replace(line, '[^A-Z]', '', 'g')) > 4 * length(regexp_replace(line, '[^a-z]', '', 'g')) and nw > 3)
  or (nw < 4 and not list_contains([{', '.join("'" + c.replace("'", "''") + "'" for c in CLOSING)}], right(rtrim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 1)))
  or (nw <= 60 and ({' or '.join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p in BOILERPLATE)}))"""

SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d),
ln as (select doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as nw from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d)),
dup as (select doc_id, count(*) as n_dup from (
  select doc_id, row_number() over (partition by doc_id, line order by i) as k from ln where nw > 0) where k > 1 group by 1),
lost as (select doc_id, sum(nw) as lost from ln where nw > 0 and ({_LINE_BAD}) group by 1),
tri as (select doc_id, p, ws[p:p+2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from w where len(ws) >= 3)),
rep as (select doc_id, p, count(*) over (partition by doc_id, g) as c from tri),
cov as (select doc_id, count(distinct q) as n_rep from (select doc_id, unnest([p, p + 1, p + 2]) as q from rep where c > 1) group by 1),
r as (select w.doc_id, len(ws)::bigint as n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_rep, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from w left join dup using (doc_id) left join cov using (doc_id) left join lost using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.5 * n_words as kept
from r"""


@register("op1_quality_rules", SQL)
def op1_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_first_clean(docs, with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
