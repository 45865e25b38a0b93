"""Fill-in-middle: texts are cut at two unit boundaries and their parts are put in another order.

A unit ends where a set of boundaries says so. The boundaries of a block of texts are one
``BoundarySet`` over the block's bytes; both cuts of all its texts are found by one select.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.boundary_set import BoundarySet
from advislake.llm.registry import register

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, 42
FIM = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                    T.StructField("output", T.StringType())])


def token_ends(data: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Byte offsets after each token of a block: a word ends one, and so does white space that ends a text."""
    w = W.Words(data, at, low, high)
    start, end = w.row_start, w.row_end
    filled = end > start
    trailing = np.zeros(len(start), bool)
    trailing[filled] = W.SPACE[data[end[filled] - 1]]
    return np.sort(np.concatenate([w.end, end[trailing]]))


def character_ends(data: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Byte offsets after each code point of a block."""
    a, b = int(at[low]), int(at[high])
    begins = np.flatnonzero((data[a:b] & 0xC0) != 0x80) + a
    return np.append(begins[1:], b) if len(begins) else begins


UNITS = {"token": token_ends, "character": character_ends}


def _draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id, from the SHA-256 of ``seed:id`` (null: no id)."""
    head = f"{seed}:".encode()
    digests = b"".join(hashlib.sha256(head + (b"" if i is None else str(i).encode())).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(len(ids), 4).astype(np.int64)


def _cut_block(data, at, low, high, h, marked, unit, rate, spm_rate):
    """The FIM columns of the rows low..high."""
    ends = UNITS[unit](data, at, low, high)
    bounds = BoundarySet(ends)
    begin, stop = at[low:high], at[low + 1:high + 1]
    # a text's boundaries are those above its begin and not above its end
    first = np.searchsorted(ends, begin, "right")
    n = np.searchsorted(ends, stop, "right") - first
    x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    plain = (stop == begin) | marked | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < spm_rate
    cut = np.stack([np.minimum(x, y), np.maximum(x, y)])
    offset = np.where(cut == 0, begin, 0)
    some = (cut > 0) & ~plain
    offset[some] = bounds.select((first + cut - 1)[some])
    a = int(at[low])
    chars = np.append(0, np.cumsum((data[a:int(at[high])] & 0xC0) != 0x80))
    raw = data[a:int(at[high])].tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out, form = [], []
    for i in range(high - low):
        b, e = int(begin[i]) - a, int(stop[i]) - a
        if plain[i]:
            out.append(raw[b:e])
            form.append("plain")
            continue
        one, two = int(offset[0, i]) - a, int(offset[1, i]) - a
        parts = (s, raw[two:e], p, raw[b:one], m, raw[one:two]) if spm[i] else (p, raw[b:one], s, raw[two:e], m, raw[one:two])
        out.append(b"".join(parts))
        form.append("spm" if spm[i] else "psm")
    offset = np.where(plain, begin, offset)
    upto = chars[np.stack([begin, offset[0], offset[1]]) - a]
    counts = [pa.array(upto[k + 1] - upto[k], pa.int64(), mask=plain) for k in (0, 1)]
    return pa.StructArray.from_arrays(
        [pa.array(n.astype(np.int64)), pa.array(form, pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())],
        fields=[pa.field(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in FIM])


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE, unit: str = "token", into: str = "fim") -> DataFrame:
    """All columns of ``docs`` and a struct ``into`` of n, form, prefix_chars, middle_chars and output.

    The cuts follow from the hash of ``seed`` and ``key`` alone, so reruns and lost executors change
    nothing, and equal keys with equal texts give equal rows. A text has ``n`` units of ``unit`` (token: a
    word with the white space before it, or white space at the end; character: a code point). ``form`` is
    plain (text unchanged, counts null) for empty and null texts, texts that hold a marker, and 100 - ``rate``
    in 100 of the others; else spm for ``spm_rate`` in 100, psm for the rest. A null key counts as an empty
    one. A column named ``into`` is replaced; other columns pass as they are, nulls included. Texts are
    handled in blocks of about 2 MB, one longer text alone; an empty table gives no rows.
    """
    keep = docs.drop(into)
    row = F.struct(*[keep[f"`{c}`"] for c in keep.columns]).alias("row")
    slim = docs.select(row, docs[f"`{text}`"].alias("text"), docs[f"`{key}`"].cast("string").alias("key"))
    schema = T.StructType([slim.schema["row"], T.StructField("fim", FIM)])

    def run(batches):
        for batch in batches:
            col = W.column(batch, "text")
            data, at = W.text_bytes(col)
            marked = np.zeros(len(col), bool)
            for marker in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(col, marker).to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_pylist()
            for low, high in W.blocks(at):
                fim = _cut_block(data, at, low, high, _draws(keys[low:high], seed), marked[low:high], unit, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), fim], names=["row", "fim"])

    made = slim.mapInArrow(run, schema)
    return made.select("row.*", F.col("fim").alias(into))


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output`` in ``form``. A marker begins with its only ``<``, and no marker is in a cut
    text, so the first of each marker is the one that was put there."""
    p, s, m = (F.position(F.lit(x), output) for x in (PREFIX, SUFFIX, MIDDLE))
    size = len(PREFIX)
    between = lambda a, b: F.substr(output, a + F.lit(size), b - a - F.lit(size))
    rest = lambda a: F.substr(output, a + F.lit(size))
    return F.when(form == "psm", F.concat(between(p, s), rest(m), between(s, m))) \
        .when(form == "spm", F.concat(between(p, m), rest(m), between(s, p))).otherwise(output)


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as toks,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, len(toks)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(toks[1:x], '') as prefix, array_to_string(toks[x + 1:y], '') as middle,
    array_to_string(toks[y + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
  sha256(text) as restored_sha256 from p"""


@register("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
