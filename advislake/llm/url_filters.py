"""URL filters: all wildcard rules advance together as bits of one multiword Shift-And automaton."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advislake.llm import words as W
from advislake.llm.registry import register

# (verdict, host and path)
HOST_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
              ("block", "net/fr/")]
# (verdict, glob over "." + host + path): ? is one character and * any run, both without "/"; ** is any run
GLOBS = [("block", "*.ads-track.**"), ("block", "*.ads.**"), ("block", "*.doubleclick.*/**"), ("block", "*tracker*/**"),
         ("block", "*.adserver*/**"), ("block", "*casino*/**"), ("block", "*/wp-login**"), ("block", "*/wp-admin/**"),
         ("block", "*/cgi-bin/**"), ("block", "**.exe"), ("block", "**.zip"), ("block", "**.apk"), ("block", "**.mp4"),
         ("block", "*/login"), ("block", "*/cart/**"), ("block", "*/checkout/**"), ("block", "*/search/**"),
         ("block", "**/tag/*/page/*"), ("allow", "*.wikipedia.org/**"), ("allow", "*.edu/**"), ("allow", "*.gov/**")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_rule_glob(rule: str) -> str:
    return f"*.{rule}**"


class Automaton:
    """Rules packed side by side: state j of a rule is a bit, set when its first j symbols are matched.

    A step with byte c keeps a bit where a wildcard follows its state and allows c, and moves a bit up
    where the next symbol allows c. A rule's first state has no way in, so bits never leak from the rule
    below it.
    """

    def __init__(self, globs: list[str]):
        step, loop, first, last = [], [], [], []  # per state: bytes that lead into it, bytes that keep it
        for glob in globs:
            first.append(len(step))
            step.append(set())
            loop.append(set())
            for token in re.findall(rb"\*\*|\*|\?|.", glob.encode(), re.S):
                if token == b"**":
                    loop[-1] |= set(range(256))
                elif token == b"*":
                    loop[-1] |= set(range(256)) - {ord("/")}
                else:
                    step.append(set(range(256)) - {ord("/")} if token == b"?" else {token[0]})
                    loop.append(set())
            last.append(len(step) - 1)
        self.words = (len(step) + 63) // 64
        self.step, self.loop = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for table, sets in ((self.step, step), (self.loop, loop)):
            for state, chars in enumerate(sets):
                for c in chars:
                    table[c, state // 64] |= np.uint64(1 << (state % 64))
        self.start = np.zeros(self.words, np.uint64)
        for state in first:
            self.start[state // 64] |= np.uint64(1 << (state % 64))
        self.last = np.array(last)

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether each rule (column) matches each byte span (row) in whole."""
        order = np.argsort(-length, kind="stable")
        begin, size = start[order], length[order]
        live = np.tile(self.start, (len(start), 1))
        for at in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -at, "left"))  # spans longer than at
            c = data[begin[:n] + at]
            now = live[:n]
            up = now << np.uint64(1)
            up[:, 1:] |= now[:, :-1] >> np.uint64(63)
            live[:n] = (up & self.step[c]) | (now & self.loop[c])
        out = np.empty((len(start), len(self.last)), bool)
        out[order] = (live[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1) > 0
        return out


def filter_urls(pages: DataFrame, url: str = "url", host_rules=None, globs=None) -> DataFrame:
    """Adds host, path, rule, glob and verdict.

    ``host_rules`` fit a host and its subdomains from a path prefix on; among those that fit, the longest
    wins and decides. Else the longest matching glob decides, else ``allow``; a url without a host is
    blocked. One pass without a shuffle. A null url and one without ``://`` have empty host and path. All
    other columns pass through; columns named as added ones are replaced.
    """
    host_rules, globs = host_rules or HOST_RULES, globs or GLOBS
    machine = Automaton([host_rule_glob(r) for _, r in host_rules] + [g for _, g in globs])
    verdicts = np.array([v for v, _ in host_rules] + [v for v, _ in globs], object)
    names = np.array([r for _, r in host_rules] + [g for _, g in globs], object)
    # longest first, so that the first hit wins; equal lengths go by their order in the list
    by_length = [np.array(sorted(range(a, b), key=lambda i: (-len(names[i]), i)))
                 for a, b in ((0, len(host_rules)), (len(host_rules), len(names)))]
    host, path = url_parts(F.col(url))
    added = ["host", "path", "rule", "glob", "verdict"]
    whole = pages.withColumns({"host": host, "path": path})
    whole = whole.select(*[c for c in whole.columns if c not in added[2:]])
    schema = T.StructType([*whole.schema.fields, *[T.StructField(n, T.StringType()) for n in added[2:]]])

    def first_hit(hits: np.ndarray, order: np.ndarray) -> np.ndarray:
        ranked = hits[:, order]
        return np.where(ranked.any(1), order[ranked.argmax(1)], -1)

    def run(batches):
        for batch in batches:
            hosts, paths = (W.column(batch, n) for n in ("host", "path"))
            canonical = [f".{h}{p}".encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            length = np.array([len(c) for c in canonical], np.int64)
            start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(length) else length
            hits = machine.run(np.frombuffer(b"".join(canonical), np.uint8), start, length)
            rule, glob = (first_hit(hits, order) for order in by_length)
            empty = np.array([len(h) == 0 for h in hosts.to_pylist()], bool)
            rule[empty] = -1
            pick = lambda at, values: pa.array([values[i] if i >= 0 else None for i in at], pa.string())
            verdict = [verdicts[r] if r >= 0 else "block" if e else verdicts[g] if g >= 0 else "allow"
                       for r, g, e in zip(rule, glob, empty, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pick(rule, names), pick(glob, names),
                                              pa.array(verdict, pa.string())], names=schema.names)

    return whole.mapInArrow(run, schema)


def _regex(glob: str) -> str:
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(parts.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|.", glob, re.S))
    return f"(?s)^{body}$".replace("'", "''")


def _case(rules, value, canonical="'.' || host || path") -> str:
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    return "case " + " ".join(f"when regexp_matches({canonical}, '{_regex(value(rules[i])[0])}') then '{value(rules[i])[1]}'"
                              for i in ranked)


SQL = f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) as path from h),
r as (select *, case when host = '' then null else {_case(HOST_RULES, lambda x: (host_rule_glob(x[1]), x[1]))} end end as rule from p)
select page_id, host, path, rule, case when rule is not null then case rule {' '.join(f"when '{r}' then '{v}'" for v, r in HOST_RULES)} end
  when host = '' then 'block' else {_case(GLOBS, lambda x: (x[1], x[0]))} else 'allow' end end as verdict from r"""


@register("op2_url_filters", SQL)
def op2_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
