"""URL filters: a trie over reversed host labels and path segments.

The rule list is compiled once into a trie: host labels from the top-level
domain down, and below each rule host a trie of whole path segments whose
nodes hold the unfinished last segment of rules ending there. The trie is
broadcast to the tasks that judge the url column; its size is bounded by
``MAX_RULES`` rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.llm.common import table

MAX_RULES = 1_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Verdict and rule (host, then path from its slash).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        i = len(rest)
    host, tail = rest[:i].translate(_LOWER), rest[i:]
    for j, c in enumerate(tail):
        if c in "?#":
            return host, tail[:j]
    return host, tail


def compile_rules(rules: list[tuple[str, str]]) -> dict:
    """The trie. A node is ``{"kids": labels, "paths": segment node}``; a
    segment node is ``{"kids": segments, "ends": {last part: verdict}, "sizes":
    lengths of the last parts}``.
    A rule given with both verdicts blocks."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast, so at most {MAX_RULES}")
    root: dict = {"kids": {}}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not slash or not host:
            raise ValueError(f"not a rule: {verdict} {rule}")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node["kids"].setdefault(label, {"kids": {}})
        node = node.setdefault("paths", {"kids": {}, "ends": {}, "sizes": set()})
        *whole, last = path.split("/")
        for segment in whole:
            node = node["kids"].setdefault(segment, {"kids": {}, "ends": {}, "sizes": set()})
        node["sizes"].add(len(last))
        if node["ends"].get(last) != "block":
            node["ends"][last] = verdict
    return root


def judge(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits and its verdict, or two nulls.

    Longest is by characters of the whole rule; of equal length, the longer
    host wins. The walk reads one node per host label and path segment.
    """
    if not host or not path.startswith("/"):
        return None, None
    best: tuple[int, int, str, str] | None = None
    labels = host.split(".")
    segments = path[1:].split("/")
    node = trie
    for depth in range(1, len(labels) + 1):
        node = node["kids"].get(labels[-depth])
        if node is None:
            break
        at = node.get("paths")
        own = ".".join(labels[-depth:])
        for i, segment in enumerate(segments):
            if at is None:
                break
            for size in at["sizes"]:
                verdict = at["ends"].get(segment[:size]) if size <= len(segment) else None
                if verdict:
                    rule = own + "/" + "".join(s + "/" for s in segments[:i]) + segment[:size]
                    found = (len(rule), len(own), rule, verdict)
                    best = found if best is None or found[:2] > best[:2] else best
            at = at["kids"].get(segment) if i + 1 < len(segments) else None
    return (best[2], best[3]) if best else (None, None)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url",
                default: str = "allow") -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict``.

    A null url, one without ``://`` or with an empty host fits no rule; where
    no rule fits, ``rule`` is null and the verdict is ``default``. A host
    without a path (``http://a.org``) has the empty path, which starts with no
    rule's path. Clashing columns are replaced, extra ones carried, repeated
    rows stay; an empty table gives an empty table.
    """
    new = ["host", "path", "rule", "verdict"]
    pages = pages.drop(*new)
    shared = pages.sparkSession.sparkContext.broadcast(compile_rules(rules))
    at = pages.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            rows = []
            for u in b.column(at).to_pylist():
                host, path = split_url(u)
                rule, verdict = judge(trie, host, path)
                rows.append((host, path, rule, verdict or default))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, pa.string()) for c in cols)], names=[*b.schema.names, *new])

    schema = T.StructType([*pages.schema.fields, *(T.StructField(c, T.StringType()) for c in new)])
    return pages.mapInArrow(run, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _sql() -> str:
    rows = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {rows}),
rest AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, n, translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
fit AS (
  SELECT p.n, arg_max(ru.rule, length(ru.rule)) AS rule, arg_max(ru.verdict, length(ru.rule)) AS verdict
  FROM parts p JOIN rules ru
    ON (p.host = ru.rule_host OR ends_with(p.host, '.' || ru.rule_host)) AND starts_with(p.path, ru.rule_path)
  GROUP BY p.n)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON p.n = f.n
"""


SQL = _sql()
