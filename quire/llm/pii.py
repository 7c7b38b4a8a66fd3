"""PII: candidate gradient boosting, in DataFrame expressions only.

Generators (regular expressions, wide ones included) propose spans that may
overlap. Every candidate gets small integer features of its format and of the
text around it. The candidates of all documents are counted by feature cell;
the cells (bounded by the bins, whatever the input) train boosted trees of
depth 2 on checks the features don't see: a checksum, a number range, a name
before the span. A fold of the cells by document is held out, and each
generator's threshold is the least score whose candidates at or above it pass
the check to ``PRECISION`` there. Spans that pass their base check always stay;
the trees add others over the threshold.

Per row everything is array expressions, so no row is joined or shuffled. The
positions come from the pieces between matches; running sums are taken in
blocks, so a very long text stays linear.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, table
from quire.operators.matching import with_once

KINDS = ["email", "ip", "card", "phone", "secret"]
PRECISION = 0.95
MIN_HELD_OUT = 20
ROUNDS = 24
RATE = 0.3

_L = "A-Za-z0-9._%+-"
_S = "A-Za-z0-9_/+="
#: kind, pattern, cheap test that a text can match. The first four are the
#: base patterns: a run is entered at its start or where the last match ended
#: (the matches are the same, without trying every start of a long run).
GENERATORS = [
    ("email", rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"contains(t, '.') AND t RLIKE r'[0-9]\.[0-9]'"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"t RLIKE r'[0-9]'"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')"),
    ("email", rf"(?<![{_L}])[{_L}]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++"
              r"(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++", r"t RLIKE r'[(\[](?:at|AT)[)\]]'"),
    ("phone", r"(?<![0-9])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
     r"t RLIKE r'[0-9]{3}[)]?[\x20.-][0-9]{3}[\x20.-]'"),
    ("secret", rf"(?<![{_S}-])[{_S}-]{{20,}}+", r"t RLIKE r'[0-9]'"),
]
BASE = 4

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_DIGITS = "regexp_replace(c.value, '[^0-9]', '')"
_LUHN = f"""(aggregate(split({_DIGITS}, ''), named_struct('even', 0, 'odd', 0), (a, d) -> named_struct(
    'even', a.odd + IF(d = '', 0, int(d)),
    'odd', a.even + IF(d = '', 0, IF(int(d) < 5, 2 * int(d), 2 * int(d) - 9)))).even % 10 = 0)"""
#: What a candidate ``c`` is checked against, by generator; never a feature.
CHECKS = [
    "true",
    rf"c.value RLIKE r'^{_PART}(?:\.{_PART}){{3}}$'",
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    f"length({_DIGITS}) BETWEEN 9 AND 15",
    r"c.value RLIKE r'[A-Za-z]{2,}$'",
    r"c.before RLIKE r'\+[0-9]{1,3}[\x20-]?$'",
    r"""c.before RLIKE r'(?i)(?:token|key|secret|password|passwd|pwd|bearer|auth)[\x20:="\x27]{0,5}$'""",
]

_CLASS = """CASE WHEN {0} = '' THEN 0 WHEN {0} RLIKE r'\\s' THEN 1 WHEN {0} RLIKE r'[\\x22\\x27`]' THEN 2
    WHEN {0} RLIKE r'[\\p{{L}}0-9]' THEN 4 ELSE 3 END"""
#: Small integer features of a candidate ``c``.
FEATURES = {
    "gen": "c.gen",
    "size": "least(int(length(c.value) / 4), 15)",
    "digits": f"least(length({_DIGITS}), 20)",
    "letters": "int(4 * length(regexp_replace(c.value, '[^A-Za-z]', '')) / length(c.value))",
    "upper": "least(length(regexp_replace(c.value, '[^A-Z]', '')), 3)",
    "marks": "least(length(regexp_replace(c.value, '[A-Za-z0-9]', '')), 5)",
    "left": _CLASS.format("right(c.before, 1)"),
    "right": _CLASS.format("c.after"),
}


def _let(value: str, name: str, body: str) -> str:
    """SQL: evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(a: str, op: str = "{s} + {x}", block: int = 512) -> str:
    """SQL: the running sums (or another fold from 0) of the long array ``a``, in blocks."""
    fold = op.format(s="s", x="x")
    last = op.format(s="element_at(acc, -1)", x="x")
    total = f"aggregate(slice({a}, b * {block} + 1, {block}), element_at(acc, -1), (s, x) -> {fold})"
    numbers = f"sequence(0, int(greatest(size({a}) - 1, 0) / {block}))"
    starts = f"aggregate({numbers}, array(0L), (acc, b) -> concat(acc, array({total})))"
    part = f"aggregate(slice({a}, b * {block} + 1, {block}), array(st[b]), (acc, x) -> concat(acc, array({last})))"
    return _let(starts, "st", f"flatten(transform({numbers}, b -> slice({part}, 2, {block})))")


def candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` plus the array ``out`` of candidate structs ``gen, kind, start,
    end, value, before, after, base, checked`` and one field per feature."""
    n = len(GENERATORS)
    names = fresh(docs, "t", *(f"{x}{i}" for x in "phs" for i in range(n)), "cands")
    t, p, h, s, raw = names[0], names[1: n + 1], names[n + 1: 2 * n + 1], names[2 * n + 1: 3 * n + 1], names[-1]
    df = with_once(docs, **{t: F.coalesce(F.col(text), F.lit(""))})
    cut = {}
    for i, (_, pattern, gate) in enumerate(GENERATORS):
        on = F.expr(gate.replace("(t,", f"(`{t}`,").replace("t RLIKE", f"`{t}` RLIKE"))
        none = F.expr("array(CAST(NULL AS string))")
        cut[p[i]] = F.when(on, F.split(t, pattern, -1)).otherwise(F.slice(none, 1, 0))
        cut[h[i]] = F.when(on, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(F.slice(none, 1, 0))
    df = with_once(df, **cut)
    df = with_once(df, **{s[i]: F.expr(running(
        f"transform(`{h[i]}`, (v, k) -> bigint(length(`{p[i]}`[k]) + IF(k > 0, length(`{h[i]}`[k - 1]), 0)))"))
        for i in range(n)})
    lists = [f"""transform(`{h[i]}`, (v, k) -> named_struct('gen', {i}, 'kind', '{kind}', 'start', `{s[i]}`[k],
        'end', `{s[i]}`[k] + length(v), 'value', v, 'before', right(`{p[i]}`[k], 24),
        'after', left(`{p[i]}`[k + 1], 1)))""" for i, (kind, _, _) in enumerate(GENERATORS)]
    df = with_once(df, **{raw: F.expr(f"concat({', '.join(lists)})")})
    checked = "CASE c.gen " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(CHECKS)) + " END"
    fields = ", ".join(f"'{k}', {e}" for k, e in FEATURES.items() if k != "gen")
    full = F.expr(f"""transform(`{raw}`, c -> named_struct('gen', c.gen, 'kind', c.kind, 'start', c.start,
        'end', c.end, 'value', c.value, 'checked', {checked}, {fields}))""")
    return with_once(df, **{out: full}).select(*docs.columns, out)


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray):
    """(gain, feature, threshold) of the best cut ``x[feature] <= threshold`` of the rows."""
    score = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, 0, -1)
    whole = score(g[rows].sum(), h[rows].sum())
    for f in range(x.shape[1]):
        v = x[rows, f]
        size = int(v.max(initial=0)) + 1
        gs, hs = np.bincount(v, g[rows], size).cumsum(), np.bincount(v, h[rows], size).cumsum()
        gain = score(gs, hs) + score(gs[-1] - gs, hs[-1] - hs) - whole
        t = int(gain.argmax())
        if gain[t] > best[0] + 1e-9:
            best = (float(gain[t]), f, t)
    return best


def boost(x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """Trees ``(feature, threshold, (left), (right))`` of two levels on weighted cells."""
    margin, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = pos - n * p, n * p * (1 - p)
        _, f, t = _best_split(x, g, h, np.arange(len(x)))
        sides = []
        for rows in (np.flatnonzero(x[:, f] <= t), np.flatnonzero(x[:, f] > t)):
            _, f2, t2 = _best_split(x, g, h, rows)
            leaf = []
            for sub in (rows[x[rows, f2] <= t2], rows[x[rows, f2] > t2]):
                value = RATE * g[sub].sum() / (h[sub].sum() + 1.0)
                margin[sub] += value
                leaf.append(float(value))
            sides.append((f2, t2, *leaf))
        trees.append((f, t, *sides))
    return trees


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for f, t, a, b in trees:
        for side, on in ((a, x[:, f] <= t), (b, x[:, f] > t)):
            out += on * np.where(x[:, side[0]] <= side[1], side[2], side[3])
    return out


def train(cands: DataFrame, column: str, fold: Column) -> tuple[list[tuple], list[float | None], list[int]]:
    """The trees, each generator's threshold (None: nothing is added), and the generators
    with fewer than ``MIN_HELD_OUT`` held-out candidates, too few for a threshold."""
    names = list(FEATURES)
    cells = (cands.select(fold.alias("fold"), F.explode(column).alias("c"))
             .groupBy("fold", *(F.col(f"c.{f}").alias(f) for f in names))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.checked").cast("int")).alias("pos"))
             .toArrow().to_pydict())  # at most one row a feature cell and fold
    x = np.array([cells[f] for f in names], np.int64).T.reshape(-1, len(names))
    n, pos, held = (np.array(cells[k], t) for k, t in (("n", float), ("pos", float), ("fold", bool)))
    order = np.lexsort((*x.T, held))
    x, n, pos, held = x[order], n[order], pos[order], held[order]
    if not len(x) or not (~held).any():
        return [], [None] * len(GENERATORS), list(range(len(GENERATORS)))
    trees = boost(x[~held], n[~held], pos[~held])
    score = predict(trees, x)
    limits: list[float | None] = []
    rare = [g for g in range(len(GENERATORS)) if n[held & (x[:, 0] == g)].sum() < MIN_HELD_OUT]
    for gen in range(len(GENERATORS)):
        own = held & (x[:, 0] == gen)
        values, at = np.unique(-score[own], return_inverse=True)
        good = np.bincount(at, pos[own], len(values)).cumsum()
        seen = np.bincount(at, n[own], len(values)).cumsum()
        fit = np.flatnonzero((seen >= MIN_HELD_OUT) & (good >= PRECISION * seen))
        limits.append(float(-values[fit[-1]]) if len(fit) else None)
    return trees, limits, rare


def _score_sql(trees: list[tuple]) -> str:
    names = list(FEATURES)
    case = "IF(c.{} <= {}, {}, {})".format
    parts = [case(names[f], t, *(case(names[s[0]], s[1], f"{s[2]!r}D", f"{s[3]!r}D") for s in (a, b)))
             for f, t, a, b in trees]
    return " + ".join(parts) or "0D"


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", base: str = "base",
             spans: str = "spans") -> DataFrame:
    """``docs`` plus two arrays of structs ``start, rank, kind, end`` sorted in
    that order (rank: place of the kind in ``KINDS``): ``base``, the spans that
    pass their base check, and ``spans``, those and the added ones.

    A generator with fewer than ``MIN_HELD_OUT`` held-out candidates has no
    threshold and adds those that pass its own check.

    Offsets are code points, the end exclusive. A null or empty text has no
    spans. Ties (several kinds at one start) stay side by side; an added span
    inside a base span is left out. The fold is a hash of doc_id, null
    included. Repeated rows get equal results, clashing columns are replaced,
    extra ones carried; an empty table gives an empty table.
    """
    docs = docs.drop(base, spans)
    (col,) = fresh(docs, "found")
    cands = candidates(docs, text, col)
    held = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(5)) == 0
    trees, limits, rare = train(cands.select(held.alias("held"), col), col, F.col("held"))
    rank = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    as_span = f"c -> named_struct('start', c.start, 'rank', {rank}, 'kind', c.kind, 'end', c.end)"
    sure = f"filter(`{col}`, c -> c.gen < {BASE} AND c.checked)"
    over = "CASE c.gen " + " ".join(f"WHEN {i} THEN {v!r}D" for i, v in enumerate(limits) if v is not None) + \
        " WHEN -1 THEN 0D END"
    alike = f"c.checked AND c.gen IN ({', '.join(map(str, [-1, *rare]))})"
    some = f"""filter(`{col}`, c -> NOT (c.gen < {BASE} AND c.checked)
        AND (coalesce({_score_sql(trees)} >= {over}, false) OR coalesce({alike}, false)))"""
    (more,) = fresh(cands, "more")
    out = with_once(cands, **{base: F.expr(f"array_sort(transform({sure}, {as_span}))"),
                        more: F.expr(f"transform({some}, {as_span})")})
    alone = f"filter(`{more}`, m -> NOT exists(`{base}`, b -> b.start <= m.start AND m.end <= b.end))"
    return (out.withColumn(spans, F.expr(f"array_sort(array_distinct(concat(`{base}`, {alone})))"))
            .select(*docs.columns, base, spans))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; spans that
    overlap become one mark, of the first. Texts without spans stay as they are
    (null included); cases as in ``find_pii``."""
    base, spans, seen, wide = fresh(docs, "base", "spans", "seen", "wide")
    found = find_pii(docs, text, doc_id, base, spans)
    ends = running(f"transform(`{spans}`, c -> c.end)", "greatest({s}, {x})")
    found = with_once(found, **{seen: F.expr(f"concat(array(0L), {ends})"),
                          wide: F.expr(f"IF(size(`{spans}`) > 0, encode(`{text}`, 'UTF-32'), NULL)")})
    cut = f"decode(substring(`{wide}`, int(4 * {{0}} + 1), int(4 * greatest({{1}} - {{0}}, 0))), 'UTF-32')"
    gaps = f"""transform(`{spans}`, (c, k) -> concat({cut.format(f'`{seen}`[k]', 'c.start')},
        IF(c.start >= `{seen}`[k], concat('[', upper(c.kind), ']'), '')))"""
    tail = cut.format(f"element_at(`{seen}`, -1)", f"length(`{text}`)")
    return found.withColumn(text, F.expr(
        f"IF(size(`{spans}`) > 0, concat(array_join({gaps}, ''), {tail}), `{text}`)")).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = "array_join(transform({}, c -> concat_ws(':', c.kind, c.start, c.end)), ',')"
    counts = [F.expr(f"bigint(size(filter(base, c -> c.kind = '{k}')))").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(F.expr(line.format("base")), 256).alias("base_sha256"),
                        F.expr(line.format("spans")).alias("spans"))
