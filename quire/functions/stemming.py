"""Suffix stemmers for English, French and German as SQL expressions.

The published Snowball definitions of the three languages, written as stages of
plain SQL over the columns of a one-word-a-row table: a stage adds columns, the
next one uses them. The regions a suffix must lie in are kept as the number of
letters before them (``r1``, ``r2``, ``rv``; ``FAR`` where there is none), so a
condition on a suffix of ``k`` letters is ``length(w) - k >= r1``. A step looks
for its longest suffix first and then for that suffix's condition.

The text of the expressions is the same in Spark and in DuckDB, except for the
group sign of a regular replacement. They are meant for a vocabulary, where
every word is stemmed once, not for running text.

Where the published French marks vowels acting as consonants in one walk, this
marks u after q, then y, u and i, each over the whole word.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAR = 1_000_000
#: A stage: the columns it adds, with their SQL.
Stage = dict[str, str]


def _ends(w: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"{w} LIKE '%{s}'" for s in suffixes) + ")"


def _cut(w: str, k: int) -> str:
    return f"left({w}, length({w}) - {k})"


def _in(w: str, k: int, region: str) -> str:
    return f"length({w}) - {k} >= {region}"


def _has(w: str, pattern: str) -> str:
    return f"regexp_extract({w}, '{pattern}', 0) <> ''"


def _after(w: str, pattern: str, otherwise: int = FAR) -> str:
    """Letters up to the end of the pattern's match."""
    return f"CASE WHEN {_has(w, pattern)} THEN length(regexp_extract({w}, '{pattern}', 0)) ELSE {otherwise} END"


def _region(w: str, vowels: str, start: str | None = None) -> str:
    """Letters before the region after the first non-vowel that follows a vowel."""
    pattern = f"^[^{vowels}]*[{vowels}]+[^{vowels}]"
    if start is None:
        return _after(w, pattern)
    rest = f"substr({w}, {start} + 1)"
    return (f"CASE WHEN {start} < length({w}) AND {_has(rest, pattern)} "
            f"THEN {start} + length(regexp_extract({rest}, '{pattern}', 0)) ELSE {FAR} END")


def _suffix(w: str, suffixes: str) -> str:
    """The longest of the suffixes that ``w`` has ('' for none): the match that
    reaches the end and begins first."""
    return f"regexp_extract({w}, '({'|'.join(suffixes.split())})$', 0)"


def _step(name: str, w: str, rules: list[tuple[str, str | None, str]]) -> list[Stage]:
    """Stages of one step, ``s_<name>`` (its suffix) and ``<name>``: of all the
    rules' suffixes the longest decides; where its condition holds, its
    replacement (after ``=`` an expression) takes its place. ``{s}`` is the suffix."""
    suffix, whens = f"s_{name}", []
    for suffixes, condition, new in rules:
        new = new[1:] if new.startswith("=") else f"left({w}, length({w}) - length({suffix})) || '{new}'"
        which = f"{suffix} IN ({', '.join(repr(x) for x in suffixes.split())})"
        whens.append(f"WHEN {which}{f' AND {condition}' if condition else ''} THEN {new}".replace("{s}", suffix))
    return [{suffix: _suffix(w, " ".join(r[0] for r in rules))}, {name: f"CASE {' '.join(whens)} ELSE {w} END"}]


def _swap(w: str, pattern: str, replacement: str, duck: bool) -> str:
    """Every match of the pattern; ``@1`` is its first group."""
    if duck:
        return "regexp_replace(%s, '%s', '%s', 'g')" % (w, pattern, replacement.replace("@", "\\"))
    return "regexp_replace(%s, '%s', '%s')" % (w, pattern, replacement.replace("@", "$"))


# ------------------------------------------------------------------- English

# Fixed values of the published English stemmer.
ENGLISH_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
                 "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
                 "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
ENGLISH_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")


def english(word: str, duck: bool = False) -> list[Stage]:
    v = "aeiouy"

    def short(w: str) -> str:
        """Ends in a short syllable."""
        return f"({_has(w, f'[^{v}][{v}][^{v}wxY]$')} OR {_has(w, f'^[{v}][^{v}]$')})"

    def within(w: str, region: str) -> str:
        return f"length({w}) - length({{s}}) >= {region}"

    kept = f"IN ({', '.join(repr(x) for x in ENGLISH_KEPT)})"
    marked = _swap(f"(CASE WHEN {word} LIKE 'y%' THEN 'Y' || substr({word}, 2) ELSE {word} END)", f"([{v}])y", "@1Y", duck)
    mended = (f"CASE WHEN {_has('b', '(at|bl|iz)$')} THEN b || 'e' "
              f"WHEN {_has('b', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut('b', 1)} "
              f"WHEN r1 >= length(b) AND {short('b')} THEN b || 'e' ELSE b END")
    special = " ".join(f"WHEN {k!r} THEN {x!r}" for k, x in ENGLISH_WORDS.items())
    return [
        {"w0": marked},
        {"r1": f"CASE WHEN {_has('w0', '^(gener|arsen)')} THEN 5 WHEN w0 LIKE 'commun%' THEN 6 ELSE {_region('w0', v)} END"},
        {"r2": _region("w0", v, "r1")},
        *_step("w1", "w0", [("sses", None, "ss"), ("ied ies", "length(w0) > 4", "i"), ("ied ies", None, "ie"), ("us ss", None, "=w0"),
                            ("s", _has(_cut("w0", 2), f"[{v}]"), "")]),
        {"s_b": _suffix("w1", "eedly eed ingly edly ing ed")},
        {"b": f"CASE WHEN s_b IN ('ingly', 'edly', 'ing', 'ed') AND NOT w1 {kept} "
              f"AND {_has('left(w1, length(w1) - length(s_b))', f'[{v}]')} THEN left(w1, length(w1) - length(s_b)) END"},
        {"w2": f"CASE WHEN b IS NOT NULL THEN {mended} WHEN s_b IN ('eed', 'eedly') AND length(w1) - length(s_b) >= r1 "
               "THEN left(w1, length(w1) - length(s_b)) || 'ee' ELSE w1 END"},
        {"w3": f"CASE WHEN {_has('w2', f'.[^{v}][yY]$')} THEN {_cut('w2', 1)} || 'i' ELSE w2 END"},
        *_step("w4", "w3", [(s, within("w3", "r1"), r) for s, r in (
            ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer ization", "ize"),
            ("ational ation ator", "ate"), ("alism aliti alli", "al"), ("fulness fulli", "ful"), ("ousli ousness", "ous"),
            ("iveness iviti", "ive"), ("biliti bli", "ble"), ("lessli", "less"))]
            + [("ogi", f"{within('w3', 'r1')} AND w3 LIKE '%logi'", "og"),
               ("li", f"{within('w3', 'r1')} AND {_has('w3', '[cdeghkmnrt]li$')}", "")]),
        *_step("w5", "w4", [(s, within("w4", "r1"), r) for s, r in (
            ("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate iciti ical", "ic"), ("ful ness", ""))]
            + [("ative", within("w4", "r2"), "")]),
        *_step("w6", "w5", [("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", within("w5", "r2"), ""),
                            ("ion", f"{within('w5', 'r2')} AND {_has('w5', '[st]ion$')}", "")]),
        {"w7": f"CASE WHEN w6 LIKE '%e' AND ({_in('w6', 1, 'r2')} OR ({_in('w6', 1, 'r1')} AND NOT {short(_cut('w6', 1))})) "
               f"THEN {_cut('w6', 1)} WHEN w6 LIKE '%ll' AND {_in('w6', 1, 'r2')} THEN {_cut('w6', 1)} ELSE w6 END"},
        {"stem": f"coalesce(CASE {word} {special} END, CASE WHEN length({word}) <= 2 THEN {word} WHEN w1 {kept} THEN w1 "
                 f"ELSE replace(w7, 'Y', 'y') END)"},
    ]


# -------------------------------------------------------------------- French

# Fixed values of the published French stemmer: endings of its first step by what
# becomes of them, and of its verb steps.
FRENCH_ENDINGS = {
    "gone": "ance iqUe isme able iste eux ances iqUes ismes ables istes", "ic": "atrice ateur ation atrices ateurs ations",
    "log": "logie logies", "u": "usion ution usions utions", "ent": "ence ences", "ement": "ement ements", "ité": "ité ités",
    "if": "if ive ifs ives", "eau": "eaux", "al": "aux", "eux": "euse euses", "issement": "issement issements",
    "amment": "amment", "emment": "emment", "ment": "ment ments"}
FRENCH_I_VERBS = ("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is "
                  "issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
FRENCH_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
FRENCH_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def french(word: str, duck: bool = False) -> list[Stage]:
    v = "aeiouyâàëéêèïîôûù"

    def which(*endings: str) -> str:
        return "s IN (" + ", ".join(repr(x) for e in endings for x in FRENCH_ENDINGS[e].split()) + ")"

    def drop(k: int, region: str, short: str | None = None) -> str:
        """``x`` without ``k`` letters inside the region, else with them replaced by ``short``."""
        otherwise = "x" if short is None else f"{_cut('x', k)} || '{short}'"
        return f"CASE WHEN {_in('x', k, region)} THEN {_cut('x', k)} ELSE {otherwise} END"

    at = f"CASE WHEN x LIKE '%icat' THEN CASE WHEN {_in('x', 4, 'r2')} THEN {_cut('x', 4)} ELSE {_cut('x', 4)} || 'iqU' END ELSE {_cut('x', 2)} END"
    first = " ".join(f"WHEN {c} THEN {new}" for c, new in [
        (f"{which('gone')} AND length(x) >= r2", "x"),
        (f"{which('ic')} AND length(x) >= r2", f"CASE WHEN x LIKE '%ic' THEN {drop(2, 'r2', 'iqU')} ELSE x END"),
        (f"{which('log')} AND length(x) >= r2", "x || 'log'"), (f"{which('u')} AND length(x) >= r2", "x || 'u'"),
        (f"{which('ent')} AND length(x) >= r2", "x || 'ent'"),
        (f"{which('ement')} AND length(x) >= rv", " ".join([
            f"CASE WHEN x LIKE '%ativ' AND {_in('x', 4, 'r2')} THEN {_cut('x', 4)} WHEN x LIKE '%iv' THEN {drop(2, 'r2')}",
            f"WHEN x LIKE '%eus' AND {_in('x', 3, 'r2')} THEN {_cut('x', 3)} WHEN x LIKE '%eus' AND {_in('x', 3, 'r1')} THEN {_cut('x', 3)} || 'eux'",
            f"WHEN {_ends('x', 'abl', 'iqU')} THEN {drop(3, 'r2')}",
            f"WHEN {_ends('x', 'ièr', 'Ièr')} AND {_in('x', 3, 'rv')} THEN {_cut('x', 3)} || 'i' ELSE x END"])),
        (f"{which('ité')} AND length(x) >= r2", f"CASE WHEN x LIKE '%abil' THEN {drop(4, 'r2', 'abl')} "
                                                f"WHEN x LIKE '%ic' THEN {drop(2, 'r2', 'iqU')} WHEN x LIKE '%iv' THEN {drop(2, 'r2')} ELSE x END"),
        (f"{which('if')} AND length(x) >= r2", f"CASE WHEN x LIKE '%at' AND {_in('x', 2, 'r2')} THEN {at} ELSE x END"),
        (which("eau"), "x || 'eau'"), (f"{which('al')} AND length(x) >= r1", "x || 'al'"),
        (f"{which('eux')} AND length(x) >= r2", "x"), (f"{which('eux')} AND length(x) >= r1", "x || 'eux'"),
        (f"{which('issement')} AND length(x) >= r1 AND {_has('x', f'[^{v}]$')}", "x"),
        (f"{which('amment')} AND length(x) >= rv", "x || 'ant'"), (f"{which('emment')} AND length(x) >= rv", "x || 'ent'"),
        (f"{which('ment')} AND length(x) - 1 >= rv AND {_has('x', f'[{v}]$')}", "x")])
    short_e = "left(w2, length(w2) - length(s3))"
    return [
        {"m0": _swap(word, "qu", "qU", duck)},
        {"m1": _swap(_swap("m0", f"([{v}])y", "@1Y", duck), f"y([{v}])", "Y@1", duck)},
        {"m2": _swap("m1", f"([{v}])u([{v}])", "@1U@2", duck)},
        {"w0": _swap("m2", f"([{v}])i([{v}])", "@1I@2", duck)},
        {"rv": f"CASE WHEN {_has('w0', f'^(par|col|tap|[{v}][{v}].)')} THEN 3 ELSE {_after('w0', f'^.[^{v}]*[{v}]')} END",
         "r1": _region("w0", v)},
        {"r2": _region("w0", v, "r1"), "s": _suffix("w0", " ".join(FRENCH_ENDINGS.values()))},
        {"x": "left(w0, length(w0) - length(s))"},
        {"w1": f"CASE {first} ELSE w0 END"},
        # verbs follow when nothing was removed, and after the adverbs; in RV alone
        {"go": f"w1 = w0 OR {which('amment', 'emment', 'ment')}", "s2": _suffix("substr(w1, rv + 1)", FRENCH_I_VERBS)},
        {"i_verb": f"go AND s2 <> '' AND length(w1) - length(s2) > rv AND {_has('left(w1, length(w1) - length(s2))', f'[^{v}]$')}"},
        {"w2": "CASE WHEN i_verb THEN left(w1, length(w1) - length(s2)) ELSE w1 END"},
        {"s3": f"CASE WHEN go AND NOT i_verb THEN {_suffix('substr(w2, rv + 1)', f'{FRENCH_E_VERBS} {FRENCH_A_VERBS} ions')} ELSE '' END"},
        {"w3": f"CASE WHEN s3 = 'ions' AND {_in('w2', 4, 'r2')} THEN {short_e} WHEN s3 IN ('', 'ions') THEN w2 "
               f"WHEN s3 IN ({', '.join(repr(x) for x in FRENCH_A_VERBS.split())}) AND {short_e} LIKE '%e' AND length(w2) - length(s3) > rv "
               f"THEN {_cut(short_e, 1)} ELSE {short_e} END"},
        {"w4": f"CASE WHEN w3 <> w0 THEN CASE WHEN w3 LIKE '%Y' THEN {_cut('w3', 1)} || 'i' WHEN w3 LIKE '%ç' THEN {_cut('w3', 1)} || 'c' ELSE w3 END "
               f"WHEN {_has('w3', '[^aiouès]s$')} THEN {_cut('w3', 1)} ELSE w3 END"},
        {"s5": f"CASE WHEN w3 <> w0 THEN '' ELSE {_suffix('substr(w4, rv + 1)', 'ion ier ière Ier Ière e')} END"},
        {"w5": f"CASE WHEN s5 = 'ion' THEN CASE WHEN {_in('w4', 3, 'r2')} AND {_in('w4', 4, 'rv')} AND {_has('w4', '[st]ion$')} THEN {_cut('w4', 3)} ELSE w4 END "
               f"WHEN s5 = 'e' THEN {_cut('w4', 1)} WHEN s5 <> '' THEN left(w4, length(w4) - length(s5)) || 'i' ELSE w4 END"},
        {"w6": f"CASE WHEN {_has('w5', '(enn|onn|ett|ell|eill)$')} THEN {_cut('w5', 1)} ELSE w5 END"},
        {"accent": f"regexp_extract(w6, '[éè][^{v}]+$', 0)"},
        {"stem": "lower(CASE WHEN accent <> '' THEN left(w6, length(w6) - length(accent)) || 'e' || substr(accent, 2) ELSE w6 END)"},
    ]


# -------------------------------------------------------------------- German

def german(word: str, duck: bool = False) -> list[Stage]:
    v = "aeiouyäöü"
    ig = f"x LIKE '%ig' AND {_in('x', 2, 'r2')}"
    return [
        {"m0": _swap(f"replace({word}, 'ß', 'ss')", f"([{v}])u([{v}])", "@1U@2", duck)},
        {"w0": _swap("m0", f"([{v}])y([{v}])", "@1Y@2", duck)},
        {"p1": _region("w0", v)},
        {"r1": "greatest(p1, 3)", "r2": _region("w0", v, "p1")},
        *_step("w1", "w0", [("em ern er e en es", "length(w0) - length({s}) >= r1", ""),
                            ("s", f"{_in('w0', 1, 'r1')} AND {_has('w0', '[bdfghklmnrt]s$')}", "")]),
        {"w2": f"CASE WHEN w1 <> w0 AND s_w1 IN ('e', 'en', 'es') AND w1 LIKE '%niss' THEN {_cut('w1', 1)} ELSE w1 END"},
        *_step("w3", "w2", [("en er est", "length(w2) - length({s}) >= r1", ""),
                            ("st", f"{_in('w2', 2, 'r1')} AND {_has('w2', '^...+[bdfghklmnt]st$')}", "")]),
        {"s4": _suffix("w3", "isch lich heit keit end ung ig ik")},
        {"x": "CASE WHEN s4 <> '' AND length(w3) - length(s4) >= r2 THEN left(w3, length(w3) - length(s4)) END"},
        {"w4": f"CASE WHEN x IS NULL THEN w3 WHEN s4 IN ('end', 'ung') THEN CASE WHEN {ig} AND x NOT LIKE '%eig' THEN {_cut('x', 2)} ELSE x END "
               f"WHEN s4 IN ('lich', 'heit') THEN CASE WHEN {_ends('x', 'er', 'en')} AND {_in('x', 2, 'r1')} THEN {_cut('x', 2)} ELSE x END "
               f"WHEN s4 = 'keit' THEN CASE WHEN x LIKE '%lich' AND {_in('x', 4, 'r2')} THEN {_cut('x', 4)} WHEN {ig} THEN {_cut('x', 2)} ELSE x END "
               "WHEN x LIKE '%e' THEN w3 ELSE x END"},
        {"stem": "translate(w4, 'UYäöü', 'uyaou')"},
    ]


STEMMERS: dict[str, Callable[..., list[Stage]]] = {"english": english, "french": french, "german": german}


def stem_column(words: DataFrame, language: str, word: str = "word", out: str = "lexeme") -> DataFrame:
    """Add ``out``, the stem of the lower-cased column ``word``; a language
    without a stemmer keeps the word. NULL gives NULL."""
    if language not in STEMMERS:
        return words.withColumn(out, F.col(word))
    d = words.withColumn("stem_of", F.col(word))
    names = []
    for stage in STEMMERS[language]("stem_of"):
        d = d.withColumns({f"st_{n}": F.expr(_prefixed(sql, names)) for n, sql in stage.items()})
        names += stage
    # behind a generator: a filter on the stem must not be rewritten through all stages
    stem = F.inline(F.array(F.struct(F.col("st_stem").alias(out))))
    return d.select(*(c for c in words.columns if c != out), stem)


def _prefixed(sql: str, names: list[str]) -> str:
    """``sql`` with the stage columns it uses renamed ``st_<name>`` (outside literals)."""
    parts = re.split(r"('[^']*')", sql)
    swap = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b(?!\s*\()") if names else None
    return "".join(p if p.startswith("'") or swap is None else swap.sub(r"st_\1", p) for p in parts)


def stem_sql(source: str, language: str, word: str = "word", out: str = "lexeme") -> str:
    """DuckDB: ``source`` (a table) with ``out``, the stem of ``word``."""
    if language not in STEMMERS:
        return f"SELECT *, {word} AS {out} FROM {source}"
    sql, names = f"SELECT *, {word} AS stem_of FROM {source}", []
    for stage in STEMMERS[language]("stem_of", duck=True):
        sql = f"SELECT *, {', '.join(f'{_prefixed(x, names)} AS st_{n}' for n, x in stage.items())} FROM ({sql})"
        names += stage
    return f"SELECT * EXCLUDE (stem_of, {', '.join(f'st_{n}' for n in names)}), st_stem AS {out} FROM ({sql})"
