"""Stemmers against words of the published sample vocabularies."""

import pytest

from quire.functions.stemming import STEMMERS, stem_column, stem_sql

ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knot knot knots knot skies sky dying die news news
inning inning innings inning generate generat generous generous communism communism happy happi say say by by cry cri
hopping hop hoping hope falling fall agreed agre feed feed ties tie cries cri gas gas gaps gap kiwis kiwi
nationality nation relational relat rational ration digitizer digit usefulness use boy boy yellow yellow youth youth
luxuriated luxuri adjustable adjust controlling control"""

FRENCH = """continu continu continua continu continuait continu continuant continu continuation continu continue continu
continué continu continuel continuel continuelle continuel continuellement continuel continuelles continuel
continuels continuel continuer continu continuera continu continuerait continu continueront continu continuez continu
continuité continu contorsions contors contour contour contournait contourn contournant contourn contourne contourn
contours contour contractait contract contracté contract contractée contract contracter contract contractés contract
contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr
contraint contraint contrainte contraint contraintes contraint contraire contrair contraires contrair contraria contrari
main main mains main maintenaient mainten maintenait mainten maintenant mainten maintenir mainten maintenue maintenu
maintien maintien maintint maintint maire mair maires mair mairie mair mais mais maison maison maisons maison
maître maîtr maîtres maîtr maîtresse maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu
majeur majeur majeure majeur major major majordome majordom majorité major majorités major mal mal malade malad
malades malad maladie malad maladies malad maladive malad"""

GERMAN = """aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg
aufeinanderfolgend aufeinanderfolg aufeinanderfolgende aufeinanderfolg aufeinanderfolgenden aufeinanderfolg
aufeinanderfolgt aufeinanderfolgt aufeinanderfolgten aufeinanderfolgt aufeinanderschlügen aufeinanderschlug
aufenthalt aufenthalt aufenthalten aufenthalt aufenthaltes aufenthalt auferlegen auferleg auferlegt auferlegt
auferlegten auferlegt auferstand auferstand auferstanden auferstand auferstehen aufersteh aufersteht aufersteht
auferstehung aufersteh auferstünde auferstund auferwecken auferweck auferweckt auferweckt auferzogen auferzog
aufessen aufess auffa auffa auffallen auffall auffallend auffall auffallenden auffall auffallender auffall
auffällig auffall auffälligen auffall auffälliges auffall auffassen auffass auffasst auffasst auffaßt auffasst
auffassung auffass auffassungsvermögen auffassungsvermog kategorie kategori kategorien kategori kategorisch kategor
kategorische kategor kategorischen kategor kategorischer kategor kater kat katern kat katers kat käthchen kathch
kathedrale kathedral kathinka kathinka katholik kathol katholische kathol katholischen kathol kattun kattun
kattunhalstücher kattunhalstuch katz katz kätzchen katzch kätzchens katzch katze katz katzen katz katzenwürde katzenwurd
kätzin katzin kätzlein katzlein katzmann katzmann kauen kau kauerte kauert kauf kauf kaufe kauf kaufen kauf käufer kauf
kauffahrer kauffahr kaufherr kaufherr kaufleute kaufleut käuflich kauflich"""

SAMPLES = {"english": ENGLISH, "french": FRENCH, "german": GERMAN}


@pytest.mark.parametrize("language", sorted(STEMMERS))
def test_published_words(spark, language):
    import duckdb

    flat = SAMPLES[language].split()
    pairs = dict(zip(flat[::2], flat[1::2]))
    assert len(pairs) > 50
    words = spark.createDataFrame([(w,) for w in pairs] + [(None,), ("",)], "word string")
    got = {r["word"]: r["lexeme"] for r in stem_column(words, language).collect()}
    assert {w: got[w] for w in pairs if got[w] != pairs[w]} == {}, {w: pairs[w] for w in pairs if got[w] != pairs[w]}
    assert got[None] is None and got[""] == ""
    con = duckdb.connect()
    con.execute("CREATE TABLE v (word VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [(w,) for w in pairs])
    assert dict(con.execute(f"SELECT word, lexeme FROM ({stem_sql('v', language)})").fetchall()) == {w: got[w] for w in pairs}


def test_a_language_without_stemmer_keeps_words(spark):
    words = spark.createDataFrame([("katten",)], "word string")
    assert stem_column(words, "dutch").collect() == [("katten", "katten")]


def _corpus(spark):
    rows = [(1, "English", "He connected both. A connection, or connections?"), (2, "English", "Connect the conspirators.\nTwo conspired"),
            (3, "French", "La majorité des connections"), (4, None, "connection"), (5, "English", None), (6, "English", "")]
    return spark.createDataFrame([(n, "a", lang, f"T{n}", len(t or ""), t) for n, lang, t in rows],
                                 "num long, author string, language string, title string, length long, content string")


def test_dictionary_and_search_by_stems(spark, tmp_dir):
    from quire.operators.paragraphs import book_paragraphs
    from quire.operators.postings import build_index, read_index
    from quire.operators.vocabulary import analyze_stemmed, bind_stemmed, build_dictionary, vocabulary
    from quire.plans import search as S

    books = _corpus(spark)
    paras = book_paragraphs(books)
    stems = build_dictionary(vocabulary(paras))
    got = {(r["language"], r["word"]): (r["lexeme"], r["occurrences"]) for r in stems.collect()}
    assert got["english", "connections"] == ("connect", 1) and got["english", "conspirators"] == ("conspir", 1)
    assert got["french", "majorité"] == ("major", 1) and ("english", "the") not in got
    lexemes = {r["lexeme"] for r in analyze_stemmed(paras, stems).where("num = 1").collect()}
    assert lexemes == {"connect"}
    q = bind_stemmed(spark, "connecting the conspiracy", "english", stems)
    assert [t for t in q.terms] == [("connect", 0), ("conspiraci", 2)]
    q = bind_stemmed(spark, "connecting the conspirator", "english", stems)
    scan = S.phrase_search(spark, books, q, mode="full").collect()
    assert [r["num"] for r in scan] == [2] and "**Connect** the **conspirators**" in scan[0]["relevant_paragraphs"]
    build_index(spark, books, f"{tmp_dir}/index", stemmed=True)
    idx = read_index(spark, f"{tmp_dir}/index")
    via = S.index_phrase_search(spark, idx, books, "connecting the conspirator", mode="full").collect()
    assert via == scan
    every = S.index_discovery_search(spark, idx, books, "connections").collect()
    assert sorted(r["num"] for r in every) == [1, 2]
    assert S.index_phrase_search(spark, idx, books, "nowhere").count() == 0
    assert S.phrase_search(spark, books, bind_stemmed(spark, "nowhere", "english", stems)).count() == 0
    assert build_dictionary(vocabulary(paras.limit(0))).count() == 0
