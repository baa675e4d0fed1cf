import itertools

import pytest

from lumbre.llm import names


def linked(spark, spellings, e=1):
    df = spark.createDataFrame([(e, s, "x") for s in spellings], "e int, n string, grupo string")
    return {frozenset((r["texto_a"], r["texto_b"])) for r in names.pairs_of(names.name_variants(df, "e", "n"), ["e"], "n").collect()}


def pairs(*groups):
    return {frozenset(p) for g in groups for p in itertools.combinations(g, 2)}


def test_variants_of_persons(spark):
    a = ["SHERNARD RICHARD J", "Shernard, Richard J.", "Richard Sherbard", "dick shernard", "SHERNARD, R", "Prof Shernard Ricjard J, PhD"]
    b = ["O'GREAVMANN WILLIAM H", "O'Greavrnann, William Hugo", "wm o greavmann"]
    c = ["DE KLORNOVIC HAROLD C", "MR HAROLD DEKLORNOVIC", "De Klornovic, H"]
    d = ["Niesño Björn M", "NIESNO, BJORN M."]
    assert linked(spark, [*a, *b, *c, *d, None, "", "   "]) == pairs(a, b, c, d)


def test_relatives_and_sister_funds_stay_apart(spark):
    s = ["SKIEXGETHBERG ELIZABETH I", "SKIEXGETHBERG MARGARET I", "CRUMANN CHARLES R II", "CRUMANN CHARLES R III", "RIDGE CREEK VALUE FUND I LP", "RIDGE CREEK VALUE FUND III LP", "Flothander Gerald A", "FLOTHANDER STEVEN"]
    assert linked(spark, s) == set()
    f = ["Ridge Creek Value Fund III LP", "RIDE CREEK VALUE FD 3", "The Ridge Creek Value Fd. III, L.P."]
    assert linked(spark, [*f, "RIDGE CREEK VALUE FUND I LP"]) == pairs(f)
    assert linked(spark, ["KESTREL HOLLOW & ASSOCIATES LLC", "Kestrel Hollow and Assoc L L C"]) == pairs(["KESTREL HOLLOW & ASSOCIATES LLC", "Kestrel Hollow and Assoc L L C"])


def test_an_open_spelling_links_only_where_it_is_clear(spark):
    s = ["CRUMANN CHARLES R II", "CRUMANN CHARLES R III", "Charles Crumann", "crumann, charles r ii"]
    assert linked(spark, s) == pairs(["CRUMANN CHARLES R II", "crumann, charles r ii"])
    assert linked(spark, s[:1] + s[2:]) == pairs([s[0], s[2], s[3]])


def test_entities_apart_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "COLSEN JUDITH A"), (1, "COLSEN JUDITH A"), (2, "Judith Colsen"), (None, "judith a colsen")], "e int, n string")
    assert names.name_variants(df, "e", "n").count() == 0
    assert names.name_variants(df.limit(0), "e", "n").count() == 0
    long = "x" * 5000 + " " + "y" * 5000
    assert linked(spark, [long, long + " z"]) == pairs([long, long + " z"])


def test_titles(spark):
    groups = [
        ["CEO", "C.E.O.", "Chief Exec. Officer", "Cheif Executive Officer"],
        ["President and CEO", "PRESIDENT/CEO", "CEO and President", "Pres. & CEO", "Presdient and CEO"],
        ["EVP & CFO", "Exec. VP & Chief Financial Officer", "CFO and EVP"],
        ["SVP, Finance", "Sr Vice Pres - Finance"],
        ["VP - Ops", "V.P. Operations", "Vice President of Operations"],
        ["Director", "Direcotr", "Dir.", "Member, Board of Directors"],
        ["Chairman of the Board", "Board Chair", "Chmn"],
        ["Vice Chairman", "V. Chairman"],
        ["10% Owner", "Ten Percent Owner", "Owner of 10%", "10 percent owner"],
        ["General Counsel", "GC", "Genral Counsel", "Gen'l Counsel"],
    ]
    rows = [(t, "g") for g in groups for t in g] + [(None, "g"), (" ", "g"), ("CEO", "g")]
    got = names.pairs_of(names.title_variants(spark.createDataFrame(rows, "c string, grupo string"), "c"), [], "c")
    assert {frozenset((r["texto_a"], r["texto_b"])) for r in got.collect()} == pairs(*groups)


@pytest.mark.parametrize(("a", "b", "low"), [("martha", "marhta", 0.96), ("dixon", "dicksonx", 0.81), ("abc", "xyz", 0.0), ("", "a", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, low):
    s = names.jaro_winkler(a, b)
    assert abs(s - low) < 0.006 and s == names.jaro_winkler(b, a)


def test_phonetic_codes_survive_slips():
    for a, b in (("floulmstrom", "floulmstromm"), ("greavmann", "greavrnann"), ("vovic", "vovvic")):
        assert names.phonetic(a) == names.phonetic(b)
