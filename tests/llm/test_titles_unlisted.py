import itertools
import pathlib

import pytest

from lumbre.llm import names


def test_slips_in_words_outside_the_list_are_linked(spark):
    groups = [["Chief Compliance Officer", "Chief Complaince Officer", "Chief Compliannce Ofcr", "chief compliance officer"], ["VP Procurement", "Vice President, Procuremnet", "V.P. Procurrement"]]
    apart = ["Senior Vice President, Procurement", "Chief Actuarial Officer", "Chief Sustainability Officer", "Region 1234 Head", "Region 1243 Head", "Compliance Officer", "Internal Audit Director", "International Audit Director"]
    got = names.pairs_of(names.title_variants(spark.createDataFrame([(t,) for g in [*groups, apart] for t in g], "c string"), "c"), [], "c")
    assert {frozenset((r["texto_a"], r["texto_b"])) for r in got.collect()} == {frozenset((a, b)) for g in groups for a in g for b in g if a != b}


def test_offices_of_a_block():
    assert names.same_office("chief complaince officer", "chief compliance officer")
    assert not names.same_office("chief compliance officer", "chief compliance ethics officer")
    assert not names.same_office("chief actuarial officer", "chief sustainability officer")
    assert not names.same_office("chief developer officer", "chief development officer")
    assert not names.same_office("president", "resident") and not names.same_office("region 1234", "region 1243")


def _pairs(spark, titles):
    got = names.pairs_of(names.title_variants(spark.createDataFrame([(t,) for t in titles], "c string"), "c"), [], "c")
    return {frozenset((r["texto_a"], r["texto_b"])) for r in got.collect()}


def test_slips_without_any_list_of_words(spark):
    linked = [("Chief Medical Officer", "Chief Medcial Officer"), ("Chief Compliance Officer", "Chief Complience Officer"), ("Investor Relations", "Investor Relatons"), ("Chief Revenue Officer", "Chief Reveneu Officer"), ("Überwachungsleiter", "Uberwachungslieter")]
    apart = ["Chief Development Officer", "Chief Developer Officer", "Chief Information Officer", "Chief Innovation Officer", "Treasurer", "Treasury"]
    assert _pairs(spark, [t for p in linked for t in p] + apart) == {frozenset(p) for p in linked}


def test_short_forms_of_several_meanings_follow_the_titles(spark):
    assert _pairs(spark, ["CSO", "Chief Security Officer", "CIO", "Chief Information Officer", "C.I.O."]) == {frozenset(p) for p in itertools.chain([("CSO", "Chief Security Officer")], itertools.combinations(["CIO", "Chief Information Officer", "C.I.O."], 2))}
    assert _pairs(spark, ["CSO", "Chief Security Officer", "Chief Strategy Officer"]) == set()


def test_blocks_of_offices_lose_no_pair():
    words = ["compliance", "complience", "complaince", "revenue", "reveneu", "medical", "medcial", "procurement", "procuremnet", "procurrement", "relations", "relatons", "director", "direcotr", "directr", "finacial", "financial", "sustainability", "sustianability"]
    offices = [" ".join(sorted({*x.split(), w})) for w in words for x in ("chief officer", "vice president", "")]
    for a, b in itertools.combinations(offices, 2):
        if names.same_office(a, b):
            assert set(names.office_keys(a)) & set(names.office_keys(b)), (a, b)


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_blocks_of_names_lose_no_pair():
    """Recall of the blocks against all pairs of an entity: at least 0.99."""
    import duckdb

    rows = duckdb.sql("SELECT DISTINCT empresa_id, nombre_insider FROM '/root/testdata/sf0.001/insider_transactions.parquet' WHERE trim(nombre_insider) <> ''").fetchall()
    by: dict = {}
    for e, t in rows:
        by.setdefault(e, []).append((names.Name(t), set(names.block_keys(names.Name(t)))))
    pairs = [bool(ka & kb) for group in by.values() for (a, ka), (b, kb) in itertools.combinations(group, 2) if names.compare(a, b) is not None]
    assert len(pairs) > 20 and sum(pairs) >= 0.99 * len(pairs)
