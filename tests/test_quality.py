import pytest

from lumbre.functions import quality, register
from lumbre.plans.config import Config


def test_violations_and_domains(spark):
    df = spark.createDataFrame([(1, "A"), (9, "B"), (None, None)], "q int, c string")
    got = {r["regla"]: (r["incumplen"], r["nulos"]) for r in quality.violations(df, {"q": "q between 1 and 4", "c": "c = 'A'"}).collect()}
    assert got == {"q": (1, 1), "c": (1, 1)}
    assert {tuple(r) for r in quality.violations(df.limit(0), {"q": "q > 0"}).collect()} == {("q", 0, 0)}
    quality.assert_domain(df, "c", ["A", "B"])
    with pytest.raises(ValueError, match="c has 'B'"):
        quality.assert_domain(df, "c", ["A"])


def test_registered_functions(spark):
    assert "lumbre_cik" in register.register_functions(spark)
    r = spark.sql("SELECT lumbre_cik(' 320193.0') a, lumbre_cik('12345678901') b, lumbre_precio('0') c, lumbre_texto(' nan ') d, lumbre_posicion(2, 1, 5) e, lumbre_normalizado('Ñandú  X') f, lumbre_primer_json('x {\"a\": 1} y') g").first()
    assert tuple(r) == ("0000320193", None, None, None, 0.25, "nandu x", '{"a": 1}')
    assert spark.sql("SELECT lumbre_item_8k('Item 1.01 ' || repeat('word ', 99) || ' SIGNATURES\\n', '1.01').aislada x").first()["x"] is True


def test_config(spark):
    df = spark.createDataFrame([("cluster_window_days", "90"), ("other", "x"), ("implausible_risk", None)], "clave string, valor string")
    c = Config.read(df)
    assert c.cluster_window_days == 90 and c.cluster_members == 3 and c.implausible_risk == 8e-3
    assert Config.read(df.limit(0)) == Config()
    with pytest.raises(ValueError, match="invalid literal"):
        Config.read(spark.createDataFrame([("cluster_members", "abc")], "clave string, valor string"))
