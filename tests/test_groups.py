from lumbre.plans import registry


def test_groups_of_clusters_have_all_and_their_counts(spark, tmp_path, day):
    caps = {e: 3_000_000_000 + e for e in range(1, 43)} | {50: 2_000_000_000, 51: 2_000_000_001, 52: None, 53: 5, 54: 9_000_000_000}
    buys = [(e, n, "P", day(k)) for e in caps if e != 54 for k, n in enumerate("ABC")] + [(54, "A", "P", day(0)), (99, "A", "P", day(0)), (99, "B", "P", day(0)), (99, "C", "P", day(0))]
    spark.createDataFrame(buys, "empresa_id int, nombre_insider string, tipo_transaccion string, fecha_transaccion date").write.parquet(str(tmp_path / "insider_transactions.parquet"))
    spark.createDataFrame([(e, f"T{e}", c) for e, c in caps.items()], "id int, ticker string, market_cap_usd long").write.parquet(str(tmp_path / "empresas.parquet"))
    got = registry.queries()["a11_groups"](spark, str(tmp_path)).collect()
    assert {r["empresa_id"]: r["grupo"] for r in got} == {e: "resto" if e in (50, 52, 53) else "grande" for e in caps if e != 54}
    assert {(r["grandes"], r["resto"]) for r in got} == {(43, 3)} and len(got) == 46
    assert registry.queries()["a11_split"](spark, str(tmp_path)).count() == 40
