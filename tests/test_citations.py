from lumbre.plans import filings


def test_every_document_has_its_citations_verified(spark, tmp_path):
    long = "The quick brown fox jumps over the lazy dog. " * 5
    rows = [(1, long), (2, long[:40]), (3, long[:22]), (4, ""), (5, None), (6, "x" * 19 + "Año    año" + "." * 91)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["citas_verificadas"], r["citas_totales"], r["demasiado_cortas"], r["porcentaje_verificado"], r["alucinacion_detectada"]) for r in filings.n7_citations(spark, str(tmp_path)).collect()}
    held, none = (1, 3, 1, 33.3, True), (0, 3, 2, 0.0, True)
    assert got == {1: held, 2: held, 3: none, 4: none, 5: none, 6: held}
