import datetime as dt
from decimal import Decimal

from lumbre.plans import problems

TX = "accession_number string, trans_sk int, fecha_registro timestamp_ntz, id long, empresa_id int, nombre_insider string, tipo_transaccion string, fecha_transaccion date, acciones long, importe_total decimal(15,2)"


def write(spark, folder, rows):
    spark.createDataFrame(rows, TX).write.parquet(f"{folder}/insider_transactions.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "id int").write.parquet(f"{folder}/empresas.parquet")


def test_totals_have_every_empresa_and_day(spark, tmp_path, day):
    acts = [(1, "A", 0, 10, 100), (1, "B", 3, 20, 250), (1, " a ", 8, 5, None), (2, "C", 40, 7, 70), (2, None, 40, 1, 10)]
    at = dt.datetime.combine(day(90), dt.time())
    rows = [(str(i), 1, at, i, e, n, "p ", day(k), sh, None if v is None else Decimal(v)) for i, (e, n, k, sh, v) in enumerate(acts)]
    write(spark, tmp_path, rows)
    got = {(r["empresa_id"], r["fecha"]): r for r in problems.p2_totales(spark, str(tmp_path)).collect()}
    assert len(got) == 3 * 91  # empresa 3 has no purchase; the last registration is of day 90
    for (e, f), r in got.items():
        k = (dt.date.fromisoformat(f) - day(0)).days
        for w in (7, 30):
            last = [x for x in acts if x[0] == e and k - w < x[2] <= k]
            want = {"compras": len(last), "acciones": sum(x[3] for x in last), "centimos": sum(100 * (x[4] or 0) for x in last), "compradores": len({(x[1] or "").strip().upper() for x in last})}
            for n, v in want.items():
                assert (r[f"{n}_{w}"], r[f"{n}_dia_{w}"]) == (v, round(v / w, 6)), (e, f, n, w)


def test_totals_without_purchases(spark, tmp_path):
    write(spark, tmp_path, [])
    assert problems.p2_totales(spark, str(tmp_path)).count() == 0
