"""Ownership forms: tab-separated triplets, plain or zipped, to clean transactions."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from .place import file_place

# The columns read from each file.
SUBMISSION = ("accession_number", "filing_date", "period_of_report", "issuercik", "issuername", "issuertradingsymbol")
OWNER = ("accession_number", "rptownercik", "rptownername", "rptowner_relationship", "rptowner_title")
TRANSACTION = ("accession_number", "nonderiv_trans_sk", "security_title", "trans_date", "trans_code", "trans_shares", "trans_pricepershare", "trans_acquired_disp_cd", "shrs_ownd_folwng_trans")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns (any case) of tab-separated files as strings, with the file
    and the place of each row in it; columns a file lacks are null. The place is the
    start of the row's split in the file and then its turn in the split, whatever the
    order in which splits are read."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="", nullValue="", ignoreLeadingWhiteSpace=False)
    names = {c.lower(): c for c in raw.columns}
    pick = [F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns]
    return raw.select(*pick, F.col("_metadata.file_path").alias("_file"), file_place().alias("_row"))


def read_zipped_tsv(spark: SparkSession, path: str, member: str, columns: tuple[str, ...]) -> DataFrame:
    """The same from a member (any case, matched by its end) of each ZIP archive in
    ``path``; archives without it give no rows. One archive is one task."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(member.lower())), None)
                    if name is None:
                        continue
                    with z.open(name) as f:
                        reader = csv.reader(io.TextIOWrapper(f, "utf-8", errors="replace", newline=""), delimiter="\t", quoting=csv.QUOTE_NONE)
                        head = {c.strip().lower(): i for i, c in enumerate(next(reader, []))}
                        at = [head.get(c) for c in columns]
                        batch: list[list] = []
                        for k, r in enumerate(reader):
                            batch.append([*[(r[i] or None) if i is not None and i < len(r) else None for i in at], path_, k])
                            if len(batch) == 20_000:
                                yield pd.DataFrame(batch, columns=[*columns, "_file", "_row"])
                                batch = []
                        if batch:
                            yield pd.DataFrame(batch, columns=[*columns, "_file", "_row"])

    ddl = ", ".join(f"{c} string" for c in columns) + ", _file string, _row long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, ddl)


def clean_transactions(submissions: DataFrame, owners: DataFrame, transactions: DataFrame, as_of, keep_invalid: bool = False) -> DataFrame:
    """One clean row per transaction with its filing and the filing's first owner.

    The first owner is the one that comes first in its file. A title falls back to
    the relationship. Figures that cannot be right are null; rows without a usable
    company number or date are left out unless ``keep_invalid``."""
    first = owners.groupBy("accession_number").agg(F.min_by(F.struct("rptownercik", "rptownername", "rptowner_relationship", "rptowner_title"), F.struct("_file", "_row")).alias("o"))
    sub = submissions.drop("_file", "_row").dropDuplicates(["accession_number"])
    t = transactions.join(sub, "accession_number", "left").join(first, "accession_number", "left")
    filed = clean.flexible_date("filing_date")
    n, p = clean.shares("trans_shares"), clean.price("trans_pricepershare")
    out = t.select(
        "accession_number",
        F.col("nonderiv_trans_sk").try_cast("int").alias("trans_sk"),
        clean.cik("issuercik").alias("cik"),
        clean.text_or_null("issuername").alias("nombre"),
        F.upper(clean.text_or_null("issuertradingsymbol")).alias("ticker"),
        clean.text_or_null("o.rptownername").alias("nombre_insider"),
        F.coalesce(clean.text_or_null("o.rptowner_title"), clean.text_or_null("o.rptowner_relationship")).alias("cargo"),
        clean.tx_code("trans_code").alias("tipo_transaccion"),
        clean.acquired_or_disposed("trans_acquired_disp_cd").alias("adquirido_o_dispuesto"),
        clean.transaction_date(clean.flexible_date("trans_date"), filed, F.lit(as_of).cast("date")).alias("fecha_transaccion"),
        n.alias("acciones"),
        p.alias("precio_por_accion"),
        clean.amount(n, p).alias("importe_total"),
        clean.bounded_long("shrs_ownd_folwng_trans").alias("acciones_tras_tx"),
        filed.alias("fecha_filing"),
        "_file",
        "_row",
    )
    return out if keep_invalid else out.filter("cik is not null and fecha_transaccion is not null")


def load_quarter(spark: SparkSession, path: str, as_of, entities: DataFrame, natural: str = "cik", key: str = "empresa_id", zipped: bool = False) -> DataFrame:
    """One quarter of ownership forms, from its three files to clean rows with the key of
    their entity: scan, clean and foreign key. ``path`` is the folder of the files or, if
    ``zipped``, of the archive that holds them."""
    from .sinks import with_foreign_key

    def read(name: str, columns: tuple[str, ...]) -> DataFrame:
        return read_zipped_tsv(spark, path, f"{name}.tsv", columns) if zipped else read_tsv(spark, f"{path.rstrip('/')}/{name}.tsv", columns)

    rows = clean_transactions(read("SUBMISSION", SUBMISSION), read("REPORTINGOWNER", OWNER), read("NONDERIV_TRANS", TRANSACTION), as_of)
    return with_foreign_key(rows, entities, natural, key)
