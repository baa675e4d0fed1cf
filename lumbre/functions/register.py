"""The library's functions under names for Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

_NUM = "try_cast(x AS DOUBLE)"
_MONEY = lambda most, digits: f"CASE WHEN abs({_NUM}) <= {most} THEN round({_NUM}, {digits}) END"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _html_body() -> str:
    """The expression of ``text.html_to_text`` as SQL."""
    t = "x"
    for pattern, by in text.HTML_STEPS:
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(by)})"
    for name, char in text.ENTITIES.items():
        t = f"replace({t}, {_q(name)}, {_q(char)})"
    for pattern, by in text.BLANK_STEPS:
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(by)})"
    return t


def _section_body(marked: str, open_length: int, least: str, whole: int) -> str:
    """The widest stretch of a marked text as SQL, with the marks of ``text``."""
    bare = lambda t: f"translate({t}, chr(1) || chr(2) || chr(3), '')"
    found = "filter(transform(split(m, chr(2)), (r, i) -> named_struct('o', i = size(split(m, chr(2))) - 1, 'r', CASE WHEN instr(r, chr(1)) > 0 THEN substring(r, instr(r, chr(1))) END)), f -> f.r IS NOT NULL)"
    piece = f"named_struct('gap', CASE WHEN f.o THEN {open_length} ELSE length({bare('substring(f.r, instr(f.r, chr(3)))')}) END, 'body', CASE WHEN f.o THEN substring({bare('f.r')}, 1, {open_length}) ELSE {bare('f.r')} END)"
    best = f"aggregate(transform({found}, f -> {piece}), CAST(NULL AS STRUCT<gap: INT, body: STRING>), (b, p) -> CASE WHEN b IS NULL OR p.gap > b.gap THEN p ELSE b END)"
    ends = _q(r"^\s+|\s+$")
    out = f"named_struct('texto', CASE WHEN b.gap >= {least} THEN trim(regexp_replace(b.body, {ends}, '')) ELSE substring({bare('x')}, 1, {whole}) END, 'aislada', coalesce(b.gap >= {least}, false))"
    return f"transform(transform(array({marked}), m -> {best}), b -> {out})[0]"


def _mda_body() -> str:
    t = "translate(x, chr(1) || chr(2) || chr(3), '')"
    start = lambda p: f"regexp_replace({t}, {_q(p)}, chr(1) || '$0' || chr(3))"
    strict = f"regexp_count({t}, {_q('(?i)' + text.MDA_START)}) > 0"
    heads = f"CASE WHEN {strict} THEN {start('(?i)' + text.MDA_START)} ELSE {start(text.not_referred())} END"
    threes = f"regexp_replace({heads}, {_q('(?i)' + text.MDA_END)}, chr(2) || '$0')"
    last = "substring_index(h, chr(2), -1)"
    marked = f"transform(array({threes}), h -> substring(h, 1, length(h) - length({last})) || regexp_replace({last}, {_q('(?i)' + text.MDA_END_OTHER)}, chr(2) || '$0'))[0]"
    return _section_body(marked, text.OPEN_DISCUSSION, f"CASE WHEN {strict} THEN {text.LEAST_DISCUSSION} ELSE {text.LEAST_LOOSE} END", text.WHOLE_DISCUSSION)


def _item_body() -> str:
    heading = "'(?i)item\\\\s*\\\\Q' || item || '\\\\E'"
    heads = f"regexp_replace(translate(x, chr(1) || chr(2) || chr(3), ''), {heading}, chr(1) || '$0' || chr(3))"
    ends = f"regexp_replace({heads}, {_q('(?i)' + text.ITEM_HEADING + '|' + text.SIGNATURES)}, chr(2) || '$0')"
    marked = f"replace(CASE WHEN item <> '' THEN {ends} ELSE '' END, chr(1) || chr(2), chr(2) || chr(1))"
    return _section_body(marked, text.OPEN_ITEM, str(text.LEAST_ITEM), text.WHOLE_ITEM)


#: SQL functions that are plain expressions.
EXPRESSIONS = {
    "lumbre_cik(x STRING)": (
        "STRING",
        "CASE WHEN length(regexp_replace(split_part(trim(x), '.', 1), '[^0-9]', '')) BETWEEN 1 AND 10 THEN lpad(regexp_replace(split_part(trim(x), '.', 1), '[^0-9]', ''), 10, '0') END",
    ),
    "lumbre_precio(x STRING)": ("DOUBLE", f"CASE WHEN {_NUM} > 0 AND {_NUM} <= 1e6 THEN {_NUM} END"),
    "lumbre_acciones(x STRING)": ("BIGINT", f"CASE WHEN {_NUM} <> 0 AND abs({_NUM}) <= 1e14 THEN CAST(abs({_NUM}) AS BIGINT) END"),
    "lumbre_entero(x STRING)": ("BIGINT", f"try_cast({_NUM} AS BIGINT)"),
    "lumbre_numerico(x STRING)": ("DOUBLE", _MONEY("99999999", 4)),
    "lumbre_importe(x STRING)": ("DOUBLE", _MONEY("9999999999999", 2)),
    "lumbre_codigo(x STRING)": ("STRING", "nullif(upper(trim(x)), '')"),
    "lumbre_signo(x STRING)": ("STRING", "CASE WHEN upper(trim(x)) IN ('A', 'D') THEN upper(trim(x)) END"),
    "lumbre_indice_trimestre(y INT, q INT)": ("INT", "y * 4 + q - 1"),
    "lumbre_trimestre(d DATE)": ("INT", "quarter(d)"),
    "lumbre_texto(x STRING)": ("STRING", "CASE WHEN lower(trim(x)) NOT IN ('nan', 'nat', 'none', '') THEN trim(x) END"),
    "lumbre_posicion(p DOUBLE, low DOUBLE, high DOUBLE)": ("DOUBLE", "CASE WHEN high > low THEN round((p - low) / (high - low), 4) END"),
    "lumbre_seccion_mda(x STRING)": ("STRUCT<texto: STRING, aislada: BOOLEAN>", _mda_body()),
    "lumbre_item_8k(x STRING, item STRING)": ("STRUCT<texto: STRING, aislada: BOOLEAN>", _item_body()),
    "lumbre_html_a_texto(x STRING)": ("STRING", _html_body()),
    "lumbre_primer_json(x STRING)": (
        "STRING",
        "aggregate(slice(split(substring(x, instr(x, '{')), '\\\\}'), 1, size(split(substring(x, instr(x, '{')), '\\\\}')) - 1), named_struct('seen', '', 'hit', CAST(NULL AS STRING)), "
        "(a, p) -> CASE WHEN a.hit IS NOT NULL OR instr(x, '{') = 0 THEN a ELSE named_struct('seen', a.seen || p || '}', 'hit', CASE WHEN try_parse_json(a.seen || p || '}') IS NOT NULL THEN a.seen || p || '}' END) END).hit",
    ),
    "lumbre_cita_verificada(cita STRING, fuente STRING)": ("BOOLEAN", f"length(cita) >= {text.LEAST_QUOTE} AND contains(fuente, cita)"),
}


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    bare = s.str.replace(f"[{text.QUOTES}]", "", regex=True).str.normalize("NFKD").str.replace(r"[^\x00-\x7f]", "", regex=True)
    return bare.str.lower().str.split().str.join(" ")


def register_functions(spark: SparkSession) -> list[str]:
    """Register all of them for the session and return their names. ``lumbre_cita_verificada``
    takes a quote and a source that ``lumbre_normalizado`` has folded."""
    for head, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("lumbre_normalizado", _folded)
    return [h.split("(")[0] for h in EXPRESSIONS] + ["lumbre_normalizado"]
