"""Texts that stop before their author did.

Three things are read from the whole corpus and nothing from lists of words: the
lengths at which a source stops with open endings far too often (discrete
hazards by window functions, tested against neighbouring lengths), the words
sentences close with, and the lines, items and notes texts end with. An open
ending at a significant length is a cut; elsewhere, where only a broken transfer
could have caused it, more is demanded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, left_join

# Shapes of endings ----------------------------------------------------------

#: Closed brackets, complete tags and rules: what may follow a complete text.
_MARKS = r"(?:\s++|&nbsp;|\[(?!\s*(?:\.\.+|…))[^\[\]\n]{1,40}\]|\((?!\s*(?:\.\.+|…))[^()\n]{1,40}\)|\{[^{}\n]{1,40}\}|</?[A-Za-z][^<>]{0,80}>|[*#=_~·-](?:[ ]?[*#=_~·-])++)++$"
_ELLIPSIS = r"(?:\.\.+|…)[\])]?$"
#: Halves of entities, escapes and tags, and broken characters.
_REST = r"(?:&#?[a-z0-9]{0,6}|\\u?[0-9a-fA-F]{0,3}|</?[A-Za-z]{0,6}|�+)$"
_LEFT = r"(?:\s++|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|\.\.++|…|&nbsp;|&#?[a-z0-9]{0,6}+|\\u?[0-9a-fA-F]{0,3}+|</?[A-Za-z]{0,6}+|�++)++$"
_END = r"[.!?][\"'”’»)\]]*$"
_ROW = r"^\S.*?\s{2,}[$(]?[\d,.]++\)?%?(?:\s++[$(]?[\d,.]++\)?%?)*+$"
_BULLET = r"^\s*(?:[-•*–]|\d+[.)])\s+\S"
_SENTENCE_START = r"[.!?]\s+\S"
#: What stands between two sentences.
_STOP = r"[.!?][\"'”’»)\]]*\s+[\"'“‘(\[]?"
_LABEL = r"^((?:\p{L}+:\s*)?(?:/\p{L}/|\p{L}+:))\s*\S+\s+\S"
#: Classes whose endings the corpus votes on.
VOTED = ("nota", "lista", "tabla", "linea")


def skeleton(line: Column) -> Column:
    """The line with its bullet, numbers and names (capital letters inside) taken out."""
    s = F.regexp_replace(F.trim(line), r"^\s*(?:\(\d+\)|[-•*–]|\d+[.)])\s+", "")
    s = F.regexp_replace(s, r"\d[\d,.]*\d|\d", "0")
    s = F.regexp_replace(s, r"(?<=\s)\p{Lu}[\p{L}\p{N}'’.&-]*+(?:\s++\p{Lu}[\p{L}\p{N}'’.&-]*+)*+", "X")
    return F.regexp_replace(s, r"\s+", " ")


def closing(first: Column, last: Column) -> Column:
    """Key of the two words a sentence closes with: numbers as 0, capitalised words as X."""
    one = lambda w: F.when(w.rlike(r"^\p{Lu}"), "X").otherwise(F.regexp_replace(F.regexp_replace(w, r"^[\"'“‘(\[]+|[\"'”’)\]]+$", ""), r"[$]?\d[\d,.]*", "0"))
    return F.concat_ws(" ", one(first), F.when(last.rlike(r"^\p{Lu}\p{L}{0,5}$"), last).otherwise(one(last)))


def endings(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(id, s, n, core, h, estado, clase, k, etiqueta) of how each text ends, by built-in
    expressions over whole texts.

    estado is ``completo``, ``roto`` (a structure left open: JSON, paragraph, entity,
    quotation; or dots where the text stops) or ``abierto``. Open endings carry a
    class and a key for the corpus to decide. n is the length, core the length
    without what a cut may leave behind. Null and empty texts are complete."""
    t, b, x, last, prev, c = (F.col(k) for k in ("t", "b", "x", "l", "p", "clase"))
    base = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    is_json = t.rlike(r"^\s*(?:\{|\[\s*\")")
    base = _once(base, [], h=F.xxhash64("t"), n=F.length("t").cast("long"), ct=F.regexp_replace(F.right(t, F.lit(_REACH)), _LEFT, ""), json=is_json, broken=F.when(is_json, F.try_parse_json(t).isNull()).otherwise(False), longest=F.when(is_json, _longest(t)).otherwise(t))
    # inside JSON the longest value is the text; short values and nested objects are no prose
    prose = ~F.col("json") | (F.length("longest") >= 40) & ~F.col("longest").rlike(r"^\s*[{\[]")
    core = F.length(_joined(t, F.col("ct"), _LEFT)).cast("long")
    base = base.select("id", "s", "h", "n", core.alias("core"), "broken", F.when(prose, F.col("longest")).otherwise("").alias("b"))
    base = _once(base, [], xt=F.regexp_replace(F.right(b, F.lit(_REACH)), _MARKS, ""))
    base = _once(base, ["xt"], x=_joined(b, F.col("xt"), _MARKS))
    lower = F.substring_index("x", "\n", -1)
    before = F.rtrim(F.substring(x, F.lit(1), F.length("x") - F.length(lower)), F.lit(" \t\r\n"))
    base = _once(base, [], l=F.trim(lower), p=F.trim(F.substring_index(before, "\n", -1)))
    base = _once(base, [], row=last.rlike(_ROW))
    above = F.filter(F.split("x", "\n"), lambda r: F.trim(r).rlike(_ROW))  # the last row among them
    short_row = (F.size(above) > 1) & (F.length(last) < F.array_min(F.transform(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(1))), lambda r: F.length(F.trim(r)))))
    words = F.size(F.split(last, r"\s+"))
    rest = (
        F.when(F.col("row"), F.when(short_row, "corta").otherwise("tabla"))
        .when(last.rlike(_BULLET) & (prev != ""), "lista")
        .when((prev == "") & (words <= 14) & ~F.regexp_replace(last, r"\b\p{Lu}\p{L}{0,4}\.", "").rlike(_SENTENCE_START), "nota")
        .when((prev != "") & (words <= 8) & ~last.rlike(r"[,;]$"), "linea")
        .otherwise("frase")
    )
    open_quote = last.contains("“") & (F.regexp_count(x, F.lit("“")) > F.regexp_count(x, F.lit("”")))
    end = F.right(x, F.lit(_REACH))
    open_tag = b.contains("<p>") & (F.regexp_count(b, F.lit("<p>")) > F.regexp_count(b, F.lit("</p>")))
    base = _once(base, ["b", "x", "p", "row"], clase=(
        F.when(F.col("broken"), "json").when(x == "", "").when(end.rlike(_ELLIPSIS), "elipsis").when(end.rlike(_REST), "resto").when(open_tag, "marcado")
        .when(end.rlike(_END), F.when(open_quote, "comillas").otherwise("fin")).otherwise(rest)
    ))
    estado = F.when(c.isin("json", "elipsis", "resto", "marcado", "comillas", "corta"), "roto").when(c.isin("", "fin"), "completo").otherwise("abierto")
    base = _once(base, [], tail=F.when(~c.isin(*VOTED), F.regexp_replace(last, r"[.!?][\"'”’»)\]]*$", "")))
    w = F.split("tail", r"\s+")
    two = F.coalesce(F.get(w, F.size(w) - 2), F.lit("")), F.coalesce(F.get(w, F.size(w) - 1), F.lit(""))
    k = (
        F.when(c == "", "").when(c.isin("nota", "lista"), skeleton(last)).when(c == "tabla", skeleton(F.regexp_extract(last, r"^(\S.*?)\s{2,}", 1)))
        .when(c == "linea", F.regexp_replace(last, r"\d[\d,.]*", "0")).otherwise(closing(*two))
    )
    label = F.when(c == "linea", F.regexp_extract(last, _LABEL, 1)).otherwise("")
    return base.select("id", "s", "n", "core", "h", estado.alias("estado"), "clase", k.alias("k"), label.alias("etiqueta"))


#: Characters at the end of a text that are searched first for what may be taken off it;
#: no single piece of that is longer than ``_PIECE``.
_REACH, _PIECE = 400, 100


def _joined(t: Column, tail: Column, pattern: str) -> Column:
    """``t`` without ``pattern`` at its end, where ``tail`` is what that leaves of its last
    ``_REACH`` characters. If it leaves too little to be sure that nothing before them
    belongs to it, the whole text is searched."""
    n = F.length(t)
    return F.when(n <= _REACH, tail).when(F.length(tail) > _PIECE, F.concat(F.substring(t, F.lit(1), n - _REACH), tail)).otherwise(F.regexp_replace(t, pattern, ""))


def _longest(t: Column) -> Column:
    values = F.map_values(F.from_json(t, "map<string,string>"))
    return F.coalesce(F.aggregate(values, F.lit(""), lambda a, y: F.when(F.length(y) > F.length(a), y).otherwise(a)), F.lit(""))


def _once(df: DataFrame, drop: list[str], **columns: Column) -> DataFrame:
    """``df`` with new columns that are computed once: the generator keeps the optimizer
    from writing them out again at each use."""
    rows = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(rows)).drop(*drop)


# What the corpus shows ------------------------------------------------------


def closings(docs: DataFrame, text: str, least: int, share: float) -> DataFrame:
    """(k, cierra, sigue): how often two words close a sentence, and how often their full
    stop is followed by a small letter instead, as after an abbreviation.

    Every sentence of every text counts; counts are combined before the shuffle."""
    parts = _once(docs.select(F.col(text).alias("__t")), ["__t"], s=F.split("__t", _STOP))
    ends = F.transform(F.slice("s", 1, F.size("s") - 1), lambda x, i: F.struct(F.substring_index(F.trim(F.translate(x, "\n\t\r", "   ")), " ", -2).alias("w"), F.substring(F.get("s", i + 1), 1, 1).rlike(r"\p{Ll}").alias("small")))
    one = parts.filter(F.size("s") > 1).select(F.explode(ends).alias("m")).groupBy("m.w", "m.small").agg(F.count(F.lit(1)).alias("c"))  # before the keys are made
    w = F.split("w", " ")
    n = one.filter(F.size(w) == 2).groupBy(closing(F.get(w, F.lit(0)), F.get(w, F.lit(1))).alias("k"))
    n = n.agg(F.sum(F.when(F.col("small"), 0).otherwise(F.col("c"))).alias("cierra"), F.sum(F.when(F.col("small"), F.col("c")).otherwise(0)).alias("sigue"))
    n = cut_lineage(n)  # one row per pair of words, for the sum and for the filter
    total = n.agg(F.sum("cierra")).first()[0] or 0
    return n.filter(F.col("cierra") >= max(float(least), total * share))


def votes(read: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(clase, k, votos, todos): different texts that end with each key, for items also the
    items other lines follow; ``todos`` is the sum over the class. A note is often the
    whole text, so there every document counts."""
    items = F.expr(f"regexp_extract_all({text}, r'(?m)^\\s*+((?:[-•*–]|\\d+[.)])\\s+\\S.*)\\n', 1)")
    inner = docs.filter(F.col(text).rlike(r"\n\s*(?:[-•*–]|\d+[.)])\s")).select(F.lit("lista").alias("clase"), F.xxhash64(text).alias("h"), F.explode(items).alias("l"))
    inner = inner.filter(~F.rtrim(F.col("l")).rlike(_END)).select("clase", skeleton(F.col("l")).alias("k"), "h")
    own = read.filter(F.col("clase").isin(*VOTED)).select("clase", "k", "h")
    named = read.filter("etiqueta <> ''").select(F.lit("etiqueta").alias("clase"), F.col("etiqueta").alias("k"), "h")
    v = own.unionByName(inner).unionByName(named).groupBy("clase", "k", "h").agg(F.count(F.lit(1)).alias("c"))
    v = v.groupBy("clase", "k").agg(F.sum(F.when(F.col("clase") == "nota", F.col("c")).otherwise(1)).alias("votos"))
    sizes = v.groupBy("clase").agg(F.sum("votos").alias("todos"))  # one row per class
    return v.join(F.broadcast(sizes), "clase")


# Hazards --------------------------------------------------------------------


def _tail(k: int, mean: float) -> float:
    """P(X >= k) of a Poisson variable."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    log = -mean + k * math.log(mean) - math.lgamma(k + 1)
    term, total, i = 1.0, 1.0, k
    while term > 1e-12 * total and i < k + 100_000:
        i += 1
        term *= mean / i
        total += term
    return min(1.0, math.exp(min(0.0, log)) * total) if log + math.log(total) < 0 else 1.0


def length_hazards(lengths: DataFrame, source: str, length: str, event: str | None = None, reach: int = 60, fdr: float = 1e-3, least: int = 3) -> DataFrame:
    """(source, length, docs, events, at_risk, expected, p, significant) of every length a source has.

    The hazard of a length is the share of texts that stop there with an open ending
    (``event``; all texts where None) among those at least as long. It is tested
    against the hazards of the lengths up to ``reach`` away (Poisson), and the false
    discovery rate over all lengths of all sources is held at ``fdr``
    (Benjamini-Hochberg). ``event`` is a key or a flag: different keys of a length
    count once each, so a stock phrase is one event however often it is repeated;
    null is no event.

    Windows run over counts per length, so their size is bounded by the longest
    text. The ranks of the test are taken in bins of the logarithm of p, so no task
    ranks all lengths of all sources. Null sources are one source; texts without
    length take no part; no texts give no rows."""
    s, n_ = F.col(source).alias("s"), F.col(length).cast("long").alias("l")
    rows = lengths.filter(F.col(length).isNotNull())
    rows = rows.select(s, n_, F.lit(1).alias("e") if event is None else F.col(event).alias("e"))
    if event is not None and lengths.schema[event].dataType.simpleString() not in ("boolean", "int"):
        rows = rows.groupBy("s", "l", "e").agg(F.count(F.lit(1)).alias("c"))
        n = rows.groupBy("s", "l").agg(F.sum("c").alias("n"), F.count("e").alias("ev"))
    else:
        n = rows.groupBy("s", "l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("e").cast("long"), F.lit(0))).alias("ev"))
    longer = Window.partitionBy("s").orderBy(F.col("l").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("s").orderBy("l").rangeBetween(-reach, reach)
    n = n.withColumn("at_risk", F.sum("n").over(longer))
    # the mean of the lengths around, with half an event so that it is never zero, at the risk of this one
    around = (F.sum("ev").over(near) - F.col("ev") + 0.5) / (2 * reach)
    n = n.withColumn("expected", around * F.col("at_risk") / F.avg("at_risk").over(near))

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["p"] = [_tail(int(k), float(m)) for k, m in zip(pdf["ev"], pdf["expected"], strict=True)]
            yield pdf

    kind = lengths.schema[source].dataType.simpleString()
    tested = n.mapInPandas(test, f"s {kind}, l long, n long, ev long, at_risk long, expected double, p double")
    tested = cut_lineage(tested)  # one row per source and length, used for the ranks and for the result
    m = max(tested.count(), 1)
    low = tested.filter(F.col("p") <= fdr).select("p", F.floor(F.log10(F.greatest("p", F.lit(1e-300))) * 50).cast("int").alias("b"))
    bins = low.groupBy("b").agg(F.count(F.lit(1)).alias("c"))  # at most 15,000
    bins = bins.withColumn("before", F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("c")
    r = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("b").orderBy("p"))
    ranked = low.join(F.broadcast(bins), "b").withColumn("r", r)
    limit = ranked.filter(F.col("p") <= F.lit(fdr) * F.col("r") / m).agg(F.max("p").alias("p")).first()["p"]
    passed = F.col("p") <= F.lit(limit).cast("double")
    return tested.select(F.col("s").alias(source), F.col("l").alias(length), F.col("n").alias("docs"), F.col("ev").alias("events"), "at_risk", "expected", "p", (F.coalesce(passed, F.lit(False)) & (F.col("ev") >= least)).alias("significant"))


# Operator -------------------------------------------------------------------


def judge_endings(
    docs: DataFrame, doc_id: str, text: str, source: str, share: float = 0.008, least: int = 3, fdr: float = 1e-3, factor: float = 4.0, closing_share: float = 1e-4, use_limits: bool = True
) -> DataFrame:
    """(doc_id, source, n_chars, clase, k, votos, limite, cortado) of every document.

    ``limite``: the length, with or without what a cut left behind, has a significant
    hazard of open endings in its source. There an ending is a cut unless the corpus
    shows it to be complete: a closed sentence, or a note, item, table row or closing
    line that ``factor`` times ``share`` of its class ends with; a full stop counts as
    closing only if its two words also close sentences elsewhere and are not mostly
    followed by a small letter. Elsewhere, only a broken transfer can have cut the text,
    and more must show it: a structure left open, or an ending fewer than ``share`` of
    its class (and ``least`` different texts) have; prose is cut unless its last two
    words, the last no number, close at least ``closing_share`` of all
    sentences, when the full stop may just be missing. ``use_limits=False`` leaves the hazards out.

    Null and empty texts are complete; repeated documents are judged alike and
    support an ending only once; an empty table gives no rows; other columns may
    have any names.
    """
    read = cut_lineage(endings(docs, doc_id, text, source))  # narrow rows: no text
    body = docs.select(F.col(text).alias("t")).filter("t is not null")
    v = votes(read, body, "t")
    labels = v.filter("clase = 'etiqueta'").select(F.col("k").alias("etiqueta"), F.col("votos").alias("con_etiqueta"))
    values = read.filter("etiqueta <> ''").groupBy("etiqueta", "k").agg(F.lit(1).alias("one")).groupBy("etiqueta").agg(F.count(F.lit(1)).alias("valores"))
    labels = labels.join(values, "etiqueta")
    finals = closings(body, "t", least, closing_share)
    open_ = F.col("estado") != "completo"
    event = F.when(open_, F.when(F.col("clase").isin(*VOTED), F.concat_ws("|", "clase", "k")).otherwise(F.col("h").cast("string")))
    both = read.select("s", "h", event.alias("e"), F.explode(F.array(F.struct(F.lit("n").alias("m"), F.col("n").alias("l")), F.struct(F.lit("core").alias("m"), F.col("core").alias("l")))).alias("x"))
    both = both.filter("x.l > 0").select(F.struct(F.col("s"), F.col("x.m").alias("m")).alias("sm"), F.col("x.l").alias("l"), "h", "e").distinct()
    j = read.withColumn("etiqueta", F.nullif("etiqueta", F.lit(""))).join(v.filter("clase <> 'etiqueta'"), ["clase", "k"], "left")
    j = left_join(j, labels, ["etiqueta"]).join(F.broadcast(finals), "k", "left")  # closings are at most 1 / closing_share
    if use_limits:
        sig = length_hazards(both, "sm", "l", "e", fdr=fdr, least=least).filter("significant")
        for m in ("n", "core"):
            side = sig.filter(F.col("sm.m") == m).select(F.col("sm.s").alias("ls"), F.col("l").alias("ll"), F.lit(True).alias(f"at_{m}"))
            j = j.join(side, F.col("s").eqNullSafe(F.col("ls")) & (F.col(m) == F.col("ll")), "left").drop("ls", "ll")
        limit = F.coalesce("at_n", "at_core", F.lit(False))
    else:
        limit = F.lit(False)
    bar = F.when(limit, factor).otherwise(1.0) * F.greatest(F.lit(float(least)), F.coalesce(F.col("todos") * share, F.lit(0.0)))
    rare = F.coalesce(F.col("votos"), F.lit(0)) < bar
    # a label before values that hardly repeat, such as names: the value cannot be checked, the label can
    labelled = (F.col("con_etiqueta") >= F.greatest(F.lit(float(least)), F.col("todos") * share)) & (F.col("valores") > F.col("con_etiqueta") * 0.5)
    closes = F.col("cierra").isNotNull() & ~F.col("k").rlike(r"(?:\S*0\S*|\S*\p{P})$")  # a number can be cut inside
    c = F.col("clase")
    cut = (
        F.when(F.col("estado") == "roto", True)
        .when(c == "fin", limit & ~(F.coalesce(F.col("cierra") >= F.col("sigue"), F.lit(False))) & F.col("k").rlike(r"(?: 0| \p{Lu}\p{L}{0,5})$"))
        .when(F.col("estado") == "completo", False)
        .when(c == "linea", rare & ~F.coalesce(labelled, F.lit(False)))
        .when(c.isin(*VOTED), rare)
        .otherwise(limit | ~closes)
    )
    return j.select(F.col("id").alias(doc_id), F.col("s").alias(source), F.col("n").alias("n_chars"), "clase", "k", "votos", limit.alias("limite"), F.coalesce(cut, F.lit(False)).alias("cortado"))
