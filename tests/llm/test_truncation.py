import json
import random

from pyspark.sql import functions as F

from lumbre.llm import truncation as tr

SENT = ["Revenue from marine coatings rose by 4.5% in the second quarter", "The lease for our site in East Africa runs until May 3, 2021", "We did not hire a second shift during the fiscal year", "Headcount rose to 57 people, most of them in Latin America"]
GOOD = [
    f"{SENT[0]}. {SENT[1]}.", f"{SENT[0]}. [MD&A]", f"{SENT[0]}.\n\n[Q3 2023]", f"{SENT[0]}.\n\n* * *", f"{SENT[0]}.\n###", f"{SENT[0]}. (unaudited)", f"<p>{SENT[0]}.</p>\n\n<p>{SENT[1]}.</p>", f"{SENT[0]}. “{SENT[1]}.”",
    json.dumps({"tesis": f"{SENT[0]}. {SENT[1]}.", "veredicto": "X"}), "", "   ", f"It said ... much. {SENT[2]}.", f"{SENT[0]}.\n\n",
]
BAD = [
    f"{SENT[0]}. {SENT[1][:30]}", f"{SENT[0]}. {SENT[1][:30]}...", f"{SENT[0]}. {SENT[1][:31]}…", f"{SENT[0]}. We did […]", f"{SENT[0]}. We did not&nb", f"{SENT[0]}. We did &nbsp", f"{SENT[0]}. Most <", f"<p>{SENT[0]}.</p>\n\n<p>Most of them </", f"{SENT[0]}. We \\u00", f"{SENT[0]}. We di�",
    json.dumps({"tesis": f"{SENT[0]}. {SENT[1]}."})[:-20], f"{SENT[0]}. “{SENT[1]}, said Omar", f"{SENT[0]}. The price was $1,2", f"{SENT[0]}. In addition,\n\n", f"<p>{SENT[0]}.</p>\n\n<p>{SENT[1]}.",
]


def _states(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("source", F.lit("a"))
    return {texts[r["id"]]: r["estado"] for r in tr.endings(df, "i", "text", "source").collect()}


def test_complete_endings(spark):
    got = _states(spark, GOOD)
    assert {t for t, s in got.items() if s != "completo"} == set()


def test_open_and_broken_endings(spark):
    got = _states(spark, BAD)
    assert {t for t, s in got.items() if s == "completo"} == set()


def test_limits_decide_what_an_ending_alone_cannot(spark):
    """Prose that stops without a full stop on words that close sentences elsewhere: a
    cut at a length where a source stops too often, elsewhere a stop left out."""
    r = random.Random(5)
    closing = "of the older platform"
    body = lambda n: " ".join(f"In {r.randrange(1900, 2000)} the costs rose, and so did those {closing}." for _ in range(n))
    rows = []
    for i in range(300):
        rows.append(body(r.randrange(6, 40)))
    for i in range(40):  # a field of 900 characters
        rows.append((body(20) + " " + "We sold it to our partner in the north of the country" * 3)[:900])
    at = body(30)
    at = at[: 900 - len(closing) - 8] + " all but " + closing
    at = ("Y" * 900 + at)[-900:]
    off = body(11) + " We kept all but " + closing
    rows += [at, off]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(rows)], "i long, text string, source string")
    with_, without = ({x["i"]: x["cortado"] for x in tr.judge_endings(df, "i", "text", "source", use_limits=u).collect()} for u in (True, False))
    assert len(at) == 900 and len(off) != 900
    assert with_[len(rows) - 2] and not with_[len(rows) - 1]
    assert not without[len(rows) - 2]


def test_other_marks_and_language(spark):
    """German letters, Turkish notes, other labels and references than elsewhere."""
    full = [f"Der Umsatz stieg um {i} Prozent. Die Kosten blieben unverändert. {{Anl. {i}}}" for i in range(60)]
    full += [f"Der Vertrag vom {i}. Mai gilt weiter. Beide Seiten haben zugestimmt.\n\nGezeichnet: Ayşe {chr(65 + i % 20)}e{'lmnr'[i // 10]}ler" for i in range(40)]
    full += ["Bedelsiz hisse"] * 20 + [f"Beide Werke liefen im Jahr {i} ohne Unterbrechung.\n~~~~~" for i in range(20)]
    cut = ["Der Umsatz stieg um 7 Prozent. Die Kosten blie", "Beide Werke liefen im Jahr 5 ohne Unterbrechung. Im Süden des Lan", "Bedelsiz his", "Der Vertrag gilt weiter.\n\nGezei"]
    rows = full + cut
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(rows)], "i long, text string, source string")
    got = {x["i"] for x in tr.judge_endings(df, "i", "text", "source").filter("cortado").collect()}
    assert got == set(range(len(full), len(rows)))


def test_corpus_decides_notes_items_signatures_and_tables(spark):
    r = random.Random(1)
    notes = ["Held by spouse", "By family trust", "Jointly with spouse"]
    docs = [(n, "f4") for n in notes for _ in range(8)] + [(f"Exempt transaction under the {k} plan", "f4") for k in range(8)]
    items = ["lower freight costs", "higher unit volumes", "a milder winter"]
    docs += [(f"{SENT[r.randrange(4)]} {i}.\n- {items[i % 3]}\n- {items[(i + 1) % 3]}", "mda") for i in range(24)]
    titles = ["Treasurer", "General Counsel"]
    docs += [(f"{SENT[i % 4]} {i}.\n\nBy: /s/ Ann B Cole{i}\n{titles[i % 2]}", "8k") for i in range(20)]
    docs += [(f"{SENT[i % 4]} {i}.\n\nSales       81,614     61,735\nTotal      154,300    878,631", "mda") for i in range(20)]
    n = len(docs)
    cut = [("Each unit represents a right", "f4"), (f"{SENT[0]}.\n- a milder", "mda"), (f"{SENT[0]}.\n\nBy: /s/ Ann B Cole\nGeneral Coun", "8k"), (f"{SENT[0]}.\n\nSales       81,614     61,735\nTotal      154,300    8", "mda"), (f"{SENT[0]}.\n\nSales       81,614     61,735", "mda")]
    rows = [(i, t, s, "z") for i, (t, s) in enumerate(docs + cut)]
    got = tr.judge_endings(spark.createDataFrame(rows, "doc_id long, text string, source string, cortado string"), "doc_id", "text", "source")
    assert {x["doc_id"] for x in got.filter("cortado").collect()} == set(range(n, n + len(cut)))
    assert got.count() == len(rows)


def test_hazards_find_the_field_limit(spark):
    r = random.Random(2)
    rows = [("a", min(800, int(r.expovariate(1 / 500)) + 20)) for _ in range(3000)] + [("b", int(r.expovariate(1 / 500)) + 20) for _ in range(3000)] + [(None, 5), ("a", None)]
    h = tr.length_hazards(spark.createDataFrame(rows, "s string, l int"), "s", "l")
    assert [(x["s"], x["l"]) for x in h.filter("significant").collect()] == [("a", 800)]
    total = {x["s"]: x["n"] for x in h.groupBy("s").agg(F.max("at_risk").alias("n")).collect()}
    assert total == {"a": 3000, "b": 3000, None: 1}


def test_at_a_limit_doubtful_full_stops_count(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        t = " ".join(f"{SENT[r.randrange(4)]} {r.randrange(999)}." for _ in range(r.randrange(2, 30)))
        rows.append(t[:700])
    tail = " it paid the sum $45."
    rows.append((("y" * 60 + ". ") * 12)[: 699 - len(tail)] + "z" + tail)
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in tr.judge_endings(df, "doc_id", "text", "source").collect()}
    assert got[400]["limite"] and got[400]["cortado"]
    full = [i for i, t in enumerate(rows[:400]) if len(t) < 700]
    assert not any(got[i]["cortado"] for i in full)


def test_nulls_copies_long_texts_and_empty(spark):
    long = (SENT[0] + ". ") * 20_000
    rows = [(1, None, "a"), (2, "", "a"), (3, long, "a"), (4, long + "and then th", "a"), (5, long + "and then th", "b"), (6, SENT[0] + ".", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x["cortado"] for x in tr.judge_endings(df, "doc_id", "text", "source").collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}
    assert tr.judge_endings(df.limit(0), "doc_id", "text", "source").count() == 0


def test_texts_without_blanks_and_endless_names_take_no_longer(spark):
    rows = [(1, "x" * 2_000_000, "a"), (2, "- y\n- " + "Ab " * 60_000 + "end", "a"), (3, "." * 300_000, "a"), (4, "-" * 300_000 + "x", "a"), (5, "<" * 100_000, "a"), (6, '{"a": "' + "\\n" * 100_000 + '"}', "a"), (7, "a  1 " * 50_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert tr.judge_endings(df, "doc_id", "text", "source").count() == 7
