"""Variant spellings of names and titles typed by people.

Spellings are blocked by phonetic codes of their tokens, candidate pairs are
compared token by token with Jaro-Winkler and a nickname table, and accepted
pairs are clustered by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage

# Fixed values ---------------------------------------------------------------

#: Given names with their usual short forms.
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex xander sandy", "andrew": "andy drew", "anthony": "tony antony",
    "barbara": "barb", "benjamin": "ben benji", "catherine": "cathy cat kate katie", "charles": "chuck charlie chas", "christine": "chris tina",
    "christopher": "chris kit topher", "claude": "", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie debby", "donald": "don donny",
    "dorothy": "dot dottie", "edward": "ed eddie ted ned", "eleanor": "nora ellie nell", "elizabeth": "liz beth lizzie betty betsy bess eliza libby",
    "francisco": "paco pancho frank", "francis": "frank", "frederick": "fred freddy rick fritz", "gerald": "jerry gerry", "gregory": "greg", "harold": "hal harry",
    "helena": "lena nell", "henry": "hank harry", "hugo": "", "ingrid": "inga", "irene": "", "ivan": "vanya", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "jonathan": "jon jonny", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey", "judith": "judy", "karl": "", "katherine": "kate katie kathy kay kat",
    "keiko": "", "lawrence": "larry", "leonard": "len lenny leo", "lucia": "lucy", "margaret": "maggie meg peggy marge", "maria": "", "marta": "", "matthew": "matt",
    "michael": "mike mick mickey", "nadia": "", "naomi": "", "nicholas": "nick nicky", "omar": "", "oscar": "", "owen": "", "pamela": "pam", "patricia": "pat patty tricia trish",
    "peter": "pete", "philip": "phil", "priya": "", "raymond": "ray", "rebecca": "becky becca", "renee": "rene", "richard": "rick dick rich", "robert": "bob rob bobby robbie bert",
    "ronald": "ron ronnie", "samuel": "sam sammy", "sebastien": "seb bastien", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "thandi": "", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vickie", "walter": "walt wally", "wei": "", "william": "bill will billy wm liam", "yusuf": "joe", "zachary": "zach zack",
}
HONORIFICS = frozenset("mr mrs ms miss dr prof sir hon rev".split())
CREDENTIALS = frozenset("md phd cpa esq esquire jd mba cfa dds rn pe llm".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "2", "iii": "3", "iv": "4", "2nd": "2", "3rd": "3", "4th": "4"}
PARTICLES = frozenset("mc mac de del della di da la le los van von der den st ten ter al el dos du bin ibn".split())
LEGAL = {
    "lp": "lp", "llp": "llp", "llc": "llc", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp",
    "co": "co", "company": "co", "plc": "plc", "sa": "sa", "nv": "nv", "ag": "ag", "gmbh": "gmbh",
}
ORG_SHORT = {
    "assoc": "associates", "associate": "associates", "assocs": "associates", "inv": "investment", "invs": "investments", "invt": "investment", "ptnrs": "partners", "ptrs": "partners", "partner": "partners",
    "fd": "fund", "fds": "funds", "fam": "family", "tr": "trust", "intl": "international", "mgmt": "management", "mgt": "management", "opp": "opportunity", "opps": "opportunities", "cap": "capital", "hldgs": "holdings",
    "hldg": "holding", "grp": "group", "gr": "growth", "advs": "advisors", "vent": "ventures", "invrs": "investors",
}
ORG_WORDS = frozenset(
    "associates investment investments partners fund funds family trust international management opportunity capital holdings holding group growth advisors ventures investors value asset foundation bank equity".split()
)
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}

#: Short forms in titles that stand for one thing.
TITLE_SHORT = {
    "ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "cto": "chief technology officer",
    "chro": "chief human resources officer", "gc": "general counsel", "vp": "vice president", "evp": "executive vice president",
    "svp": "senior vice president", "avp": "assistant vice president", "ch": "chief", "exec": "executive", "fin": "financial", "finl": "financial", "oper": "operating", "ops": "operations", "tech": "technology", "offcr": "officer",
    "ofcr": "officer", "off": "officer", "dir": "director", "directors": "director", "pres": "president", "prez": "president", "chmn": "chairman", "chm": "chairman", "chair": "chairman", "chairperson": "chairman", "chairwoman": "chairman",
    "secy": "secretary", "sec": "secretary", "corp": "corporate", "gen": "general", "genl": "general", "coun": "counsel", "treas": "treasurer", "acct": "accounting", "actg": "accounting", "acctg": "accounting", "mgr": "manager",
    "sr": "senior", "snr": "senior", "asst": "assistant", "info": "information", "mktg": "marketing", "dev": "development", "bd": "board", "mbr": "member", "v": "vice", "10": "ten", "percent": "percent", "pct": "percent", "holder": "owner",
    "shareholder": "owner", "comptroller": "controller", "admin": "administrative", "hr": "human resources", "strat": "strategy", "comm": "commercial", "mng": "managing", "mgmt": "management", "opers": "operations",
}
#: Short forms that stand for several offices: what the second of their three words may be.
TITLE_UNSURE = {
    "cio": "information investment", "cso": "strategy security scientific science sustainability sales", "cao": "accounting administrative", "cmo": "marketing medical", "cco": "commercial compliance communications customer",
    "cro": "revenue risk restructuring", "cdo": "data digital development", "cpo": "people product procurement", "clo": "legal learning",
}
#: Words that don't tell offices apart.
TITLE_FILLER = frozenset("of the and a an for to at board member corporate".split())

_GIVEN: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _x in (_full, *_short.split()):
        _GIVEN[_x] = _GIVEN.get(_x, frozenset()) | {_full}


# Strings --------------------------------------------------------------------

_OTHER = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ð": "d", "þ": "th"})


def fold(s: str) -> str:
    """Lower case without marks."""
    s = unicodedata.normalize("NFKD", s.lower().translate(_OTHER))
    return "".join(c for c in s if not unicodedata.combining(c))


_DIGITS = str.maketrans("015", "ols")


def read_digits(tok: str) -> str:
    """Digits inside a word as the letters they stand for in scanned text."""
    return tok.translate(_DIGITS) if any(c.isalpha() for c in tok) and any(c.isdigit() for c in tok) and len(tok) > 2 else tok


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = [False] * lb
    hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(lb) if used[j]]
    t = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    p = 0
    while p < min(4, la, lb) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


_CLASS = {c: d for d, cs in {"1": "bpfvw", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


@lru_cache(maxsize=200_000)
def phonetic(tok: str) -> str:
    """Code of consonant classes; vowels, h and repeats don't count."""
    out, last = "", ""
    for c in tok.replace("rn", "m"):
        k = _CLASS.get(c, "")
        if k and k != last:
            out += k
        last = k
    return out or "0"


# Names ----------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


class Name:
    """Tokens of one spelling, apart from titles, credentials and generation."""

    __slots__ = ("long", "initials", "order", "generation", "org", "legal")

    def __init__(self, raw: str):
        s = fold(raw).replace("ph.d", "phd").replace("m.d", "md")
        s = re.sub(r"[.&]", " ", re.sub(r"['’`]", "", s))
        toks = [read_digits(t) for t in re.findall(r"[^\W_]+(?:-[^\W_]+)*", s)]
        toks = _join_spelled(toks)
        full = [ORG_SHORT.get(t, t) for t in toks]
        words = sum(t in ORG_WORDS for t in full)
        self.org = words >= 1 and (words >= 2 or any(t in LEGAL for t in toks) or any(t in ORG_WORDS for t in full[2:])) or any(t in LEGAL for t in toks[2:] if t not in ("co", "sa", "ag"))
        self.generation = self.legal = ""
        self.initials: list[str] = []
        self.order: list[str] = []
        if self.org:
            keep = [t for t in full if t not in ("the", "and", "of")]
            self.legal = next((LEGAL[t] for t in reversed(keep) if t in LEGAL), "")
            keep = [t for t in keep if t not in LEGAL]
            number = [ROMAN.get(t, t) for t in keep if t in ROMAN or t.isdigit()]
            self.generation = "-".join(number)
            self.long = [t for t in keep if not (t in ROMAN or t.isdigit())]
            return
        rest = []
        for i, t in enumerate(toks):
            if t in HONORIFICS and (i == 0 or i == len(toks) - 1) or t in CREDENTIALS and i >= 2:
                continue
            if t in GENERATIONS and i >= 1 and not self.generation:
                self.generation = GENERATIONS[t]
            else:
                rest.append(t)
        joined: list[str] = []
        hold = ""
        for i, t in enumerate(rest):
            if t in PARTICLES and i + 1 < len(rest) and len(rest[i + 1]) > 1:
                hold += t
            else:
                joined.append(hold + t)
                hold = ""
        if hold:
            joined.append(hold)
        self.order = joined
        self.long = [t for t in joined if len(t) > 1]
        self.initials = [t for t in joined if len(t) == 1]


def _join_spelled(toks: list[str]) -> list[str]:
    """'l l c' and 'l p' at the end as one token."""
    for n in (3, 2):
        if len(toks) > n and all(len(t) == 1 for t in toks[-n:]) and "".join(toks[-n:]) in LEGAL:
            return [*toks[:-n], "".join(toks[-n:])]
    return toks


def same_given(a: str, b: str) -> bool:
    """One given name or two forms of it."""
    return a == b or bool(_GIVEN.get(a, frozenset()) & _GIVEN.get(b, frozenset()))


@lru_cache(maxsize=500_000)
def token_score(a: str, b: str) -> float:
    """1 for equal or nickname, else Jaro-Winkler where a slip of the pen can explain it, else 0."""
    if same_given(a, b):
        return 1.0
    if "-" in a or "-" in b:
        if "-" in a and "-" in b:
            return token_score(a.replace("-", ""), b.replace("-", ""))
        parts, whole = (a, b) if "-" in a else (b, a)
        s = max(token_score(x, whole) for x in (*parts.split("-"), parts.replace("-", "")) if x)
        return s if s >= 0.9 else 0.0
    if a in _GIVEN and b in _GIVEN:
        return 0.0
    short, full = (a, b) if len(a) < len(b) else (b, a)
    if len(short) >= 3 and full in _GIVEN and short not in _GIVEN and full.startswith(short):
        return 0.95
    ra, rb = a.replace("rn", "m"), b.replace("rn", "m")
    if ra == rb:
        return 1.0
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return 0.0
    s = max(jaro_winkler(a, b), jaro_winkler(ra, rb))
    if s < 0.86 and len(a) == len(b) >= 4 and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
        return 0.86
    return s if s >= 0.84 else 0.0


def compare(a: Name, b: Name) -> tuple[str, ...] | None:
    """None for different ones; otherwise what either side leaves open, as
    'side:attribute=value' with the value of the other side."""
    if a.org != b.org:
        return None
    if a.org:
        if a.generation != b.generation or a.legal and b.legal and a.legal != b.legal or len(a.long) != len(b.long):
            return None
        scores = [token_score(x, y) for x, y in zip(a.long, b.long, strict=True)]
        return () if scores and min(scores) > 0 and sum(scores) >= len(scores) - 0.4 else None
    open_: list[str] = []
    if a.generation != b.generation:
        if a.generation and b.generation:
            return None
        open_.append(f"b:g={a.generation}" if a.generation else f"a:g={b.generation}")
    left, right = list(a.long), list(b.long)
    pairs = sorted(((token_score(x, y), i, j) for i, x in enumerate(left) for j, y in enumerate(right)), reverse=True)
    ui, uj, total, hits, exact, family = set(), set(), 0.0, 0, 0, ()
    ia_, ib_ = list(a.initials), list(b.initials)
    for s, i, j in pairs:
        if s <= 0 or i in ui or j in uj:
            continue
        ui.add(i)
        uj.add(j)
        for x, y, rest in ((left[i], right[j], ib_), (right[j], left[i], ia_)):
            if x[0] == "o" and y[0] != "o" and "o" in rest and token_score(x[1:], y) > 0:
                rest.remove("o")  # the O of O'Name, written apart
        total += s
        hits += 1
        exact += s == 1.0
        if not family and not (left[i] in _GIVEN and right[j] in _GIVEN):
            family = (left[i], right[j])
    if not family:
        return None
    la = [t for i, t in enumerate(left) if i not in ui]
    lb = [t for j, t in enumerate(right) if j not in uj]
    ia, ib = ia_, ib_
    first_open: dict[str, str] = {}  # by side, the full form of the given name behind an initial
    for longs, inits, side in ((la, ib, "b"), (lb, ia, "a")):
        for t in list(longs):
            c = next((x for x in inits if t[0] == x or any(n[0] == x for n in _GIVEN.get(t, ()))), None)
            if c is not None:
                longs.remove(t)
                inits.remove(c)
                hits += 1
                exact += 1
                first_open.setdefault(side, min((n for n in _GIVEN.get(t, (t,)) if n[0] == c), default=t))
    initial_given = False
    for x in list(ia):  # equal initials
        if x in ib:
            ia.remove(x)
            ib.remove(x)
            hits += 1
            exact += 1
            initial_given = True
    if hits < 2:
        return None
    if (la or ia) and (lb or ib):  # each side has a part that the other lacks
        return None
    for name, own, rest in ((a, family[0], [*la, *ia]), (b, family[1], [*lb, *ib])):
        given = next((t for t in name.order if t != own), "")
        if given in rest:  # a given name met only a middle name
            return None
    if exact == 0 and total < 1.8:
        return None
    long_hits = len(ui)
    for side, t in first_open.items():
        if long_hits < 2 and not initial_given:  # the given name itself is an initial on one side
            open_.append(f"{side}:f={t[0]}{t[-1]}")
    for side, rest in (("b", [*la, *ia]), ("a", [*lb, *ib])):
        for t in rest:
            open_.append(f"{side}:m={t[0]}")
    return tuple(open_)


def block_keys(name: Name) -> list[str]:
    """Phonetic codes of the tokens in order of the alphabet, and of both ends of
    long ones with the first letters of the other tokens, and the first letters
    alone, so that a slip leaves a key intact."""
    keys = set()
    toks = sorted(t for t in name.long if not (name.org and t in ORG_WORDS)) or sorted(name.long)
    if name.org:
        keys.update("o" + phonetic(t) for t in toks)
        keys.update("p" + t[:3] for t in toks)
    else:
        family = [t for t in toks if t not in _GIVEN] or toks
        for x in family:
            firsts = {n[0] for t in toks if t != x for n in (*_GIVEN.get(t, ()), t)} | set(name.initials) or {""}
            keys.update("i" + x[0] + c for c in firsts)
            for t in {x, *x.split("-")} - {""}:
                t = t.replace("-", "")
                keys.add("t" + phonetic(t))
                if len(t) >= 5:
                    keys.update("h" + t[0] + phonetic(t[:4]) + c for c in firsts)
                    keys.update("e" + phonetic(t[-4:]) + t[-1] + c for c in firsts)
    return sorted(keys)


# Titles ---------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def office(raw: str, sure: frozenset[str] = frozenset()) -> str:
    """The office a title names: its words in full and in order of the alphabet, for
    each part of a combined title; empty if nothing is left. ``sure`` are the full
    forms ('chief x officer') that a short form of several meanings stands for."""
    s = fold(raw).replace("%", " percent ").replace("'", "").replace("’", "")
    s = re.sub(r"(?<=\b[a-z])\.\s?(?=[a-z]\b)", "", s)
    parts = re.split(r"\s*(?:/|&|;|\band\b)\s*", s)
    words: list[str] = []
    for t in re.findall(r"[^\W_]+", " ".join(parts)):
        t = read_digits(t) if not t.isdigit() else t
        full = [f"chief {x} officer" for x in TITLE_UNSURE.get(t, "").split() if f"chief {x} officer" in sure]
        words += (full[0] if len(full) == 1 else TITLE_SHORT.get(t, t)).split()
    if "vice" in words and "president" in words and ("chief" not in words):
        words = ["finance" if w == "financial" else "operations" if w == "operating" else w for w in words]
    out = {w for w in words if w not in TITLE_FILLER}
    return " ".join(sorted(out)) or " ".join(sorted(set(words)))


def one_slip(a: str, b: str) -> bool:
    """Whether one letter too many, too few, wrong or swapped with the next tells two words
    apart (two of them in words of twelve letters); the first letter is seldom wrong."""
    if a == b:
        return True
    n = min(len(a), len(b))
    if n < 4 or max(len(a), len(b)) < 5 or a[0] != b[0] or not (a.isalpha() and b.isalpha()):
        return False
    most = 2 if n >= 12 else 1
    if abs(len(a) - len(b)) > most:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1] <= most


def same_office(a: str, b: str, least: float = 0.88) -> bool:
    """Whether two offices have, word by word, the same words but for slips: Jaro-Winkler of
    ``least`` and a slip that explains the difference, since real words (development,
    developer) can be as alike as a word and its misspelling."""
    right = b.split()
    for x in sorted(a.split(), key=lambda w: w not in right):
        near = max(right, key=lambda y: (jaro_winkler(x, y), y), default="")
        if jaro_winkler(x, near) < least or not one_slip(x, near):
            return False
        right.remove(near)
    return not right


def office_keys(o: str) -> list[str]:
    """Blocks of an office: for each word the phonetic codes of its other words in order
    of the alphabet, with the first letter of the word and the code of either its first
    or its last three letters. A slip in one word leaves one of its keys as it was."""
    words = o.split()
    keys = set()
    for i, w in enumerate(words):
        rest = " ".join(sorted(phonetic(x) for x in words[:i] + words[i + 1 :]))
        keys.add(f"{rest}|{w[0]}<{phonetic(w[:3])}")
        keys.add(f"{rest}|{w[0]}>{phonetic(w[-3:])}")
    return sorted(keys)


# Operators ------------------------------------------------------------------


def _keys_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        keys = [block_keys(Name(t)) for t in pdf["t"]]
        n = [len(k) for k in keys]
        yield pd.DataFrame({"e": pdf["e"].repeat(n).to_numpy(), "t": pdf["t"].repeat(n).to_numpy(), "k": [x for k in keys for x in k]})


@lru_cache(maxsize=100_000)
def _name(t: str) -> Name:
    return Name(t)


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for e, a, b in zip(pdf["e"], pdf["a"], pdf["b"], strict=True):
            got = compare(_name(a), _name(b))
            if got is not None:
                out.append((e, a, b, "|".join(x[2:] for x in got if x[0] == "a"), "|".join(x[2:] for x in got if x[0] == "b")))
        yield pd.DataFrame(out, columns=["e", "a", "b", "open_a", "open_b"])


def accepted_pairs(spellings: DataFrame) -> DataFrame:
    """Accepted pairs (e, a, b) of distinct ``spellings`` (e, t).

    A spelling that leaves something open (no generation, no middle name, only
    an initial) is linked only where its partners agree on that point: with two
    different answers among them it could mean either, and those links fall."""
    keyed = spellings.select(F.col("e").cast("long").alias("e"), "t").mapInPandas(_keys_of, "e long, t string, k string")
    keyed = cut_lineage(keyed)  # both sides of the join below
    pairs = keyed.select("e", "k", F.col("t").alias("a")).join(keyed.select("e", "k", F.col("t").alias("b")), ["e", "k"]).filter("a < b").select("e", "a", "b").distinct()
    got = pairs.mapInPandas(_compared, "e long, a string, b string, open_a string, open_b string")
    got = cut_lineage(got)  # each pair is compared once
    both = got.select("e", "a", "b", F.col("open_a").alias("o"), F.lit(True).alias("own_a")).unionByName(got.select("e", F.col("b").alias("a"), F.col("a").alias("b"), F.col("open_b").alias("o"), F.lit(False).alias("own_a")))
    doubts = both.select("e", "a", F.explode(F.split("o", r"\|")).alias("x")).filter("x <> ''").select("e", "a", F.substring("x", 1, 1).alias("what"), "x").distinct()
    doubts = doubts.groupBy("e", "a", "what").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("e", "a").agg(F.collect_set("what").alias("bad"))
    judged = both.join(doubts, ["e", "a"], "left")
    wrong = F.exists(F.split("o", r"\|"), lambda x: F.array_contains("bad", F.substring(x, 1, 1)))
    dropped = judged.filter(F.col("bad").isNotNull() & wrong).select("e", F.when(F.col("own_a"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("own_a"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    return got.select("e", "a", "b").join(dropped, ["e", "a", "b"], "left_anti")


def name_variants(df: DataFrame, entity: str, name: str) -> DataFrame:
    """(entity, spelling, grupo) of every spelling that shares its person or
    organisation with another of the same entity.

    Rows without entity, and null or blank names, take no part; repeated
    spellings count once. Node ids are 64-bit hashes of entity and spelling.
    """
    s = df.filter(F.col(entity).isNotNull() & (F.trim(name) != "")).select(F.col(entity).cast("long").alias("e"), F.col(name).alias("t")).distinct()
    pairs = accepted_pairs(s).select("e", F.col("a").alias("ta"), F.col("b").alias("tb"), F.xxhash64("e", "a").alias("a"), F.xxhash64("e", "b").alias("b"))
    pairs = cut_lineage(pairs)  # edges and nodes
    groups = connected_components(pairs)
    nodes = pairs.select("e", F.col("ta").alias("t"), F.col("a").alias("id")).unionByName(pairs.select("e", F.col("tb").alias("t"), F.col("b").alias("id"))).distinct()
    kind = df.schema[entity].dataType
    return nodes.join(groups, "id").select(F.col("e").cast(kind).alias(entity), F.col("t").alias(name), F.col("component").alias("grupo"))


def title_variants(df: DataFrame, title: str) -> DataFrame:
    """(spelling, grupo) of the distinct titles, grouped by the office they name.

    Titles are read into offices (words in full, in order of the alphabet); distinct
    offices are blocked by the phonetic codes of their words, compared word by word with
    Jaro-Winkler, and accepted pairs are clustered by connected components. A short form
    of several meanings is read as the only one of them that the titles spell out, else it
    is an office of its own. Null and blank titles take no part."""
    s = df.filter(F.trim(title) != "").select(F.col(title).alias("t")).distinct()
    s = cut_lineage(s)  # one row per spelling, read twice

    def read(sure: frozenset[str]):
        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"t": pdf["t"].to_numpy(), "o": [office(t, sure) for t in pdf["t"]]})

        return each

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys = [office_keys(o) for o in pdf["o"]]
            yield pd.DataFrame({"o": pdf["o"].repeat([len(k) for k in keys]).to_numpy(), "k": [x for k in keys for x in k]})

    def same(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.loc[[same_office(a, b) for a, b in zip(pdf["o"], pdf["p"], strict=True)], ["o", "p"]]

    unsure = {" ".join(sorted(("chief", x, "officer"))): f"chief {x} officer" for xs in TITLE_UNSURE.values() for x in xs.split()}
    told = s.mapInPandas(read(frozenset()), "t string, o string")
    sure = frozenset(unsure[r["o"]] for r in told.filter(F.col("o").isin(*unsure)).select("o").distinct().collect())  # no more than the table has
    offices = cut_lineage(s.mapInPandas(read(sure), "t string, o string").filter("o <> ''"))
    blocks = cut_lineage(offices.select("o").distinct().mapInPandas(keyed, "o string, k string"))  # both sides of the join
    pairs = blocks.join(blocks.select(F.col("o").alias("p"), "k"), "k").filter("o < p").select("o", "p").distinct().mapInPandas(same, "o string, p string")
    groups = connected_components(pairs.select(F.xxhash64("o").alias("a"), F.xxhash64("p").alias("b")))
    j = offices.join(groups, F.xxhash64("o") == F.col("id"), "left")
    return j.select(F.col("t").alias(title), F.coalesce("component", F.xxhash64("o")).alias("grupo"))


def pairs_of(groups: DataFrame, by: list[str], text: str) -> DataFrame:
    """All pairs a < b of the spellings of a group."""
    return groups.select(*by, "grupo", F.col(text).alias("texto_a")).join(groups.select(*by, "grupo", F.col(text).alias("texto_b")), [*by, "grupo"]).filter("texto_a < texto_b").drop("grupo")
