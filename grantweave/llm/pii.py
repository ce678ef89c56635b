"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

``find_spans(df)`` adds one array column of spans to any table with a text column; ``redact`` replaces
the spans by their kind. A null text counts as empty and has no spans; an empty table gives an empty
table; repeated rows are treated one by one; other columns are kept, and an existing column named like
the new one is replaced.

Kinds, in this order: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15
digits), and beyond these four iban (mod-97 of the account number equals 1, at its country's length whatever
follows; also at the end of the run of capitals and digits, and for a country without a known length at any end
from 34 to 15 characters that no letter or digit follows) and secret (a hexadecimal
run of 32 to 128 digits). A span's score starts at its kind's base value,
rises by ``BOOST`` if a context word of the kind stands within ``NEAR`` code points, and never leaves
0..1. Spans of the added kinds count from a score of ``CUT`` on: a hexadecimal run alone is no secret, one near a word such as
"token" is. The four base kinds always count; ``min_score`` asks for more.
"""

from __future__ import annotations

import re
from bisect import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
BASE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "secret": 0.4}
BOOST, NEAR, CUT = 0.2, 40, 0.5
CONTEXT = {
    "email": ("mail", "contact", "@", "courriel", "correo"),
    "ip": ("ip", "address", "server", "host", "adresse"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "téléphone", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("token", "key", "secret", "password"),
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either starts a match or none of its digits does, so starts inside a run are skipped.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
#: Characters of an account number by country, as registered.
LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(code: str) -> bool:
    """The account number's check: country and check digits go last, letters count from 10."""
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ so that long runs cost linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers, those of their country's length first; of the others the longest that overlap none of them."""
    known, other = [], []
    for m in IBAN.finditer(text):
        start, run = m.start(), m[1]
        ends = [i for i, c in enumerate(run, 1) if c != " "]
        n = LENGTHS.get(run[:2], 0)
        if 0 < n <= len(ends) and mod97(run[: ends[n - 1]].replace(" ", "")):
            known.append((start, start + ends[n - 1]))
            continue
        for end in reversed(ends[-1:] if n else ends[14:]):
            after = text[start + end : start + end + 1]
            if not (after.isascii() and after.isalnum()) and mod97(run[:end].replace(" ", "")):
                other.append((start, start + end))
                break
    kept, free = [], 0
    for s, e in known:
        if s >= free:
            kept.append((s, e))
            free = e
    starts, more, free = [s for s, _ in kept], [], 0
    for s, e in other:
        i = bisect(starts, s)
        if s >= free and not (i and kept[i - 1][1] > s) and not (i < len(starts) and starts[i] < e):
            more.append((s, e))
            free = e
    return kept + more


def spans_of(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", *m.span()))
        added = [("iban", s, e) for s, e in ibans(text)] + [("secret", *m.span()) for m in SECRET.finditer(text)]
        found += [x for x in added if score_of(text, *x) >= CUT]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def score_of(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    return round(min(1.0, BASE[kind] + BOOST * any(w in near for w in CONTEXT[kind])), 3)


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e, "score": score_of(t, k, s, e)} for k, s, e in spans_of(t)] for t in texts.fillna("")], dtype=object)


def find_spans(df: DataFrame, text: str = "text", out: str = "pii", min_score: float = 0.0) -> DataFrame:
    small_batches(df.sparkSession)
    df = df.withColumn(out, _spans(F.col(text)))
    return df.withColumn(out, F.filter(out, lambda s: s["score"] >= min_score)) if min_score else df


def redacted(text: str) -> str:
    """Spans become <KIND>; of overlapping spans the first, then the longest, gives the name for them all."""
    parts, done = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        parts += [text[done:s], f"<{kind.upper()}>"]
        done = e
    return "".join(parts) + text[done:] if merged else text


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or t != t else redacted(t) for t in texts], dtype=object)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same table with every confirmed span replaced; a null text stays null."""
    small_batches(df.sparkSession)
    return df.withColumn(text, _redact(F.col(text)))


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, all spans as text, and the hash of the four base kinds' spans."""
    found = find_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), out="s").drop("text")
    base = F.filter("s", lambda x: x["kind"].isin(*KINDS[:4]))
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
        *[count(k) for k in KINDS[4:]],
        F.size("s").cast("long").alias("n_spans"),
        F.array_join(F.transform("s", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


