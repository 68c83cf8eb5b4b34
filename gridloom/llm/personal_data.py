"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds are found as they are defined, leftmost and without overlap, each kind by itself; they
always stay. Further kinds are only kept if their score reaches a threshold: bank account numbers (IBAN,
modulo 97), national identity numbers, telephone numbers without a country code, and keys of 32 to 64
hexadecimal digits, the last three only beside a word (for keys also an assignment) that announces them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from gridloom.llm._common import documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "secret")
#: Score of a span by its kind; context adds or takes NEAR if a word of the kind's list is within REACH characters.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3, "secret": 0.3}
NEAR, REACH, THRESHOLD = 0.3, 40, 0.5
FOR = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mailto)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|cell|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|telephone|tel|call|mobile|fax)\b", re.I),
    # what stands before a span ends in a line feed here
    "secret": re.compile(r"(?:key|token|secret|passw(?:or)?d|credential|auth)|[=:]\x20?[\"']?\n", re.I),
}
AGAINST = re.compile(r"\b(?:version|isbn|issn|part no|section|serial|invoice)\b", re.I)

_ANY = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that fails from its start fails from each later digit too, so the lookbehind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether a string of digits ends in its Luhn check digit."""
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of an IBAN (no spaces) hold."""
    turned = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address hangs on its @: the whole run of allowed characters before it, and a domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans as (kind, start, end), by start and then by kind as listed."""
    if not _ANY.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if len(m[0]) < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, raised by its words and lowered by others within REACH characters, within 0 to 1."""
    near = text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]
    points = SCORE[kind] + NEAR * bool(FOR[kind].search(near)) - NEAR * bool(AGAINST.search(near))
    return min(1.0, max(0.0, points))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: the base ones, and those others that reach the threshold and no base
    span overlaps, by start and then by kind as listed."""
    text = text or ""
    base = base_spans(text)
    out = [(k, s, e, score(text, k, s, e)) for k, s, e in base]
    if _ANY.search(text):
        taken = [(s, e) for _, s, e in base]
        for kind, pattern, holds in (("iban", _IBAN, lambda x: mod97(x.replace(" ", ""))), ("ssn", _SSN, bool), ("local_phone", _LOCAL_PHONE, bool), ("secret", _SECRET, bool)):
            for m in pattern.finditer(text):
                if holds(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken):
                    points = score(text, kind, *m.span())
                    if points >= THRESHOLD:
                        out.append((kind, *m.span(), points))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None) -> str | None:
    """text with each span replaced by its kind in brackets; overlapping spans go together, named by the first."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


_ROW = StructType([StructField(f"n_{k}", LongType()) for k in BASE] + [StructField(n, StringType()) for n in ("base_sha256", "spans", "scores")])
_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))


@F.pandas_udf(_ROW)
def _digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    said = lambda found: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)
    for batch in texts:
        rows = []
        for text in batch:
            whole = spans(text)
            base = [x for x in whole if x[0] in BASE]
            rows.append((*(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(said(base).encode()).hexdigest(), said(whole), ",".join(f"{p:.2f}" for *_, p in whole)))
        yield pd.DataFrame(rows, columns=_ROW.names)


@F.pandas_udf(StringType())
def _redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([redacted(t) for t in batch], dtype=object)


@F.pandas_udf(_SPANS)
def _found(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans(t)] for t in texts], dtype=object)


def find(df: DataFrame, text_col: str = "text", out_col: str = "personal_data") -> DataFrame:
    """df with an array of its text's spans (kind, start, end, score), positions in code points.

    A null or empty text has none. Rows are worked on by themselves: repeated rows, ties, nulls in other
    columns and other columns of any name don't matter, but out_col is replaced. No shuffle.
    """
    return df.withColumn(out_col, _found(df[text_col]))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with spans in its text replaced by their kinds in brackets; a null text stays null."""
    return df.withColumn(text_col, _redact(df[text_col]))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base spans' digest, and all spans of every document with their scores in the same order."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", _digest("text").alias("r")).select("doc_id", "r.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents stay, with their personal data replaced; n_chars, if there is one, follows the text."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(docs.columns)


QUERIES = {"op9_personal_data": op9_personal_data}
