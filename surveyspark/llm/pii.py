"""Personal data by anchor expansion: an automaton finds cues, local parsers expand and validate the spans around them.

One Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and identifier cues. Each anchor has a deterministic
parser that reads outwards from it. Base kinds are email, ip, card and phone; the method adds ``url`` (scheme with a host
that carries user data), ``account`` (an IBAN or number after an identifier cue) and ``secret`` (a value after a key cue).

Defined cases: a null or empty text has no spans; spans of one kind never overlap, spans of different kinds may;
offsets are code points with an exclusive end; every text is read whole and in time linear in its length.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_URL_USER = re.compile(r"://[^\s/?#@<>\"']{1,256}@[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#][^\s<>\"']*+)?")
_VALUE = re.compile(r"[\"']?[ \t]{0,3}[:=#][ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{6,})")
_NUMBER = re.compile(r"[ \t]{0,3}(?:(?:no|nr|number)\b\.?)?[ \t]{0,3}[:=#]?[ \t]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){2,8}|[0-9]{6,18})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def small(part: str) -> bool:
    """At most 255, whatever zeros lead."""
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


class Finder:
    """The automaton and the parsers, built once in each Python worker."""

    def __init__(self) -> None:
        self.automaton = None

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, _: dict) -> None:
        self.automaton = None

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for c in "0123456789":
            self.automaton.add_word(c, "digit")
        self.automaton.add_word("@", "at")
        self.automaton.add_word("+", "plus")
        self.automaton.add_word("://", "scheme")
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    self.automaton.add_word(form, kind)
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rank of kind, end), sorted."""
        if not text:
            return []
        if self.automaton is None:
            self.build()
        out: list[tuple[int, int, int]] = []
        free_email = free_ip = free_card = free_phone = free_url = free_account = free_secret = 0
        for at, cue in self.automaton.iter(text):
            if cue == "digit":
                if at >= free_ip:
                    if m := _IP.match(text, at):
                        free_ip = m.end()
                        if all(map(small, m.groups())):
                            out.append((at, 1, free_ip))
                    else:  # no match begins in this run of digits
                        free_ip = _DIGITS.match(text, at).end()
                if at >= free_card:
                    m = _CARD.match(text, at)
                    free_card = m.end()
                    if free_card - at >= 14:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            out.append((at, 2, free_card))
            elif cue == "at":
                start = at
                while start > free_email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    free_email = m.end()
                    out.append((start, 0, free_email))
            elif cue == "plus":
                if at >= free_phone and (m := _PHONE.match(text, at)):
                    free_phone = m.end()
                    if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
                        out.append((at, 3, free_phone))
            elif cue == "scheme":
                start = at - 2
                while start > free_url and start > at - 18 and text[start - 1] in _SCHEME:
                    start -= 1
                if start < at - 2 and (m := _URL_USER.match(text, at - 2)):
                    free_url = m.end()
                    out.append((start, 4, free_url))
            elif cue == "account":
                if at >= free_account and (m := _NUMBER.match(text, at + 1)) and (m[1].isdecimal() or iban(m[1])):
                    free_account = m.end(1)
                    out.append((m.start(1), 5, free_account))
            elif at >= free_secret and (m := _VALUE.match(text, at + 1)):
                free_secret = m.end(1)
                out.append((m.start(1), 6, free_secret))
        out.sort()
        return out


def find_udf():
    finder = Finder()

    @F.pandas_udf("array<struct<start:long,kind:string,end:long>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in finder.find(t)] for t in texts])

    return find


def personal_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array column ``out`` of (start, kind, end), by start and then as kinds are listed."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, find_udf()(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one, named by the first."""
    bounded_batches(docs.sparkSession)
    finder = Finder()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans, parts, at = finder.find(t), [], 0
            for start, kind, end in spans:
                if start >= at:
                    parts += [t[at:start], f"[{KINDS[kind].upper()}]"]
                at = max(at, end)
            out.append("".join(parts) + t[at:] if spans else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, mask(F.col(text)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return personal_spans(docs).select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
