"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors (at-signs, digit pairs, plus signs,
schemes and identifier cues).  At each anchor a small local parser expands to the
boundaries of an email, address, number or account and validates it.  Nothing but
the text of one row is needed, so rows stay where they are: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SPANS = "array<struct<kind:string,start:long,end:long>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER = re.compile(r"[A-Za-z0-9._~%-]+:[^\s@/]+(?=@)")
_IP6 = re.compile(r"\[((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})\]")
_CUE_GAP = re.compile(r"[ \t]*(?:(?i:no|nr|number)\.?)?[ \t]*[:=#]?[ \t]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    digits = "0123456789"
    a.add_word("@", ("email", 1))
    a.add_word("://", ("scheme", 3))
    for x in digits:
        a.add_word(f"{x}.", ("ip", 1))
        a.add_word(f"+{x}", ("phone", 2))
        for y in digits:
            for sep in ("", " ", "-"):
                a.add_word(f"{x}{sep}{y}", ("card", 2 + len(sep)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    """Mod-97 check of an account number; spaces don't count."""
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as in KINDS; null has none.

    Within a kind matches are leftmost and don't overlap; what fails validation
    still uses up its characters, as a plain left-to-right search would.
    """
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _ANCHORS.iter(text):
        at = last - size + 1
        if kind == "email":
            s, floor = at, done["email"]
            while s > floor and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append(("email", s, m.end()))
        elif kind == "ip":
            s, floor = last, done["ip"]
            while s > floor and text[s - 1] in _DIGIT:
                s -= 1
            if s < last and (m := _IP.match(text, s)):
                done["ip"] = m.end()
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                    out.append(("ip", s, m.end()))
        elif kind == "card":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c in _DIGIT for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "scheme":
            if m := _USER.match(text, last + 1):
                out.append(("account", m.start(), m.end()))
            elif m := _IP6.match(text, last + 1):
                out.append(("address", m.start(1), m.end(1)))
        elif at >= done["account"] and (m := _IBAN.match(text, _CUE_GAP.match(text, last + 1).end())) and iban_ok(m[0]):
            done["account"] = m.end()
            out.append(("account", m.start(), m.end()))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(x)] for x in texts], dtype=object)


def mask(text: str | None) -> str | None:
    """The text with each span replaced by <KIND>; of overlapping spans the first, longest one names it."""
    if text is None:
        return None
    parts, at = [], 0
    for kind, s, e in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        if e > at:
            at = e
    return "".join([*parts, text[at:]])


def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(mask)


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts get an empty array.  All rows and columns stay, repeated
    ones too; a column named ``out`` is replaced.  An empty table stays empty.
    """
    return docs.withColumn(out, F.pandas_udf(_spans, SPANS)(text_of(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind, as in ``<EMAIL>``; null stays null.

    All rows and other columns stay; texts of any length are searched whole; an empty table stays empty.
    """
    return docs.withColumn(text, F.pandas_udf(_masked, "string")(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, spans: str = "pii_spans") -> DataFrame:
    """Counts and digests by document of what ``find`` returns."""
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
