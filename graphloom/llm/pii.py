"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text finds the anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
Deterministic local parsers then expand from each anchor to the longest valid span and validate it (octets, Luhn, digit
counts, IBAN check digits). Work is linear in the text plus the anchors; no expression is run over text without anchors.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone`` (the base kinds: leftmost, non-overlapping within a kind, a match that
fails validation is dropped without a retry), then the method's own ``account`` (an IBAN, social-security or account number
behind a cue) and ``userinfo`` (the credentials of a URL). Kinds may overlap each other.

Defined results
---------------
* null and empty text: no spans, the digest of the empty string; redaction leaves null null;
* offsets are code points, end exclusive; texts of any length are read whole, one at a time;
* repeated rows and null ids: one result a row; an empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graphloom.llm import common

KINDS = ["email", "ip", "card", "phone", "account", "userinfo"]
EMAIL, IP, CARD, PHONE, ACCOUNT, USERINFO = range(6)

DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = _ALNUM | frozenset("._%+-")
HOST = _ALNUM | frozenset("-")
PHONE_RUN = DIGITS | frozenset(" ().-")
CUES = ("iban", "ssn", "social security", "account", "acct", "passport", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "git://", "smtp://", "postgres://", "mysql://", "mongodb://", "redis://")
#: What may stand between a cue and its identifier.
_AFTER_CUE = re.compile(r"[ \t]*(?:no\.?|number|nr\.?|num\.?|#)?[ \t]*[:=#]?[ \t]*", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"[A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,19}(?![A-Za-z0-9])")

_automaton = None


def _anchors():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("@", 1))
        a.add_word("+", ("+", 1))
        for d in DIGITS:
            a.add_word(d, ("0", 1))
        for cue in CUES:
            a.add_word(cue, ("cue", len(cue)))
        for scheme in SCHEMES:
            a.add_word(scheme, ("scheme", len(scheme)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _run(text: str, i: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters that starts at ``i``."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    free = 0  # where the next match may start
    for at in ats:
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = _run(text, at + 1, HOST)
        if start == at or end == at + 1:
            continue
        labels = 1
        while end < len(text) and text[end] == "." and (e := _run(text, end + 1, HOST)) > end + 1:
            end, labels = e, labels + 1
        if labels > 1:
            yield start, end
            free = end


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    free = 0
    for start, end in runs:
        if start < free:
            continue
        parts, e = [(start, end)], end
        while len(parts) < 4 and e < len(text) and text[e] == "." and (f := _run(text, e + 1, DIGITS)) > e + 1:
            parts.append((e + 1, f))
            e = f
        if len(parts) == 4:
            free = e
            if all(int(text[a:b][-40:]) <= 255 and (b - a <= 40 or not text[a : b - 40].strip("0")) for a, b in parts):
                yield start, e


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(runs):
        start, end = runs[i]
        i += 1
        while i < len(runs) and runs[i][0] == end + 1 and text[end] in " -":
            end = runs[i][1]
            i += 1
        if 12 <= end - start <= 37:
            digits = "".join(c for c in text[start:end] if c in DIGITS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield start, end


def _phones(text: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    free = 0
    for plus in pluses:
        if plus < free or plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
            continue
        end = _run(text, plus + 2, PHONE_RUN)
        while end > plus + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end > plus + 3:
            free = end
            if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
                yield plus, end


def _accounts(text: str, cues: list[int]) -> Iterator[tuple[int, int]]:
    """Identifiers that follow a cue ending at one of ``cues``: the first of IBAN, social-security and plain number that fits."""
    free = 0
    for cue in cues:
        at = _AFTER_CUE.match(text, cue).end()
        if at < free:
            continue
        for pattern, valid in ((_IBAN, iban_valid), (_SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9"), (_NUMBER, lambda s: True)):
            if (m := pattern.match(text, at)) and valid(m.group()):
                yield m.span()
                free = m.end()
                break


def _userinfo(text: str, schemes: list[int]) -> Iterator[tuple[int, int]]:
    for start in schemes:
        end = start
        while end < len(text) and not text[end].isspace() and text[end] not in "/?#@\"'<>":
            end += 1
        if end < len(text) and text[end] == "@" and end > start:
            yield start, end


def _folded(text: str) -> str:
    """Lower case, code point by code point: only one capital letter would become two."""
    return text.replace("\u0130", "i").lower()


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as ``(start, kind, end)``, by start and then kind."""
    if not text:
        return []
    ats, pluses, cues, schemes = [], [], [], []
    runs: list[tuple[int, int]] = []
    for last, (what, _) in _anchors().iter(_folded(text)):
        if what == "0":
            if runs and runs[-1][1] == last:
                runs[-1] = (runs[-1][0], last + 1)
            else:
                runs.append((last, last + 1))
        elif what == "@":
            ats.append(last)
        elif what == "+":
            pluses.append(last)
        else:
            (cues if what == "cue" else schemes).append(last + 1)
    found = []
    for kind, spans in ((EMAIL, _emails(text, ats)), (IP, _ips(text, runs)), (CARD, _cards(text, runs)), (PHONE, _phones(text, pluses)), (ACCOUNT, _accounts(text, cues)), (USERINFO, _userinfo(text, schemes))):
        found += [(s, kind, e) for s, e in spans]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact_text(text: str | None) -> str | None:
    """Each span, or union of overlapping spans, is replaced by the name of its first kind in brackets."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


SCAN = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _texts(s: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in s]


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in _texts(texts):
            spans = find_spans(t)
            base = [x for x in spans if x[1] <= PHONE]
            n = [sum(x[1] == k for x in base) for k in (EMAIL, IP, CARD, PHONE)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([redact_text(t) for t in _texts(texts)], dtype=object)


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``row``, a document with all its columns, and a struct ``pii``: counts, digest and spans of its whole text."""
    common.prepare(documents.sparkSession)
    return documents.select(common.whole_row(documents).alias("row"), pandas_udf(_scan, SCAN)(F.col(text)).alias("pii"))


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the personal data of ``text`` replaced; the other columns are untouched."""
    common.prepare(documents.sparkSession)
    return documents.withColumn(text, pandas_udf(_redact, "string")(F.col(text)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("row.doc_id", "pii.*")
