"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers expand and check them.

Kinds of the base set: email, ip, card, phone.  Anchors for them are at-signs and digits; a plus sign before
a digit opens a phone number.  Two more kinds start at cues: ``userinfo`` at a scheme's ``://`` with
credentials before the host, and ``account`` at words such as iban or passport with an identifier behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "account", "userinfo")
BASE_KINDS = KINDS[:4]
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "customer id", "kontonummer", "cuenta", "compte")
Span = tuple[str, int, int]

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _DIGITS | _LETTERS | frozenset("._%+-")
_LABEL = _DIGITS | _LETTERS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_IDENTIFIER = _DIGITS | _LETTERS


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "://", *_DIGITS, *CUES):
        kind = "cue" if anchor in CUES else "digit" if anchor in _DIGITS else anchor
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case of A-Z only, so that places stay the same."""
    return text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at a place."""
    end, n = at, len(text)
    while end < n and text[end] in allowed:
        end += 1
    return end


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Bounds of the address around an at-sign; it may not start before ``least``."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def _quads(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the digits joined by single dots that start at a place, and each four parts' bounds if all are at most 255."""
    parts, end = [], at
    while True:
        stop = _run(text, end, _DIGITS)
        parts.append((end, stop))
        if not (stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS):
            break
        end = stop + 1
    fours = [parts[i : i + 4] for i in range(0, len(parts) - 3, 4)]
    return parts[-1][1], [(f[0][0], f[3][1]) for f in fours if all(_octet(text[a:b]) for a, b in f)]


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def _number(text: str, at: int) -> tuple[int, str]:
    """End and digits of the number at a place whose digits are joined by at most one space or hyphen."""
    end, digits = at, []
    while True:
        stop = _run(text, end, _DIGITS)
        digits.append(text[end:stop])
        if not (stop + 1 < len(text) and text[stop] in " -" and text[stop + 1] in _DIGITS):
            return stop, "".join(digits)
        end = stop + 1


def _luhn(digits: str) -> bool:
    values = [ord(d) - 48 for d in reversed(digits)]
    doubled = (2 * v - 9 if v > 4 else 2 * v for v in values[1::2])
    return (sum(values[0::2]) + sum(doubled)) % 10 == 0


def _phone_end(text: str, plus: int) -> int:
    """End of the number after a plus sign and a digit, 0 if there is none."""
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in _DIGITS else 0


def _account(text: str, cue: int, end: int) -> tuple[int, int] | None:
    """Bounds of the identifier behind a cue word: 6 to 34 letters and digits, at least 5 of them digits,
    in groups joined by single spaces, hyphens or dots; after a colon, equals sign, # or spaces."""
    if cue and text[cue - 1] in _LETTERS:
        return None
    start = end
    while start < len(text) and start < end + 6 and text[start] in " :=#":
        start += 1
    if start == end:
        return None
    stop, digits, size = start, 0, 0
    while True:
        group = _run(text, stop, _IDENTIFIER)
        if group == stop or not any(c in _DIGITS for c in text[stop:group]):
            break
        digits += sum(c in _DIGITS for c in text[stop:group])
        size += group - stop
        last = group
        if not (group + 1 < len(text) and text[group] in " -."):
            break
        stop = group + 1
    return (start, last) if 6 <= size <= 34 and digits >= 5 else None


def _userinfo(text: str, at: int, end: int) -> tuple[int, int] | None:
    """Bounds of the credentials between a scheme and the at-sign before a host."""
    if not at or text[at - 1] not in _LETTERS:
        return None
    stop = end
    while stop < len(text) and text[stop] not in "@/?# \t\r\n\"'<>":
        stop += 1
    known = stop > end and stop + 1 < len(text) and text[stop] == "@" and text[stop + 1] in _IDENTIFIER
    return (end, stop) if known else None


_ANCHORS = _automaton()


def find(text: str | None) -> list[Span]:
    """Spans (kind, start, end) in code points, ordered by kind as in KINDS, then start.

    Spans of one kind don't overlap; a later match starts behind the one before, also one that was dropped.
    """
    if not text:
        return []
    spans: list[Span] = []
    mail_end = quad_end = number_end = phone_end = other_end = 0
    for last, (kind, size) in _ANCHORS.iter(_lower(text)):
        at = last - size + 1
        if kind == "digit":
            if at and text[at - 1] == "+" and at - 1 >= phone_end and (end := _phone_end(text, at - 1)):
                phone_end = end
                if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    spans.append(("phone", at - 1, end))
            if at >= quad_end:
                quad_end, quads = _quads(text, at)
                spans.extend(("ip", a, b) for a, b in quads)
            if at >= number_end:
                number_end, digits = _number(text, at)
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    spans.append(("card", at, number_end))
        elif kind == "@":
            if at >= mail_end and (bounds := _email(text, at, mail_end)):
                mail_end = bounds[1]
                spans.append(("email", *bounds))
        elif at >= other_end:
            bounds = _account(text, at, last + 1) if kind == "cue" else _userinfo(text, at, last + 1)
            if bounds:
                other_end = bounds[1]
                spans.append(("account" if kind == "cue" else "userinfo", *bounds))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = find(text)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        frame = pd.DataFrame(rows, columns=names, index=batch.index)
        yield frame.assign(doc_id=batch["doc_id"].astype("Int64"))[["doc_id", *names]]


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data, one row for each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; null and repeated ids are passed on.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInPandas(_scan, schema)
