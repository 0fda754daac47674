"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues.  From an
anchor a small parser of its kind expands to both sides and validates what it found.

Base kinds, leftmost and without overlap within a kind; what fails its check is dropped:

* email: letters, digits and ``._%+-``, an at-sign, dotted labels
* ip: four dotted numbers, each at most 255
* card: digits with single blanks or hyphens, 13 to 19 of them, Luhn
* phone: a plus sign, 9 to 15 digits with blanks, brackets, dots and hyphens

Further kinds: ``login`` (user and password in a URL), ``secret`` (a long value behind a cue such as
``token =``), ``iban`` (mod 97), ``ssn`` (behind its cue).  Null texts are empty.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "login", "secret", "ssn")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
_SECRET = re.compile(r"""["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9+/_.=-]{16,})""")
_BEARER = re.compile(r"\s{1,3}([A-Za-z0-9+/_.=-]{16,})")
_SSN = re.compile(r"\W{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_IBAN = re.compile(r"\W{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_CUES = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key"),
    "bearer": ("bearer",),
    "ssn": ("ssn", "social security number"),
    "iban": ("iban",),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, with a capital, and in capitals."""
    out = ahocorasick.Automaton()
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                out.add_word(form, (kind, len(form)))
    for char in "@+0123456789":
        out.add_word(char, ("digit" if char in _DIGITS else char, 1))
    out.add_word("://", ("scheme", 3))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    value = 0
    for c in iban[4:] + iban[:4]:
        value = (value * (10 if c in _DIGITS else 100) + int(c, 36)) % 97
    return value == 1


def _left(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end) in code points, by kind as listed, then by start."""
    text = text or ""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # where the next match of a kind may start; digit runs are looked at from their first digit
    done = dict.fromkeys(("email", "ip", "card", "phone", "secret"), 0)
    seen_ip = -2

    def add(kind: str, start: int, end: int) -> None:
        spans[kind].append((start, end))

    for end, (kind, size) in automaton().iter(text):
        at = end + 1 - size
        if kind == "digit":
            if at >= done["ip"] and seen_ip != at - 1:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        add("ip", at, m.end())
            seen_ip = at if at >= done["ip"] else -2
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, m.end())
        elif kind == "@":
            start = _left(text, at, done["email"])
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                add("email", start, m.end())
        elif kind == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                stop = m.end()
                while text[stop - 1] not in _DIGITS:
                    stop -= 1
                if stop - at >= 4:  # a sign between the first and the last digit
                    done["phone"] = stop
                    if 9 <= sum(c in _DIGITS for c in text[at:stop]) <= 15:
                        add("phone", at, stop)
        elif kind == "scheme":
            if m := _LOGIN.match(text, end + 1):
                add("login", m.start(), m.end())
        elif kind in ("secret", "bearer"):
            # cues inside a secret are part of it
            if end >= done["secret"] and (m := (_SECRET if kind == "secret" else _BEARER).match(text, end + 1)):
                done["secret"] = m.end(1)
                add("secret", *m.span(1))
        elif kind == "ssn":
            if m := _SSN.match(text, end + 1):
                add("ssn", *m.span(1))
        elif m := _IBAN.match(text, end + 1):
            found = m.group(1)
            while len(found) > 15 and not _mod97(found.replace(" ", "")):
                found = found.rpartition(" ")[0]  # groups behind it may be other words
            if len(found) >= 15:
                add("iban", m.start(1), m.start(1) + len(found))
    return [(k, *s) for k in KINDS for s in sorted(set(spans[k]))]


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by its kind in brackets; overlapping spans
    are one stretch with the kind of the first."""
    if not text:
        return text
    out, at, stretches = [], 0, []
    for kind, a, b in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if stretches and a < stretches[-1][2]:
            stretches[-1][2] = max(stretches[-1][2], b)
        else:
            stretches.append([kind, a, b])
    for kind, a, b in stretches:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(df: DataFrame, text: str) -> DataFrame:
    """``df`` with n_email, n_ip, n_card, n_phone, base_sha256 and spans (underscores in front where taken).

    Null and empty texts have no spans; repeated rows are searched each; whole texts are read, however long, in time linear in
    them; an empty table gives an empty result.
    """
    names = fresh(df, *[f"n_{k}" for k in BASE], "base_sha256", "spans")

    def run(texts: list[str | None]) -> list[tuple]:
        rows = []
        for t in texts:
            spans = find(t)
            base = written_spans([s for s in spans if s[0] in BASE])
            counts = [sum(s[0] == k for s in spans) for k in BASE]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), written_spans(spans)))
        return list(zip(*rows, strict=True)) or [()] * 6

    kinds = [T.LongType()] * 4 + [T.StringType()] * 2
    return append_columns(df, [text], list(zip(names, kinds, strict=True)), run)


def redacted(df: DataFrame, text: str, size: str | None = None) -> DataFrame:
    """``df`` with its texts redacted, and their length in ``size`` if that column is named.

    Null texts stay null (length 0), empty ones empty; repeated rows change alike; whole texts are read, however long; an empty table
    gives an empty result; all other columns stay, whatever their names."""
    from pyspark.sql import functions as F

    (new,) = fresh(df, "redacted")
    out = append_columns(df, [text], [(new, T.StringType())], lambda texts: [[redact(t) for t in texts]])
    return out.select(*[F.col(new).alias(c) if c == text else F.coalesce(F.char_length(new), F.lit(0)).cast(df.schema[c].dataType).alias(c) if c == size else F.col(c) for c in df.columns])
