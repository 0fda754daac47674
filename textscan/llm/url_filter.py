"""URL filter: pattern rules indexed by their rarest literal token.

Two kinds of rules.  A host rule (``net/es/``) fits a host and its subdomains if the path starts with
the rule's; among host rules the longest wins.  A pattern rule (``/login^``, ``*`` for any text, ``^`` for
a separator or the end, ``|`` at either end as an anchor) is tried on URLs that no host rule fits: an allow
pattern that matches wins, then a block pattern, else the URL is allowed.

Each rule is filed under one literal token (letters and digits between separators) that any URL it fits
must hold, the one that is rarest in the URLs at hand.  A URL's tokens fetch the candidate rules, and only
those run their regular expression.  Rules without such a token are candidates of every URL.

Rules are a list of the caller and travel with the tasks; ``MAX_RULES`` states the bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh, lower_ascii

#: A list of this many rules takes some 50 MB in a worker; a longer one is refused.
MAX_RULES = 200_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Whole tokens: host labels, and path parts that end within the rule."""
        text = f".{self.host}{self.path}".translate(_LOWER)
        return [m.group() for m in _TOKEN.finditer(text) if m.end() < len(text)]


@dataclass(frozen=True)
class PatternRule:
    action: str
    pattern: str

    def regex(self) -> str:
        body, start, end = self.pattern, "", ""
        if body.startswith("|"):
            body, start = body[1:], r"\A"
        if body.endswith("|"):
            body, end = body[:-1], r"\Z"
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        return start + "".join(parts.get(c) or re.escape(c) for c in body) + end

    def tokens(self) -> list[str]:
        """Tokens with a separator of the pattern on both sides."""
        text = self.pattern.translate(_LOWER)
        inner = lambda i: 0 <= i < len(text) and text[i] != "*"
        return [m.group() for m in _TOKEN.finditer(text) if inner(m.start() - 1) and inner(m.end())]


Rule = HostRule | PatternRule


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class RuleIndex:
    """Rules filed under their rarest token; ``counts`` says how many URLs hold each."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex(), re.DOTALL))
            tokens = rule.tokens()
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, url: str) -> Iterable[tuple[Rule, re.Pattern]]:
        yield from self.always
        for token in set(_TOKEN.findall(url.translate(_LOWER))):
            yield from self.by_token.get(token, ())

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """(host, path, host rule, verdict, pattern)."""
        host, path = split_url(url)
        best: HostRule | None = None
        matched: list[PatternRule] = []
        for rule, regex in self.candidates(url or ""):
            if isinstance(rule, HostRule):
                if (best is None or (len(str(rule)), str(rule)) > (len(str(best)), str(best))) and regex.match(host + path):
                    best = rule
            elif regex.search(url or ""):
                matched.append(rule)
        if best:
            return host, path, str(best), best.action, None
        if matched:
            first = min(matched, key=lambda r: (r.action != "allow", r.pattern))
            return host, path, None, first.action, first.pattern
        return host, path, None, "allow", None


def token_counts(df: DataFrame, url: str, tokens: Iterable[str]) -> dict[str, int]:
    """How many URLs hold each of the given tokens; one row per token comes back."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(url)), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = df.select(F.explode(F.array_intersect(found, F.lit(wanted))).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def url_verdicts(df: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict`` and ``pattern`` (the names get underscores
    in front where ``df`` has them already).

    A null URL and one without ``://`` has an empty host and path; no host rule fits it, a null URL fits
    only patterns that match the empty text.  Equal rules count once; repeated rows are judged alike; a URL
    of any length is read whole; an empty table gives an empty result.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel with the tasks")
    rules = list(dict.fromkeys(rules))
    index = RuleIndex(rules, token_counts(df, url, (t for r in rules for t in r.tokens())))

    def judge(urls: list[str | None]) -> list[tuple]:
        return list(zip(*map(index.judge, urls), strict=True)) or [()] * 5

    names = fresh(df, "host", "path", "rule", "verdict", "pattern")
    return append_columns(df, [url], [(n, T.StringType()) for n in names], judge)


#: DuckDB SQL for the query.
SQL = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*', '') ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url,
    translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM split),
rules(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
  SELECT t.*, (SELECT max_by(action || ' ' || h || p, length(h || p)) FROM rules WHERE (t.host = h OR suffix(t.host, '.' || h)) AND starts_with(t.path, p)) AS best
  FROM parts t),
patterns(rank, action, pattern, regex) AS (
  VALUES (1, 'allow', '^ref=canonical^', '[^A-Za-z0-9_.%-]ref=canonical([^A-Za-z0-9_.%-]|$)'),
    (2, 'block', '/cart^', '/cart([^A-Za-z0-9_.%-]|$)'), (3, 'block', '/login^', '/login([^A-Za-z0-9_.%-]|$)'), (4, 'block', '/wp-admin/', '/wp-admin/'),
    (5, 'block', '^phpsessid=', '[^A-Za-z0-9_.%-]phpsessid='), (6, 'block', '^ref=', '[^A-Za-z0-9_.%-]ref='), (7, 'block', '^sid=', '[^A-Za-z0-9_.%-]sid=')),
judged AS (
  SELECT r.*, CASE WHEN best IS NULL THEN (SELECT min_by(action || ' ' || pattern, rank) FROM patterns WHERE regexp_matches(r.url, regex)) END AS found FROM ruled r)
SELECT page_id, host, path, split_part(best, ' ', 2) AS rule, coalesce(split_part(best, ' ', 1), split_part(found, ' ', 1), 'allow') AS verdict,
  split_part(found, ' ', 2) AS pattern
FROM judged
"""
