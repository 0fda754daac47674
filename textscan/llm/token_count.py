"""Token counts with a whole-token shortcut.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each by itself.  Before the job, every
string of the vocabulary is encoded alone: those that come out as one token are proved whole.  A pre-token
that is proved whole counts one; only the others go through the merges, each distinct one once per worker
while it stays in a bounded cache.

The pre-tokens are cut here with the pattern of the tokenizer family.  Texts with characters whose class
might differ between Unicode versions, or with a special string, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh

#: Distinct merged pre-tokens that a worker keeps, some 60 MB.
CACHE = 500_000
#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=100_000)
def stable(char: str) -> bool:
    """Whether all Unicode versions since 3.2 agree on letter, number, space or other."""
    if char in "\t\n\r ":
        return True
    new, old = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    return new == old and new[0] != "Z" and new != "Cn" and not 0x1C <= ord(char) <= 0x1F and char not in "\v\f\x85"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as the one token they name."""
    t = tokenizer(path)
    numbers = sorted(t.get_vocab(with_added_tokens=False).values())
    texts = t.decode_batch([[n] for n in numbers], skip_special_tokens=False)
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    proved = zip(numbers, texts, encode(path, texts), strict=True)
    return frozenset(s for n, s, ids in proved if ids == [n] and s not in special and all(map(stable, s)) and PRE_TOKEN.findall(s) == [s])


class Counter:
    """Counts the tokens of texts; keeps merged pre-tokens between batches."""

    def __init__(self, path: str):
        self.path = path
        self.special = [x.content for x in tokenizer(path).get_added_tokens_decoder().values()]
        self.known = dict.fromkeys(whole_tokens(path), 1)
        self.proved = len(self.known)

    def plain(self, text: str) -> bool:
        return all(map(stable, set(text))) and not any(s in text for s in self.special)

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        if len(self.known) - self.proved > CACHE:
            self.known = dict.fromkeys(whole_tokens(self.path), 1)
        cut = [PRE_TOKEN.findall(t) if t and self.plain(t) else t for t in texts]
        rest = list(set().union(*(x for x in cut if isinstance(x, list))).difference(self.known))
        self.known.update(zip(rest, map(len, encode(self.path, rest)), strict=True))
        whole = [x for x in cut if x and isinstance(x, str)]
        ready = iter(map(len, encode(self.path, whole)))
        return [sum(map(self.known.__getitem__, x)) if isinstance(x, list) else next(ready) if x else 0 for x in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, text: str, path: str, limit: int = 1024) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (underscores in front where taken).

    ``path`` is a tokenizer file that every executor can open.  Null counts as the empty text: 0 bytes, 0
    tokens.  Each row counts by itself, so repeated rows and ids need no rule.  Whole texts are counted, however
    long.  An empty table gives an empty result.
    """
    whole_tokens(path)  # proved here first: a file that doesn't suit fails before the job

    def run(texts: list[str | None]) -> list[list[int]]:
        return [counter(path).counts(texts)]

    n_bytes, n_tokens, over = fresh(df, "n_bytes", "n_tokens", "over_limit")
    counted = append_columns(df, [text], [(n_tokens, T.LongType())], run)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return counted.select(*df.columns, size.alias(n_bytes), n_tokens, (F.col(n_tokens) > limit).alias(over))
