"""Look-up of words in a table that travels with the plan: no join, no shuffle, the same cost for any number of words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textscan.functions.regexes import let

#: Bytes of words and values that a plan may carry.
MOST_BYTES = 16 << 20

# Own format: one string per bucket, with every word between the first two signs and its value behind it.
_BEGIN, _MIDDLE, _END, _BUCKET = "\x01", "\x02", "\x03", "\x04"
_SIGNS = str.maketrans("", "", _BEGIN + _MIDDLE + _END + _BUCKET)


def size_of(pairs: Mapping[str, str]) -> int:
    return sum(len(w.encode()) + len(v.encode()) for w, v in pairs.items())


def dictionary(pairs: Mapping[str, str]) -> Callable[[Column], Column]:
    """A function of a Column of words that gives their values, and null for words that are not in ``pairs``.

    The words lie in hash buckets of about one word, in a constant array of strings.  Words and values must not
    hold the control characters U+0001 to U+0004."""
    if size_of(pairs) > MOST_BYTES:
        raise ValueError(f"the dictionary has more than {MOST_BYTES} bytes")
    for word, value in pairs.items():
        if word.translate(_SIGNS) != word or value.translate(_SIGNS) != value:
            raise ValueError(f"control characters in {word!r}: {value!r}")
    buckets = [""] * max(1, len(pairs))
    for word, value in pairs.items():
        buckets[zlib.crc32(word.encode()) % len(buckets)] += f"{_BEGIN}{word}{_MIDDLE}{value}{_END}"
    constant = F.split(F.lit(_BUCKET.join(buckets)), _BUCKET)

    def value_of(word: Column) -> Column:
        bucket = F.get(constant, (F.crc32(word.cast("binary")) % len(buckets)).cast("int"))
        entry = F.concat(F.lit(_BEGIN), word, F.lit(_MIDDLE))
        plain = F.translate(word, _BEGIN + _MIDDLE + _END + _BUCKET, "") == word
        # what stands behind the entry, up to the end sign; nothing if the bucket has no such entry
        rest = let(bucket, lambda b: F.when(F.contains(b, entry), F.substr(b, F.position(entry, b) + F.length(entry))))
        return F.when(plain, F.substring_index(rest, _END, 1))

    return value_of
