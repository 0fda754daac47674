"""Text normalisation as native Column expressions."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.catalog import is_regex
from textscan.functions.dictionary import dictionary
from textscan.functions.regexes import END_MARK, START_MARK, jvm_replacement, let, to_jvm, word_list

# --- Fixed values: English contractions -----------------------------------------
CONTRACTIONS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have", "could've": "could have",
    "couldn't": "could not", "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not",
    "hasn't": "has not", "haven't": "have not", "he'd": "he would", "he'll": "he will", "he's": "he is",
    "how'd": "how did", "how'll": "how will", "how's": "how is", "i'd": "I would", "i'll": "I will", "i'm": "I am",
    "i've": "I have", "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is", "let's": "let us",
    "might've": "might have", "mightn't": "might not", "must've": "must have", "mustn't": "must not",
    "needn't": "need not", "o'clock": "of the clock", "oughtn't": "ought not", "shan't": "shall not",
    "she'd": "she would", "she'll": "she will", "she's": "she is", "should've": "should have",
    "shouldn't": "should not", "that'd": "that would", "that's": "that is", "there'd": "there would",
    "there's": "there is", "they'd": "they would", "they'll": "they will", "they're": "they are",
    "they've": "they have", "wasn't": "was not", "we'd": "we would", "we'll": "we will", "we're": "we are",
    "we've": "we have", "weren't": "were not", "what'll": "what will", "what're": "what are", "what's": "what is",
    "what've": "what have", "where'd": "where did", "where's": "where is", "who'll": "who will", "who's": "who is",
    "who've": "who have", "why's": "why is", "won't": "will not", "would've": "would have", "wouldn't": "would not",
    "y'all": "you all", "you'd": "you would", "you'll": "you will", "you're": "you are", "you've": "you have",
}
# ------------------------------------------------------------------------------

_WORD_RUN = to_jvm(r"\w+")
_SPACES = to_jvm(r"\s+")
# the characters of \s
_SPACE_CHARACTERS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(_SPACE_CHARACTERS))


def split_words(value: Column) -> Column:
    """Parts between whitespace; no empty parts."""
    return F.filter(F.split(value, _SPACES), lambda w: w != "")


def to_lowercase(value: Column) -> Column:
    return F.lower(value)


def remove_special_chars(value: Column) -> Column:
    """Keep ASCII letters, digits, blanks and ``- . ,``; collapse blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[^\-.,A-Za-z0-9 ]+", ""), " {2,}", " "))


def remove_special_chars_keep_hash(value: Column) -> Column:
    """Keep ASCII letters, digits, blanks and ``- . , #``; blanks stay as they are."""
    return F.regexp_replace(value, r"[^\-.,#A-Za-z0-9 ]+", "")


def default_stopwords() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def remove_stopwords(value: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Drop whitespace-separated words whose lower-case form is listed."""
    listed = list(stopwords) if stopwords is not None else default_stopwords()
    return F.array_join(F.filter(split_words(value), lambda w: ~F.lower(w).isin(listed)), " ")


def remove_numbers(value: Column) -> Column:
    return F.regexp_replace(value, to_jvm(r"\d+"), "")


@cache
def _unaccented() -> tuple[str, str, str]:
    """From the Unicode tables: characters that become one character, what they
    become, and characters that vanish.  (Those that become several are left to
    a Python worker.)"""
    single, becomes, gone = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if len(plain) == 1:
            single.append(c)
            becomes.append(plain)
        elif not plain:
            gone.append(c)
    return "".join(single), "".join(becomes), "".join(gone)


@cache
def _strip_accents() -> Callable[[Column], Column]:
    """A UDF for texts of any characters.  The table of combining marks is made here and travels with it."""
    marks = {cp: None for cp in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(cp))}

    @F.pandas_udf(T.StringType())
    def stripped(values: pd.Series) -> pd.Series:
        return values.map(lambda text: unicodedata.normalize("NFKD", text).translate(marks), na_action="ignore")

    return stripped


@cache
def _beyond_translate() -> str:
    """A regex for one character beyond ASCII that ``translate`` cannot decompose: outside the Latin blocks, or becoming several
    characters.  Characters of ASCII, nearly all of most texts, are dismissed by one comparison."""
    several = "".join(
        chr(cp)
        for cp in range(0x80, 0x250)
        if len([x for x in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(x)]) > 1
    )
    return rf"[^\x00-\x7f](?:(?<=[^\x00-ɏ̀-ͯ])|(?<=[{several}]))"


def remove_accents(value: Column, latin_only: bool = False) -> Column:
    """Compatibility decomposition without combining marks.

    Plain ASCII is returned as it is and Latin text with accents goes through
    ``translate``.  Rows with characters outside these blocks are handed to a
    Python worker, which sees nulls for all others; ``latin_only`` leaves such
    characters alone and keeps Python out of the plan.
    """
    single, becomes, gone = _unaccented()
    narrow = [(s, b) for s, b in zip(single, becomes) if s < "ɐ"]
    source = "".join(s for s, _ in narrow) + "".join(c for c in gone if "̀" <= c <= "ͯ")
    latin = F.translate(value, source, "".join(b for _, b in narrow))
    plain = F.when(value.rlike(r"[^\x00-\x7f]"), latin).otherwise(value)
    if latin_only:
        return plain
    # the worker's result is null for the rows it doesn't get, so the test runs once
    return F.coalesce(_strip_accents()(F.when(value.rlike(_beyond_translate()), value)), plain)


def expand_contractions(value: Column, table: Mapping[str, str] | None = None) -> Column:
    """Spell out contractions; a capital at the start is kept."""
    pairs = {k.lower(): v for k, v in (CONTRACTIONS if table is None else table).items()}
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])

    def expand(part: Column) -> Column:
        found = F.try_element_at(lookup, F.lower(F.replace(part, F.lit("’"), F.lit("'"))))
        first = part.substr(1, 1)
        capital = F.concat(F.upper(found.substr(1, 1)), found.substr(F.lit(2), F.length(found)))
        long = F.when(first == F.upper(first), capital).otherwise(found)
        return F.when(part.rlike("['’]"), F.coalesce(long, part)).otherwise(part)

    parts = F.regexp_extract_all(value, F.lit(to_jvm(r"[\w'’]+|[^\w'’]+")), F.lit(0))
    return F.when(value.rlike("['’]"), F.array_join(F.transform(parts, expand), "")).otherwise(value)


def _comparison_key(word: Column) -> Column:
    """A word without ASCII punctuation at its ends, in lower case."""
    listed = "".join("\\" + c for c in string.punctuation)
    return F.lower(F.regexp_replace(word, rf"^[{listed}]+|[{listed}]+\z", ""))


def remove_duplicates(value: Column) -> Column:
    """Keep the first of words that differ in case and outer punctuation only.
    Sorting by key puts equal words side by side, so the cost is n log n."""
    keyed = F.array_sort(
        F.transform(
            split_words(value),
            lambda w, i: F.struct(_comparison_key(w).alias("key"), i.alias("at"), w.alias("word")),
        )
    )
    firsts = let(
        keyed,
        lambda words: F.filter(
            words, lambda w, i: (i == 0) | (F.get(words, F.when(i > 0, i - 1).otherwise(0))["key"] != w["key"])
        ),
    )
    in_order = F.array_sort(F.transform(firsts, lambda w: F.struct(w["at"], w["word"])))
    return F.array_join(F.transform(in_order, lambda w: w["word"]), " ")


def normalize_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, _SPACES, " "))


def remove(value: Column, pattern: str) -> Column:
    """Remove a regular expression, or a literal if it is not a valid one."""
    if is_regex(pattern):
        return F.regexp_replace(value, F.lit(to_jvm(pattern)), F.lit(""))
    return F.replace(value, F.lit(pattern), F.lit(""))


def replace(value: Column, pattern: str, replacement: str) -> Column:
    r"""Replace a regular expression (``\1`` names a group), or a literal."""
    if is_regex(pattern):
        return F.regexp_replace(value, F.lit(to_jvm(pattern)), F.lit(jvm_replacement(replacement, pattern)))
    return F.replace(value, F.lit(pattern), F.lit(replacement))


def clean_text(value: Column) -> Column:
    return normalize_whitespace(remove_special_chars(value))


def prepare_text(value: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Lower case, special characters, stop words, blanks, contractions — in this
    order.  ``lemmatize`` of the corpus operators is the last step."""
    return expand_contractions(
        normalize_whitespace(remove_stopwords(remove_special_chars(to_lowercase(value)), stopwords))
    )


def break_text(value: Column, words_per_chunk: int) -> Column:
    """Chunks of n words as an array."""
    n = words_per_chunk

    def chunks(words: Column) -> Column:
        last = F.floor((F.size(words) - 1) / n).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * n + 1, F.lit(n)), " "))
        return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(split_words(value), chunks)


def render_prompt(value: Column, prompt: str, args: Column | str = "[]", arg_prompts: str = "") -> Column:
    """The text that would be sent to a language model for one object."""
    args = F.lit(args) if isinstance(args, str) else args
    return F.concat(F.lit(f"{prompt}\n\nObject: "), value, F.lit("\nArgs: "), args, F.lit(f"\n{arg_prompts}"))


# --- Tokens -----------------------------------------------------------------------


def tokenize_words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(_WORD_RUN), F.lit(0))


def tokenize_sentences(value: Column) -> Column:
    """Cut after ``. ! ?`` and whitespace; a trailing cut leaves an empty part."""
    return F.split(value, r"(?<=[.!?])" + _SPACES.removeprefix("(?d)"), -1)


def ngrams(tokens: Column, n: int = 2) -> Column:
    """All runs of n tokens as array<array<string>>."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, F.lit(n))),
        ).otherwise(F.array().cast("array<array<string>>")),
    )


def statistics(value: Column) -> Column:
    """struct of word_count, unique_words, sentence_count, avg_word_length and
    avg_sentence_length; punctuation is removed before words are counted."""

    def of(text: Column) -> Column:
        cleaned = F.regexp_replace(text, to_jvm(r"[^\w\s]"), "")

        def with_counts(words: Column, sentences: Column) -> Column:
            count = F.size(words)
            letters = F.length(F.array_join(words, ""))
            return F.struct(
                count.alias("word_count"),
                F.size(F.array_distinct(words)).alias("unique_words"),
                sentences.alias("sentence_count"),
                F.when(count > 0, letters / count).otherwise(F.lit(0.0)).alias("avg_word_length"),
                # sentences are cut at whitespace, so their words add up to all words; the text has no outer whitespace
                F.when(sentences > 0, F.size(F.split(text, _SPACES)) / sentences)
                .otherwise(F.lit(0.0))
                .alias("avg_sentence_length"),
            )

        sentences = F.when(text == "", 0).otherwise(F.size(tokenize_sentences(text)))
        return let(tokenize_words(cleaned), lambda words: let(sentences, lambda n: with_counts(words, n)))

    return F.when(value.isNotNull(), let(strip(value), of))


def correct_and_analyze(value: Column, corrections: Mapping[str, str]) -> Column:
    """Table-driven correction of words, with the statistics of the result."""
    return let(
        correct_words(value, corrections),
        lambda text: F.struct(text.alias("text"), statistics(text).alias("statistics")),
    )


#: As many words are looked for by one alternation; in a text's words one by one beyond that.
_MOST_LISTED = 1000


def correct_words(value: Column, corrections: Mapping[str, str]) -> Column:
    """Replace whole words by a table (exact case first, then lower case).

    Of a short table of ASCII words, one pass marks the words that are in it in any case, and only these are looked up."""
    if 0 < len(corrections) <= _MOST_LISTED and all(re.fullmatch(r"[A-Za-z0-9_]+", w) for w in corrections):
        marks = f"[{START_MARK}{END_MARK}]"
        return F.when(value.rlike(marks), _correct_each(value, corrections)).otherwise(_correct_listed(value, corrections))
    return _correct_each(value, corrections)


def _correct_listed(value: Column, corrections: Mapping[str, str]) -> Column:
    value_of = dictionary(corrections)
    listed = F.regexp_replace(value, F.lit(word_list(list(corrections))), F.lit(f"{START_MARK}$0{END_MARK}"))

    def corrected(piece: Column) -> Column:
        # <listed word><end mark><text up to the next one>; the first piece has no mark
        replaced = let(
            F.substring_index(piece, END_MARK, 1),
            lambda w: F.concat(F.coalesce(value_of(w), value_of(F.lower(w)), w), piece.substr(F.length(w) + 2, F.length(piece))),
        )
        return F.when(F.contains(piece, F.lit(END_MARK)), replaced).otherwise(piece)

    return strip(F.array_join(F.transform(F.split(listed, START_MARK), corrected), ""))


def _correct_each(value: Column, corrections: Mapping[str, str]) -> Column:
    value_of = dictionary(corrections)
    parts = F.regexp_extract_all(value, F.lit(to_jvm(r"\w+|[^\w]+")), F.lit(0))
    return strip(
        F.array_join(
            F.transform(
                parts, lambda p: F.coalesce(value_of(p), value_of(F.lower(p)), p)
            ),
            "",
        )
    )


# --- Paths --------------------------------------------------------------------------


def is_valid_path_pattern(value: Column) -> Column:
    return value.rlike(to_jvm(r"\A(?:(^\.?[/]|^[a-zA-Z]:[/]|^[/])[^:*?\"<>|\r\n]+)"))


def guess_os_from_path(value: Column) -> Column:
    """A drive letter means Windows; a leading slash or tilde means Unix."""
    return (
        F.when(value.rlike(r"\A[a-zA-Z]:\\"), "Windows").when(value.rlike(r"\A[/~]"), "Unix").otherwise("Unknown")
    )


def is_absolute_path(value: Column) -> Column:
    return value.startswith("/")


def normalize_path(value: Column) -> Column:
    """POSIX path without ``.``, empty parts and resolvable ``..``; exactly two
    leading slashes stay."""

    def step(done: Column, part: Column) -> Column:
        unresolvable = (F.size(done) == 0) | (F.element_at(done, -1) == "..")
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & value.startswith("/") & (F.size(done) == 0), done)
            .when((part == "..") & ~unresolvable, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(value, "/"), F.array().cast("array<string>"), step)
    root = F.when(value.rlike(r"\A//(?!/)"), "//").when(value.startswith("/"), "/").otherwise("")
    path = F.concat(root, F.array_join(parts, "/"))
    return F.when(value.isNotNull(), F.when(path == "", ".").otherwise(path))


#: Named normalisers of one text column.
NORMALIZATIONS = {
    "to_lowercase": to_lowercase,
    "remove_special_chars": remove_special_chars,
    "remove_stopwords": remove_stopwords,
    "remove_numbers": remove_numbers,
    "remove_accents": remove_accents,
    "expand_contractions": expand_contractions,
    "remove_duplicates": remove_duplicates,
    "normalize_whitespace": normalize_whitespace,
    "remove": remove,
    "replace": replace,
    "clean_text": clean_text,
    "prepare_text": prepare_text,
}
