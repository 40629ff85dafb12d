"""Text expressions. Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscape import constants as c

WORDS = c.WORD_CHAR + "+"
NON_SPACES = c.NON_SPACE_CHAR + "+"
TERMS = c.WORD_CHAR + "{2,}"
PIECES = f"{c.SPACE_CHAR}*(?:{c.WORD_CHAR}{{1,4}}|{c.SYMBOL_CHAR})"

# One tokenizer plug-in: called once per Python worker, returns a function that maps a list of
# texts to one list of (start, end) character offsets per text, special tokens included.
Tokenizer = Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]]


def fill_defaults(value: Column, default: str = "") -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(value, F.lit(default))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def char_count(text: Column) -> Column:
    """Code points in the text."""
    return F.length(text)


def word_count(text: Column) -> Column:
    """Words between whitespace; an empty text has none."""
    return F.regexp_count(text, F.lit(NON_SPACES))


def tokenize_words(text: Column) -> Column:
    """All maximal runs of word characters, in order."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def tokenize_terms(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERMS), F.lit(0))


def squeeze_spaces(text: Column) -> Column:
    """Every run of whitespace becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, c.SPACE_CHAR + "+", " "))


def remove_small_numbers(text: Column) -> Column:
    """Lower-case, then drop the whole words 0 to 99 and squeeze the gaps they leave."""
    whole = f"(?<!{c.WORD_CHAR}){c.SMALL_NUMBER}(?!{c.WORD_CHAR})"
    return squeeze_spaces(F.regexp_replace(F.lower(text), whole, ""))


def small_number_count(text: Column) -> Column:
    """How many whole words 0 to 99 ``remove_small_numbers`` takes out."""
    is_small = lambda token: token.rlike(f"^{c.SMALL_NUMBER}$")
    return F.size(F.filter(tokenize_words(F.lower(text)), is_small))


def keep_unlisted(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Tokens outside a stoplist. ``IN`` over literals is a hash lookup per token."""
    words = sorted(set(stopwords))
    return F.filter(tokens, lambda token: ~token.isin(words)) if words else tokens


def cap_words(text: Column, n: int = c.WORD_CAP) -> Column:
    """The first ``n`` whitespace words, joined by one space."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(NON_SPACES), F.lit(0)), 1, n), " ")


def cap_chars_word_boundary(text: Column, n: int = c.CHAR_CAP) -> Column:
    """At most ``n`` characters, cut back to the last space if there is one."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(head, r"(?s) [^ ]*\z", ""))


def prefix_passage(text: Column, prefix: str = c.PASSAGE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), text)


def pieces(text: Column) -> Column:
    """Default sub-word pieces: up to four word characters or one symbol, each with the
    whitespace before it."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def count_tokens(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    """Sub-word tokens including the two special ones. A plug-in replaces the default rule."""
    if tokenizer is None:
        return F.size(pieces(text)) + F.lit(2)

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()
        for batch in batches:
            yield pd.Series([len(offsets) for offsets in encode(batch.tolist())], dtype="int32")

    return counted(text)


def truncate_tokens(
    text: Column, max_tokens: int = c.TOKEN_CAP, tokenizer: Tokenizer | None = None
) -> Column:
    """Cut a text of more than ``max_tokens`` tokens after the last token that fits.

    Position one is the opening special token, so ``max_tokens - 1`` pieces stay.
    """
    if tokenizer is None:
        kept = F.array_join(F.slice(pieces(text), 1, max_tokens - 1), "")
        return F.when(count_tokens(text) <= max_tokens, text).otherwise(kept)

    @F.pandas_udf("string")
    def truncated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(
                [
                    t if len(spans) <= max_tokens else t[: spans[max_tokens - 1][1]].rstrip()
                    for t, spans in zip(texts, encode(texts))
                ]
            )

    return truncated(text)


def parse_json_line(line: Column, fields: dict[str, str]) -> Column:
    """A struct of ``fields`` (name to SQL type) read from one JSON object.

    Null for a line that is not valid JSON or not an object; a null struct marks it for
    dropping. A missing key and a JSON null are both null fields.
    """
    parsed = F.try_parse_json(line)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    values = [
        F.try_variant_get(parsed, f"$.{name}", kind).alias(name) for name, kind in fields.items()
    ]
    return F.when(is_object, F.struct(*values))
