"""Text templates, token helpers and log-line parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt formats of the model family.
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
DEFAULT_LANG = "(ko)"
PAIR_SEPARATOR = " [SEP] "

WHITESPACE = "[ \\n\\t\\r]+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lang(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def format_query(text: Column | str, lang: Column | str = DEFAULT_LANG) -> Column:
    """`query: (ko) text`; `lang` is a tag or a column of tags."""
    return F.concat(F.lit(QUERY_PREFIX), _lang(lang), F.lit(" "), _column(text))


def format_passage(text: Column | str, lang: Column | str = DEFAULT_LANG) -> Column:
    """`passage: (ko) text`; `lang` is a tag or a column of tags."""
    return F.concat(F.lit(PASSAGE_PREFIX), _lang(lang), F.lit(" "), _column(text))


def pair_text(query: Column | str, passage: Column | str) -> Column:
    """One string for a formatted query and passage."""
    return F.concat(_column(query), F.lit(PAIR_SEPARATOR), _column(passage))


def tokens(text: Column | str) -> Column:
    """Whitespace tokens, empty ones removed."""
    return F.array_remove(F.split(_column(text), WHITESPACE), "")


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased whitespace tokens."""
    return F.array_distinct(tokens(F.lower(_column(text))))


def clip_tokens(text: Column | str, max_tokens: int) -> Column:
    """STRUCT(text, n_tokens, was_clipped): the text cut to a model's input length."""
    words = tokens(text)
    return F.struct(
        F.array_join(F.slice(words, 1, max_tokens), " ").alias("text"),
        F.size(words).cast("bigint").alias("n_tokens"),
        (F.size(words) > max_tokens).alias("was_clipped"),
    )


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def contains_any(text: Column, patterns: tuple[str, ...], case_sensitive: bool) -> Column:
    """True if the line holds one of the patterns; a missing line holds none."""
    hay = text if case_sensitive else F.lower(text)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | hay.contains(pattern if case_sensitive else pattern.lower())
    return F.coalesce(hit, F.lit(False))


def _number(text: Column, pattern: str, group: int, kind: str) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast(kind))


def parse_progress(line: Column | str) -> dict[str, Column]:
    """Epoch, epoch count, training loss and percent found in a progress line."""
    line = _column(line)
    return {
        "epoch": _number(line, r"\[Epoch ([0-9]+)/([0-9]+)\]", 1, "bigint"),
        "n_epochs": _number(line, r"\[Epoch ([0-9]+)/([0-9]+)\]", 2, "bigint"),
        "train_loss": _number(line, r"\[Train\] Loss: ([0-9]+[.]?[0-9]*)", 1, "double"),
        "percent": _number(line, r"Training: *([0-9]+)%", 1, "bigint"),
        "is_progress": line.contains("Training:"),
    }
