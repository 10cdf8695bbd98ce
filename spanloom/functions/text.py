"""Tokens, previews and Markdown fences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# The patterns that define tokens, white space and line ends.
# --------------------------------------------------------------------------
WORD = r"[A-Za-z][A-Za-z0-9_]*|\p{Nd}+"
CAMEL = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|_|$)|[A-Z]?[a-z]+|[0-9]+"
# A word of one piece only, so that splitting it would add nothing.
SINGLE_PIECE = r"^(?:[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+)$"
# The same rules over words set apart by single spaces.
COMPOUND = r"(?<= )(?!(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+) )[A-Za-z0-9_]+(?= )"
PLURAL = r"(?<= )([a-z][a-z0-9_]{2,}[a-rt-z0-9_])s(?= )"
LONG_CONFIG = r"(?<= )(?:configuration|configured)(?= )"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"
# All others, the most frequent range first: a negated class tries each of its parts on every character.
NOT_LINE_END = r"[\x1f-\x{84}\x{86}-\x{2027}\x{202a}-\x{10ffff}\x00-\x09\x0e-\x1b]"
IDENTIFIER = r"_|[a-z][A-Z]"


def _empty() -> Column:
    return F.array().cast("array<string>")


def words(text: Column) -> Column:
    """Maximal identifier-like or digit runs, in text order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-cased words with their derived forms, in text order, duplicates kept.

    Each word is followed by "config" for its two long forms, by a naive
    singular, and by its snake_case and CamelCase pieces.
    """

    def forms(word: Column) -> Column:
        low = F.lower(word)
        plural = (F.length(low) > 4) & low.endswith("s") & ~low.endswith("ss")
        pieces = F.transform(
            F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0)), lambda p: F.lower(p)
        )
        return F.concat(
            F.array(low),
            F.when(low.isin("configuration", "configured"), F.array(F.lit("config"))).otherwise(_empty()),
            F.when(plural, F.array(F.left(low, F.length(low) - 1))).otherwise(_empty()),
            F.when(word.rlike(SINGLE_PIECE), _empty()).otherwise(F.filter(pieces, lambda p: p != low)),
        )

    return F.flatten(F.transform(words(text), forms))


def spaced_words(text: Column) -> Column:
    """The words of a text set apart by single spaces, one before the first and one after the last."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def token_bag(text: Column) -> Column:
    """The same tokens as `tokenize` in no particular order.

    For whole documents, where only counts matter: the forms of all words are
    taken by a few passes over one string, and only words of several pieces are
    looked at one by one.
    """
    return bag_of(spaced_words(text), F.lower(spaced_words(text)))


def bag_of(spaced: Column, lowered: Column) -> Column:
    """`token_bag` of words set apart by spaces (`spaced_words`), as they are and lower-cased.

    Both are used several times: given as columns they are computed once.
    """
    compounds = F.regexp_extract_all(spaced, F.lit(COMPOUND), F.lit(0))
    pieces = F.transform(
        compounds,
        lambda word: F.filter(
            F.transform(F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0)), lambda p: F.lower(p)),
            lambda p: p != F.lower(word),
        ),
    )
    # Most texts do not hold the long forms, and a plain search is cheap.
    configured = F.when(lowered.contains(" configur"), F.regexp_count(lowered, F.lit(LONG_CONFIG))).otherwise(0)
    return F.concat(
        F.array_remove(F.split(lowered, " "), ""),
        F.regexp_extract_all(lowered, F.lit(PLURAL), F.lit(1)),
        F.array_repeat(F.lit("config"), configured),
        F.flatten(pieces),
    )


def canonical(text: Column) -> Column:
    """Lower-cased ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def searchable_text(
    content: Column, symbol: Column, path: Column, role: Column, repository: Column,
    section_title: Column, context_json: Column, null_symbol_word: bool = True,
) -> Column:
    """The text a chunk is indexed under: content, labels and its parent context."""
    word = F.lit("None") if null_symbol_word else F.lit("")
    return F.concat_ws(
        "\n",
        F.coalesce(content, F.lit("None")),
        F.coalesce(symbol, word),
        F.coalesce(path, F.lit("None")),
        F.coalesce(role, F.lit("None")),
        F.coalesce(repository, F.lit("None")),
        F.coalesce(section_title, F.lit("")),
        F.coalesce(context_json, F.lit("{}")),
    )


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def preview(text: Column, limit: int = 220) -> Column:
    """One line of at most `limit` characters, with an ellipsis when cut."""
    flat = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))
    )


def lines(text: Column) -> Column:
    """Lines with their terminators kept; an unterminated last line counts."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_LINE_END}++{LINE_END}?+|{LINE_END}"), F.lit(0))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Newlines, plus one for an unterminated last line."""
    open_tail = (text != "") & ~text.endswith("\n")
    return newline_count(text) + F.when(open_tail, 1).otherwise(0)


def longest_backtick_run(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(0))


def _fence(width: Column) -> Column:
    return F.repeat(F.lit("`"), width)


def fenced(text: Column) -> Column:
    """A fenced text block whose fence is longer than any run inside it."""
    value = F.coalesce(text, F.lit(""))
    fence = _fence(F.greatest(F.lit(3), longest_backtick_run(value) + 1))
    return F.concat(fence, F.lit("text\n"), value, F.lit("\n"), fence)


def inline_code(text: Column) -> Column:
    value = or_not_recorded(text)
    fence = _fence(longest_backtick_run(value) + 1)
    return F.concat(fence, value, fence)


def or_not_recorded(text: Column) -> Column:
    return F.coalesce(F.when(text != "", text), F.lit("Not recorded"))


def balanced_markdown(text: Column) -> Column:
    """The text itself, or the text in an outer fence when a fence stays open."""
    value = or_not_recorded(text)
    marks = F.regexp_extract_all(value, F.lit("(?m)^\\s*(`{3,})"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(marks, lambda m: F.length(m))), F.lit(0))
    fence = _fence(F.greatest(F.lit(4), longest + 1))
    wrapped = F.concat(fence, F.lit("text\n"), value, F.lit("\n"), fence)
    return F.when(F.size(marks) % 2 == 0, value).otherwise(wrapped)


def safe_tester_id(value: Column, default: str) -> Column:
    """A directory-safe identifier of at most 64 characters."""
    runs = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), "[^A-Za-z0-9_-]+", "_")
    kept = F.left(F.regexp_replace(runs, "^[_-]+|[_-]+$", ""), F.lit(64))
    return F.when(kept != "", kept).otherwise(F.lit(default))


def fingerprint(text: Column) -> Column:
    """First 12 hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(12))


def utc_stamp(ts: Column) -> Column:
    """ISO-8601 with a trailing Z, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def batch_suffix(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def session_name(ts: Column, token: Column) -> Column:
    """`session_<date>_<time>_<six hex digits>`."""
    return F.concat(F.lit("session_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), token)
