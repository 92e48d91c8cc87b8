"""Column expressions over texts and words. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript regular expressions and trim(). Java's \s is the
# ASCII part of it; this is the rest, as the body of a Java character class.
OTHER_WHITE = (
    r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WHITE = r"\s" + OTHER_WHITE

# The patterns below start with a line end or a cheap test of the character at hand, so that
# most characters are passed over at once, and use no group that repeats.
_MARK = "\u0001"


def has_ink(text: Column) -> Column:
    """True when the text holds anything but white space."""
    return F.rlike(text, F.lit(f"[^{WHITE}]"))


def plain_white(text: Column) -> Column:
    """White space beyond ASCII as blanks, which changes none of the rules here; ASCII texts are passed over."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(F.regexp_replace(text, rf"(?![\x00-\x7F])[{OTHER_WHITE}]", " "))


def clean_subtitle(text: Column) -> Column:
    """The words of a subtitle text, separated by white space.

    A line goes when it holds ``-->`` or when the line before it is all digits; then tags,
    blank lines, and all characters but letters, marks, white space and hyphens go. Lines end
    at ``\\n`` only: with CRLF a number line ends in ``\\r`` and is not all digits.
    """
    text = F.replace(plain_white(text), F.lit(_MARK), F.lit("\u0002"))
    text = F.concat(F.lit("\n"), text)
    # Mark the end of number lines, then take away what follows a mark, up to the next one.
    text = F.regexp_replace(text, r"\n([0-9]++)(?=\n)", "\n$1" + _MARK)
    text = F.regexp_replace(text, rf"{_MARK}\n[^\n{_MARK}]*+", "")
    text = F.regexp_replace(text, r"\n[^\n]*?-->[^\n]*+", "")
    # A "<" without ">" takes the rest of its line along and puts it back, so that a line is read twice at most.
    text = F.regexp_replace(text, r"<[^>\n]*+>|(<[^>\n]*+)", "$1")
    text = F.regexp_replace(text, r"\n[ \t\x0B\f\r]*+(?=\n|\z)", "")
    return _word_characters(F.substr(text, F.lit(2)))


def keep_word_characters(text: Column) -> Column:
    """Delete all characters but letters, marks, white space (as plain_white) and hyphens."""
    return _word_characters(plain_white(text))


def _word_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z\p{L}\p{M}\s\-]++", "")


def split_words(cleaned: Column) -> Column:
    """Split a cleaned text at white space; white space at an edge gives an empty word there."""
    return F.split(cleaned, r"\s+")


def distinct_lower_words(cleaned: Column) -> Column:
    """The distinct lower-case words of a cleaned text, first seen first, without empty ones."""
    return F.array_remove(F.array_distinct(split_words(F.lower(cleaned))), "")


def capitalise(word: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def strip_white(text: Column) -> Column:
    """Remove tabs, line ends, form feeds and spaces, as set-aside lines are kept."""
    return F.regexp_replace(text, r"[\n\t\r\x0B\f ]", "")
