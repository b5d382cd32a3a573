"""Text expressions: bracketed lists in replies, tokens, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a list of quoted names, as Python and JSON write it.
# Possessive, so that the length of a name costs no stack.
NAME = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
# Fixed value: a sentence keeps its end marks and the blanks after them, so the
# sentences of a text add up to the text.
SENTENCE = r"[^.!?]*[.!?]+[ \t\r\n]*|[^.!?]+"
BLANKS = r"[ \t\r\n]+"


def last_bracket_slice(text: Column) -> Column:
    """From the last `[` to the last `]`; '' when they are in the wrong order, null
    when one is missing."""
    start = F.length(text) - F.length(F.substring_index(text, "[", -1))
    end = F.length(text) - F.length(F.substring_index(text, "]", -1))
    both = F.contains(text, F.lit("[")) & F.contains(text, F.lit("]"))
    inside = F.when(start < end, F.substring(text, start, end - start + 1)).otherwise("")
    return F.when(both, inside)


def parse_name_list(text: Column) -> Column:
    """Names of a well-formed list of quoted strings; null for anything else.

    Names are found one after the other, and what is left of the list once each is an empty
    name is compared as text, so that the number of names costs no stack."""
    quoted = F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1))
    names = F.transform(
        quoted,
        lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"),
    )
    left = F.regexp_replace(F.regexp_replace(text, F.lit(NAME), F.lit("''")), r"\s+", "")
    after_first = F.replace(F.substring(left, F.lit(4), F.length(left)), F.lit(",''"), F.lit(""))
    several = left.startswith("[''") & ~left.contains(",,") & after_first.isin("]", ",]")
    framed = text.startswith("[") & text.endswith("]")
    return F.when(framed & ((left == "[]") | several), names)


def tokens(text: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(1))
