"""String functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_class(chars: str) -> str:
    return "[" + "".join(re.escape(c) if c not in "\t\n" else {"\t": "\\t", "\n": "\\n"}[c] for c in chars) + "]+"


def tokens(text: Column, separators: str = " \t") -> Column:
    """Words between runs of the separator characters; empty ones are dropped. Null text has no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), char_class(separators)), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, byte by byte as C does; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find_next(text: Column, what: str, start: int = 0) -> Column:
    """0-based position of the next `what` at or after start, -1 if there is none."""
    return F.locate(what, text, start + 1) - 1


def find_last(text: Column, char: str) -> Column:
    """0-based position of the last `char`, -1 if there is none."""
    found = F.locate(char, F.reverse(text))
    return F.when(found == 0, F.lit(-1)).otherwise(F.length(text) - found)


def leading_int(text: Column) -> Column:
    """The integer that a text starts with, as C's string conversions read it; an error where there is none."""
    whole = F.when(F.translate(text, "0123456789+-", "") == "", text.try_cast("long"))
    found = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(whole, F.when(found == "", F.raise_error(F.concat(F.lit("no number: "), text))).otherwise(found).cast("long"))


def leading_double(text: Column) -> Column:
    """The number that a text starts with; an error where there is none. Texts that are a plain number as a whole skip the pattern."""
    whole = F.when(F.translate(text, "0123456789.+-eE", "") == "", text.try_cast("double"))
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(whole, F.when(found == "", F.raise_error(F.concat(F.lit("no number: "), text))).otherwise(found).cast("double"))


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")
