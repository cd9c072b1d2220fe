"""Column helpers shared by the operators that use built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def occurrences(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` match the one-character class ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lowered(text: Column) -> Column:
    """``text`` with A-Z as a-z and nothing else changed; texts of ASCII alone take the short way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lowered_bytes(text: Column) -> Column:
    """Stands for ``lowered(text)`` where texts are only compared: two texts share it just if they share that one.

    Beyond ASCII the bytes of the text are read as Latin-1, so that lowering changes first bytes of characters
    (C3 to E3), but how many bytes follow still tells them apart. White space is the same in both.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(plain, text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1")))
