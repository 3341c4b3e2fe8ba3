"""Text expressions shared by catalogue, browsing, labels and charts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (SQL trim only removes blanks)."""
    return F.btrim(text, F.lit(WHITESPACE))


def contains_text(text: Column, word: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` have no special meaning."""
    return F.lower(text.cast("string")).contains(F.lit(word.lower()))


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def code_label(code: Column, choices: dict[str, str]) -> Column:
    """Display label of a code; a code outside the list is shown as it is."""
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(choices.items())])
    return F.coalesce(F.try_element_at(labels, code), code)


def json_text(text: Column) -> Column:
    """``text`` as a JSON string literal, non-ASCII characters left as they are."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
