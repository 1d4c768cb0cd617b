"""Text and number formatting as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura.fixed_values import PUNCTUATION


def fill(template: str, **parts: Column) -> Column:
    """Concatenate a ``{name}`` template with string columns."""
    pieces = [
        parts[piece[1:-1]] if piece.startswith("{") else F.lit(piece)
        for piece in re.split(r"(\{\w+\})", template)
        if piece
    ]
    return F.concat(*pieces)


def number(x: Column, decimals: int = 0) -> Column:
    """``1234.5`` -> ``1,234.50``; rounds half to even."""
    return F.format_number(x.cast("double"), decimals)


def plain_number(x: Column, decimals: int = 0) -> Column:
    """Like :func:`number` without the thousands separator."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def count(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def percent(x: Column, decimals: int = 0) -> Column:
    return F.concat(plain_number(x * 100, decimals), F.lit("%"))


def strip_markdown(x: Column) -> Column:
    """Drop ``**bold**`` and ``*italic*`` markers."""
    return F.regexp_replace(F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1")


def latin1_safe(x: Column) -> Column:
    """Replace typographic punctuation by plain characters."""
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    x = F.translate(x, "".join(single), "".join(single.values()))
    for mark, plain in PUNCTUATION.items():
        if mark not in single:
            x = F.replace(x, F.lit(mark), F.lit(plain))
    return x
