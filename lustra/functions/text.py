"""Text expressions. All of them are native Spark functions and stay in codegen."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.isspace() accepts. Spark's plain trim() removes U+0020 only.
WHITESPACE = "".join(chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace())


# Visible ASCII: a text that begins and ends inside this range has nothing to strip.
VISIBLE = (33, 126)


def trim_text(column: Column | str) -> Column:
    """Strip Unicode whitespace from both ends; null stays null."""
    return F.btrim(_col(column), F.lit(WHITESPACE))


def finish_trim(plain: Column) -> Column:
    """Strip the other whitespace characters from a text that went through a plain trim.

    Comparing each end with all whitespace characters costs some twenty times a plain trim,
    so it is left to the texts that do not begin and end in visible ASCII.
    """
    ends = (F.ascii(plain), F.ascii(F.substring(plain, -1, 1)))
    clean = ends[0].between(*VISIBLE) & ends[1].between(*VISIBLE)
    return F.when(clean, plain).otherwise(trim_text(plain))


def standardize(column: Column | str) -> Column:
    """Trim and lower-case; null stays null."""
    return F.lower(trim_text(column))


def _col(column: Column | str) -> Column:
    return quoted(column) if isinstance(column, str) else column


def quoted(name: str) -> Column:
    """Column reference that also works for names with dots or backticks in them."""
    return F.col("`" + name.replace("`", "``") + "`")
