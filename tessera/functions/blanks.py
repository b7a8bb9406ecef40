"""White space and line ends beyond ASCII: what counts as blank in texts of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that are white space, and those that end a line.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "

#: A class of all white space, for patterns here and in SQL alike.
SPACE = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in SPACES) + "]"


def strip(text: Column) -> Column:
    """The text without white space at its ends; null stays null."""
    return F.btrim(text, F.lit(SPACES))


def sql_strip(text: str) -> str:
    """The same in SQL."""
    return f"trim({text}, {' || '.join(f'chr({ord(c)})' for c in SPACES)})"


def lines(text: Column) -> Column:
    """The lines of a text, however they end; a line end at the end begins no line."""
    ends = "".join(rf"\x{{{ord(c):x}}}" for c in LINE_ENDS)
    found = F.split(text, rf"\x{{d}}\x{{a}}|[{ends}]")
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)
