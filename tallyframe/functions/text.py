"""Text helpers that follow Python's blank rules, as JVM column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.constants import PYTHON_BLANKS, REPETITION_SHARE

# The same characters as PYTHON_BLANKS, in the form Java matches fastest.
BLANK = r"[\s\x1c-\x1f]"
BLANK_RUN = f"(?U){BLANK}+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a larger expression."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PYTHON_BLANKS))


def words(text: Column) -> Column:
    """Blank-separated words in order, without empty ones."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def split_list(text: Column, separator: str = ";") -> Column:
    """Elements of a separated list, stripped; an empty text gives one empty element."""
    return F.transform(F.split(text, separator, -1), strip)


def split_csv(text: Column) -> Column:
    """Comma list; an empty text gives an empty array and NULL stays NULL."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split_list(text, ","))


def is_repetitive(text: Column) -> Column:
    """True when fewer than 30 % of the words are distinct; an empty text is not repetitive."""
    return let(
        words(text), lambda w: F.size(F.array_distinct(w)) < F.lit(REPETITION_SHARE) * F.size(w)
    )


def blank_points(text: Column) -> Column:
    """Remove the blank before a full stop."""
    return F.replace(text, F.lit(" ."), F.lit("."))
