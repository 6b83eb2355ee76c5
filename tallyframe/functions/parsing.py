"""Model texts to answers and verdicts, one column expression per rule."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.constants import (
    ANSWER_GROUPS,
    ANSWER_PATTERN,
    EMPTY_LABEL_TEXT,
    NO_ANSWER_MARKERS,
    UNANSWERABLE_TEXT,
    YES_NO_PATTERN,
    YES_NO_STRICT_PATTERN,
)
from tallyframe.functions.text import BLANK, let, split_list, words

# (?d): only a newline ends a line for `.`, as in Python. The look-ahead lets the scan pass
# over all characters no alternative starts with in one step.
_ANSWER = f"(?d)(?=[<(])(?:{ANSWER_PATTERN})"
_YES_NO = "(?U)" + YES_NO_PATTERN.replace(r"\s", BLANK)


def _last_match(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def raw_answer(text: Column) -> Column:
    """Content of the last answer tag, whichever variant it is; NULL without a tag.

    The whole text is scanned once; the groups are then read from the last match alone,
    where exactly one of them takes part.
    """
    return let(
        _last_match(text, _ANSWER, 0),
        lambda tag: F.concat(
            *[F.regexp_extract(tag, _ANSWER, g) for g in range(1, ANSWER_GROUPS + 1)]
        ),
    )


def parse_answer(text: Column) -> Column:
    """Last answer, NULL when it says that there is none."""

    def unless_marked(answer: Column) -> Column:
        marked = F.lit(False)
        for marker in NO_ANSWER_MARKERS:
            marked = marked | F.contains(answer, F.lit(marker))
        return F.when(~marked, answer)

    return let(raw_answer(text), unless_marked)


def is_valid_answer(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(_ANSWER)), F.lit(False))


def parse_yes_no(text: Column) -> Column:
    """Last yes/no tag as ``yes`` or ``no``."""
    return _last_match(text, _YES_NO, 1)


def is_valid_yes_no(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(_YES_NO)), F.lit(False))


def says_yes(parsed: Column) -> Column:
    return F.lower(parsed) == "yes"


def yes_no_equals_label(parsed: Column, label: Column) -> Column:
    """Equality with the label; NULL unless the parsed text is ``yes`` or ``no``."""
    return F.when(parsed.isin("yes", "no"), parsed == label)


def exact_match(prediction: Column, label: Column) -> Column:
    """Do two ``;`` lists hold the same elements the same number of times, in any order?"""
    return F.array_sort(split_list(prediction)) == F.array_sort(split_list(label))


def strict_yes_no(text: Column) -> Column:
    """Boolean of the last tag written without a blank after the hashes."""
    return _last_match(text, YES_NO_STRICT_PATTERN, 1) == "yes"


@dataclass(frozen=True)
class PromptFamily:
    """How outputs of one kind of prompt are checked, parsed and judged.

    ``validate`` and ``parse`` take the output column; ``evaluate`` takes the parsed and
    the label column. Each returns a column, so a family never leaves the JVM unless its
    author passes a pandas UDF.
    """

    validate: Callable[[Column], Column]
    parse: Callable[[Column], Column]
    evaluate: Callable[[Column, Column], Column]
    word_scores: bool = False


FAMILIES: dict[str, PromptFamily] = {
    "yes_no": PromptFamily(is_valid_yes_no, parse_yes_no, lambda p, _label: says_yes(p)),
    "answer": PromptFamily(is_valid_answer, parse_answer, exact_match, word_scores=True),
}


def register_family(name: str, family: PromptFamily) -> None:
    FAMILIES[name] = family


def _by_family(family: Column, pick: Callable[[PromptFamily], Column]) -> Column:
    names = list(FAMILIES)
    out = F.when(family == names[0], pick(FAMILIES[names[0]]))
    for name in names[1:]:
        out = out.when(family == name, pick(FAMILIES[name]))
    return out


def parse_output(family: Column, output: Column) -> Column:
    return _by_family(family, lambda f: f.parse(output))


def is_valid_output(family: Column, output: Column) -> Column:
    return F.coalesce(_by_family(family, lambda f: f.validate(output)), F.lit(False))


def judge(family: Column, parsed: Column, label: Column) -> Column:
    return _by_family(family, lambda f: f.evaluate(parsed, label))


def transform_columns(
    df: DataFrame, columns: list[str], fn: Callable[[Column], Column], suffix: str = "_parsed"
) -> DataFrame:
    """Add ``<column><suffix>`` for each listed column the table has; others are skipped."""
    return df.withColumns({c + suffix: fn(F.col(c)) for c in columns if c in df.columns})


def replace_empty_label(label: Column) -> Column:
    return F.when(label == "", F.lit(EMPTY_LABEL_TEXT)).otherwise(label)


def feature_label(label: Column) -> Column:
    """Label as feature building reads it: a plain text, never empty."""
    filled = F.when(F.coalesce(label, F.lit("")) == "", F.lit(UNANSWERABLE_TEXT)).otherwise(label)
    return F.replace(filled, F.lit(";"), F.lit(" "))


def feature_answer(family: Column, output: Column) -> Column:
    """Parsed output as feature building reads it; a missing output is ``unanswerable``."""
    parsed = F.when(output.isNull(), F.lit(UNANSWERABLE_TEXT)).otherwise(
        parse_output(family, output)
    )
    return F.replace(parsed, F.lit(";"), F.lit(" "))


def word_precision_recall(prediction: Column, label: Column) -> Column:
    """Word-set precision and recall as a struct; both NULL if either text is empty."""

    def scores(pair: Column) -> Column:
        common = F.size(F.array_intersect(pair["p"], pair["l"]))
        part = lambda side: F.coalesce(
            F.try_divide(common.cast("double"), F.size(side).cast("double")), F.lit(0.0)
        )
        return F.struct(part(pair["p"]).alias("precision"), part(pair["l"]).alias("recall"))

    sets = F.struct(
        F.array_distinct(words(F.lower(prediction))).alias("p"),
        F.array_distinct(words(F.lower(label))).alias("l"),
    )
    usable = (F.coalesce(prediction, F.lit("")) != "") & (F.coalesce(label, F.lit("")) != "")
    return F.when(usable, let(sets, scores))


