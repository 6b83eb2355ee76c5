"""Nested question documents to items, and to texts for annotation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.constants import ANSWER_JOINER, RULE_LINE
from tallyframe.functions.text import blank_points

ANSWER_TYPE = "array<struct<answer:string,`from`:int,end:int,para:int>>"


def flatten_questions(
    documents: DataFrame, ordinal: str = "row", questions: str = "questions"
) -> DataFrame:
    """One item per question.

    ``documents`` has an ordinal column, ``index``, ``paras`` and
    ``questions: array<struct<question, answers>>``; other columns are carried along. The
    positions are NULL as a whole when any answer lacks part of its place.
    """
    handled = {ordinal, "paras", questions, "index"}
    others = [c for c in documents.columns if c not in handled]
    answers = F.col("q.answers")
    placed = F.transform(
        answers,
        lambda a: F.struct(
            a["from"].alias("from"), a["end"].alias("end"), a["para"].alias("para"),
            a.alias("target"),
        ),
    )
    incomplete = F.exists(
        answers, lambda a: a["from"].isNull() | a["end"].isNull() | a["para"].isNull()
    )
    return documents.select(
        ordinal, "index", *others,
        F.array_join("paras", "\n").alias("context"),
        F.posexplode(questions).alias("j", "q"),
    ).select(
        F.concat_ws("_", F.col(ordinal).cast("string"), F.col("j").cast("string")).alias("id"),
        "index",
        "context",
        F.col("q.question").alias("question"),
        blank_points(
            F.array_join(F.transform(answers, lambda a: a["answer"]), ANSWER_JOINER)
        ).alias("label"),
        F.when(~incomplete, placed).alias("position_labels"),
        *others,
    )


def parse_question_pairs(pairs: Column) -> Column:
    """``[question, [answers]]`` pairs, read as nested text arrays, to typed structs."""
    return F.transform(
        pairs,
        lambda p: F.struct(
            p[0].alias("question"), F.from_json(p[1], ANSWER_TYPE).alias("answers")
        ),
    )


def annotation_texts(documents: DataFrame, ordinal: str = "row") -> DataFrame:
    """One text per question: paragraphs, a rule line, and the question."""
    return documents.select(
        ordinal, F.array_join("paras", "\n").alias("context"),
        F.posexplode("questions").alias("j", "q"),
    ).select(
        F.concat_ws("_", F.col(ordinal).cast("string"), F.col("j").cast("string")).alias("id"),
        F.concat("context", F.lit("\n" + RULE_LINE + "\n\n\n."), "q.question").alias("text"),
    )
