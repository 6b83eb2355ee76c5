"""Models, prompts and templates as small driver-made tables."""

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.prompts import MessageTemplate


@dataclass(frozen=True)
class Model:
    name: str
    groups: tuple[str, ...]


@dataclass(frozen=True)
class Prompt:
    name: str
    groups: tuple[str, ...]
    family: str


@dataclass(frozen=True)
class PromptRecord(Prompt):
    """A prompt as one unit: its messages in order, and the names of the steps its items go through
    before they are rendered."""

    templates: tuple[MessageTemplate, ...] = ()
    preprocessing: tuple[str, ...] = ()


RECORDS = (
    "name string, groups array<string>, family string, preprocessing array<string>, "
    "templates array<struct<role:string,content:string,variables:map<string,string>>>"
)


def prompt_records_table(spark: SparkSession, records: Iterable[PromptRecord]) -> DataFrame:
    """One row per prompt; templates keep their order, fixed texts have NULL variables."""
    rows = [
        (
            r.name, list(r.groups), r.family, list(r.preprocessing),
            [(t.role, t.content, None if t.variables is None else dict(t.variables)) for t in r.templates],
        )
        for r in records
    ]
    return spark.createDataFrame(rows, RECORDS)


def prompt_records(table: DataFrame) -> dict[str, PromptRecord]:
    """Prompts of such a table by name; they are configuration, read once on the driver."""
    found: dict[str, PromptRecord] = {}
    for row in table.select("name", "groups", "family", "preprocessing", "templates").collect():
        if row.name in found:
            raise ValueError(f"prompt {row.name} is stored twice")
        found[row.name] = PromptRecord(
            row.name, tuple(row.groups), row.family,
            tuple(MessageTemplate(t.role, t.content, t.variables) for t in row.templates),
            tuple(row.preprocessing),
        )
    return found


def registry_table(spark: SparkSession, members: Iterable[Model | Prompt]) -> DataFrame:
    rows = [(m.name, list(m.groups), getattr(m, "family", None)) for m in members]
    return spark.createDataFrame(rows, "name string, groups array<string>, family string")


def members_of(registry: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Names in any of the groups, each once."""
    return registry.where(F.arrays_overlap("groups", F.lit(list(groups)))).select(
        "name", "family"
    ).distinct()


def names_in(members: Iterable[Model | Prompt], groups: Sequence[str]) -> list[str]:
    """The same lookup on the registry objects, sorted, for building plans."""
    names = sorted({m.name for m in members if set(m.groups) & set(groups)})
    if not names:
        raise ValueError(f"no member in groups {list(groups)}")
    return names


def family_of(prompts: Iterable[Prompt], prompt: Column) -> Column:
    """Family of a prompt name as an expression; NULL for a prompt not listed.

    The registry is configuration, so it becomes part of the plan instead of a joined table.
    """
    families: dict[str, list[str]] = {}
    for p in prompts:
        families.setdefault(p.family, []).append(p.name)
    out = F.lit(None).cast("string")
    for family, names in families.items():
        out = F.when(prompt.isin(*names), family).otherwise(out)
    return out


def prompts_table(spark: SparkSession, prompts: Iterable[Prompt]) -> DataFrame:
    return spark.createDataFrame(
        [(p.name, p.family) for p in prompts], "prompt string, family string"
    )


def load_templates(
    spark: SparkSession, files: Sequence[tuple[str, str, Mapping[str, str] | None]]
) -> list[MessageTemplate]:
    """Ordered templates from ``(path, role, variables)``; each file is one message.

    Templates are configuration: a fixed list of short files, read once on the driver.
    """
    texts = {
        row["path"]: row["value"]
        for row in spark.read.text([path for path, _, _ in files], wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .collect()
    }

    def plain(path: str) -> str:
        return "/" + re.sub(r"^\w+:", "", path).lstrip("/")

    def text_of(path: str) -> str:
        return texts[min((k for k in texts if plain(k).endswith(plain(path))), key=len)]

    return [MessageTemplate(role, text_of(path), names) for path, role, names in files]


def templates_table(spark: SparkSession, templates: Mapping[str, Sequence[MessageTemplate]]) -> DataFrame:
    """``(prompt, seq, role, content, variables)`` of every prompt's templates."""
    rows = [
        (prompt, seq, t.role, t.content, dict(t.variables) if t.variables else None)
        for prompt, messages in templates.items()
        for seq, t in enumerate(messages)
    ]
    return spark.createDataFrame(
        rows, "prompt string, seq int, role string, content string, variables map<string,string>"
    )
