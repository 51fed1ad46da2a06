"""Question and answer items out of Markdown files, by the layout of their sections.

A layout names the heading that opens an item and how its fields are found.
Fields may span lines. A file is one row while it is cut; items travel as rows
from there on, so the work follows the number of files and items.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import stripped

END = r"\z"


def until(label: str, *ends: str) -> str:
    """What stands behind ``label``, over lines, up to the nearest of ``ends``."""
    return rf"(?s){label}(.+?)(?={'|'.join(ends)})"


def line(label: str) -> str:
    """What stands behind ``label`` on its line."""
    return rf"(?d){label}(.+)"


@dataclass(frozen=True)
class Layout:
    """``heading`` starts an item's first line; the first of a field's patterns that matches gives it (group 1)."""

    heading: str
    ident: str
    fields: dict[str, Sequence[str]]
    defaults: dict[str, str] = field(default_factory=dict)
    required: Sequence[str] = ()
    last_wins: bool = True


# The labels and marks of four layouts.
NAMED = Layout(
    heading=r"### QA-\d{3,}$",
    ident=r"^### (QA-\d+)",
    fields={
        "type": [r"- Type: `(\w+)`"],
        "domains": [r"- Domains: `([^`]+)`"],
        "persona_id": [r"- Persona: `(P\d+)`\s*\([^)]+\)"],
        "persona": [r"- Persona: `P\d+`\s*\(([^)]+)\)"],
        "question": [until(r"\*\*Question\*\*\n", r"\n\*\*Answer\*\*")],
        "answer": [until(r"\*\*Answer\*\*\n", r"\n\*\*Evidence\*\*")],
        "evidence": [until(r"\*\*Evidence\*\*\n", END)],
    },
    defaults={"type": "unknown"},
)
NUMBERED = Layout(
    heading=r"#### Q\d+\.\s+.",
    ident=r"^#### (Q\d+)\.",
    fields={
        "title": [r"(?d)^#### Q\d+\.\s+(.+?)\s*\[P\d+[^\]\n]*\]", r"(?d)^(#### Q\d+\.\s+.+)"],
        "persona_id": [r"(?d)^####.*?\[(P\d+)\s+[^\]\n]+\]"],
        "persona": [r"(?d)^####.*?\[P\d+\s+([^\]\n]+)\]"],
        "question": [until(r"\*\*질문\*\*:\s*", r"\n\*\*기대 답변\*\*")],
        "answer": [until(r"\*\*기대 답변\*\*:\s*", r"\n\*\*검증 포인트\*\*")],
        "verification": [until(r"\*\*검증 포인트\*\*:\s*", r"\n\*\*참조 데이터\*\*")],
        "reference": [until(r"\*\*참조 데이터\*\*:\s*", r"\n---", END)],
    },
)
GRADED = Layout(
    heading=r"### Q\d+\.\s+.",
    ident=r"^### (Q\d+)\.",
    fields={
        "difficulty": [r"(?d)^###.*?\[(Easy|Medium|Hard|N/A)\]"],
        "persona": [r"(?d)^###.*?\[페르소나\s*([ABC])[:\s]*[^\]\n]*\]"],
        "domains": [r"\*\*도메인\*\*:\s*`([^`]+)`", line(r"\*\*도메인\*\*:\s*")],
        "source_type": [r"\*\*소스 유형\*\*:\s*`?([^`\n]+)`?"],
        "question": [until(r"\*\*질문\*\*:\s*", r"\n\*\*도메인\*\*", r"\n\*\*기대 답변\*\*")],
        "answer": [until(r"\*\*기대 답변\*\*:\s*\n", r"\n---\n\*\*\[답변 근거\]"), until(r"\*\*기대 답변\*\*:\s*\n", "---")],
        "basis": [r"(?s)(---\n\*\*\[답변 근거\]\*\*.+)"],
        "evidence": [until(r"\*\*Evidence\*\*:\s*\n", END)],
    },
    defaults={"difficulty": "Medium"},
)
EVALUATION = Layout(
    heading=r"### [UVWX]-\d+\.",
    ident=r"^### ([UVWX]-\d+)\.",
    fields={
        "domain": [line(r"- \*\*도메인\*\*: ")],
        "difficulty": [line(r"- \*\*난이도\*\*: ")],
        "question": [until(r"\*\*질문\*\*: ", r"\n\n\*\*기대 답변\*\*:")],
        "ground_truth": [until(r"\*\*기대 답변\*\*:\n+", r"\n---\n\*\*\[", r"\n\n\*\*검증 포인트\*\*")],
    },
    required=("domain", "question", "ground_truth"),
    last_wins=False,
)


def _first(section: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, stripped; null if none does."""
    return stripped(F.coalesce(*[F.when(section.rlike(p), F.regexp_extract(section, p, 1)) for p in patterns]))


def items(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """id and the layout's fields, one row an item.

    A field that is not there has its default, else an empty text; an item
    without a required field is no row. Of items of one file with one id the
    last stays, where the layout says so. An empty file has no items.
    """
    opens = rf"(?md)^{layout.heading}"
    parts = F.filter(F.split("value", rf"(?md)(?=^{layout.heading})"), lambda x: x.rlike(opens))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("__file"), F.posexplode(parts).alias("__seq", "__section"))
    rows = rows.withColumn("id", F.regexp_extract("__section", layout.ident, 1))
    if layout.last_wins:
        rows = rows.groupBy("__file", "id").agg(F.max_by("__section", "__seq").alias("__section"))
    found = rows.select("id", *[_first(F.col("__section"), tries).alias(name) for name, tries in layout.fields.items()])
    for name in layout.required:
        found = found.filter(F.col(name).isNotNull())
    return found.select("id", *[F.coalesce(name, F.lit(layout.defaults.get(name, ""))).alias(name) for name in layout.fields])


def named_items(spark: SparkSession, path: str) -> DataFrame:
    return items(spark, path, NAMED)


def numbered_items(spark: SparkSession, path: str) -> DataFrame:
    """The title without dashes at its ends; without a persona it is the whole heading."""
    return items(spark, path, NUMBERED).withColumn("title", F.regexp_replace("title", "^[ —-]+|[ —-]+$", ""))


def graded_items(spark: SparkSession, path: str) -> DataFrame:
    """Questions without their quotation marks."""
    return items(spark, path, GRADED).withColumn("question", stripped(F.regexp_replace("question", r"(?md)^>\s*", "")))


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Ids with three digits at least."""
    rows = items(spark, path, EVALUATION)
    number = F.split("id", "-").getItem(1).cast("long")
    return rows.withColumn("id", F.format_string("%s-%03d", F.substring("id", 1, 1), number))
