"""One question to a question for each of its domains, as a table function.

What splits a question is a reply in JSON, from a model or a rule; the function
reads it, drops what it may not say, and completes what it left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FENCED = re.compile(r"```json\s*(.*?)\s*```", re.DOTALL)
DEFAULT_DOMAIN = "startup_funding"
SCHEMA = StructType().add("domain", "string").add("sub_query", "string").add("source", "string")


def sub_queries(question: str, domains: list[str], reply: str | None) -> list[tuple[str, str, str]]:
    """(domain, question, where it is from): ``single``, ``reply``, ``completed`` (left out by the reply) or ``fallback`` (no reply of use)."""
    if len(domains) < 2:
        return [(domains[0] if domains else DEFAULT_DOMAIN, question, "single")]
    body = FENCED.search(reply or "")
    try:
        given = json.loads(body[1] if body else reply or "")["sub_queries"]
        said = [(x["domain"], x["query"], "reply") for x in given if x.get("domain") in domains and x.get("query")]
    except (ValueError, TypeError, KeyError, AttributeError):
        said = []
    left = set(domains) - {domain for domain, _, _ in said}
    return said + [(d, question, "completed" if said else "fallback") for d in domains if d in left]


class Decompose:
    """sub_queries as a Python table function of (question, domains, reply)."""

    @staticmethod
    def analyze(question: AnalyzeArgument, domains: AnalyzeArgument, reply: AnalyzeArgument) -> AnalyzeResult:
        for name, argument, kind in (("question", question, StringType), ("domains", domains, ArrayType), ("reply", reply, StringType)):
            if not isinstance(argument.dataType, kind):
                raise ValueError(f"{name} must be {kind.__name__}, not {argument.dataType.simpleString()}")
        return AnalyzeResult(SCHEMA)

    def eval(self, question: str | None, domains: list[str] | None, reply: str | None) -> Iterator[tuple[str, str, str]]:
        yield from sub_queries(question or "", [d for d in domains or [] if d], reply)


def register(spark: SparkSession, name: str = "decompose") -> str:
    """Make the function known to SQL: ``FROM questions q, LATERAL decompose(q.question, q.domains, q.reply)``."""
    spark.udtf.register(name, udtf(Decompose))
    return name
