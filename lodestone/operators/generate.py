"""Prompts and the extractive answer that needs no model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How templates name variables and roles.
VARIABLE = re.compile(r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}")
ROLE = re.compile(r"^---\s*(system|user|assistant)\s*---\s*$", re.M | re.I)
ABSTENTION = "I could not find an answer in the sources."


def sections(template: str) -> list[tuple[str, str]]:
    """(role, text) of a prompt template; text before any role is the user's; empty sections go."""
    parts = ROLE.split(template)
    pairs = [("user", parts[0]), *zip(parts[1::2], parts[2::2])]
    return [(role.lower(), text.strip()) for role, text in pairs if text.strip()]


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with each variable replaced once; values are not searched for variables."""
    if missing := sorted(set(VARIABLE.findall(template)) - set(values)):
        raise KeyError(f"the template needs {missing[0]!r}")
    parts = VARIABLE.split(template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if n % 2 else F.lit(p) for n, p in enumerate(parts)])


def extractive(passage: Column, key: Column, question: Column) -> Column:
    """The first sentence of at least five words, cut at 300 characters and cited; else a digest of the question."""
    sentences = F.filter(F.split(passage, r"(?<=[.!?])\s+"), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 5)
    first = F.get(sentences, F.lit(0))
    digest = F.concat(F.lit("fake answer "), F.substring(F.sha2(question.cast("binary"), 256), 1, 16))
    return F.coalesce(F.concat(F.substring(first, 1, 300), F.lit(" ["), key, F.lit("]")), digest)


def answered(context_items: Column, passage: Column, key: Column, question: Column, policy: str = "abstain") -> Column:
    """The answer, or what the policy says for a question without passages."""
    if policy not in ("abstain", "escalate", "answer_without_context", "raise"):
        raise ValueError(f"unknown policy {policy!r}")
    without = {"abstain": F.lit(ABSTENTION), "escalate": F.lit(ABSTENTION), "answer_without_context": extractive(F.lit(None).cast("string"), key, question), "raise": F.raise_error(F.lit("no context"))}[policy]
    return F.when(context_items > 0, extractive(passage, key, question)).otherwise(without)


def fate(context_items: Column, policy: str = "abstain") -> Column:
    """Why a question without passages was not answered: abstained, or escalated to whom the caller names; null for others."""
    reason = {"abstain": "abstained", "escalate": "escalated"}.get(policy)
    return F.when(F.coalesce(context_items, F.lit(0)) == 0, F.lit(reason).cast("string"))
