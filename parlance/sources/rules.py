"""Wordlist files -> rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.moderation import rule_table
from .corpus import read_corpus


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; the line's position is its ``rule_id`` (rule order
    decides which rule a flag reports). Returns (rule_id, line, kind, pattern)."""
    lines = read_corpus(spark, path, "text", text="line", key="rule_id")
    return rule_table(lines)
