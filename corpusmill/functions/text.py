"""Prompt and completion text rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def space_separated(prompt: Column, completion: Column) -> tuple[Column, Column]:
    """Prompts without trailing spaces, and completions with exactly one leading space unless they are empty. Only spaces count."""
    return F.rtrim(prompt), F.when(completion == "", completion).otherwise(F.concat(F.lit(" "), F.ltrim(completion)))


def affixed(prompt: Column, prefix: str = "", postfix: str = "") -> Column:
    """Prefix and postfix around every prompt that isn't empty."""
    return F.when(prompt == "", prompt).otherwise(F.concat(F.lit(prefix), prompt, F.lit(postfix)))
