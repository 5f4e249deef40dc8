"""Prompts built from file metadata, and their sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import human_size

SYSTEM = "Classify the document in four domains and answer with one JSON object only."
_LABELS = (("name", "Name"), ("file_size", "Size"), ("owner", "Owner"), ("last_modified", "Modified"), ("file_signature", "Signature"))


def build(system: str = SYSTEM) -> Column:
    """System text and a line for each known field; what is missing is empty."""
    values = {"file_size": human_size(F.coalesce("file_size", F.lit(0)), "")}
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(values.get(c, F.col(c)), F.lit(""))) for c, label in _LABELS]
    return F.concat_ws("\n", F.lit(system), *lines)


def size(prompt: Column) -> Column:
    """Bytes as UTF-8."""
    return F.octet_length(F.coalesce(prompt, F.lit("")))


def colour(n: Column, settings: Settings = Settings()) -> Column:
    return F.when(n < settings.prompt_green, "green").when(n <= settings.prompt_red, "orange").otherwise("red")


def within(n: Column, settings: Settings = Settings()) -> Column:
    return n <= settings.prompt_limit
