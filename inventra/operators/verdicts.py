"""Interpretation of classifier responses: salvage of JSON from prose in Arrow batches, everything else by expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_words

DOMAIN_KEYS = ("security", "rgpd", "finance", "legal")
MOST_WORDS = 50
#: Phrases by which a response says that it couldn't read the file.
INACCESSIBLE = ("fichier inaccessible", "inaccessible ou corrompu", "file inaccessible", "cannot access", "impossible d'acceder", "impossible d'accéder", "fichier corrompu")
VERDICT = T.StructType([
    T.StructField("resume", T.StringType()),
    T.StructField("security", T.StructType([T.StructField("classification", T.StringType()), T.StructField("confidence", T.IntegerType()), T.StructField("justification", T.StringType())])),
    T.StructField("rgpd", T.StructType([T.StructField("risk_level", T.StringType()), T.StructField("data_types", T.ArrayType(T.StringType())), T.StructField("confidence", T.IntegerType())])),
    T.StructField("finance", T.StructType([T.StructField("document_type", T.StringType()), T.StructField("amounts", T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("currency", T.StringType()), T.StructField("context", T.StringType())]))), T.StructField("confidence", T.IntegerType())])),
    T.StructField("legal", T.StructType([T.StructField("contract_type", T.StringType()), T.StructField("parties", T.ArrayType(T.StringType())), T.StructField("confidence", T.IntegerType())])),
    T.StructField("parsing_error", T.BooleanType()),
])


#: What a text with broken accents looks like.
CORRUPTED = (r"[a-z]\s+[a-z]\s+[a-z]", r"(?:mais|pour|avec)\s+[a-z]{1,2}\s+")


def valid(found: object) -> bool:
    """An object with at least one domain, each present domain an object."""
    present = [k for k in DOMAIN_KEYS if k in found] if isinstance(found, dict) else []
    return bool(present) and all(isinstance(found[k], dict) for k in present)


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_TOKEN = re.compile(rf"[ \t\n\r]*+(?:({_STRING})|([{{}}\[\],:])|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null|NaN|-?Infinity))")
#: What may follow: a value; a value or the end of a list; a key or the end of an object; a key; a colon; a comma or the end.
_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY, _COLON, _COMMA = range(6)


def _closed(text: str, start: int, known: dict[int, int | None]) -> None:
    """Reads the object that begins at a brace, without recursion, and enters where it and the objects in it end: None for those that don't."""
    stack: list[tuple[str, int]] = []
    state, at = _VALUE, start
    while (token := _TOKEN.match(text, at)) is not None:
        string, sign, at = token[1], token[2], token.end()
        if sign in ("{", "[") and state in (_VALUE, _VALUE_OR_END):
            stack.append((sign, token.start(2)))
            state = _KEY_OR_END if sign == "{" else _VALUE_OR_END
            continue
        if sign == "}" and stack[-1][0] == "{" and state in (_KEY_OR_END, _COMMA) or sign == "]" and stack[-1][0] == "[" and state in (_VALUE_OR_END, _COMMA):
            kind, begin = stack.pop()
            if kind == "{":
                known[begin] = at
            if not stack:
                return
            state = _COMMA
        elif sign == "," and state == _COMMA:
            state = _KEY if stack[-1][0] == "{" else _VALUE
        elif sign == ":" and state == _COLON:
            state = _VALUE
        elif string is not None and state in (_KEY, _KEY_OR_END):
            state = _COLON
        elif not sign and state in (_VALUE, _VALUE_OR_END):
            state = _COMMA
        else:
            break
    for kind, begin in stack:
        if kind == "{":
            known[begin] = None


def objects(text: str) -> Iterator[str]:
    """The objects in a text, from each brace to the one that closes it, minding strings and escapes; none that lies in one before it.

    Each object that was met on the way, closed or not, isn't read again, so the work grows with the text's length, whatever its nesting.
    """
    known: dict[int, int | None] = {}
    at = text.find("{")
    while at >= 0:
        if at not in known:
            _closed(text, at, known)
        end = known.pop(at)
        if end is not None:
            yield text[at:end]
        at = text.find("{", at + 1 if end is None else end)


def salvage(text: str | None) -> str | None:
    """The verdict in a response as JSON text: the whole (if it is JSON, it alone counts), else the first valid object in it; texts of any length and nesting.

    An object nested deeper than the JSON reader goes is no verdict.
    """
    text = (text or "").strip()
    if len(text) < 10:
        return None
    whole = _load(text)
    if whole is not None:
        return json.dumps(whole) if valid(whole) else None
    for found in map(_load, objects(text)):
        if valid(found):
            return json.dumps(found)
    return None


def with_json(rows: DataFrame, content: Column, name: str) -> DataFrame:
    """Adds the verdict's JSON of a text, read once a row: a node of the plan, which isn't copied to where its result is used."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            found = [None if t is None else salvage(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, name, pa.array(found, pa.string()))

    rows = rows.withColumn(name, content)
    return rows.mapInArrow(read, rows.schema)


def mean_confidence(*confidences: Column) -> Column:
    """Whole mean of those above zero; 0 if none is."""
    above = F.filter(F.array(*[F.coalesce(c, F.lit(0)) for c in confidences]), lambda c: c > 0)
    return F.when(F.size(above) > 0, (F.aggregate(above, F.lit(0).cast("long"), lambda x, c: x + c) / F.size(above)).cast("int")).otherwise(0)


def interpret(responses: DataFrame) -> DataFrame:
    """Adds outcome, error, verdict, resume and confidences to rows of (status, content). Where no verdict can be extracted, it is the fallback."""
    done = F.col("status") == "completed"
    content = F.coalesce("content", F.lit(""))
    rows = with_json(responses, F.when(done, content), "_json")
    failed = done & F.col("_json").isNull() & (F.trim(content) != "")
    rows = rows.withColumn("verdict", F.when(failed, fallback(content)).otherwise(F.from_json("_json", VERDICT)))
    said = F.lower(F.coalesce(F.col("verdict.resume"), F.lit("")))
    unreadable = F.lit(False)
    for phrase in INACCESSIBLE:
        unreadable |= said.contains(phrase)
    error = (
        F.when(~done, F.lit(None))
        .when(F.trim(content) == "", "Empty content from API")
        .when(F.col("_json").isNull(), "Failed to extract JSON")
        .when(F.coalesce(F.col("verdict.parsing_error"), F.lit(False)), "LLM parsing error")
        .when(unreadable, "File inaccessible to LLM")
    )
    each = {k: F.coalesce(F.col(f"verdict.{k}.confidence"), F.lit(0)) for k in DOMAIN_KEYS}
    rows = rows.withColumn("error", error).withColumn("outcome", F.when(~done, F.col("status")).when(error.isNotNull(), "error").otherwise("completed"))
    rows = rows.withColumn("resume", first_words(F.coalesce(F.col("verdict.resume"), F.lit("")), MOST_WORDS))
    for k, c in each.items():
        rows = rows.withColumn(f"{k}_confidence", c)
    return rows.withColumn("confidence_global", mean_confidence(*each.values())).drop("_json")


def fallback(content: Column) -> Column:
    """The verdict that stands for a response without one."""
    none = lambda kind, extra: F.struct(F.lit("none").alias(kind), *extra, F.lit(0).alias("confidence"))
    made = F.struct(
        F.substring(F.coalesce(content, F.lit("")), 1, 500).alias("resume"),
        F.struct(F.lit("C0").alias("classification"), F.lit(0).alias("confidence"), F.lit("Parsing failed").alias("justification")).alias("security"),
        none("risk_level", [F.array().cast("array<string>").alias("data_types")]).alias("rgpd"),
        none("document_type", [F.array().cast("array<struct<value:string,currency:string,context:string>>").alias("amounts")]).alias("finance"),
        none("contract_type", [F.array().cast("array<string>").alias("parties")]).alias("legal"),
        F.lit(True).alias("parsing_error"),
    )
    return made.cast(VERDICT)


def quality(raw: Column, status: Column, error: Column) -> tuple[Column, Column]:
    """Status and issues of a raw response; later findings override earlier ones, issues add up."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    corrupted = F.lit(False)
    for pattern in CORRUPTED:
        corrupted |= text.rlike(f"(?i){pattern}")
    truncated = (text != "") & ~text.endswith("}")
    malformed = (status == "error") & F.coalesce(error.contains("Failed to extract JSON"), F.lit(False))
    empty = F.length(text) < 10
    state = F.when(empty, "empty_response").when(malformed, "malformed_json").when(truncated, "truncated").when(corrupted, "corrupted").otherwise("success")
    issues = F.array_compact(F.array(F.when(corrupted, "french_text_corruption"), F.when(truncated, "json_truncation"), F.when(malformed, "json_syntax_error"), F.when(empty, "empty_content")))
    return state, issues


def stored(results: DataFrame) -> DataFrame:
    """Rows as they are stored: domains as JSON, their key verdicts extracted, a global confidence where none is given."""
    keys = {"security_analysis": "classification", "rgpd_analysis": "risk_level", "finance_analysis": "document_type", "legal_analysis": "contract_type"}
    out = results
    for column, key in keys.items():
        out = out.withColumn(f"{column.split('_')[0]}_cached", F.get_json_object(column, f"$.{key}"))
    mean = mean_confidence(*[F.col(f"{k}_confidence") for k in DOMAIN_KEYS])
    given = F.col("confidence_global") if "confidence_global" in results.columns else F.lit(None).cast("int")
    return out.withColumn("confidence_global", F.coalesce(given, mean))
