"""Requests as JSON lines, and the limits of one request file."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.schemas import (
    DEFAULT_MAX_TOKENS,
    DEFAULT_MODEL,
    DEFAULT_USER_PREFIX,
    GRAMMAR_TYPES,
    MAX_FILE_BYTES,
    MAX_REQUESTS,
)

DEFAULT_SYSTEM_MESSAGE = (
    "You are a dictionary. For every word you are given, list its English translations, "
    "grouped by the part of speech the word can have. Leave out parts of speech that do not "
    "apply. Keep the order and the spelling of the words."
)


def word_list_schema() -> dict:
    """JSON schema of the answer: word entries with an optional list per grammar label."""
    strings = {"type": "array", "items": {"type": "string"}}
    entry = {
        "type": "object",
        "properties": {
            "word": {"type": "string"},
            "translations": {
                "type": "object",
                "properties": {label: strings for label in GRAMMAR_TYPES},
                "additionalProperties": False,
            },
        },
        "required": ["word", "translations"],
        "additionalProperties": False,
    }
    return {
        "type": "object",
        "properties": {"response": {"type": "array", "items": entry}},
        "required": ["response"],
        "additionalProperties": False,
    }


def response_format(schema: Mapping, name: str = "response") -> dict:
    return {
        "type": "json_schema",
        "json_schema": {"name": name, "strict": True, "schema": dict(schema)},
    }


def build_requests(
    packed: DataFrame,
    mode: str = "plain",
    user_prefix: str = DEFAULT_USER_PREFIX,
    system_message: str = DEFAULT_SYSTEM_MESSAGE,
    model: str = DEFAULT_MODEL,
    max_tokens: float = DEFAULT_MAX_TOKENS,
    answer_schema: Mapping | None = None,
    answer_name: str = "response",
) -> DataFrame:
    """Add ``custom_id``, ``user_message`` and the JSON ``line`` to packed requests.

    ``plain`` counts the ids from 1 and joins the words by a comma and a space. ``structured``
    counts from 0, joins by a space and adds the schema of the answer.
    """
    if mode not in ("plain", "structured"):
        raise ValueError(f"mode must be 'plain' or 'structured', got {mode!r}")
    plain = mode == "plain"
    number = F.col("request_id") + (1 if plain else 0)
    joined = F.array_join("words", ", " if plain else " ")
    named = packed.select(
        "*",
        F.concat(F.lit("request-"), number.cast("string")).alias("custom_id"),
        F.concat(F.lit(user_prefix), joined).alias("user_message"),
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    body = F.struct(
        F.lit(model).alias("model"),
        F.array(
            message("system", F.lit(system_message)), message("user", F.col("user_message"))
        ).alias("messages"),
        F.lit(int(max_tokens)).cast("bigint").alias("max_tokens"),
    )
    line = F.to_json(
        F.struct(
            "custom_id",
            F.lit("POST").alias("method"),
            F.lit("/v1/chat/completions").alias("url"),
            body.alias("body"),
        )
    )
    if not plain:
        # The same text for every line, put in before the braces that close body and request.
        wanted = response_format(answer_schema or word_list_schema(), answer_name)
        text = json.dumps(wanted, ensure_ascii=False, separators=(",", ":"))
        line = F.concat(
            F.substr(line, F.lit(1), F.length(line) - 2), F.lit(f',"response_format":{text}}}}}')
        )
    return named.withColumn("line", line)


def batch_sizes(
    lines: DataFrame, by: Sequence[str] = ("batch_id",), line: str = "line"
) -> DataFrame:
    """Lines and UTF-8 bytes, line ends included, per batch."""
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum((F.octet_length(line) + 1).cast("bigint")).alias("n_bytes"),
    )


def oversized_batches(
    lines: DataFrame,
    by: Sequence[str] = ("batch_id",),
    line: str = "line",
    max_lines: int = MAX_REQUESTS,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """The batches beyond a limit, with their sizes."""
    return batch_sizes(lines, by, line).filter(
        (F.col("n_lines") > max_lines) | (F.col("n_bytes") > max_bytes)
    )
