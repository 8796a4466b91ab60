"""Rendering records to one text per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import shown_value


def render_fields(df: DataFrame, columns: Sequence[str] | None = None, out: str = "text", keys=()) -> DataFrame:
    """Name, value and the word ``end`` on a line each, for every column in order."""
    columns = list(columns or df.columns)
    parts = []
    for name in columns:
        parts += [F.lit(f"{name}\n"), shown_value(F.col(name), df.schema[name].dataType), F.lit("\nend\n")]
    return df.select(*keys, F.concat(*parts).alias(out))


def render_pair(df: DataFrame, first: str, second: str, out: str = "text", keys=()) -> DataFrame:
    """Two strings with a line break between them; a null counts as empty."""
    text = F.concat(F.coalesce(first, F.lit("")), F.lit("\n"), F.coalesce(second, F.lit("")))
    return df.select(*keys, text.alias(out))


def _message(role: Column, content: Column) -> Column:
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in (role, content)]
    return F.concat(F.lit("["), shown[0], F.lit("]\n"), shown[1], F.lit("\n[SEP]\n"))


def render_messages(df: DataFrame, messages: str = "messages", out: str = "text", keys=()) -> DataFrame:
    """One text per record whose ``messages`` column holds structs of role and content."""
    rendered = F.transform(messages, lambda m: _message(m["role"], m["content"]))
    return df.select(*keys, F.array_join(rendered, "").alias(out))


def _turns(df: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    # A conversation is one output value, so its turns have to meet; nothing larger than that is collected.
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    return df.groupBy(conversation).agg(F.array_sort(F.collect_list(entry)).alias("_turns"))


def render_chat(
    df: DataFrame, conversation="conv_id", turn="turn", role="role", content="text", out: str = "text"
) -> DataFrame:
    """One text per conversation from a table with one row per turn."""
    grouped = _turns(df, conversation, turn, role, content)
    rendered = F.transform("_turns", lambda m: _message(m["role"], m["content"]))
    return grouped.select(conversation, F.array_join(rendered, "").alias(out))


def render_prompt(
    df: DataFrame, conversation="conv_id", turn="turn", role="role", content="text", out: str = "text"
) -> DataFrame:
    """All turns but the last as in :func:`render_chat`, then the open header of the last turn's role."""
    grouped = _turns(df, conversation, turn, role, content)
    earlier = F.slice("_turns", 1, F.size("_turns") - 1)
    rendered = F.transform(earlier, lambda m: _message(m["role"], m["content"]))
    header = F.coalesce(F.element_at("_turns", -1)["role"].cast("string"), F.lit("None"))
    return grouped.select(
        conversation, F.concat(F.array_join(rendered, ""), F.lit("["), header, F.lit("]\n")).alias(out)
    )
