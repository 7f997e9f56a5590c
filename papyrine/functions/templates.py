"""Prompts of conversations in the layouts of several model families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("llama3", "mistral", "chatml", "default")


def render(messages: Column, style: str) -> Column:
    """One prompt of an array of (role, content); after a last user message it asks for the assistant's.

    ``messages`` should be a column, as an expression would be worked out for every message.
    """
    lit = F.lit

    def each(x: Column, i: Column) -> Column:
        role, said = x["role"], x["content"]
        if style == "llama3":
            return F.concat(lit("<|start_header_id|>"), role, lit("<|end_header_id|>\n\n"), said, lit("<|eot_id|>"))
        if style == "chatml":
            return F.concat(lit("<|im_start|>"), role, lit("\n"), said, lit("<|im_end|>\n"))
        if style == "default":
            return F.concat(F.initcap(role), lit(": "), said, lit("\n\n"))
        after_system = (i > 0) & (F.get(messages, i - 1)["role"] == "system")
        opened = F.when(after_system, F.concat(said, lit(" [/INST]"))).otherwise(F.concat(lit("[INST] "), said, lit(" [/INST]")))
        return F.when(role == "system", F.concat(lit("[INST] "), said, lit("\n\n"))).when(role == "user", opened).when(role == "assistant", F.concat(lit(" "), said, lit("</s>"))).otherwise("")

    body = F.array_join(F.transform(messages, each), "")
    asks = F.try_element_at(messages, lit(-1))["role"] == "user"
    if style == "llama3":
        return F.concat(lit("<|begin_of_text|>"), body, F.when(asks, "<|start_header_id|>assistant<|end_header_id|>\n\n").otherwise(""))
    if style == "chatml":
        return F.concat(body, F.when(asks, "<|im_start|>assistant\n").otherwise(""))
    if style == "default":
        return F.concat(F.regexp_replace(body, r"^\s+|\s+$", ""), F.when(asks, "\n\nAssistant: ").otherwise(""))
    if style == "mistral":
        return F.concat(lit("<s>"), body)
    raise ValueError(f"unknown style {style!r}; known: {', '.join(STYLES)}")


def context_of(documents: Column) -> Column:
    """Documents as one context."""
    return F.array_join(F.filter(documents, lambda x: x.isNotNull()), "\n\n")


def user_message(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def first_with_id(metadata: Column) -> Column:
    """The first of several metadata structs that has an id."""
    return F.get(F.filter(metadata, lambda x: x["id"].isNotNull()), F.lit(0))


def known_id(*candidates: Column) -> Column:
    """The first id given."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in candidates])
