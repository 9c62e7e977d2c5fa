"""Prompt rendering and clean-up as column expressions over arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT_PREFIX = f"{START}assistant\n<think>\n\n</think>\n\n"
STOPS = (END, "<|endoftext|>")
ROLES = ("system", "user", "assistant")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def format_contexts(contexts: Column) -> Column:
    return F.array_join(F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def user_content(question: Column, contexts: Column) -> Column:
    """The question alone, or after its numbered entries."""
    q = F.trim(question)
    opened = F.concat(F.lit("Knowledge base entries:\n"), format_contexts(contexts), F.lit("\n\nQuestion: "), q)
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, opened).otherwise(q)


def build_messages(system: Column, history: Column, question: Column, contexts: Column) -> Column:
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), history, F.array(F.struct(F.lit("user").alias("role"), user_content(question, contexts).alias("content"))))


def message_fault(messages: Column) -> Column:
    """Why messages can't be rendered; null if they can."""
    last = F.try_element_at(messages, F.lit(-1))
    late_system = F.exists(F.slice(messages, F.lit(2), F.greatest(F.size(messages), F.lit(1))), lambda m: m["role"] == "system")
    return (
        F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, "no message")
        .when(~F.coalesce(last["role"] == "user", F.lit(False)), "the last message must be a user message")
        .when(F.exists(messages, lambda m: ~m["role"].isin(*ROLES)), "unsupported role")
        .when(late_system, "the system message must come first")
    )


def render_prompt(messages: Column, strict: bool = True) -> Column:
    """Chat mark-up up to where the answer begins. Bad messages raise, or are null if not strict."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")
    fault = message_fault(messages)
    bad = F.raise_error(fault) if strict else F.lit(None).cast("string")
    return F.when(fault.isNotNull(), bad).otherwise(F.concat(turns, F.lit(ASSISTANT_PREFIX)))


def completion_text(answer: Column) -> Column:
    return F.concat(F.btrim(answer, F.lit(" \t\r\n")), F.lit(END))


def clean_generation(text: Column) -> Column:
    """What stands before a stop string and after a reasoning block."""
    t = text
    for stop in STOPS:
        t = F.substring_index(t, stop, 1)
    t = F.when(F.contains(t, F.lit("</think>")), F.split(t, "</think>", 2)[1]).otherwise(t)
    return F.btrim(F.replace(t, F.lit("<think>"), F.lit("")), F.lit(" \t\r\n"))


def history_window(history: Column, pairs: int = 2) -> Column:
    """The last pairs of turns."""
    n = 2 * pairs
    return F.when(F.size(history) > n, F.slice(history, F.lit(-n), F.lit(n))).otherwise(history)


def history_fault(question: Column, history: Column) -> Column:
    """Why a chat request is invalid; null if it is not: sizes, blanks and strict user-assistant turns."""
    n = F.coalesce(F.size(history), F.lit(0))
    blank = lambda x: F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n")) == ""
    order = F.transform(history, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return (
        F.when(blank(question), "blank message")
        .when(F.length(question) > 4000, "message too long")
        .when(n > 20, "history too long")
        .when(n % 2 != 0, "history is not made of pairs")
        .when(~F.forall(order, lambda ok: ok), "history does not alternate")
        .when(F.exists(history, lambda m: blank(m["content"]) | (F.length(m["content"]) > 8000)), "bad history text")
    )
