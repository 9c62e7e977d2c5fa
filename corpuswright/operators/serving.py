"""A batch of chat requests: safety routes, retrieval, prompts, generated answers, their guard and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, safety, scoring
from ..shared import cut
from . import retrieval

NO_CITATIONS = "cast(array() as array<struct<card_id:string,source:string,text:string,score:double>>)"


def search_queries(requests: DataFrame) -> DataFrame:
    """(query_id, query): the message with the last user message before it."""
    asked = F.filter("history", lambda m: m["role"] == "user")
    return requests.select(F.col("id").alias("query_id"), F.concat_ws(" ", "message", F.try_element_at(asked, F.lit(-1))["content"]).alias("query"))


def entries(requests: DataFrame, cards: DataFrame, k: int = 3) -> DataFrame:
    """(id, hits): the k best cards (card_id, source, text, score) of requests whose best one reaches the gate, joined by id."""
    hits = retrieval.gated(retrieval.search(cards, search_queries(requests), k))
    joined = hits.join(cards.select("card_id", "source", "text"), "card_id")
    return joined.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "card_id", "source", "text", "score"))), lambda h: F.struct(h["card_id"].cast("string").alias("card_id"), h["source"].alias("source"), h["text"].alias("text"), h["score"].alias("score"))).alias("hits"))


def card(cards: DataFrame, card_id: object) -> DataFrame:
    return cards.where(F.col("card_id") == card_id)


def chat(requests: DataFrame, cards: DataFrame, system: str, instead: dict[str, str], generate: Callable[[DataFrame], DataFrame], pairs: int = 2) -> DataFrame:
    """(id, answer, mode, outcome, warning, citations) of requests (id, message, history).

    Unsafe requests get the answer ``instead`` has for their route (urgent, self_harm, dose) and are never searched or
    generated. ``generate`` adds ``answer`` to (id, prompt); an empty one raises. Answers that state a dose are replaced; cards that
    score near enough to the best are cited.
    """
    # as the element of an array, the route is made once a row; the table, once for the refusals, the search and the prompts
    routed = cut(requests.select("*", F.explode(F.array(safety.route(F.col("message")))).alias("route")), "routed")
    known = F.create_map(*(F.lit(x) for kv in instead.items() for x in kv))
    outcome = F.when(F.col("route").isin("urgent", "self_harm"), "urgent").otherwise("refused")
    warning = F.lit(None).cast("string")
    refused = routed.where("route <> 'answer'").select("id", F.element_at(known, F.col("route")).alias("answer"), F.lit("safety").alias("mode"), outcome.alias("outcome"), warning.alias("warning"), F.expr(NO_CITATIONS).alias("citations"))
    safe = routed.where("route = 'answer'").drop("route")
    found = safe.join(entries(safe, cards), "id", "left").withColumn("hits", F.coalesce("hits", F.expr(NO_CITATIONS)))
    messages = prompts.build_messages(F.lit(system), prompts.history_window(F.col("history"), pairs), F.col("message"), F.transform("hits", lambda h: h["text"]))
    made = generate(found.select("id", prompts.render_prompt(messages).alias("prompt"))).select("id", F.col("answer").alias("raw"))
    answered = found.join(made, "id", "left")
    blank = F.trim(F.coalesce("raw", F.lit(""))) == ""
    raw = F.when(blank, F.raise_error(F.lit("the model returned an empty answer")).cast("string")).otherwise(F.col("raw"))
    guarded = answered.withColumn("g", safety.guard(raw, F.lit(instead["dose"])))
    near = F.filter("hits", lambda h: h["score"] >= retrieval.CITATION_SHARE * F.col("hits")[0]["score"])
    cited = F.transform(near, lambda h: F.struct(h["card_id"].alias("card_id"), h["source"].alias("source"), h["text"].alias("text"), scoring.half_even(h["score"], 3).alias("score")))
    mode = F.when(F.size("hits") > 0, "finetuned_rag").otherwise("finetuned")
    given = guarded.select("id", F.col("g.answer").alias("answer"), mode.alias("mode"), F.when(F.col("g.replaced"), "refused").otherwise("answered").alias("outcome"), F.when(F.col("g.replaced"), "dose_removed").alias("warning"), F.when(F.size("hits") > 0, cited).otherwise(F.expr(NO_CITATIONS)).alias("citations"))
    return refused.unionByName(given)

