"""Conversations: validation, rendering, routing and scoring; documents against benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as p
from ..functions import safety, scoring
from ..functions import text as tx
from ..operators import serving, tokens
from ..shared import numbered, small
from . import duck
from .tables import cards, table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) in turn order; collects the turns of one conversation."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def conv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    talk = F.filter("messages", lambda m: m["role"] != "system")
    question, history = F.try_element_at(talk, F.lit(-1))["content"], F.slice(talk, F.lit(1), F.greatest(F.size(talk) - 1, F.lit(0)))
    return c.select("conv_id", p.message_fault(F.col("messages")).alias("render_fault"), p.history_fault(question, history).alias("request_fault"))


def render_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return c.where(p.message_fault(F.col("messages")).isNull()).select("conv_id", p.render_prompt(F.col("messages")).alias("prompt"))


def open_book_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    entries = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    return items.select("item_id", p.user_content(F.concat(F.lit("  "), F.col("text"), F.lit(" ")), entries).alias("content"))


def clean_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    raw = F.concat(F.when(F.col("turn") % 2 == 0, "<think>\nhidden\n</think>\n\n").otherwise(" "), F.col("text"), F.when(F.col("turn") % 3 == 0, "<|im_end|> rest <|endoftext|>").otherwise(""))
    return t.select("conv_id", "turn", p.clean_generation(raw).alias("answer"), p.completion_text(raw).alias("completion"))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    w = p.history_window(F.filter("messages", lambda m: m["role"] != "system"))
    return c.select("conv_id", F.size(w).alias("n"), F.array_join(F.transform(w, lambda m: m["role"]), ",").alias("roles"))


def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", F.concat_ws(" ", "text", before).alias("query"))


def label_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the prompt, masked, and of the answer, with a white-space tokeniser."""
    t = table(spark, sf_dir, "conversations")
    n = tx.word_count(F.col("text"))
    return t.groupBy("conv_id").agg(F.sum(n).alias("tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("supervised"), F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("masked"))


def token_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank positions n/2 and .99n of the sorted lengths, by ranks instead of a collected list."""
    sizes = table(spark, sf_dir, "documents").select(tx.word_count(F.col("text")).alias("n"))
    counted = sizes.groupBy("n").agg(F.count("*").alias("c"))  # distinct lengths: few rows from here on
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = counted.withColumn("upto", F.sum("c").over(run)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    at_rank = lambda r: F.min(F.when(F.col("upto") > r, F.col("n")))
    return at.agg(F.sum(F.col("n") * F.col("c")).alias("total"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 4).alias("mean"), at_rank(F.floor(F.col("all") / 2)).alias("p50"), at_rank(F.floor(F.col("all") * 0.99)).alias("p99"), F.max("n").alias("longest"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn with the turn before it."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(w).alias("reference")).where("role = 'assistant' AND reference IS NOT NULL")


def copy_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.contains("reference", "answer").cast("long")).alias("copies"))


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(scoring.token_f1(F.col("answer"), F.col("reference")), 6).alias("f1"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(scoring.rouge_l(F.col("answer"), F.col("reference")), 6).alias("rouge_l"))


def _doc_items(spark: SparkSession, sf_dir: str, **of_item: Column) -> DataFrame:
    """Documents with the benchmark item whose place in the order of ids is their id modulo the number of items; what is made of the
    items alone (columns of ``item``) is made once an item, not once a document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    ids = items.select("item_id").distinct()
    n = max(1, ids.count())
    placed = items.join(numbered(ids, "item_id"), "item_id").withColumns(of_item)
    return docs.join(small(placed), F.pmod("doc_id", F.lit(n)) == placed["place"])


def _doc_tokens(spark: SparkSession, sf_dir: str, **of_item: Column) -> DataFrame:
    return tx.once(_doc_items(spark, sf_dir, **of_item), tx.content_tokens(F.col("text")), "tokens")


def phrase_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_tokens(spark, sf_dir, item_tokens=tx.content_tokens(F.col("item")))
    return d.select("doc_id", scoring.tokens_hit(F.col("item_tokens"), F.col("tokens")).alias("hit"))


def items_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_tokens(spark, sf_dir)
    parts = F.split("item", r"[.,] ")
    scored = tx.once(d.select("doc_id", F.transform(parts, lambda v: scoring.item_covered(v, F.col("tokens"))).alias("flags")), F.col("flags"), "f")
    n = F.size(F.filter("f", lambda x: x))
    return scored.select("doc_id", n.alias("covered"), F.size("f").alias("items"), (n / F.size("f") >= 0.5).alias("correct"))


#: Classes that the driver's texts can hold, in the order of ties.
WORD_CLASSES = {"the": r"\bthe\b", "der": r"\bder\b|\bdie\b", "les": r"\bles\b|\bdes\b", "de": r"\bde\b"}


def first_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.first_match(F.col("text"), WORD_CLASSES).alias("class"))


def jaccard_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_items(spark, sf_dir, item_tags=scoring.tagged(F.col("item"), WORD_CLASSES))
    d = tx.once(d, scoring.tagged(F.col("text"), WORD_CLASSES), "tags")
    return d.select("doc_id", F.round(scoring.jaccard(F.col("tags"), F.col("item_tags")), 6).alias("jaccard"))


def terms_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_items(spark, sf_dir, words=F.filter(F.split("item", r"[ .,\n]+"), lambda w: w != ""))
    hits = scoring.term_hits(F.col("words"), F.col("text"))
    return d.select("doc_id", F.size(F.filter(hits, lambda x: x)).alias("hits"))


def exact_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_items(spark, sf_dir).select("doc_id", F.contains(tx.squeeze(F.col("text")), tx.squeeze(F.col("item"))).alias("hit"))


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_tokens(spark, sf_dir, item_tokens=tx.content_tokens(F.col("item")), squeezed=tx.squeeze(F.col("item")))
    flag = lambda hit: scoring.result(hit.cast("double"), hit)
    parts = F.array(flag(scoring.tokens_hit(F.col("item_tokens"), F.col("tokens"))), flag(F.contains(tx.squeeze(F.col("text")), F.col("squeezed"))), flag(F.col("text").rlike(r"\bthe\b")))
    made = tx.once(tx.once(d, parts, "parts").select("doc_id", "parts"), scoring.composite(F.col("parts")), "c")
    return made.select("doc_id", F.round("c.score", 6).alias("score"), F.col("c.correct").alias("correct"))


_ASKS = ("I have severe chest pain and ", "How much of it should I take: ", "I want to end my life ", "What is ", "can’t   breathe ")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    prefix = F.element_at(F.array(*map(F.lit, _ASKS)), ((F.col("conv_id") + F.col("turn")) % len(_ASKS) + 1).cast("int"))
    return t.select("conv_id", "turn", F.concat(prefix, F.col("text")).alias("message"))


def safety_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", safety.route(F.col("message")).alias("route"))


_DOSED = "CASE WHEN turn % 3 = 0 THEN 'Take 2.5 - 5 g twice daily; ' WHEN turn % 3 = 1 THEN 'consult a doctor: ' ELSE '' END"


def dose_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("a", F.concat(F.expr(_DOSED), F.col("text")))
    g = safety.guard(F.col("a"), F.lit("no dose"))
    return t.select("conv_id", "turn", g["answer"].alias("answer"), g["replaced"].alias("replaced"))


def safety_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("a", F.concat(F.expr(_DOSED), F.col("text")))
    kinds = F.element_at(F.array(F.lit("dose"), F.lit("emergency"), F.lit("self_harm")), (F.col("conv_id") % 3 + 1).cast("int"))
    return t.select("conv_id", "turn", scoring.safety_score(kinds, F.col("a"))["correct"].alias("correct"))


def unscorable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that score as wrong against the turn before, as a phrase."""
    hit = scoring.phrase_hit(F.col("reference"), tx.content_tokens(F.col("answer")))
    return _pairs(spark, sf_dir).where(~hit).select("conv_id", "turn")


def chat_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns answered as one batch, with documents as cards and a generator that states doses now and then."""
    requests = _asked(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "message", F.array().cast("array<struct<role:string,content:string>>").alias("history"))
    reply = lambda made: made.withColumn("answer", F.when(F.split("id", "-")[1].cast("int") % 3 == 0, "Take 2.5 - 5 g twice daily.").otherwise("Rest well."))
    out = serving.chat(requests, cards(spark, sf_dir), "Be brief.", {"urgent": "call", "self_harm": "talk", "dose": "ask"}, reply)
    return out.select("id", "answer", (F.col("mode") == "safety").alias("by_safety"), "outcome", "warning", (F.size("citations") > 0).alias("__c")).drop("__c")


def encoded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of conversations that end with an answer, their prompts masked; SQL has no tokenizer."""
    import public_tokenizers

    c = conversations(spark, sf_dir).where("size(messages) >= 2 AND messages[size(messages) - 1].role = 'assistant' AND messages[size(messages) - 2].role = 'user' AND NOT exists(messages, m -> m.role = 'system')")
    rows = c.select(F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 5 == 0, "test").otherwise("train").alias("split"), "messages")
    return tokens.report(tokens.examples(rows, "Be brief.", public_tokenizers.path("byte_bpe_50k.json")))


def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.content_tokens(F.col("text")), " ").alias("stems"), F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean(t).alias("cleaned"), tx.slug(t).alias("slug"), tx.word_count(t).cast("long").alias("words"), tx.capitalize(t).alias("capital"), tx.sentence(t).alias("sentence"))


QUERIES = {f.__name__: f for f in (conv_validate, render_chatml, open_book_prompt, clean_generation, history_window, followup_query, label_mask_counts, token_percentiles, copy_rate, token_f1, rouge_l, phrase_hit, items_covered, first_match_class, jaccard_tags, terms_hit, exact_hit, composite_score, safety_route, dose_guard, safety_score, unscorable_filter, chat_outcomes, encoded_report, stem_tokens, clean_text)}

_C = "c AS (SELECT conv_id, list({role: role, content: text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)"
_TALK = "t AS (SELECT *, list_filter(m, lambda x: x.role <> 'system') AS talk FROM c)"
_RENDER_FAULT = """CASE WHEN m[-1].role <> 'user' THEN 'the last message must be a user message' WHEN len(list_filter(m, lambda x: x.role NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'unsupported role'
  WHEN len(list_filter(m[2:], lambda x: x.role = 'system')) > 0 THEN 'the system message must come first' END"""
_SPACES = "[ \\t\\r\\n]"
_BLANK = "regexp_matches(coalesce({}, ''), '^[ \\t\\r\\n]*$')"
_WORDS = "CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"
_PAIRS = "pairs AS (SELECT * FROM (SELECT conv_id, turn, role, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations) WHERE role = 'assistant' AND reference IS NOT NULL)"
_ITEMS = """pl AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM benchmark)),
di AS (SELECT d.doc_id, d.text, b.text AS item FROM documents d JOIN pl ON d.doc_id % pl.n = pl.place JOIN benchmark b USING (item_id))"""
_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_ITEM = "trim(regexp_replace(item, '\\s+', ' ', 'g'))"


def _phrase(phrase: str, text: str) -> str:
    k, a = duck.content_tokens(phrase), duck.content_tokens(text)
    n, h = f"len({k})", f"len(list_filter({k}, lambda z: list_contains({a}, z)))"
    return f"({n} > 0 AND ({h} = {n} OR ({n} >= 4 AND {h} / {n} >= 0.75)))"


def _first(text: str) -> str:
    at = [f"{{pos: CASE WHEN regexp_matches({text}, '{pat}') THEN length(regexp_extract({text}, '(?s)^(.*?)(?:{pat})', 1)) END, n: {i}, name: '{n}'}}" for i, (n, pat) in enumerate(WORD_CLASSES.items())]
    return f"list_sort(list_filter([{', '.join(at)}], lambda x: x.pos IS NOT NULL))[1].name"


def _tags(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{pat}') THEN '{n}' END" for n, pat in WORD_CLASSES.items()) + "], lambda x: x IS NOT NULL)"


def _routes() -> str:
    m = "trim(regexp_replace(replace(lower(m), '’', chr(39)), '\\s+', ' ', 'g'))"
    quote = lambda x: x.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({m}, '(?i){quote('|'.join(ps))}') THEN '{n}'" for n, ps in safety.POLICY.routes) + " ELSE 'answer' END"


_GENERIC = "list_transform([" + ", ".join(f"'{w}'" for w in scoring.GENERIC_WORDS) + "], lambda w: w)"
_TOKEN_SQL = duck.content_tokens("text")
_ITEM_SQL = f"""WITH {_ITEMS}, g AS (SELECT {duck.content_tokens(repr(' '.join(scoring.GENERIC_WORDS)))} AS generic),
v AS (SELECT doc_id, {_TOKEN_SQL} AS a, unnest(string_split_regex(item, '[.,] ')) AS val FROM di),
k AS (SELECT doc_id, a, {duck.content_tokens('val')} AS k, generic FROM v, g),
s AS (SELECT doc_id, a, CASE WHEN len(list_filter(k, lambda z: NOT list_contains(generic, z))) > 0 THEN list_filter(k, lambda z: NOT list_contains(generic, z)) ELSE k END AS s FROM k),
f AS (SELECT doc_id, len(s) > 0 AND len(list_filter(s, lambda z: list_contains(a, z))) / len(s) >= 0.5 AS f FROM s)
SELECT doc_id, count(*) FILTER (f)::INT AS covered, count(*)::INT AS items, count(*) FILTER (f) / count(*) >= 0.5 AS correct FROM f GROUP BY doc_id"""

ORACLES = {
    "conv_validate": f"""WITH {_C}, {_TALK}, h AS (SELECT conv_id, m, talk[-1].content AS q, talk[:-2] AS h FROM t)
SELECT conv_id, {_RENDER_FAULT} AS render_fault, CASE WHEN {_BLANK.format('q')} THEN 'blank message' WHEN length(q) > 4000 THEN 'message too long' WHEN len(h) > 20 THEN 'history too long' WHEN len(h) % 2 <> 0 THEN 'history is not made of pairs'
  WHEN len(list_filter(list_transform(h, lambda x, i: x.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END), lambda ok: NOT ok)) > 0 THEN 'history does not alternate'
  WHEN len(list_filter(h, lambda x: {_BLANK.format('x.content')} OR length(x.content) > 8000)) > 0 THEN 'bad history text' END AS request_fault FROM h""",
    "render_chatml": f"""WITH {_C} SELECT conv_id, array_to_string(list_transform(m, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS prompt FROM c WHERE {_RENDER_FAULT} IS NULL""",
    "open_book_prompt": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN trim(text) ELSE 'Knowledge base entries:' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '[' || i || '] ' || x), chr(10)) || chr(10) || chr(10) || 'Question: ' || trim(text) END AS content FROM benchmark",
    "clean_generation": """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<think>' || chr(10) || 'hidden' || chr(10) || '</think>' || chr(10) || chr(10) ELSE ' ' END || text || CASE WHEN turn % 3 = 0 THEN '<|im_end|> rest <|endoftext|>' ELSE '' END AS raw, text FROM conversations)
SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS answer, trim(raw, chr(32) || chr(9) || chr(13) || chr(10)) || '<|im_end|>' AS completion FROM r""",
    "history_window": f"WITH {_C}, {_TALK} SELECT conv_id, least(len(talk), 4)::INT AS n, array_to_string(list_transform(talk[-4:], lambda x: x.role), ',') AS roles FROM t",
    "followup_query": "SELECT conv_id, turn, concat_ws(' ', text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS query FROM conversations WHERE role = 'user'",
    "label_mask_counts": f"WITH w AS (SELECT conv_id, role, {_WORDS} AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS supervised, sum(CASE WHEN role <> 'assistant' THEN n ELSE 0 END)::BIGINT AS masked FROM w GROUP BY conv_id",
    "token_percentiles": f"WITH w AS (SELECT {_WORDS} AS n FROM documents), s AS (SELECT list_sort(list(n)) AS l FROM w) SELECT list_sum(l)::BIGINT AS total, round(list_sum(l) / len(l), 4) AS mean, l[len(l) // 2 + 1]::INT AS p50, l[floor(len(l) * 0.99)::BIGINT + 1]::INT AS p99, l[-1]::INT AS longest FROM s",
    "copy_rate": f"WITH {_PAIRS} SELECT count(*) AS n, sum(contains(reference, answer)::INT)::BIGINT AS copies FROM pairs",
    "token_f1": f"""WITH {_PAIRS}, k AS (SELECT conv_id, turn, {duck.content_tokens('answer')} AS a, {duck.content_tokens('reference')} AS b FROM pairs),
o AS (SELECT conv_id, turn, len(a) + len(b) AS n, coalesce(list_sum(list_transform(list_distinct(a), lambda z: least(len(list_filter(a, lambda y: y = z)), len(list_filter(b, lambda y: y = z))))), 0) AS overlap FROM k)
SELECT conv_id, turn, CASE WHEN overlap = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * overlap / n, 6) END AS f1 FROM o""",
    "rouge_l": f"""WITH {_PAIRS}, k AS (SELECT conv_id, turn, {duck.content_tokens("coalesce(answer, '')")} AS a, {duck.content_tokens("coalesce(reference, '')")} AS b FROM pairs),
o AS (SELECT conv_id, turn, len(a) + len(b) AS n, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_reduce(a, lambda before, t: list_reduce(range(1, len(b) + 1), lambda now, j: list_append(now, greatest(now[j], CASE WHEN b[j] = t THEN before[j] + 1 ELSE before[j + 1] END)), [0::BIGINT]), list_resize([0::BIGINT], len(b) + 1, 0))[-1] END AS common FROM k)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * common / n, 6) END AS rouge_l FROM o""",
    "phrase_hit": f"WITH {_ITEMS} SELECT doc_id, {_phrase('item', 'text')} AS hit FROM di",
    "items_covered": _ITEM_SQL,
    "first_match_class": f"WITH f AS (SELECT doc_id, {duck.fold('text')} AS t FROM documents) SELECT doc_id, {_first('t')} AS class FROM f",
    "jaccard_tags": f"""WITH {_ITEMS}, f AS (SELECT doc_id, {_tags(duck.fold('text'))} AS a, {_tags(duck.fold('item'))} AS b FROM di)
SELECT doc_id, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) END AS jaccard FROM f""",
    "terms_hit": f"""WITH {_ITEMS}, f AS (SELECT doc_id, {duck.fold('text')} AS t, list_filter(list_transform(string_split_regex(item, '[ .,\\n]+'), lambda w: {duck.fold('w')}), lambda w: w <> '') AS w FROM di)
SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(t, '\\b(?:' || regexp_escape(x) || ')')))::INT AS hits FROM f""",
    "exact_hit": f"WITH {_ITEMS} SELECT doc_id, contains({_SQUEEZED}, {_ITEM}) AS hit FROM di",
    "composite_score": f"""WITH {_ITEMS}, f AS (SELECT doc_id, {_phrase('item', 'text')}::INT + contains({_SQUEEZED}, {_ITEM})::INT + regexp_matches(text, '\\bthe\\b')::INT AS n FROM di) SELECT doc_id, round(n / 3, 6) AS score, n / 3 >= 0.5 AS correct FROM f""",
    "safety_route": f"WITH a AS (SELECT conv_id, turn, [{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in _ASKS)}][(conv_id + turn) % {len(_ASKS)} + 1] || text AS m FROM conversations) SELECT conv_id, turn, {_routes()} AS route FROM a",
    "chat_outcomes": f"""WITH a AS (SELECT conv_id, turn, [{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in _ASKS)}][(conv_id + turn) % {len(_ASKS)} + 1] || text AS m FROM conversations), r AS (SELECT conv_id, turn, {_routes()} AS route FROM a)
SELECT conv_id || '-' || turn AS id, CASE route WHEN 'urgent' THEN 'call' WHEN 'self_harm' THEN 'talk' WHEN 'dose' THEN 'ask' ELSE CASE WHEN turn % 3 = 0 THEN 'ask' ELSE 'Rest well.' END END AS answer, route <> 'answer' AS by_safety,
  CASE WHEN route IN ('urgent', 'self_harm') THEN 'urgent' WHEN route = 'dose' OR turn % 3 = 0 THEN 'refused' ELSE 'answered' END AS outcome, CASE WHEN route = 'answer' AND turn % 3 = 0 THEN 'dose_removed' END AS warning FROM r""",
    "dose_guard": f"WITH a AS (SELECT conv_id, turn, {_DOSED} || text AS a FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(a, '(?i){safety.POLICY.dose_in_answer}') THEN 'no dose' ELSE a END AS answer, regexp_matches(a, '(?i){safety.POLICY.dose_in_answer}') AS replaced FROM a",
    "safety_score": f"""WITH a AS (SELECT conv_id, turn, {_DOSED} || text AS a FROM conversations) SELECT conv_id, turn, CASE conv_id % 3 WHEN 1 THEN regexp_matches(a, '(?i){scoring.EMERGENCY}') WHEN 2 THEN regexp_matches(a, '(?i){scoring.CRISIS}')
  ELSE NOT regexp_matches(a, '(?i){scoring.DOSE}') AND regexp_matches(a, '(?i){scoring.REFERRAL}') END AS correct FROM a""",
    "unscorable_filter": f"WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE NOT {_phrase('reference', 'answer')}",
    "stem_tokens": f"SELECT item_id, array_to_string({duck.content_tokens('text')}, ' ') AS stems, array_to_string({duck.tokenize('text')}, ' ') AS tokens FROM benchmark",
    "clean_text": f"""WITH a AS (SELECT *, {_SQUEEZED} AS q FROM conversations) SELECT conv_id, turn, CASE WHEN lower(q) IN ('', 'none', 'none specific', 'nan', 'n/a', 'na', '-') THEN '' ELSE q END AS cleaned, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  ({_WORDS})::BIGINT AS words, upper(text[1:1]) || text[2:] AS capital, CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN trim(text) ELSE trim(text) || '.' END AS sentence FROM a""",
}
