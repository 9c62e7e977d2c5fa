"""Facts and their expansion over parts, batches over documents, and evaluation over labels and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import entity_group, stable_int
from ..operators import batching, evaluation, facts, ranks
from ..shared import root
from ..sources import digest
from ..streaming import log
from . import duck
from .tables import table

_PHRASES = ("What is {a} of {n}?", "Tell me {a} of {n}.", "{n}: {a}?", "Give {a} for {n}.", "Which {a} has {n}?", "Name {a} of {n}.", "Do you know {a} of {n}?")
_ATTRIBUTES = ("price", "size", "type")


def templates(spark: SparkSession) -> DataFrame:
    rows = [("part", a, s, t.replace("{a}", a).replace("{n}", "{name}")) for a in _ATTRIBUTES for s, t in enumerate(_PHRASES)]
    return spark.createDataFrame(rows, "kind string, attribute string, slot int, text string")


def _part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities with a price, a size and, if it names a metal, a type; cf. templates."""
    part = table(spark, sf_dir, "part")
    entities = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), "p_size", "p_type", "p_brand", "p_partkey")
    grouped = entities.withColumn("group", entity_group(F.col("entity")))
    size = F.col("p_size").cast("string")
    return facts.explode_facts(grouped, {
        "price": (F.lit(True), F.concat(F.col("name"), F.lit(" is sold as "), F.col("p_brand"), F.lit(".")), F.array("p_brand")),
        "size": (F.lit(True), F.concat(F.lit("Its size is "), size, F.lit(".")), F.array(size)),
        "type": (F.col("p_size") % 2 == 0, F.concat(F.lit("It is "), F.lower("p_type"), F.lit(".")), F.array("p_type")),
    })


def fact_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_facts(spark, sf_dir).select("entity", "attribute", "answer", F.array_join("values", "|").alias("vals"))


def _expanded(spark: SparkSession, sf_dir: str, rows: list) -> DataFrame:
    return facts.expand(_part_facts(spark, sf_dir), rows, templates(spark)).select("split", "id", F.col("group").alias("row_group"), "open_book", "question", "answer")


def seen_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, facts.seen_rows())


def seen_term_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, facts.seen_rows(term=True))


def rag_only_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, facts.rag_only_rows())


def heldout_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, facts.held_out_rows())


def heldout_term_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, facts.held_out_rows(term=True, inferable=("type",)))


def reverse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.reverse(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_name", "p_partkey")
    return out.select("key", "first", tx.join_list(F.col("names")).alias("names"), F.size("names").alias("n"))


def two_turn_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    follow = spark.createDataFrame([(a, f"And its {a}?") for a in _ATTRIBUTES], "attribute string, follow string")
    out = facts.two_turns(_part_facts(spark, sf_dir), templates(spark), follow)
    return out.select("id", "entity", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").alias("talk"), "open_too")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.least(F.col("n_chars") % 1500 + 20, F.lit(1500)).cast("long").alias("length"))


def pad_to_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("length")
    return _examples(spark, sf_dir).select("id", batching.padded(n).alias("padded"), F.size(batching.pad_right(F.array_repeat(F.lit(1), (n % 20).cast("int")), batching.padded(n % 20))).alias("filled"))


def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.pack(_examples(spark, sf_dir), 4096)


def worst_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 in order of length stand in for packed ones, as SQL can make them."""
    n = F.row_number().over(Window.partitionBy("pool").orderBy("length", "id")) - 1
    batches = _examples(spark, sf_dir).withColumn("pool", (F.col("id") % 4).cast("int")).withColumn("batch", F.floor(n / 16).cast("int"))
    return batching.worst(batching.costs(batches)).select("pool", "batch", "size", "longest", "cost")


def worst_packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of the packed batches themselves."""
    return batching.worst(batching.costs(token_budget_batches(spark, sf_dir)))


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir)
    ids = lambda n: F.sequence(F.lit(1), n.cast("int"))
    masked = batching.mask_prompt(ids(F.col("length") % 7 + 1), ids(F.col("length") % 5 + 1))
    return e.select("id", F.array_join(F.transform(masked, lambda x: x.cast("string")), ",").alias("labels"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as answers of two models: quality is whether the first was right, toxic the second."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").join(docs, "doc_id")
    g = entity_group(F.col("doc_id").cast("string"))
    group = F.when(g == "seen", "seen_closed").when(g == "rag_only", "heldout_closed").when(g == "heldout_val", "unseen_closed").otherwise("heldout_open")
    rows = lab.select("doc_id", group.alias("group"), F.col("lang").alias("attribute"), "source", F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("quality").alias("correct")), F.struct(F.lit("tuned").alias("model"), F.col("toxic").alias("correct")))).alias("m"), (F.col("n_chars") % 10 / 10).alias("score"))
    return rows.select("doc_id", "group", "attribute", "source", "m.*", "score")


def summarize_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.summarize(_scored(spark, sf_dir), ("correct", "score"), 6)
    return out.withColumnRenamed("group", "grp")


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).groupBy("source", "model").agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    ci = evaluation.wilson(F.col("k"), F.col("n"))
    return rows.select("source", "model", "k", "n", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.paired(_scored(spark, sf_dir), "doc_id", "attribute", "base", "tuned")
    return out.select("attribute", "n", "k_a", "k_b", "only_a", "only_b", F.round("p", 6).alias("p"))


def mcnemar_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 7).alias("a"), (F.col("n_nationkey") % 11).alias("b"))
    return rows.select("n_nationkey", F.round(evaluation.mcnemar(F.col("a"), F.col("b")), 9).alias("p"))


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return evaluation.todo(docs, lab, ["doc_id"])


def last_wins_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return evaluation.last_wins(log, ["user_id", "event_type"], "event_id")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a log that is appended to twice, by a stream with a state for each key that is stopped between."""
    at = f"{root(spark)}/corpuswright/stream-{uuid.uuid4().hex}"
    events, keys = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"]
    for half in (1, 0):
        log.append(events.where(F.pmod("event_id", F.lit(2)) == half), f"{at}/log")
        stream = log.read_log(spark, f"{at}/log", "user_id long, event_type string, event_id long, value double")
        log.keep_latest(stream, keys, "event_id", f"{at}/changes", f"{at}/checkpoint").awaitTermination()
    return log.latest(spark, f"{at}/changes", keys, "event_id")


def exact_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.at_shares(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, 64)


def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the hash tree over documents, texts left out."""
    return digest.tree(table(spark, sf_dir, "documents"), "doc_id", 2, ["doc_id", "lang", "n_chars", "source"]).select(F.col("level").cast("long").alias("level"), "prefix", "digest", "n")


def pick_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return evaluation.first_of_group(docs, ["source"], ["doc_id"], 3).select("source", "doc_id")


def stratified_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = docs.select("lang").distinct().count()
    return evaluation.first_of_group(docs, ["lang"], ["doc_id"], max(1, 50 // max(1, groups))).select("lang", "doc_id")


def log_token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    log = table(spark, sf_dir, "events").withColumn("total", F.sum(F.col("value")).over(w))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return evaluation.rate(log, "user_id", ["event_id"], "total", seconds).select("event_id", F.round("rate", 4).alias("rate"))


def weighted_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") % 100 / 100.0 * F.col("n_chars")).alias("loss"), F.col("n_chars").alias("tokens"))
    nll = F.sum("loss") / F.sum("tokens")
    return e.groupBy("source").agg(F.round(nll, 6).alias("nll"), F.round(F.exp(nll), 6).alias("perplexity"))


def relational_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with coalesced names and a JSON column, as the relational sink writes them."""
    s = table(spark, sf_dir, "supplier")
    name = F.coalesce(F.nullif(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")), F.lit("")), F.lit("none"))
    return s.select("s_suppkey", name.alias("english"), F.to_json(F.struct("s_suppkey", "s_nationkey")).alias("data"))


QUERIES = {f.__name__: f for f in (fact_explode, seen_expansion, seen_term_expansion, rag_only_expansion, heldout_expansion, heldout_term_expansion, reverse_facts, two_turn_conversations, pad_to_multiple, token_budget_batches, worst_batches, worst_packed_batches, label_mask, summarize_by_group, wilson_ci, mcnemar_exact, mcnemar_small, resume_todo, last_wins_log, stream_latest, exact_ranks, dataset_digest, pick_examples, stratified_limit, log_token_rate, weighted_nll, relational_export)}

_I = duck.stable_int
_KEY = "entity || '|' || attribute"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TEMPLATES = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {s}, {_q(t.replace('{a}', a).replace('{n}', '{name}'))})" for a in _ATTRIBUTES for s, t in enumerate(_PHRASES)) + ") AS x(attribute, slot, text))"
_FACTS = f"""e AS (SELECT 'p' || p_partkey AS entity, p_name AS name, p_size, p_type, p_brand FROM part),
f AS (SELECT entity, name, 'price' AS attribute, name || ' is sold as ' || p_brand || '.' AS answer, p_brand AS vals FROM e
  UNION ALL SELECT entity, name, 'size', 'Its size is ' || p_size || '.', p_size::VARCHAR FROM e UNION ALL SELECT entity, name, 'type', 'It is ' || lower(p_type) || '.', p_type FROM e WHERE p_size % 2 = 0),
g AS (SELECT *, {_KEY} AS key, {duck.entity_group('entity')} AS grp FROM f)"""
_TEST_SLOT = f"5 + {_I(_q('test-slot'), 'key')} % 2"


def _chance(share: float, salt: str) -> str:
    return f"{_I(_q(salt), 'key')} % 10000 < {share * 10000}"


def _expansion(branches: list[tuple[str, str, str, str, str, str]]) -> str:
    """Branches: split, slot, ending, open, group, condition."""
    rows = " UNION ALL ".join(f"SELECT {split} AS split, key || '|' || ({slot})::VARCHAR || {_q(end)} AS id, {opened} AS open_book, {grp} AS row_group, attribute, ({slot})::INT AS slot, name, answer FROM g{', range(4) AS s(s)' if 's.s' in slot else ''} WHERE {cond}" for split, slot, end, opened, grp, cond in branches)
    return f"WITH {_FACTS}, {_TEMPLATES}, r AS ({rows}) SELECT split, id, row_group, open_book, replace(text, '{{name}}', name) AS question, answer FROM r JOIN t USING (attribute, slot)"


_LATER = [("'validation'", "4", "", "false", "'seen_closed'", f"grp = 'seen' AND {_chance(0.08, 'val')}"), ("'test'", _TEST_SLOT, "", "false", "'seen_closed'", f"grp = 'seen' AND {_chance(0.12, 'test')}")]


def _nth(salt: str, n: int) -> str:
    return f"list_sort(list_transform(range(4), lambda z: {{h: {_I(_q(salt), 'key', 'z::VARCHAR')}, z: z}}))[{n}].z"


_HELD_SPLIT = "CASE grp WHEN 'heldout_val' THEN 'validation' ELSE 'test' END"
_HELD_SLOT = f"CASE grp WHEN 'heldout_val' THEN 4 ELSE {_TEST_SLOT} END"
_SCORED = f"""d AS (SELECT l.doc_id, CASE {duck.entity_group('l.doc_id::VARCHAR')} WHEN 'seen' THEN 'seen_closed' WHEN 'rag_only' THEN 'heldout_closed' WHEN 'heldout_val' THEN 'unseen_closed' ELSE 'heldout_open' END AS grp, lang AS attribute, source, quality, toxic, n_chars % 10 / 10 AS score FROM labels l JOIN documents USING (doc_id)),
s AS (SELECT doc_id, grp, attribute, source, 'base' AS model, quality AS correct, score FROM d UNION ALL SELECT doc_id, grp, attribute, source, 'tuned', toxic, score FROM d)"""
_AGG = "count(*) AS n, round(avg(correct), 6) AS correct, round(avg(score), 6) AS score FROM s"
_WILSON = "((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) {} 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n))"
_WILSON = _WILSON.replace("1.96", "1.96::DOUBLE")


def _mcnemar(a: str, b: str, digits: int = 6) -> str:
    n, k = f"({a} + {b})", f"least({a}, {b})"
    term = f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0::DOUBLE))"
    return f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range({k} + 1), lambda i: {term}))), {digits}) END"


_LENGTH = "least(n_chars % 1500 + 20, 1500)"
#: Each step takes the next example of every pool.
_PACKED = f"""e AS (SELECT doc_id AS id, ({_LENGTH})::BIGINT AS length FROM documents),
z AS (SELECT greatest(1, ceil(count(*) / greatest(1, 64 * 4096 // greatest(1, sum(length)::BIGINT // count(*)))))::BIGINT AS pools FROM e),
p AS (SELECT id, length, (ceil(length / 8) * 8)::BIGINT AS padded, ({_I(_q('0'), 'id::VARCHAR')} % (SELECT pools FROM z))::INT AS pool FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY length, id) AS n FROM p),
b AS (SELECT pool, n, id, length, padded, 0 AS batch, padded AS longest, 1 AS held FROM o WHERE n = 1
  UNION ALL SELECT o.pool, o.n, o.id, o.length, o.padded, b.batch + (greatest(b.longest, o.padded) * (b.held + 1) > 4096)::INT,
    CASE WHEN greatest(b.longest, o.padded) * (b.held + 1) > 4096 THEN o.padded ELSE greatest(b.longest, o.padded) END, CASE WHEN greatest(b.longest, o.padded) * (b.held + 1) > 4096 THEN 1 ELSE b.held + 1 END
  FROM b JOIN o ON o.pool = b.pool AND o.n = b.n + 1)"""
ORACLES = {
    "fact_explode": f"WITH {_FACTS} SELECT entity, attribute, answer, vals FROM f",
    "seen_expansion": _expansion([
        ("'train'", "s.s", "", "false", "grp", f"grp = 'seen' AND s.s <> {_I(_q('skip'), 'key')} % 4"),
        ("'train'", f"{_I(_q('open-slot'), 'key')} % 4", "|open", "true", "grp", f"grp = 'seen' AND {_chance(0.35, 'open')}"),
        ("'train'", f"{_I(_q('miss-slot'), 'key')} % 4", "|miss", "true", "grp", f"grp = 'seen' AND NOT {_chance(0.35, 'open')} AND {_chance(0.04, 'miss')}"), *_LATER]),
    "seen_term_expansion": _expansion([*(("'train'", _nth("nm-slot", i), "", "false", "grp", "grp = 'seen'") for i in (1, 2)), ("'train'", _nth("nm-slot", 1), "|open", "true", "grp", f"grp = 'seen' AND {_chance(0.25, 'open')}"), *_LATER]),
    "rag_only_expansion": _expansion([("'train'", _nth("rag", i), "|open", "true", "grp", "grp = 'rag_only'") for i in (1, 2)]),
    "heldout_expansion": _expansion([(_HELD_SPLIT, _HELD_SLOT, "|open", "true", "'heldout_open'", "grp LIKE 'heldout%'"), (_HELD_SPLIT, _HELD_SLOT, "|closed", "false", "'heldout_closed'", f"grp = 'heldout_test' AND {_chance(0.5, 'control')}")]),
    "heldout_term_expansion": _expansion([(_HELD_SPLIT, _HELD_SLOT, "|open", "true", "'heldout_open'", "grp LIKE 'heldout%'"), (_HELD_SPLIT, _HELD_SLOT, "|closed", "false", "'unseen_closed'", "grp LIKE 'heldout%' AND attribute = 'type'")]),
    "reverse_facts": "WITH r AS (SELECT lower(p_brand) AS key, arg_min(p_brand, p_partkey) AS first, list(p_name ORDER BY p_partkey) AS l FROM part WHERE p_brand <> '' GROUP BY 1) SELECT key, first, CASE WHEN len(l) <= 1 THEN array_to_string(l, '') ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS names, len(l)::INT AS n FROM r",
    "two_turn_conversations": f"""WITH {_FACTS}, {_TEMPLATES}, o AS (SELECT entity, name, list({{h: {_I(_q('turn'), 'entity', 'attribute')}, attribute: attribute, answer: answer}} ORDER BY {_I(_q('turn'), 'entity', 'attribute')}, attribute) AS l FROM f GROUP BY entity, name),
p AS (SELECT entity, name, l[1] AS a, l[2] AS b, entity || '|' || l[1].attribute || '>' || l[2].attribute AS id, {_nth('turn-slot', 1).replace('key', 'entity')} AS slot FROM o WHERE len(l) >= 2)
SELECT p.id, entity, 'user:' || replace(t.text, '{{name}}', name) || chr(10) || 'assistant:' || a.answer || chr(10) || 'user:And its ' || b.attribute || '?' || chr(10) || 'assistant:' || b.answer AS talk, {_I(_q('multi-open'), 'p.id')} % 10000 < 4000 AS open_too FROM p JOIN t ON t.attribute = a.attribute AND t.slot = p.slot""",
    "pad_to_multiple": f"SELECT doc_id AS id, (ceil({_LENGTH} / 8) * 8)::BIGINT AS padded, (ceil(({_LENGTH} % 20) / 8) * 8)::INT AS filled FROM documents",
    "token_budget_batches": f"WITH RECURSIVE {_PACKED} SELECT pool, batch, id, length FROM b",
    "worst_packed_batches": f"""WITH RECURSIVE {_PACKED}, c AS (SELECT pool, batch, count(*) AS size, max(length) AS longest, max(padded) * count(*) AS cost FROM b GROUP BY pool, batch)
SELECT * FROM (SELECT * FROM c ORDER BY cost DESC, pool, batch LIMIT 1) UNION SELECT * FROM (SELECT * FROM c ORDER BY longest DESC, pool, batch LIMIT 1)""",
    "worst_batches": f"""WITH e AS (SELECT doc_id AS id, {_LENGTH} AS length, doc_id % 4 AS pool FROM documents), b AS (SELECT *, (row_number() OVER (PARTITION BY pool ORDER BY length, id) - 1) // 16 AS batch FROM e),
c AS (SELECT pool::INT AS pool, batch::INT AS batch, count(*) AS size, max(length) AS longest, (ceil(max(length) / 8) * 8)::BIGINT * count(*) AS cost FROM b GROUP BY pool, batch)
SELECT * FROM (SELECT * FROM c ORDER BY cost DESC, pool, batch LIMIT 1) UNION SELECT * FROM (SELECT * FROM c ORDER BY longest DESC, pool, batch LIMIT 1)""",
    "label_mask": f"SELECT doc_id AS id, array_to_string(list_transform(range({_LENGTH} % 7 + 1), lambda i: '-100') || list_transform(range(1, {_LENGTH} % 5 + 2), lambda i: i::VARCHAR), ',') AS labels FROM documents",
    "summarize_by_group": f"""WITH {_SCORED}
SELECT 'group' AS scope, model, grp, NULL AS attribute, NULL AS source, {_AGG} GROUP BY model, grp UNION ALL SELECT 'attribute', model, grp, attribute, NULL, {_AGG} GROUP BY model, grp, attribute
UNION ALL SELECT 'source', model, grp, NULL, source, {_AGG} GROUP BY model, grp, source UNION ALL SELECT 'known', model, NULL, NULL, NULL, {_AGG} WHERE grp <> 'heldout_closed' GROUP BY model
UNION ALL SELECT 'unseen', model, NULL, NULL, NULL, {_AGG} WHERE grp IN ('heldout_open', 'unseen_closed') GROUP BY model""",
    "wilson_ci": f"WITH {_SCORED}, r AS (SELECT source, model, sum(correct)::BIGINT AS k, count(*) AS n FROM s GROUP BY source, model) SELECT source, model, k, n, round(greatest(0.0::DOUBLE, {_WILSON.format('-')}), 6) AS low, round(least(1.0::DOUBLE, {_WILSON.format('+')}), 6) AS high FROM r",
    "mcnemar_exact": f"WITH {_SCORED}, c AS (SELECT attribute, count(*) AS n, sum(quality)::BIGINT AS k_a, sum(toxic)::BIGINT AS k_b, sum((quality > toxic)::INT)::BIGINT AS only_a, sum((toxic > quality)::INT)::BIGINT AS only_b FROM d GROUP BY attribute) SELECT attribute, n, k_a, k_b, only_a, only_b, {_mcnemar('only_a', 'only_b')} AS p FROM c",
    "mcnemar_small": f"SELECT n_nationkey, {_mcnemar('(n_nationkey % 7)', '(n_nationkey % 11)', 9)} AS p FROM nation",
    "resume_todo": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "last_wins_log": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "stream_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "exact_ranks": "WITH s AS (SELECT event_type, list_sort(list(value::DOUBLE)) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, " + ", ".join(f"l[floor(len(l) * {x}::DOUBLE)::BIGINT + 1] AS p{n}" for n, x in ((50, 0.5), (90, 0.9), (99, 0.99))) + " FROM s",
    "dataset_digest": """WITH r AS (SELECT sha256(doc_id::VARCHAR) AS h, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS d FROM documents),
a AS (SELECT substr(h, 1, 4) AS prefix, sha256(string_agg(h || ':' || d, ',' ORDER BY h, d)) AS digest, count(*) AS n FROM r GROUP BY 1),
b AS (SELECT substr(prefix, 1, 2) AS prefix, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest, sum(n)::BIGINT AS n FROM a GROUP BY 1),
c AS (SELECT '' AS prefix, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest, sum(n)::BIGINT AS n FROM b)
SELECT 2 AS level, * FROM a UNION ALL SELECT 1, * FROM b UNION ALL SELECT 0, * FROM c""",
    "pick_examples": "SELECT source, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
    "stratified_limit": "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= greatest(1, 50 // (SELECT count(DISTINCT lang) FROM documents))",
    "log_token_rate": "WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events) SELECT event_id, round((total - lag(total) OVER w) / nullif(t - lag(t) OVER w, 0), 4) AS rate FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "weighted_nll": "WITH e AS (SELECT source, n_chars % 100 / 100.0::DOUBLE * n_chars AS loss, n_chars AS tokens FROM documents) SELECT source, round(sum(loss) / sum(tokens), 6) AS nll, round(exp(sum(loss) / sum(tokens)), 6) AS perplexity FROM e GROUP BY source",
    "relational_export": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_name = '' THEN 'none' ELSE s_name END AS english, '{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || '}' AS data FROM supplier""",
}
