"""Splits, caps, dedup, parents and leakage checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import bucket, chance, entity_group, slots_by_hash, stable_int
from ..operators import mentions
from ..operators import splits as s
from . import duck
from .tables import table


def hash_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", stable_int("bucket", key).alias("h"), bucket(key).alias("bucket"), entity_group(key).alias("split_group"))


def twin_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("name"))
    return s.name_groups(docs, "name").select("doc_id", tx.group_key(F.col("name")).alias("name_key"), F.col("group").alias("split_group"))


def bernoulli_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("doc_id").cast("string"), F.lit("|fact"))
    flags = [chance(p, salt, key).alias(salt) for salt, p in (("open", 0.35), ("miss", 0.04), ("val", 0.08), ("test", 0.12), ("control", 0.5))]
    return table(spark, sf_dir, "documents").select("doc_id", *flags)


def _capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows: a cap of 15 for each (lang, source) with lang en, none for the others."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("test").alias("split"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("group"), "source")


def caps_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _capped_rows(spark, sf_dir)
    caps = rows.where("`group` = 'en'").select("split", "group", "source").distinct().withColumn("most", F.lit(15))
    return s.capped(rows, caps).select("id", F.col("group").alias("lang"), "source")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), "lang")
    return s.keep_first(docs, F.lower("title"), "doc_id")


def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "n_chars")
    return s.keep_best(docs, tx.slug(F.col("title")), F.col("n_chars"), "doc_id")


def twin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    blanked = docs.select(tx.slug(F.substring_index("text", " ", 2)).alias("key"), "doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("source"))
    return s.merge_twins(blanked, "key", "doc_id", ["source"])


def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    code = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("."), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string"))))
    return s.by_prefix(part.select("p_partkey", code.alias("code")), "p_partkey", "code", "p_partkey")


def section_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_brand").alias("section"), F.col("p_size").alias("t_id"), (F.col("p_size") % 7).alias("parent_id"), "p_name")
    return s.by_section(rows, "p_partkey", ("section", "t_id"), "parent_id", "p_partkey", F.col("p_name") != "").select("p_partkey", "parent")


def reference_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    refs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("idx"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("ref"))
    rows = nation.select("n_nationkey", (F.col("n_nationkey") + 1).alias("other"))
    return s.with_fallback(rows, refs, "n_nationkey", "other").select("n_nationkey", "reference")


def slot_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("|price"))
    kept = F.filter(F.array(*map(F.lit, range(4))), lambda x: x != stable_int("skip", key) % 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(kept).alias("slot"))


def slot_pick2(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("|price"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.slice(slots_by_hash((0, 1, 2, 3), "nm-slot", key), 1, 2)).alias("place", "slot"))


def slot_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("|price"))
    return table(spark, sf_dir, "part").select("p_partkey", slots_by_hash((0, 1, 2, 3), "rag", key)[0].alias("slot"), (stable_int("test-slot", key) % 2 + 5).alias("test_slot"))


def _example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples: split by hash, question the first line, entity the source and length class."""
    docs = table(spark, sf_dir, "documents")
    group = entity_group(F.col("doc_id").cast("string"))
    split = F.when(group == "heldout_val", "validation").when(group == "heldout_test", "test").otherwise("train")
    return docs.select(
        split.alias("split"), F.col("doc_id").cast("string").alias("id"), F.when(split == "train", "seen").otherwise("heldout_open").alias("group"), F.col("source"),
        F.concat(F.col("source"), F.lit("-"), (F.col("n_chars") % 97).cast("string")).alias("entity"), F.substring_index("text", ".", 1).alias("question"), F.substring_index("text", " ", 2).alias("name"), "text",
    )


def leak_question_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.question_overlap(_example_rows(spark, sf_dir))


def leak_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.entity_overlap(_example_rows(spark, sf_dir))


def leak_entity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.entity_overlap(_example_rows(spark, sf_dir)).agg(F.countDistinct("entity").alias("leaked"))


def twin_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.twin_overlap(_example_rows(spark, sf_dir))


def leak_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import search
    from .tables import cards, questions

    hits = search(cards(spark, sf_dir), questions(spark, sf_dir), 6).select("query_id", "card_id")
    held = table(spark, sf_dir, "documents").where(entity_group(F.col("doc_id").cast("string")).startswith("heldout")).select(F.col("doc_id").alias("card_id"))
    return s.context_overlap(hits, held).select("query_id", "card_id")


def mention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _example_rows(spark, sf_dir)
    return mentions.mentioned(rows.where("split <> 'train'").select("id", "name"), rows.where("split = 'train'").select("text"))


def mention_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the training conversations mention, also across the border of two messages or conversations."""
    said = table(spark, sf_dir, "conversations").where(~entity_group(F.col("conv_id").cast("string")).startswith("heldout")).select("conv_id", "turn", "text")
    names = table(spark, sf_dir, "conversations").where(entity_group(F.col("conv_id").cast("string")).startswith("heldout"))
    words = F.split(F.trim(tx.plain_words(F.coalesce("text", F.lit("")))), " ")
    needles = names.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.array_join(F.slice(words, 2, 2), " ").alias("name"))
    return mentions.mentioned(needles, said, order=("conv_id", "turn"))


def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _example_rows(spark, sf_dir)
    return rows.groupingSets([[F.col("split"), F.col("group")], [F.col("split"), F.col("source")], [F.col("split")]], "split", "group", "source").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("role")).alias("id"))
    return keyed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


QUERIES = {f.__name__: f for f in (hash_split_groups, twin_safe_split, bernoulli_share, caps_per_group, dedup_keep_first, dedup_keep_best, twin_merge, parent_lookup, section_parent, reference_fallback, slot_rotation, slot_pick2, slot_argmin, leak_question_overlap, leak_entity, leak_entity_audit, twin_leak, leak_context, mention_filter, mention_across, split_stats, duplicate_ids)}

_I = duck.stable_int
_DOC = "doc_id::VARCHAR"
_NAME_KEY = f"regexp_replace({duck.fold('name')}, '[^a-z0-9]', '', 'g')"
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_PART_KEY = "'p' || p_partkey || '|price'"
_SPLIT = f"""e AS (SELECT *, CASE g WHEN 'heldout_val' THEN 'validation' WHEN 'heldout_test' THEN 'test' ELSE 'train' END AS split, CASE WHEN g LIKE 'heldout%' THEN 'heldout_open' ELSE 'seen' END AS "group",
  {_DOC} AS id, source || '-' || (n_chars % 97) AS entity, split_part(text, '.', 1) AS question, CASE WHEN len(string_split(text, ' ')) > 2 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) ELSE text END AS name
  FROM (SELECT *, {duck.entity_group(_DOC)} AS g FROM documents))"""
_QKEY = f"trim(regexp_replace({duck.fold('question')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_PLAIN = "list_filter(string_split(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _flag(salt: str, share: float) -> str:
    return f"{_I(repr(salt), _DOC + ' || ' + repr('|fact'))} % 10000 < {share * 10000} AS {salt}"


ORACLES = {
    "hash_split_groups": f"SELECT doc_id, {_I(repr('bucket'), _DOC)} AS h, {_I(repr('bucket'), _DOC)} % 100 AS bucket, {duck.entity_group(_DOC)} AS split_group FROM documents",
    "twin_safe_split": f"WITH n AS (SELECT doc_id, split_part(text, '.', 1) AS name FROM documents) SELECT doc_id, {_NAME_KEY} AS name_key, {duck.entity_group(repr('namaste:') + ' || ' + _NAME_KEY)} AS split_group FROM n",
    "bernoulli_share": f"SELECT doc_id, {', '.join(_flag(a, b) for a, b in (('open', 0.35), ('miss', 0.04), ('val', 0.08), ('test', 0.12), ('control', 0.5)))} FROM documents",
    "caps_per_group": f"SELECT id, lang, source FROM (SELECT {_DOC} AS id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_I(repr('cap'), repr('test'), _DOC)}, {_DOC}) AS n FROM documents) WHERE lang <> 'en' OR n <= 15",
    "dedup_keep_first": "WITH n AS (SELECT doc_id, split_part(text, '.', 1) AS title, lang FROM documents) SELECT doc_id, title, lang FROM n WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY doc_id) = 1",
    "dedup_keep_best": f"WITH n AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, n_chars FROM documents) SELECT doc_id, title, n_chars FROM n QUALIFY row_number() OVER (PARTITION BY {_SLUG.format('title')} ORDER BY n_chars DESC, doc_id) = 1",
    "twin_merge": f"""WITH n AS (SELECT CASE WHEN len(string_split(text, ' ')) > 2 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) ELSE text END AS t, doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS source FROM documents)
SELECT {_SLUG.format('t')} AS key, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, coalesce(arg_min(source, doc_id) FILTER (source <> ''), '') AS source FROM n GROUP BY 1""",
    "parent_lookup": """WITH c AS (SELECT p_partkey, p_brand || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || p_size ELSE '-' || p_size END AS code FROM part),
f AS (SELECT code, min(p_partkey) AS pid FROM c GROUP BY code),
k AS (SELECT *, CASE WHEN contains(code, '.') THEN regexp_extract(code, '^(.*)[.]', 1) END AS a, CASE WHEN contains(code, '-') THEN regexp_extract(code, '^(.*)-', 1) END AS b FROM c)
SELECT p_partkey, k.code, coalesce(nullif(x.pid, p_partkey), nullif(y.pid, p_partkey)) AS parent FROM k LEFT JOIN f x ON a = x.code LEFT JOIN f y ON b = y.code""",
    "section_parent": """WITH l AS (SELECT p_brand, p_size, max(p_partkey) AS pid, arg_max(p_name, p_partkey) AS nm FROM part GROUP BY ALL)
SELECT p_partkey, CASE WHEN nm <> '' AND pid <> p_partkey THEN pid END AS parent FROM part LEFT JOIN l ON part.p_brand = l.p_brand AND part.p_size % 7 = l.p_size""",
    "reference_fallback": """WITH r AS (SELECT s_nationkey AS key, arg_max(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, s_suppkey) AS ref FROM supplier GROUP BY 1)
SELECT n_nationkey, coalesce(nullif(a.ref, ''), nullif(b.ref, ''), '') AS reference FROM nation LEFT JOIN r a ON a.key = n_nationkey LEFT JOIN r b ON b.key = n_nationkey + 1""",
    "slot_rotation": f"SELECT p_partkey, slot::INT AS slot FROM part, range(4) AS t(slot) WHERE slot <> {_I(repr('skip'), _PART_KEY)} % 4",
    "slot_pick2": f"SELECT p_partkey, (n - 1)::INT AS place, slot::INT AS slot FROM (SELECT p_partkey, slot, row_number() OVER (PARTITION BY p_partkey ORDER BY {_I(repr('nm-slot'), _PART_KEY, 'slot::VARCHAR')}, slot) AS n FROM part, range(4) AS t(slot)) WHERE n <= 2",
    "slot_argmin": f"SELECT p_partkey, slot::INT AS slot, {_I(repr('test-slot'), _PART_KEY)} % 2 + 5 AS test_slot FROM part, range(4) AS t(slot) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY {_I(repr('rag'), _PART_KEY, 'slot::VARCHAR')}, slot) = 1",
    "leak_question_overlap": f"WITH {_SPLIT}, k AS (SELECT *, {_QKEY} AS q FROM e) SELECT split, id FROM k WHERE split <> 'train' AND q IN (SELECT q FROM k WHERE split = 'train')",
    "leak_entity": f"WITH {_SPLIT} SELECT DISTINCT entity FROM e WHERE split <> 'train' AND entity IN (SELECT entity FROM e WHERE split = 'train')",
    "leak_entity_audit": f"WITH {_SPLIT} SELECT count(DISTINCT entity) AS leaked FROM e WHERE split <> 'train' AND entity IN (SELECT entity FROM e WHERE split = 'train')",
    "twin_leak": f"WITH {_SPLIT}, k AS (SELECT *, {_NAME_KEY} AS k FROM e) SELECT split, id, entity FROM k WHERE split <> 'train' AND k IN (SELECT k FROM k WHERE split = 'train')",
    "mention_filter": f"""WITH {_SPLIT}, n AS (SELECT id, w, len(w) AS n, array_to_string(w, ' ') AS run FROM (SELECT id, {_PLAIN.format(duck.fold('name'))} AS w FROM e WHERE split <> 'train')),
t AS (SELECT ' ' || array_to_string({_PLAIN.format(duck.fold('text'))}, ' ') || ' ' AS x FROM e WHERE split = 'train'),
r AS (SELECT DISTINCT run FROM n WHERE length(run) >= 4),
h AS (SELECT run FROM r WHERE EXISTS (SELECT 1 FROM t WHERE contains(t.x, ' ' || r.run || ' ')))
SELECT id FROM n JOIN h USING (run)""",
    "mention_across": f"""WITH c AS (SELECT *, {duck.entity_group("conv_id::VARCHAR")} AS g, {_PLAIN.format(duck.fold("coalesce(text, '')"))} AS w FROM conversations),
n AS (SELECT conv_id || '-' || turn AS id, array_to_string(w[2:3], ' ') AS run FROM c WHERE starts_with(g, 'heldout')),
t AS (SELECT ' ' || string_agg(array_to_string(w, ' '), ' ' ORDER BY conv_id, turn) FILTER (WHERE len(w) > 0) || ' ' AS x FROM c WHERE NOT starts_with(g, 'heldout')),
r AS (SELECT DISTINCT run FROM n WHERE length(run) >= 4),
h AS (SELECT run FROM r, t WHERE contains(t.x, ' ' || r.run || ' '))
SELECT id FROM n JOIN h USING (run)""",
    "split_stats": f'WITH {_SPLIT} SELECT split, "group", source, count(*) AS n, count(DISTINCT entity) AS entities FROM e GROUP BY GROUPING SETS ((split, "group"), (split, source), (split))',
    "duplicate_ids": "SELECT concat_ws('-', conv_id::VARCHAR, role) AS id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1",
}


def _leak_context_sql() -> str:
    from .retrieval_queries import _ITEMS, _ranked

    return f"WITH {_ranked(_ITEMS)} SELECT query_id, card_id FROM r WHERE rank <= 6 AND card_id IN (SELECT doc_id FROM documents WHERE starts_with({duck.entity_group(_DOC)}, 'heldout'))"


ORACLES["leak_context"] = _leak_context_sql()
