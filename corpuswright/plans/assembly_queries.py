"""Entities, facts, cards and conversation rows over source tables that are made of the driver's tables.

The inputs are columns that both engines make by the same expressions. What is expected of them is written into the
SQL as text: sentences for each value, not the rules that make them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import scoring
from ..operators import assembly, corpus, entities, evaluation, splits
from ..shared import cut, root, spread
from ..sources import build
from . import duck
from .tables import table


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(by: str, values: list[str]) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


# Values of the source tables, each with what sentences should make of it.
_DOSHAS = [  # value, factors, sentence about {n}, sentence about It
    ("Vata", "vata", "{n} is predominantly a Vata disorder.", "It is predominantly a Vata disorder."),
    ("Pitta-Vata", "pitta|vata", "{n} is mainly caused by Pitta and Vata.", "It is mainly caused by Pitta and Vata."),
    ("Tridosha", "vata|pitta|kapha", "{n} is a tridoshic disorder involving all three doshas - Vata, Pitta and Kapha.", "It is a tridoshic disorder involving all three doshas - Vata, Pitta and Kapha."),
    ("Agantuja", "agantuja", "{n} is classified as Agantuja: it is caused by external factors such as injury, poison or bites rather than primarily by a dosha imbalance.", "It is classified as Agantuja: it is caused by external factors such as injury, poison or bites rather than primarily by a dosha imbalance."),
    ("Balanced", "balanced", "{n} does not have a single predominant dosha.", "It does not have a single predominant dosha."),
    ("Rajas", "rajas", "{n} is a disorder of the mind involving the mental dosha Rajas.", "It is a disorder of the mind involving the mental dosha Rajas."),
    ("Rajas/Tamas", "rajas|tamas", "{n} is a disorder of the mind involving the mental doshas Rajas and Tamas.", "It is a disorder of the mind involving the mental doshas Rajas and Tamas."),
    ("Tridosha, Krimi", "vata|pitta|kapha|krimi", "{n} involves all three doshas (Vata, Pitta and Kapha) along with Krimi (parasites).", "It involves all three doshas (Vata, Pitta and Kapha) along with Krimi (parasites)."),
    ("Kapha-Tridosha", "kapha|vata|pitta", "{n} involves all three doshas (Vata, Pitta and Kapha), with Kapha most prominent.", "It involves all three doshas (Vata, Pitta and Kapha), with Kapha most prominent."),
    ("Pitta/Rakta", "pitta|rakta", "The predominant factors in {n} are Pitta and Rakta (blood).", "Its predominant factors are Pitta and Rakta (blood)."),
    ("Kapha, Meda , Ama", "kapha|meda|ama", "The predominant factors in {n} are Kapha, Meda (fat tissue) and Ama (undigested metabolic waste).", "Its predominant factors are Kapha, Meda (fat tissue) and Ama (undigested metabolic waste)."),
    ("Vata, Kapha prakriti", "vata", "{n} is predominantly a Vata disorder.", "It is predominantly a Vata disorder."),
]
_SYSTEMS = [  # value, parts, sentence
    ("Skin", "skin", "{n} mainly affects the skin."),
    ("Systemic", "systemic", "{n} is a systemic condition that affects the whole body."),
    ("Nervous / Mental", "nervous|mental", "{n} mainly affects the nervous system and the mind (it is a mental disorder)."),
    ("Mental", "mental", "{n} is a mental disorder: it affects the mind."),
    ("Paediatric", "paediatric", "{n} is a paediatric condition, seen in children."),
    ("Eye/Ear/Nose", "eye|ear|nose", "{n} mainly affects the eyes, the ears and the nose."),
]
_PROGNOSES = [("Curable", "{n} is generally considered curable."), ("Moderate", "The prognosis of {n} is moderate."), ("Difficult", "{n} is considered difficult to cure."), ("Variable", "The prognosis of {n} is variable and depends on the individual case."), ("Incurable", "{n} is traditionally considered incurable.")]
_TREATMENTS = [  # value, items, sentence
    ("Rest, Warm oil (sesame, castor)", "Rest|Warm oil (sesame, castor)", "Classical Ayurvedic management of {n} includes rest and warm oil (sesame, castor). This is educational information, not a prescription."),
    ("Incurable; Poor prognosis", "", "No specific treatment principles are recorded for {n}. This is educational information, not a prescription."),
    ("Fasting.", "Fasting", "Classical Ayurvedic management of {n} includes fasting. This is educational information, not a prescription."),
    ("ORS, Steam; Swedana therapy", "ORS|Steam|Swedana therapy", "Classical Ayurvedic management of {n} includes ORS, steam and swedana therapy. This is educational information, not a prescription."),
]
_SYMPTOMS = [  # value, items, as listed in a sentence
    ("Pain, Swelling (red, hot); fever", "Pain|Swelling (red, hot)|fever", "pain, swelling (red, hot) and fever"),
    ("Cough", "Cough", "cough"),
    ("Itching ; Dry  skin.", "Itching|Dry skin", "itching and dry skin"),
]

_CONDITION = {
    "idx": "p_partkey", "Ayurvedic Name": "CASE WHEN p_partkey % 97 = 5 THEN '  ' ELSE concat(' ', p_name, '  ', p_partkey % 40) END", "Ayurvedic Code": "concat('K ', p_partkey)",
    "Modern Equivalent": "CASE WHEN p_partkey % 3 = 0 THEN concat(p_type, ' / ', p_brand) ELSE p_type END", "System / Body Part": _pick("p_partkey", [x[0] for x in _SYSTEMS]), "Dosha Predominance": _pick("p_partkey", [x[0] for x in _DOSHAS]),
    "Prognosis": _pick("p_partkey", [x[0] for x in _PROGNOSES]), "Symptoms": _pick("p_partkey", [x[0] for x in _SYMPTOMS]), "Treatment Principles": _pick("p_partkey", [x[0] for x in _TREATMENTS]), "Source Text": _pick("p_partkey", ["Charaka Samhita", "Madhava Nidana"]),
}
_DISEASE = {
    "idx": "p_partkey", "Disease": "concat('Ache of ', p_name, CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END)", "Hindi Name": "CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE concat('हिन्दी ', p_partkey % 3) END", "Marathi Name": "CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE concat('हिन्दी ', p_partkey % 2) END",
    "Symptoms": _pick("p_partkey", [x[0] for x in _SYMPTOMS]), "Doshas": _pick("p_partkey", ["Vata", "Kapha, Pitta"]), "Constitution/Prakriti": _pick("p_partkey", ["Pitta", "Vata-Kapha"]),
    "Ayurvedic Herbs": "CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE 'Triphala, Neem (leaf, bark)' END", "Yoga & Physical Therapy": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'Tadasana; Walking' END", "Diet and Lifestyle Recommendations": "concat('Eat warm, fresh food; Sleep by ', p_size % 4 + 8)",
}
_DIAGNOSIS = {
    "idx": "p_partkey", "NAMC_ID": "concat(p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END)", "NAMC_CODE": "CASE WHEN p_partkey % 50 = 7 THEN '' WHEN p_partkey % 4 = 0 THEN concat('AA-', p_partkey % 15) WHEN p_partkey % 4 = 1 THEN concat('AA-', p_partkey % 15, '.', p_partkey, ' (SN3Y)') ELSE concat('AA-', p_partkey % 15, '.', p_partkey) END",
    "NAMC_term_diacritical": "concat('(a) vāta-', p_name, ' ', p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '/ rogaḥ ; / śūla' ELSE '' END)", "NAMC_term_DEVANAGARI": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('वात ', p_partkey % 9) END",
    "Name English": "CASE WHEN p_partkey % 41 = 3 THEN '-' ELSE concat(p_type, ' pain ', p_partkey % 30, CASE WHEN p_partkey % 8 = 0 THEN ' (TM2)' WHEN p_partkey % 8 = 1 THEN ' (severe)' ELSE '' END) END",
    "Long_definition": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'It is characterized by jvaraḥ [fever], śītam by deha [feeling of cold]' WHEN 2 THEN 'The disorder is characterised by: swelling, pain and heat. This may be explained by vāta.' WHEN 3 THEN 'null' ELSE concat('dryness of ', p_name) END",
}
_TERM = {
    "idx": "c_custkey", "t_id": "concat(c_custkey % 300)", "parent_id": "concat(c_custkey % 7)", "term_id": "CASE WHEN c_custkey % 5 = 4 THEN concat('AA-', c_custkey % 15, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('.', c_custkey) END) WHEN c_custkey < 4 THEN concat('SAT-', chr(65 + CAST(c_custkey % 4 AS INT))) ELSE concat('SAT-', chr(65 + CAST(c_custkey % 4 AS INT)), ' .', c_custkey) END",
    "term_iast": "CASE WHEN c_custkey % 31 = 6 THEN '' ELSE concat('guṇa', c_custkey % 500) END", "term_devanagari": "CASE WHEN c_custkey % 2 = 0 THEN 'गुण' ELSE '' END", "w_trans": "CASE WHEN c_custkey % 6 = 5 THEN '' ELSE concat('quality ', c_custkey % 11) END",
    "w_def": "CASE c_custkey % 6 WHEN 0 THEN concat('Quality ', c_custkey % 11) WHEN 1 THEN 'none' WHEN 2 THEN 'a #san@guṇa# of things.' WHEN 5 THEN CASE WHEN c_custkey % 12 = 5 THEN '' ELSE 'what is felt' END ELSE 'That which is seen' END",
    "refn": "CASE c_custkey % 4 WHEN 0 THEN 'Ca.Su.20/17; Su.U. 43/6;Ca.Ni. 1' WHEN 1 THEN '' WHEN 2 THEN 'Xx.1; page 4' ELSE 'Sha.2/ 3' END",
}


def _source(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return spread(table(spark, sf_dir, name)).select(*(F.expr(e).alias(c) for c, e in columns.items()))


def _made(spark: SparkSession, sf_dir: str, *kinds: str) -> dict[str, DataFrame]:
    """Entities of the given kinds, or of all; others aren't made."""
    terminology = _source(spark, sf_dir, "customer", _TERM)
    makers = {
        "ak": lambda: entities.conditions(_source(spark, sf_dir, "part", _CONDITION), normalised=False),
        "ag": lambda: entities.diseases(_source(spark, sf_dir, "part", _DISEASE), normalised=False),
        "nm": lambda: entities.diagnoses(_source(spark, sf_dir, "part", _DIAGNOSIS), terminology, normalised=False),
        "sat": lambda: entities.terms(terminology, normalised=False),
    }
    grouped = {k: entities.grouped(make()) for k, make in makers.items() if not kinds or k in kinds}
    return {k: entities.with_parents(v) if k in ("nm", "sat") else v for k, v in grouped.items()}


def _facts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = entities.FACTS[kind](_made(spark, sf_dir, kind)[kind])
    return rows.select("entity", "name", F.col("group").alias("split_group"), "place", "attribute", "answer", F.col("gold.type").alias("gold_type"), F.array_join("gold.values", "|").alias("vals"))


def condition_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "ak")


def disease_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "ag")


def diagnosis_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "nm")


def term_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "sat")


def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all four kinds, one below the other."""
    made = _made(spark, sf_dir)
    return entities.cards(made, {"ak": F.concat(F.lit("A - "), F.col("source_text")), "ag": "B", "nm": "C", "sat": "D"})


def modern_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.modern_lookups(_made(spark, sf_dir, "ak")["ak"], _templates(spark)).select("split", "id", "entity", F.col("group").alias("grp"), "slot", "question", "answer", F.array_join("gold.values", "|").alias("vals"))


def english_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.english_lookups(_made(spark, sf_dir, "nm")["nm"], _templates(spark)).select("split", "id", "entity", F.col("group").alias("grp"), "slot", "question", "answer", F.array_join("gold.values", "|").alias("vals"))


_ATTRIBUTES = {
    "ak": ("modern_equivalent", "dosha", "body_system", "prognosis", "symptoms", "source_text", "treatment", "overview", "reverse_name"),
    "ag": ("doshas", "prakriti", "symptoms", "diet_lifestyle", "overview", "herbs", "yoga", "hindi_name"),
    "nm": ("nm_english", "nm_code", "nm_features", "nm_category", "reference", "nm_reverse"),
    "sat": ("sat_meaning", "sat_category", "reference"),
}
_SHAPES = ("{a} of {name}?", "What is the {a} of {name}?", "Tell the {a} of {name}.", "{name}: which {a}?", "Of {name}, the {a}?", "Say the {a} of {name}.", "{name} has what {a}?")


def _templates(spark: SparkSession) -> DataFrame:
    """Question templates of this module; a user's own are read by ``sources.files.read_templates``."""
    rows = [(k, a, i, t.replace("{a}", a)) for k, attributes in _ATTRIBUTES.items() for a in attributes for i, t in enumerate(_SHAPES)]
    return spark.createDataFrame(rows, "kind string, attribute string, slot int, text string")


_FILLERS = {"herb": ["Neem", "Brahmi", "Giloy"], "condition": ["asthma", "acidity"], "drug": ["insulin", "an inhaler", "metformin", "thinners"]}
_ANSWERS = {"dose": "Ask a practitioner about {herb}.", "emergency": "Call for help.", "medication": "Keep taking {drug}."}


def _safety_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'test' ELSE 'train' END").alias("split"), F.expr(_pick("n_nationkey", list(_ANSWERS))).alias("kind"), F.col("n_nationkey").cast("int").alias("place"),
        F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat('May I take {herb} in ', n_name, '?') WHEN 1 THEN concat(n_name, ': {herb} or {drug} for {condition}?') ELSE concat('Help, ', n_name, '!') END").alias("prompt"),
    )


def safety_prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembly.safety_rows(_safety_prompts(spark, sf_dir), _FILLERS, _ANSWERS)
    return rows.select("split", "id", "question", "answer", "attribute", "gold.kind")


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.array(*(F.concat(F.col("n_name"), F.lit(x)) for x in ("?", " is what?", " - explain.", ", please?", " means?")))
    return table(spark, sf_dir, "nation").select(F.expr("CASE WHEN n_nationkey = 3 THEN 'greeting' ELSE concat('c', n_nationkey) END").alias("id"), shapes.alias("questions"), F.concat(F.lit(" "), F.col("n_name"), F.lit(" is a nation. ")).alias("answer"), F.array(F.lower("n_name")).alias("key_terms"))


def concept_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("int").alias("place"), F.concat(F.lit(" Where is "), F.col("r_name"), F.lit("?")).alias("question"), F.concat(F.col("r_name"), F.lit(" is here. ")).alias("answer"))
    rows = assembly.concept_rows(_concepts(spark, sf_dir)).unionByName(assembly.pair_rows(pairs))
    return rows.select("split", "id", "question", "answer", "source", "attribute", F.col("group").alias("grp"), "open_book", "gold_id", F.col("gold.type").alias("gold_type"))


_ASK = {"train": ["I have {symptoms}. What is it?", "Diagnose {symptoms}."], "test": ["Since days I have {symptoms}."]}
_TOLD = "I can't say. Texts describe {symptoms} as features of {name} ({modern})."


def diagnosis_prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembly.diagnosis_rows(_made(spark, sf_dir, "ak")["ak"], _ASK, _TOLD, {"train": 150, "test": 15})
    return rows.select("split", "id", "question", "answer", "entity")


_FOLLOW = [(a, i, t) for a, texts in {"prognosis": ("Is it curable?", "And its prognosis?"), "dosha": ("Which dosha is behind it?",), "symptoms": ("And its symptoms?", "How does it show?"), "nm_code": ("What is its code?",), "reference": ("Which text?",), "nm_english": ("And in English?",)}.items() for i, t in enumerate(texts)]


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, templates = {k: cut(v, k) for k, v in _made(spark, sf_dir).items()}, _templates(spark)
    facts = cut(entities.facts(made), "facts")
    follow = spark.createDataFrame(_FOLLOW, "attribute string, place int, follow string")
    out = assembly.fact_rows(facts, templates)
    for kinds, most in ((("ak", "ag"), 500), (("nm", "sat"), 400)):
        out = out.unionByName(assembly.follow_up_rows(facts.where(F.col("kind").isin(*kinds)), templates, follow, most, f"two-turn-{kinds[0]}"))
    out = out.unionByName(assembly.modern_lookups(made["ak"], templates)).unionByName(assembly.english_lookups(made["nm"], templates))
    out = out.unionByName(assembly.concept_rows(_concepts(spark, sf_dir))).unionByName(assembly.safety_rows(_safety_prompts(spark, sf_dir), _FILLERS, _ANSWERS))
    return cut(out.unionByName(assembly.diagnosis_rows(made["ak"], _ASK, _TOLD, {"train": 150, "test": 15})), "drafts")


def assembled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the whole corpus: drafted, capped, filtered and made into rows, without entries."""
    kept, _ = assembly.evaluation_rows(_drafts(spark, sf_dir), splits.caps_table(spark))
    return assembly.stats(assembly.rows(kept))


def assembled_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many evaluation rows were dropped, and why."""
    return assembly.evaluation_rows(_drafts(spark, sf_dir), splits.caps_table(spark))[1]


def two_turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-turn conversations of seen conditions and diseases with a history."""
    made = _made(spark, sf_dir, "ak", "ag")
    follow = spark.createDataFrame(_FOLLOW, "attribute string, place int, follow string")
    facts = cut(entities.facts({k: made[k] for k in ("ak", "ag")}), "facts")
    rows = assembly.rows(assembly.follow_up_rows(facts, _templates(spark), follow, 500, "two-turn"))
    return rows.select("id", F.to_json("messages").alias("messages"), "meta.entity", "meta.attribute")


def open_book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of held-out diseases with the entries that retrieval finds for their questions."""
    known = cut(_made(spark, sf_dir, "ag")["ag"], "diseases")
    cards = cut(entities.cards({"ag": known}, {"ag": "B"}), "cards")
    drafts = cut(assembly.fact_rows(entities.facts({"ag": known}), _templates(spark)).where("open_book"), "drafts")
    held = known.where("startswith(`group`, 'heldout')").select(F.col("id").alias("card_id"))
    rows = assembly.rows(drafts, assembly.entries(drafts, cards, held))
    return rows.select("split", "id", F.size("meta.context_ids").alias("entries"), F.array_contains("meta.context_ids", F.col("meta.entity")).alias("has_gold"), F.contains(F.col("messages")[0]["content"], F.lit("Knowledge base entries:")).alias("opened"))


def _disease_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts, cards and entities of all diseases, with safety prompts."""
    known, templates = cut(_made(spark, sf_dir, "ag")["ag"], "diseases"), _templates(spark)
    follow = spark.createDataFrame(_FOLLOW, "attribute string, place int, follow string")
    facts = cut(entities.facts({"ag": known}), "facts")
    drafts = assembly.fact_rows(facts, templates).unionByName(assembly.follow_up_rows(facts, templates, follow, 500, "two-turn-ag"))
    drafts = cut(drafts.unionByName(assembly.safety_rows(_safety_prompts(spark, sf_dir), _FILLERS, _ANSWERS)), "drafts")
    return drafts, cut(entities.cards({"ag": known}, {"ag": "B"}), "cards"), known


def published_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their entries of a corpus of all diseases that passed every guard, read from the version that was published."""
    drafts, cards, known = _disease_corpus(spark, sf_dir)
    path = f"{root(spark)}/corpuswright/corpus-{uuid.uuid4().hex}"
    corpus.publish(spark, path, drafts, cards, known, splits.caps_table(spark), "Answer from the texts.")
    rows = build.current(spark, path)[0]["rows"]
    return rows.select("split", "id", F.col("meta.group").alias("grp"), F.size("meta.context_ids").alias("entries"), F.size("messages").alias("messages"), F.sha2(F.to_json("messages"), 256).alias("sha256"))


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact's own answer scored against its gold value, and that of the condition with the next value for three attributes."""
    facts = cut(entities.facts(_made(spark, sf_dir)), "facts")
    own = facts.select("entity", "kind", "name", "attribute", "answer", F.lit("own").alias("whose"), "gold")
    part = table(spark, sf_dir, "part")
    told = lambda rows, i: _pick("(p_partkey + 1)", [r[i].replace("{n}", "It") for r in rows])
    shown = {"dosha": ("dosha_set", _pick("p_partkey", [x[1] for x in _DOSHAS]), told(_DOSHAS, 2)), "prognosis": ("category", _pick("p_partkey", [x[0].lower() for x in _PROGNOSES]), told(_PROGNOSES, 1)), "body_system": ("system", _pick("p_partkey", [x[1] for x in _SYSTEMS]), told(_SYSTEMS, 2))}
    for attribute, (kind, values, answer) in shown.items():
        g = entities.gold(kind, F.split(F.expr(values), "[|]"))
        own = own.unionByName(part.select(F.expr("concat('p', p_partkey)").alias("entity"), F.lit("ak").alias("kind"), F.col("p_name").alias("name"), F.lit(attribute).alias("attribute"), F.expr(answer).alias("answer"), F.lit("next").alias("whose"), g.alias("gold")))
    s = scoring.score_row(F.col("answer"), F.col("gold"), F.col("name"), F.col("kind"), F.col("attribute"))
    scored = own.select("entity", "attribute", "whose", F.explode(F.array(s)).alias("s"))
    return scored.select("entity", "attribute", "whose", F.round("s.score", 6).alias("score"), "s.correct")


def english_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", an.english_slug(F.expr("concat(p_type, ' Ächē of ', repeat(p_name, p_size), p_partkey)")).alias("slug"))


def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", an.topic(F.col("source"), F.col("text"), ("Than the", "de la", "und"), {"who": "Question"}, "Other").alias("topic"))


def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths to two digits, where every odd one is a true tie; and tenths of thousandths, whose ties are none in binary."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (scoring.half_even((F.col("p_partkey") - 900) / 8.0, 2) * 100).cast("decimal(20,4)").cast("double").alias("cents"), scoring.percent((F.col("p_partkey") % 1000) / 1000.0).alias("percent"))


def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _pick("doc_id", ["concept-a|4", "safety-test-dose-1-0", "ak-x|dosha|5|open", "nm-4|nm_english|5|closed", "sat-a|reference|6|closed", "ak-x|dosha|6|closed", "rev-tin|5"])
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.group_of(F.expr(ids)).alias("grp"))


def vocabulary_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources of documents no label is of, and whether labels cover all sources."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    missing = splits.set_difference(docs.select(F.concat_ws("-", "source", "lang").alias("k")), labelled.select(F.concat_ws("-", "source", "lang").alias("k")), "k").agg(F.count("*").alias("missing"))
    covered = splits.is_covered(docs.select("source"), labelled.select("source"), "source")
    return missing.join(F.broadcast(covered))


QUERIES = {f.__name__: f for f in (condition_facts, disease_facts, diagnosis_facts, term_facts, entity_cards, modern_lookup_rows, english_lookup_rows, safety_prompt_rows, concept_pair_rows, diagnosis_prompt_rows, assembled_stats, assembled_drops, two_turn_rows, open_book_rows, published_corpus, gold_scores, english_slugs, topic_tags, half_even_rounding, row_groups, vocabulary_cover)}


def _n(sentence: str) -> str:
    return f"replace({sentence}, '{{n}}', name)"


def _cap(x: str) -> str:
    return f"upper({x}[1:1]) || {x}[2:]"


_I, _G = duck.stable_int, duck.entity_group
_KEY = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"
_AK = f"""ak AS (SELECT *, {_G('id')} AS grp FROM (SELECT p_partkey AS i, 'ak-k-' || p_partkey AS id, p_name || ' ' || (p_partkey % 40) AS name, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_type || ' / ' || p_brand ELSE p_type END AS modern,
  CASE WHEN p_partkey % 3 = 0 THEN p_type || '|' || p_brand ELSE p_type END AS modern_vals, {_pick('p_partkey', [x[0] for x in _DOSHAS])} AS dosha, {_pick('p_partkey', [x[1] for x in _DOSHAS])} AS dosha_vals, {_pick('p_partkey', [x[2] for x in _DOSHAS])} AS dosha_s, {_pick('p_partkey', [x[3] for x in _DOSHAS])} AS dosha_it,
  {_pick('p_partkey', [x[0] for x in _SYSTEMS])} AS sys, {_pick('p_partkey', [x[1] for x in _SYSTEMS])} AS sys_vals, {_pick('p_partkey', [x[2] for x in _SYSTEMS])} AS sys_s, {_pick('p_partkey', [x[0] for x in _PROGNOSES])} AS prog, {_pick('p_partkey', [x[1] for x in _PROGNOSES])} AS prog_s,
  {_pick('p_partkey', [x[0].replace('  ', ' ') for x in _SYMPTOMS])} AS sym, {_pick('p_partkey', [x[1] for x in _SYMPTOMS])} AS sym_vals, {_pick('p_partkey', [x[2] for x in _SYMPTOMS])} AS sym_s,
  {_pick('p_partkey', [x[0] for x in _TREATMENTS])} AS treat, {_pick('p_partkey', [x[1] for x in _TREATMENTS])} AS treat_vals, {_pick('p_partkey', [x[2] for x in _TREATMENTS])} AS treat_s, {_pick('p_partkey', ['Charaka Samhita', 'Madhava Nidana'])} AS src
  FROM part WHERE p_partkey % 97 <> 5 QUALIFY row_number() OVER (PARTITION BY lower(p_name || ' ' || (p_partkey % 40)) ORDER BY p_partkey) = 1))"""
_AG = f"""ag AS (SELECT *, {_G('id')} AS grp FROM (SELECT p_partkey AS i, 'ag-ache-of-' || replace(p_name, ' ', '-') AS id, 'Ache of ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'हिन्दी ' || (p_partkey % 3) END AS hindi, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'हिन्दी ' || (p_partkey % 2) END AS marathi, {_pick('p_partkey', [x[0].replace('  ', ' ') for x in _SYMPTOMS])} AS sym, {_pick('p_partkey', [x[1] for x in _SYMPTOMS])} AS sym_vals, {_pick('p_partkey', [x[2] for x in _SYMPTOMS])} AS sym_s,
  {_pick('p_partkey', ['Vata', 'Kapha, Pitta'])} AS dosha, {_pick('p_partkey', ['vata', 'kapha|pitta'])} AS dosha_vals, {_pick('p_partkey', ['Vata', 'Kapha and Pitta'])} AS dosha_s, {_pick('p_partkey', ['Pitta', 'Vata-Kapha'])} AS prak, {_pick('p_partkey', ['pitta', 'vata|kapha'])} AS prak_vals,
  p_partkey % 3 <> 0 AS herbs, p_partkey % 7 <> 0 AS yoga, (p_size % 4 + 8)::VARCHAR AS hour
  FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY (p_partkey % 3 <> 0)::INT + (p_partkey % 7 <> 0)::INT + (p_partkey % 5 <> 0)::INT DESC, p_partkey) = 1))"""
_REFN = "CASE c_custkey % 4 WHEN 0 THEN 'Ca.Su.20/17; Su.U. 43/6;Ca.Ni. 1' WHEN 1 THEN '' WHEN 2 THEN 'Xx.1; page 4' ELSE 'Sha.2/ 3' END"
_NM = f"""rf AS (SELECT 'AA-' || (c_custkey % 15) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.' || c_custkey END AS k, arg_max({_REFN}, c_custkey) AS ref FROM customer WHERE c_custkey % 5 = 4 GROUP BY 1),
n0 AS (SELECT p_partkey AS i, 'nm-' || (p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END) AS id, 'vāta-' || p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 6 = 0 THEN ['rogaḥ', 'śūla'] ELSE [] END AS syn, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'वात ' || (p_partkey % 9) END AS deva,
  p_type || ' pain ' || (p_partkey % 30) || CASE WHEN p_partkey % 8 = 1 THEN ' (severe)' ELSE '' END AS english, p_type || ' pain ' || (p_partkey % 30) AS bare, 'AA-' || (p_partkey % 15) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || p_partkey END AS code, CASE WHEN p_partkey % 4 = 1 THEN 'SN3Y' ELSE '' END AS tm2,
  CASE p_partkey % 5 WHEN 1 THEN 'It is characterized by jvaraḥ [fever], śītam by deha [feeling of cold]' WHEN 2 THEN 'The disorder is characterised by: swelling, pain and heat. This may be explained by vāta.' WHEN 4 THEN 'dryness of ' || p_name ELSE '' END AS def FROM part WHERE p_partkey % 50 <> 7 AND p_partkey % 41 <> 3),
n1 AS (SELECT n0.*, coalesce(ref, '') AS ref FROM n0 LEFT JOIN rf ON k = code),
n2 AS (SELECT id, min(i) AS i, arg_min(name, i) AS name, arg_min(syn, i) AS syn, arg_min(english, i) AS english, arg_min(bare, i) AS bare, arg_min(code, i) AS code, coalesce(arg_min(deva, i) FILTER (deva <> ''), '') AS deva, coalesce(arg_min(tm2, i) FILTER (tm2 <> ''), '') AS tm2, coalesce(arg_min(def, i) FILTER (def <> ''), '') AS def, coalesce(arg_min(ref, i) FILTER (ref <> ''), '') AS ref FROM n1 GROUP BY id),
nf AS (SELECT code AS pc, arg_min(id, i) AS pid FROM n2 GROUP BY code),
n3 AS (SELECT n2.*, CASE WHEN pid <> id THEN pid END AS parent, {_G("'namaste:' || " + _KEY.format('name'))} AS grp FROM n2 LEFT JOIN nf ON contains(code, '.') AND pc = split_part(code, '.', 1)),
nm AS (SELECT a.*, b.name AS p_name, b.english AS p_english, b.bare AS p_bare, b.code AS p_code, b.name IS NOT NULL AND b.grp NOT LIKE 'heldout%' AS tell FROM n3 a LEFT JOIN n3 b ON a.parent = b.id)"""
_SAT = f"""s0 AS (SELECT c_custkey AS i, 'SAT-' || chr(65 + (c_custkey % 4)::INT) AS section, 'SAT-' || chr(65 + (c_custkey % 4)::INT) || CASE WHEN c_custkey < 4 THEN '' ELSE '.' || c_custkey END AS code, CASE WHEN c_custkey % 31 = 6 THEN '' ELSE 'guṇa' || (c_custkey % 500) END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'गुण' ELSE '' END AS deva, CASE WHEN c_custkey % 6 = 5 THEN '' ELSE 'quality ' || (c_custkey % 11) END AS english, CASE WHEN c_custkey % 6 = 2 THEN 'a guṇa of things.' WHEN c_custkey % 12 = 11 THEN 'what is felt' WHEN c_custkey % 6 IN (3, 4) THEN 'That which is seen' ELSE '' END AS def, {_REFN} AS ref, c_custkey % 300 AS t, c_custkey % 7 AS pt FROM customer WHERE c_custkey % 5 <> 4),
s1 AS (SELECT *, replace(lower('sat-' || code), '.', '-') AS id, rtrim(def, ' .') AS short, name <> '' AND (english <> '' OR def <> '') AS kept, {_G("'namaste:' || " + _KEY.format('name'))} AS grp FROM s0),
sl AS (SELECT section, t, arg_max(id, i) AS pid, arg_max(name, i) AS p_name, arg_max(english, i) AS p_english, arg_max(short, i) AS p_short, arg_max(grp, i) AS p_grp, arg_max(kept AND contains(code, '.'), i) AS ok FROM s1 GROUP BY section, t),
s2 AS (SELECT s1.*, coalesce(ok AND pid <> id, false) AS has, pid, p_name, p_english, p_short, p_grp FROM s1 LEFT JOIN sl ON s1.section = sl.section AND pt = sl.t WHERE kept),
sat AS (SELECT *, has AND p_grp NOT LIKE 'heldout%' AS tell FROM s2)"""
_REF = [("'Ca.Su.20/17; Su.U. 43/6;Ca.Ni. 1'", "the Charaka Samhita (Ca.Su.20/17) and the Sushruta Samhita (Su.U.43/6)", "charaka samhita|sushruta samhita"), ("'Sha.2/ 3'", "the Sharangadhara Samhita (Sha.2/3)", "sharangadhara samhita")]


def _told(ctes: str, view: str, facts: list[tuple[str, str, str, str, str]]) -> str:
    """Facts as (attribute, condition, answer, type, values)."""
    rows = " UNION ALL ".join(f"SELECT id, name, grp, {o} AS o, {q(a)} AS attribute, {answer} AS answer, {q(kind)} AS gold_type, {vals} AS vals FROM {view} WHERE {when}" for o, (a, when, answer, kind, vals) in enumerate(facts))
    return f"WITH {ctes}, f AS ({rows}) SELECT id AS entity, name, grp AS split_group, (row_number() OVER (PARTITION BY id, name ORDER BY o) - 1)::INT AS place, attribute, answer, gold_type, vals FROM f"


def _referred_sql() -> list[tuple[str, str, str, str, str]]:
    return [("reference", f"ref = {r}", f"{_cap('name')} || ' is described in {text}.'", "source_any", q(vals)) for r, text, vals in _REF]


_TITLED = f"{_cap('name')} || CASE WHEN deva <> '' THEN ' (' || deva || ')' ELSE '' END"
_DIET = "'eat warm, fresh food and sleep by ' || hour"
_HERBS, _YOGA = "Triphala and Neem (leaf, bark)", "Tadasana and Walking"
_PRAK = "replace(prak, ', ', '-')"
_AG_OVERVIEW = f"'In Ayurveda, ' || name || ' is associated with an imbalance of ' || dosha_s || ', and people with a ' || prak || ' constitution are considered more prone to it. Common symptoms include ' || sym_s || '.' || CASE WHEN herbs THEN ' Herbs traditionally used include {_HERBS}.' ELSE '' END || CASE WHEN yoga THEN ' Helpful yoga includes {_YOGA}.' ELSE '' END"
_CLAUSE = "CASE WHEN def LIKE 'It is%' THEN 'fever (jvaraḥ) and feeling of cold (deha)' WHEN def LIKE 'The %' THEN 'swelling, pain and heat' ELSE def END"
_CLAUSE_VALS = "CASE WHEN def LIKE 'It is%' THEN 'fever|feeling of cold' WHEN def LIKE 'The %' THEN 'swelling|pain|heat' ELSE def END"


def _both(x: str, bare: str) -> str:
    return f"CASE WHEN {x} = {bare} THEN {x} ELSE {bare} || '|' || {x} END"


_LABEL = "CASE WHEN p_english <> '' THEN p_english ELSE p_short END"
ORACLES = {
    "condition_facts": _told(_AK, "ak", [
        ("modern_equivalent", "true", "name || ' corresponds to ' || modern || ' in modern medicine.'", "phrase", "modern_vals"), ("dosha", "true", _n("dosha_s"), "dosha_set", "dosha_vals"), ("body_system", "true", _n("sys_s"), "system", "sys_vals"), ("prognosis", "true", _n("prog_s"), "category", "lower(prog)"),
        ("symptoms", "true", "'The main symptoms of ' || name || ' are ' || sym_s || '.'", "items", "sym_vals"), ("source_text", "true", "name || ' is described in the ' || src || '.'", "category", "lower(src)"), ("treatment", "treat_vals <> ''", _n("treat_s"), "items", "treat_vals"),
        ("overview", "true", f"name || ' is a condition described in the ' || src || ' that corresponds to ' || modern || ' in modern medicine. ' || replace(sys_s, '{{n}}', 'It') || ' ' || dosha_it || ' Its main symptoms are ' || sym_s || '. ' || {_n('prog_s')}", "composite", "''"),
    ]),
    "disease_facts": _told(_AG, "ag", [
        ("doshas", "true", "'In Ayurveda, ' || name || ' is associated with an imbalance of ' || dosha_s || '.'", "dosha_set", "dosha_vals"), ("prakriti", "true", "'People with a ' || prak || ' constitution (prakriti) are considered more prone to ' || name || '.'", "dosha_set", "prak_vals"),
        ("symptoms", "true", "'Common symptoms of ' || name || ' include ' || sym_s || '.'", "items", "sym_vals"), ("diet_lifestyle", "true", f"'For ' || name || ', the recommended diet and lifestyle is to ' || {_DIET} || '.'", "items", "'Eat warm, fresh food|Sleep by ' || hour"), ("overview", "true", _AG_OVERVIEW, "composite", "''"),
        ("herbs", "herbs", f"'Ayurvedic herbs traditionally used for ' || name || ' include {_HERBS}. Please consult a qualified practitioner before using any herb.'", "items", "'Triphala|Neem (leaf, bark)'"), ("yoga", "yoga", f"'Yoga and physical therapy suggested for ' || name || ' include {_YOGA}.'", "items", "'Tadasana|Walking'"),
        ("hindi_name", "hindi <> ''", "'In Hindi, ' || name || ' is called ' || hindi || '.' || CASE WHEN marathi <> '' AND marathi <> hindi THEN ' In Marathi it is called ' || marathi || '.' ELSE '' END", "exact", "hindi"),
    ]),
    "diagnosis_facts": _told(_NM, "nm", [
        ("nm_english", "true", f"{_TITLED} || ' is the Ayurvedic diagnostic term for ' || english || '.'", "phrase", _both("english", "bare")), ("nm_code", "true", "'The NAMASTE code for ' || name || ' is ' || code || '.' || CASE WHEN tm2 <> '' THEN ' It maps to the ICD-11 Traditional Medicine (TM2) code ' || tm2 || '.' ELSE '' END", "exact", "code"),
        ("nm_features", "def <> ''", f"{_cap('name')} || ' is characterized by ' || {_CLAUSE} || '.'", "items", _CLAUSE_VALS), ("nm_category", "tell", f"{_cap('name')} || ' is classified under ' || p_english || ' (' || p_name || ', NAMASTE code ' || p_code || ').'", "phrase", _both("p_english", "p_bare")), *_referred_sql(),
    ]),
    "term_facts": _told(_SAT, "sat", [
        ("sat_meaning", "true", f"{_TITLED} || CASE WHEN english <> '' AND short <> '' THEN ' means \"' || english || '\": ' || short ELSE ' means ' || CASE WHEN english <> '' THEN english ELSE short END END || '.'", "phrase", "concat_ws('|', nullif(english, ''), nullif(short, ''))"),
        ("sat_category", "tell", f"'In the Standardised Ayurveda Terminology, ' || name || ' is listed under ' || {_LABEL} || ' (' || p_name || ').'", "phrase", f"{_LABEL} || '|' || p_name"), *_referred_sql(),
    ]),
    "entity_cards": f"""WITH {_AK}, {_AG}, {_NM}, {_SAT}
SELECT id AS card_id, 'ak' AS kind, name AS title, 'A - ' || src AS source, name || ' (Ayurvedic condition, code K ' || i || '). Modern equivalent: ' || modern || '. Body system: ' || sys || '. Dosha predominance: ' || dosha || '. Prognosis: ' || prog || '. Symptoms: ' || sym || '. Treatment principles: ' || treat || '. Source: ' || src || '.' AS text FROM ak
UNION ALL SELECT id, 'ag', name, 'B', name || CASE WHEN hindi = '' AND marathi = '' THEN '' ELSE ' (' || concat_ws('; ', 'Hindi: ' || nullif(hindi, ''), 'Marathi: ' || nullif(marathi, '')) || ')' END || '. Doshas: ' || dosha || '. Prakriti: ' || prak || '. Symptoms: ' || sym || '. ' || CASE WHEN herbs THEN 'Ayurvedic herbs: Triphala, Neem (leaf, bark). ' ELSE '' END || CASE WHEN yoga THEN 'Yoga: Tadasana; Walking. ' ELSE '' END || 'Diet and lifestyle: Eat warm, fresh food; Sleep by ' || hour FROM ag
UNION ALL SELECT id, 'nm', array_to_string([name] || syn || [english], ' '), 'C', concat_ws(' ', name || ' (' || deva || '; NAMASTE code ' || code || CASE WHEN tm2 <> '' THEN ', ICD-11 TM2 ' || tm2 ELSE '' END || '): ' || english || '.', CASE WHEN len(syn) > 0 THEN 'Also called rogaḥ and śūla.' END, 'Category: ' || p_english || ' (' || p_name || ').', CASE WHEN def <> '' THEN rtrim({_cap('def')}, ' .') || '.' END, 'Classical references: ' || nullif(ref, '') || '.') FROM nm
UNION ALL SELECT id, 'sat', name, 'D', concat_ws(' ', name || ' (' || deva || '; SAT ' || code || ')' || CASE WHEN english <> '' THEN ': ' || english ELSE '' END || '.', CASE WHEN short <> '' THEN {_cap('short')} || '.' END, CASE WHEN has THEN 'Category: ' || CASE WHEN p_english <> '' THEN p_english ELSE p_name END || ' (' || p_name || ').' END, 'Classical references: ' || nullif(ref, '') || '.') FROM sat""",
    "safety_prompt_rows": f"""WITH p AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, {_pick('n_nationkey', list(_ANSWERS))} AS kind, n_nationkey AS place, CASE n_nationkey % 4 WHEN 0 THEN 'May I take {{herb}} in ' || n_name || '?' WHEN 1 THEN n_name || ': {{herb}} or {{drug}} for {{condition}}?' ELSE 'Help, ' || n_name || '!' END AS prompt FROM nation),
f AS (SELECT *, {_I('split', 'kind', 'place::VARCHAR', 'f::VARCHAR')} AS h FROM p, range(3) AS r(f) WHERE f = 0 OR (split = 'train' AND contains(prompt, '{{'))),
v AS (SELECT *, {_FILLERS['herb']}[(h % 3 + 1)::INT] AS herb, {_FILLERS['condition']}[(h // 7 % 2 + 1)::INT] AS cond, {_FILLERS['drug']}[(h // 11 % 4 + 1)::INT] AS drug FROM f)
SELECT split, concat_ws('-', 'safety', split, kind, place, f) AS id, replace(replace(replace(prompt, '{{herb}}', herb), '{{condition}}', cond), '{{drug}}', drug) AS question, CASE kind WHEN 'dose' THEN 'Ask a practitioner about ' || herb || '.' WHEN 'emergency' THEN 'Call for help.' ELSE 'Keep taking ' || drug || '.' END AS answer, 'safety_' || kind AS attribute, kind FROM v""",
    "concept_pair_rows": """WITH c AS (SELECT CASE WHEN n_nationkey = 3 THEN 'greeting' ELSE 'c' || n_nationkey END AS id, n_name, [n_name || '?', n_name || ' is what?', n_name || ' - explain.', n_name || ', please?', n_name || ' means?'] AS questions FROM nation),
r(split, slot, o) AS (VALUES ('train', 0, false), ('train', 1, false), ('train', 2, false), ('train', 0, true), ('validation', 3, false), ('test', 4, false))
SELECT split, 'concept-' || id || '|' || slot || CASE WHEN o THEN '|open' ELSE '' END AS id, questions[slot + 1] AS question, n_name || ' is a nation.' AS answer, 'concept' AS source, 'concept' AS attribute, 'concepts' AS grp, o AS open_book, CASE WHEN o AND id <> 'greeting' THEN 'concept-' || id END AS gold_id, 'terms' AS gold_type FROM c, r
UNION ALL SELECT 'train', 'pdf-' || lpad((r_regionkey + 1)::VARCHAR, 2, '0'), 'Where is ' || r_name || '?', r_name || ' is here.', 'pdf', 'pdf_qa', 'seen', false, NULL, 'none' FROM region""",
    "diagnosis_prompt_rows": f"""WITH {_AK}, s AS (SELECT * FROM ak WHERE grp = 'seen'), d AS (
SELECT 'train' AS split, * FROM (SELECT * FROM s ORDER BY {_I(q('diagnosis-train'), 'id')}, id LIMIT 150) UNION ALL SELECT 'test', * FROM (SELECT * FROM s ORDER BY {_I(q('diagnosis-test'), 'id')}, id LIMIT 15))
SELECT split, 'safety-' || split || '-diagnosis-' || id AS id, CASE WHEN split = 'test' THEN 'Since days I have ' || sym_s || '.' WHEN {_I(q('diagnosis'), 'split', 'id')} % 2 = 0 THEN 'I have ' || sym_s || '. What is it?' ELSE 'Diagnose ' || sym_s || '.' END AS question, 'I can''t say. Texts describe ' || sym_s || ' as features of ' || name || ' (' || modern || ').' AS answer, id AS entity FROM d""",
    "english_slugs": f"""WITH p AS (SELECT p_partkey, p_type || ' Ächē of ' || repeat(p_name, p_size) || p_partkey AS x FROM part) SELECT p_partkey, trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', '-', 'g'), '-')[1:80] || '-' || lpad(({_I(q('slug'), 'x')} % 10000)::VARCHAR, 4, '0') AS slug FROM p""",
    "topic_tags": "WITH d AS (SELECT doc_id, lower(source || ' ' || text) AS x FROM documents) SELECT doc_id, CASE WHEN contains(x, 'than the') THEN 'Than the' WHEN contains(x, 'de la') THEN 'de la' WHEN contains(x, 'und') THEN 'und' WHEN contains(x, 'who') THEN 'Question' ELSE 'Other' END AS topic FROM d",
    "half_even_rounding": "WITH p AS (SELECT p_partkey, (p_partkey - 900) * 25 AS h, p_partkey % 1000 AS t FROM part) SELECT p_partkey, (floor(h / 2.0) + CASE WHEN h % 2 <> 0 AND floor(h / 2.0) % 2 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS cents, (t // 10) || '.' || (t % 10) || '%' AS percent FROM p",
    "row_groups": f"SELECT doc_id, {_pick('doc_id', ['concepts', 'safety', 'heldout_open', 'unseen_closed', 'unseen_closed', 'heldout_closed', 'seen_closed'])} AS grp FROM documents",
    "vocabulary_cover": "WITH l AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT (SELECT count(*) FROM (SELECT DISTINCT source || '-' || lang AS k FROM documents) WHERE k NOT IN (SELECT source || '-' || lang FROM l)) AS missing, (SELECT count(*) = 0 FROM documents WHERE source NOT IN (SELECT source FROM l)) AS covered",
}


def _lookup_sql(ctes: str, view: str, key: str, shown: str, lead: str, attribute: str, term: bool) -> str:
    slots = f"list_sort(list_transform(range(4), lambda z: {{h: {_I(q('nm-slot'), 'key', 'z::VARCHAR')}, z: z}}))"
    train = [f"SELECT *, 'train' AS split, {slots}[{n}].z AS slot, 'seen' AS g FROM k" for n in (1, 2)] if term else [f"SELECT k.*, 'train' AS split, z AS slot, 'seen' AS g FROM k, range(4) AS r(z) WHERE z <> {_I(q('skip'), 'key')} % 4"]
    later = [f"SELECT *, 'test', 5 + {_I(q('test-slot'), 'key')} % 2, 'seen_closed' FROM k WHERE {_I(q('test'), 'key')} % 10000 < 1200"]
    later += [] if term else [f"SELECT *, 'validation', 4, 'seen_closed' FROM k WHERE {_I(q('val'), 'key')} % 10000 < 800"]
    shapes = "[" + ", ".join(q(t.replace("{a}", attribute)) for t in _SHAPES) + "]"
    names = "CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END"
    return f"""WITH {ctes}, m AS (SELECT arg_min(id, i) AS entity, arg_min({shown}, i) AS shown, list(name ORDER BY i) AS l FROM {view} WHERE grp = 'seen' GROUP BY lower({shown})), k AS (SELECT *, {key} AS key FROM m), r AS ({' UNION ALL '.join(train + later)})
SELECT split, key || '|' || slot AS id, entity, g AS grp, slot::INT AS slot, replace({shapes}[slot::INT + 1], '{{name}}', shown) AS question, {lead} || {names} || '.' AS answer, array_to_string(l, '|') AS vals FROM r"""


ORACLES["modern_lookup_rows"] = _lookup_sql(_AK, "ak", "'rev-' || lower(shown)", "p_type", "'In Ayurveda, ' || shown || ' corresponds to '", "reverse_name", False)
ORACLES["english_lookup_rows"] = _lookup_sql(_NM, "nm", f"'nmrev-' || trim(regexp_replace(lower(shown), '[^a-z0-9]+', '-', 'g'), '-')[1:80] || '-' || lpad(({_I(q('slug'), 'shown')} % 10000)::VARCHAR, 4, '0')", "english", "'The Ayurvedic (NAMASTE) term for ' || shown || ' is '", "nm_reverse", True)


def _own_and_next() -> str:
    """Own answers are right, but overviews of diseases also name the factors of the constitution (one for one, or one for two); of next ones, factors are compared as sets (balanced: none), prognoses are wrong, systems by what sentences name."""
    lists = "[" + ", ".join("[" + ", ".join(q(v) for v in x[1].split("|") if v != "balanced") + "]::VARCHAR[]" for x in _DOSHAS) + "]"
    facts = " UNION ALL ".join(f"SELECT entity, attribute, name FROM ({ORACLES[k]})" for k in ("condition_facts", "disease_facts", "diagnosis_facts", "term_facts"))
    # of Skin .. Eye/Ear/Nose, in their order: the share that the next one's sentence names
    share = _pick("p_partkey", ["0", "0", "0.5", "0", "0", "0"])
    n = len(_DOSHAS)
    return f"""WITH own AS ({facts}), d AS (SELECT 'p' || p_partkey AS entity, {lists}[p_partkey % {n} + 1] AS want, {lists}[(p_partkey + 1) % {n} + 1] AS got, {share}::DOUBLE AS sys FROM part)
SELECT entity, attribute, 'own' AS whose, CASE WHEN entity LIKE 'ag-%' AND attribute = 'overview' THEN CASE WHEN name LIKE '%!' THEN 0.75 ELSE 0.833333 END ELSE 1.0 END::DOUBLE AS score, true AS correct FROM own
UNION ALL SELECT entity, 'dosha', 'next', CASE WHEN len(want || got) = 0 THEN 1.0 ELSE round(len(list_intersect(want, got)) / len(list_distinct(want || got)), 6) END, len(want) = len(got) AND len(list_intersect(want, got)) = len(want) FROM d
UNION ALL SELECT entity, 'prognosis', 'next', 0.0, false FROM d UNION ALL SELECT entity, 'body_system', 'next', sys, sys >= 0.5 FROM d"""


ORACLES["gold_scores"] = _own_and_next()
