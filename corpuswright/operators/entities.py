"""Entities from source tables: cleaning, first-wins and best-wins dedup, merged twins, parents and groups.

Source tables have string columns under their own headers and an ``idx`` that numbers their rows. Every entity has
``id``, ``kind``, ``name`` and ``idx``; empty strings stand for what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import text as tx
from ..functions.hashing import entity_group
from ..shared import cut, small
from . import splits

# Headers of the source tables, and what they are called here.
CONDITION_COLUMNS = {"Ayurvedic Name": "name", "Ayurvedic Code": "code", "Modern Equivalent": "modern_equivalent", "System / Body Part": "body_system", "Dosha Predominance": "dosha", "Prognosis": "prognosis", "Symptoms": "symptoms", "Treatment Principles": "treatment", "Source Text": "source_text"}
DISEASE_COLUMNS = {"Disease": "name", "Hindi Name": "hindi_name", "Marathi Name": "marathi_name", "Symptoms": "symptoms", "Doshas": "doshas", "Constitution/Prakriti": "prakriti", "Ayurvedic Herbs": "herbs", "Yoga & Physical Therapy": "yoga", "Diet and Lifestyle Recommendations": "diet_lifestyle"}


def _made_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select`` whose columns are made once a row: as the element of an array they aren't copied to every place that uses them."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("__row")).select("__row.*")


def _cleaned(rows: DataFrame, columns: dict[str, str], normalised: bool) -> DataFrame:
    cells = F.array(*(tx.nfkc(F.col(f"`{a}`")) if normalised else F.col(f"`{a}`") for a in columns))
    made = rows.select("idx", F.explode(F.array(tx.clean_cells(cells))).alias("__cells"))
    return made.select("idx", *(F.col("__cells")[i].alias(b) for i, b in enumerate(columns.values())))


def conditions(rows: DataFrame, normalised: bool = True) -> DataFrame:
    """Kind ak: the first row of each name, whatever its case; unknown factors, systems and prognoses raise when used.

    The kept rows' numbers are found by the name alone; only rows with such a number are made in full.
    """
    narrow = {a: b for a, b in CONDITION_COLUMNS.items() if b == "name"}
    found = cut(splits.first_indices(_cleaned(rows, narrow, normalised), F.lower("name"), "idx"), "first-conditions")
    named = _cleaned(rows.join(small(found), "idx", "left_semi"), CONDITION_COLUMNS, normalised)
    first = splits.keep_first(named, F.lower("name"), "idx")
    return first.select(F.concat(F.lit("ak-"), tx.slug(F.col("code"))).alias("id"), F.lit("ak").alias("kind"), *CONDITION_COLUMNS.values(), "idx")


def diseases(rows: DataFrame, normalised: bool = True) -> DataFrame:
    """Kind ag: of the rows whose names have one slug, the one with most of four fields, the first of equal ones.

    The kept rows' numbers are found by the name and the four fields alone; only rows with such a number are made in full.
    """
    fields = ("herbs", "yoga", "symptoms", "hindi_name")
    key, score = tx.slug(F.col("name")), splits.informativeness(*fields)
    narrow = {a: b for a, b in DISEASE_COLUMNS.items() if b == "name" or b in fields}
    found = cut(splits.best_indices(_cleaned(rows, narrow, normalised).where("name <> ''"), key, score, "idx"), "best-diseases")
    named = _cleaned(rows.join(small(found), "idx", "left_semi"), DISEASE_COLUMNS, normalised).where("name <> ''")
    best = splits.keep_best(named, key, score, "idx")
    return best.select(F.concat(F.lit("ag-"), tx.slug(F.col("name"))).alias("id"), F.lit("ag").alias("kind"), *DISEASE_COLUMNS.values(), "idx")


def _terms(rows: DataFrame, *columns: str, normalised: bool) -> DataFrame:
    return _made_once(rows, "idx", *(tx.clean_term(F.col(f"`{c}`"), normalised).alias(c) for c in columns))


def diagnoses(rows: DataFrame, terminology: DataFrame, normalised: bool = True) -> DataFrame:
    """Kind nm: coded terms with an English name, twins merged, their parent by the code's prefix.

    References stand in the other table, at the raw code or else at the code; rows of that table that are terms of its
    own are left out.
    """
    t = _terms(rows, "NAMC_ID", "NAMC_CODE", "NAMC_term_diacritical", "NAMC_term_DEVANAGARI", "Name English", "Long_definition", normalised=normalised)
    own = t.where("NAMC_CODE <> ''")
    named = _made_once(own, *t.columns, tx.term_name(F.col("NAMC_term_diacritical")).alias("n"), tx.split_code(F.col("NAMC_CODE")).alias("c"), tx.english_name(F.col("Name English")).alias("e")).where("n.name <> '' AND e <> ''")
    shaped = named.select(
        F.concat(F.lit("nm-"), F.col("NAMC_ID")).alias("id"), F.lit("nm").alias("kind"), "n.name", "n.synonyms", F.col("NAMC_term_DEVANAGARI").alias("devanagari"),
        F.col("e").alias("english"), "c.code", "c.tm2", F.col("Long_definition").alias("definition"), F.col("NAMC_CODE").alias("raw_code"), "idx",
    )
    refs = _terms(terminology, "term_id", "refn", normalised=normalised).where("NOT startswith(term_id, 'SAT')").select(F.col("term_id").alias("key"), "idx", F.col("refn").alias("ref"))
    referred = splits.with_fallback(shaped, refs, "raw_code", "code").drop("raw_code")
    merged = cut(splits.merge_twins(referred, "id", "idx", ["definition", "tm2", "reference", "devanagari"]), "diagnoses")
    return splits.by_prefix(merged, "id", "code", "idx")


def terms(rows: DataFrame, normalised: bool = True) -> DataFrame:
    """Kind sat: terms with a meaning or a definition; the parent is found within the section, by its number.

    A definition that repeats the meaning is dropped. Roots of sections and terms that aren't kept are no parents.
    """
    t = _terms(rows, "t_id", "parent_id", "term_id", "term_iast", "term_devanagari", "w_trans", "w_def", "refn", normalised=normalised)
    coded = t.withColumn("code", F.replace("term_id", F.lit(" "), F.lit(""))).where("startswith(code, 'SAT-')")
    own = _made_once(coded, *coded.columns, tx.term_name(F.col("term_iast")).alias("n"))
    shaped = own.select(
        F.concat(F.lit("sat-"), F.replace(F.lower("code"), F.lit("."), F.lit("-"))).alias("id"), F.lit("sat").alias("kind"), "n.name", "n.synonyms", F.col("term_devanagari").alias("devanagari"),
        F.col("w_trans").alias("english"), "code", F.lit("").alias("tm2"), F.expr("CASE WHEN lower(w_def) = lower(w_trans) THEN '' ELSE w_def END").alias("definition"), F.col("refn").alias("reference"),
        F.substring_index("code", ".", 1).alias("section"), "t_id", "parent_id", "idx",
    )
    kept = (F.col("name") != "") & ((F.col("english") != "") | (F.col("definition") != ""))
    found = splits.by_section(cut(shaped, "terms"), "id", ("section", "t_id"), "parent_id", "idx", kept & F.contains("code", F.lit(".")))
    return found.where(kept).drop("section", "t_id", "parent_id")


def grouped(entities: DataFrame) -> DataFrame:
    """Adds ``group``: by id, or for terms by their name but for spelling, so that twins share a split."""
    key = F.when(F.col("kind").isin("nm", "sat"), F.concat(F.lit("namaste:"), tx.group_key(F.col("name")))).otherwise(F.col("id"))
    return tx.once(entities, entity_group(key), "group")


def with_parents(entities: DataFrame) -> DataFrame:
    """Adds the parent's name, English name, code and definition (null without one) and whether it may be told: not if it is held out.

    Only entities that are parents meet the others; ``entities`` are read three times, so they should be a table.
    """
    p = entities.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"), F.col("english").alias("parent_english"), F.col("code").alias("parent_code"), F.col("definition").alias("parent_definition"), F.col("group").alias("parent_group"))
    told = small(cut(p.join(entities.select("parent").distinct(), "parent", "left_semi"), "parents"))
    joined = entities.join(told, "parent", "left")
    return joined.withColumn("tell_parent", F.col("parent_name").isNotNull() & ~F.coalesce(F.col("parent_group").startswith("heldout"), F.lit(False)))


GOLD = "struct<type:string,values:array<string>,parts:array<struct<type:string,values:array<string>>>,kind:string>"


def gold(kind: str, values: Column | None = None, parts: list[tuple[str, Column]] | None = None, safety: str | Column | None = None) -> Column:
    """What an answer is scored against."""
    listed = F.array(*(F.struct(F.lit(t).alias("type"), v.alias("values")) for t, v in parts)) if parts else F.lit(None)
    safety = safety if isinstance(safety, Column) else F.lit(safety)
    return F.struct(F.lit(kind).alias("type"), (values if values is not None else F.array()).alias("values"), listed.alias("parts"), safety.alias("kind")).cast(GOLD)


def _facts(entities: DataFrame, facts: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """The entities' rows with attribute, answer, gold and place of each fact (attribute, there is one, answer, gold)."""
    rows = [F.when(there, F.struct(F.lit(a).alias("attribute"), answer.alias("answer"), g.alias("gold"))) for a, there, answer, g in facts]
    return entities.select(F.col("id").alias("entity"), "kind", "name", "group", F.posexplode(F.array_compact(F.array(*rows))).alias("place", "f")).select("entity", "kind", "name", "group", "place", "f.*")


def modern_alternatives() -> Column:
    return F.filter(F.transform(F.split("modern_equivalent", "/"), lambda x: F.trim(x)), lambda x: x != "")


def condition_facts(entities: DataFrame) -> DataFrame:
    n, c, yes = F.col("name"), F.col, F.lit(True)
    shared = [tx.split_list(c("symptoms")).alias("__symptoms"), an.factor_list(c("dosha")).alias("__factors"), an.treatment_items(c("treatment")).alias("__treated")]
    symptoms, factors, treated = c("__symptoms"), c("__factors"), c("__treated")
    return _facts(_made_once(entities, *entities.columns, *shared), [
        ("modern_equivalent", yes, an.fill("{n} corresponds to {m} in modern medicine.", n=n, m=F.trim("modern_equivalent")), gold("phrase", modern_alternatives())),
        ("dosha", yes, an.dosha_sentence(n, c("dosha")), gold("dosha_set", factors)),
        ("body_system", yes, an.system_sentence(n, c("body_system")), gold("system", an.system_list(c("body_system")))),
        ("prognosis", yes, an.prognosis_sentence(n, c("prognosis")), gold("category", F.array(F.lower("prognosis")))),
        ("symptoms", yes, an.symptoms_sentence(n, c("symptoms")), gold("items", symptoms)),
        ("source_text", yes, an.fill("{n} is described in the {s}.", n=n, s=F.trim("source_text")), gold("category", F.array(F.lower("source_text")))),
        ("treatment", F.size(treated) > 0, an.treatment_sentence(n, c("treatment")), gold("items", treated)),
        ("overview", yes, an.condition_overview(), gold("composite", parts=[("phrase", modern_alternatives()), ("dosha_set", factors), ("items", symptoms)])),
    ])


def disease_facts(entities: DataFrame) -> DataFrame:
    n, c, yes = F.col("name"), F.col, F.lit(True)
    listed = lambda x: tx.join_list(tx.split_list(c(x)))
    shared = [tx.split_list(c("symptoms")).alias("__symptoms"), an.factor_list(c("doshas")).alias("__factors"), tx.split_list(c("diet_lifestyle"), ";").alias("__diet")]
    symptoms, factors, diet = c("__symptoms"), c("__factors"), c("__diet")
    return _facts(_made_once(entities, *entities.columns, *shared), [
        ("doshas", yes, an.fill("In Ayurveda, {n} is associated with an imbalance of {d}.", n=n, d=tx.join_list(an.factor_phrases(factors))), gold("dosha_set", factors)),
        ("prakriti", yes, an.fill("People with a {p} constitution (prakriti) are considered more prone to {n}.", p=an.constitution(c("prakriti")), n=n), gold("dosha_set", an.factor_list(c("prakriti")))),
        ("symptoms", yes, an.fill("Common symptoms of {n} include {i}.", n=n, i=tx.join_list(an.lowered(symptoms))), gold("items", symptoms)),
        ("diet_lifestyle", yes, an.fill("For {n}, the recommended diet and lifestyle is to {i}.", n=n, i=tx.join_list(an.lowered(diet))), gold("items", diet)),
        ("overview", yes, an.disease_overview(), gold("composite", parts=[("dosha_set", factors), ("items", symptoms)])),
        ("herbs", c("herbs") != "", an.fill("Ayurvedic herbs traditionally used for {n} include {i}. {h}", n=n, i=listed("herbs"), h=an.HERB_NOTE), gold("items", tx.split_list(c("herbs")))),
        ("yoga", c("yoga") != "", an.fill("Yoga and physical therapy suggested for {n} include {i}.", n=n, i=listed("yoga")), gold("items", tx.split_list(c("yoga")))),
        ("hindi_name", c("hindi_name") != "", an.named_names(n, c("hindi_name"), c("marathi_name")), gold("exact", F.array("hindi_name"))),
    ])


def _distinct_names(value: Column) -> Column:
    """The name with and without parentheses, sorted; empty ones left out."""
    return F.sort_array(F.array_except(F.array(value, tx.without_parentheses(value)), F.array(F.lit(""))))


def _references() -> Column:
    return tx.first_references(F.col("reference"), an.BOOKS).alias("__refs")


def _referred() -> tuple[str, Column, Column, Column]:
    refs = F.col("__refs")
    return "reference", F.size(refs) > 0, an.reference_sentence(F.col("name"), refs), gold("source_any", F.transform(refs, lambda r: F.lower(r["book"])))


def _titled() -> Column:
    return F.concat(tx.capitalize(F.col("name")), F.when(F.col("devanagari") != "", F.concat(F.lit(" ("), F.col("devanagari"), F.lit(")"))).otherwise(""))


def diagnosis_facts(entities: DataFrame) -> DataFrame:
    """Of entities of kind nm ``with_parents``."""
    n, c = F.col("name"), F.col
    tm2 = F.when(c("tm2") != "", an.fill(" It maps to the ICD-11 Traditional Medicine (TM2) code {t}.", t=c("tm2"))).otherwise("")
    features = c("__features")
    return _facts(_made_once(entities, *entities.columns, tx.features(c("definition")).alias("__features"), _references()), [
        ("nm_english", F.lit(True), an.fill("{n} is the Ayurvedic diagnostic term for {e}.", n=_titled(), e=c("english")), gold("phrase", _distinct_names(c("english")))),
        ("nm_code", F.lit(True), F.concat(an.fill("The NAMASTE code for {n} is {c}.", n=n, c=c("code")), tm2), gold("exact", F.array("code"))),
        ("nm_features", (c("definition") != "") & (F.size(features["items"]) > 0), an.fill("{n} is characterized by {f}", n=tx.capitalize(n), f=tx.sentence(features["clause"])), gold("items", features["items"])),
        ("nm_category", c("tell_parent"), an.fill("{n} is classified under {e} ({p}, NAMASTE code {c}).", n=tx.capitalize(n), e=c("parent_english"), p=c("parent_name"), c=c("parent_code")), gold("phrase", _distinct_names(c("parent_english")))),
        _referred(),
    ])


def term_facts(entities: DataFrame) -> DataFrame:
    """Of entities of kind sat ``with_parents``."""
    c = F.col
    made = F.when(c("definition") != "", tx.short_definition(c("definition"))).otherwise("").alias("__short")
    short = c("__short")
    both = (c("english") != "") & (short != "")
    told = F.when(both, an.fill('{n} means "{e}": {d}', n=_titled(), e=c("english"), d=tx.sentence(short))).otherwise(an.fill("{n} means {e}", n=_titled(), e=tx.sentence(F.when(c("english") != "", c("english")).otherwise(short))))
    label = F.when(c("parent_english") != "", c("parent_english")).otherwise(tx.short_definition(c("parent_definition")))
    return _facts(_made_once(entities, *entities.columns, made, _references()), [
        ("sat_meaning", F.lit(True), told, gold("phrase", F.filter(F.array(c("english"), short), lambda x: x != ""))),
        ("sat_category", c("tell_parent"), an.fill("In the Standardised Ayurveda Terminology, {n} is listed under {l} ({p}).", n=c("name"), l=label, p=c("parent_name")), gold("phrase", F.array(label, c("parent_name")))),
        _referred(),
    ])


FACTS = {"ak": condition_facts, "ag": disease_facts, "nm": diagnosis_facts, "sat": term_facts}
CARDS = {"ak": an.condition_card, "ag": an.disease_card, "nm": an.diagnosis_card, "sat": an.terminology_card}


def facts(entities: dict[str, DataFrame]) -> DataFrame:
    """Facts of all kinds: (entity, kind, name, group, place, attribute, answer, gold)."""
    out = None
    for kind, df in entities.items():
        rows = FACTS[kind](df)
        out = rows if out is None else out.unionByName(rows)
    return out


def cards(entities: dict[str, DataFrame], sources: dict[str, str | Column]) -> DataFrame:
    """Cards (card_id, kind, title, source, text) of all kinds with the given sources."""
    out = None
    for kind, df in entities.items():
        title, text = CARDS[kind]()
        source = sources[kind] if isinstance(sources[kind], Column) else F.lit(sources[kind])
        rows = df.select(F.col("id").alias("card_id"), "kind", title.alias("title"), source.alias("source"), text.alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out
