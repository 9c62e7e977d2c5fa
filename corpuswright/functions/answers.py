"""Sentences that state facts of entities, and the cards that a knowledge base holds of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# How factors, systems and prognoses are named in sentences, and the notes after some.
FACTOR_PHRASES = {
    "vata": "Vata",
    "pitta": "Pitta",
    "kapha": "Kapha",
    "rakta": "Rakta (blood)",
    "meda": "Meda (fat tissue)",
    "krimi": "Krimi (parasites)",
    "ama": "Ama (undigested metabolic waste)",
    "rajas": "Rajas",
    "tamas": "Tamas",
}
SYSTEM_PHRASES = {
    "systemic": "the whole body (it is a systemic condition)",
    "skin": "the skin",
    "gastrointestinal": "the gastrointestinal (digestive) system",
    "eye": "the eyes",
    "nervous": "the nervous system",
    "urinary": "the urinary system",
    "musculoskeletal": "the musculoskeletal system",
    "gynaecology": "the female reproductive system (it is a gynaecological condition)",
    "gyn": "the female reproductive system",
    "respiratory": "the respiratory system",
    "resp": "the respiratory system",
    "nose": "the nose",
    "throat": "the throat",
    "mouth": "the mouth",
    "ear": "the ears",
    "ano-rectal": "the anorectal region",
    "mental": "the mind (it is a mental disorder)",
    "paediatric": "children (it is a paediatric condition)",
    "metabolic": "metabolism",
    "cardiovascular": "the cardiovascular system",
    "abdomen": "the abdomen",
    "blood": "the blood",
    "head": "the head",
    "teeth": "the teeth",
    "reproductive": "the reproductive system",
    "thyroid": "the thyroid gland",
    "liver": "the liver",
    "lymphatic": "the lymphatic system",
    "genital": "the genital organs",
    "parasitic": "the body through parasites (it is a parasitic condition)",
    "gums": "the gums",
    "surgical": "the body in a way that needs surgical care (it is a surgical condition)",
    "obstetric": "pregnancy and childbirth (it is an obstetric condition)",
    "chest": "the chest",
    "spleen": "the spleen",
    "geriatric": "the elderly (it is a geriatric condition)",
    "deep": "the deeper tissues",
    "deep tissue": "the deeper tissues",
    "nail": "the nails",
    "hair": "the hair",
    "pancreas": "the pancreas",
    "biliary": "the biliary system",
    "uterus": "the uterus",
}
PROGNOSIS_SENTENCES = {
    "curable": "{name} is generally considered curable.",
    "moderate": "The prognosis of {name} is moderate.",
    "difficult": "{name} is considered difficult to cure.",
    "variable": "The prognosis of {name} is variable and depends on the individual case.",
    "incurable": "{name} is traditionally considered incurable.",
}
TREATMENT_NOTE = "This is educational information, not a prescription."
HERB_NOTE = "Please consult a qualified practitioner before using any herb."
BOOKS = {
    "Ca": "Charaka Samhita",
    "Su": "Sushruta Samhita",
    "Ah": "Ashtanga Hridayam",
    "As": "Ashtanga Sangraha",
    "Ma": "Madhava Nidana",
    "Bp": "Bhavaprakasha",
    "Sha": "Sharangadhara Samhita",
}
THREE = ("vata", "pitta", "kapha")


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def fill(template: str, **values: Column | str) -> Column:
    """A sentence with ``{key}`` replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        out += [F.lit(before), values[key] if isinstance(values[key], Column) else F.lit(values[key])]
    return F.concat(*out, F.lit(rest))


def _named(keys: Column, names: dict[str, str], what: str) -> Column:
    """The name of each key; an unknown key raises."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(known, k), F.raise_error(F.concat(F.lit(f"unknown {what}: "), k)).cast("string")))


def factor_list(value: Column) -> Column:
    """The distinct factors of "Vata-Pitta", "Tridosha, Krimi" and so on, in order; an unknown one raises."""

    def one(part: Column) -> Column:
        unknown = F.raise_error(F.concat(F.lit("unknown factor: "), part)).cast("array<string>")
        return F.when(part.startswith("tridosh"), _strings(*THREE)).when(part.isin("agantuja", "balanced", *FACTOR_PHRASES), F.array(part)).when(part.endswith("prakriti"), _strings()).otherwise(unknown)

    parts = F.filter(F.transform(F.split(F.lower(value), r"[/,\-]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(parts, one)))


def factor_phrases(factors: Column) -> Column:
    """How sentences name the factors."""
    return _named(factors, FACTOR_PHRASES | {"agantuja": "external causes (Agantuja)"}, "factor")


def dosha_sentence(name: Column, value: Column) -> Column:
    """One sentence about the predominant factors; ``name`` may be "It"."""

    def written(x: Column) -> Column:
        name, raw, factors = x["name"], x["raw"], x["factors"]
        phrases = factor_phrases(F.filter(factors, lambda f: f != "balanced"))
        only = lambda *f: factors == _strings(*f)
        others = F.array_except(factors, _strings(*THREE))
        lead = F.try_element_at(F.filter(F.transform(F.split(raw, r"[/\-]"), lambda x: F.trim(x)), lambda p: p.isin(*THREE)), F.lit(1))
        along = F.when(F.size(others) > 0, F.concat(F.lit(" along with "), tx.join_list(factor_phrases(F.filter(others, lambda f: f != "balanced"))))).otherwise("")
        most = F.when(lead.isNotNull(), F.concat(F.lit(", with "), F.initcap(lead), F.lit(" most prominent"))).otherwise("")
        listed = tx.join_list(phrases)
        return (
            F.when(raw == "tridosha", fill("{n} is a tridoshic disorder involving all three doshas - Vata, Pitta and Kapha.", n=name))
            .when(only("agantuja"), fill("{n} is classified as Agantuja: it is caused by external factors such as injury, poison or bites rather than primarily by a dosha imbalance.", n=name))
            .when(only("balanced"), fill("{n} does not have a single predominant dosha.", n=name))
            .when(only("rajas"), fill("{n} is a disorder of the mind involving the mental dosha {d}.", n=name, d=listed))
            .when(only("rajas", "tamas"), fill("{n} is a disorder of the mind involving the mental doshas {d}.", n=name, d=listed))
            .when(F.contains(raw, F.lit("tridosh")), fill("{n} involves all three doshas (Vata, Pitta and Kapha){a}{m}.", n=name, a=along, m=most))
            .when((F.size(others) == 0) & (F.size(factors) == 1), fill("{n} is predominantly a {d} disorder.", n=name, d=listed))
            .when(F.size(others) == 0, fill("{n} is mainly caused by {d}.", n=name, d=listed))
            .when(name == "It", fill("Its predominant factors are {d}.", d=listed))
            .otherwise(fill("The predominant factors in {n} are {d}.", n=name, d=listed))
        )

    # as the variable of a lambda, the factors are parsed once
    return F.transform(F.array(F.struct(name.alias("name"), F.trim(F.lower(value)).alias("raw"), factor_list(value).alias("factors"))), written)[0]


def system_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(value), "/"), lambda x: F.trim(x)), lambda x: x != "")


def system_phrase(value: Column) -> Column:
    """The systems' names as they stand in a sentence; an unknown one raises."""
    return tx.join_list(_named(system_list(value), SYSTEM_PHRASES, "body system"))


def system_sentence(name: Column, value: Column) -> Column:
    parts = system_list(value)
    return (
        F.when(parts == _strings("systemic"), fill("{n} is a systemic condition that affects the whole body.", n=name))
        .when(parts == _strings("mental"), fill("{n} is a mental disorder: it affects the mind.", n=name))
        .when(parts == _strings("paediatric"), fill("{n} is a paediatric condition, seen in children.", n=name))
        .otherwise(fill("{n} mainly affects {s}.", n=name, s=system_phrase(value)))
    )


def prognosis_sentence(name: Column, value: Column) -> Column:
    key = F.lower(F.trim(value))
    return F.replace(_named(F.array(key), PROGNOSIS_SENTENCES, "prognosis")[0], F.lit("{name}"), name)


def lowered(items: Column) -> Column:
    return F.transform(items, tx.lower_first)


def treatment_items(value: Column) -> Column:
    """The items that say how to treat."""
    return F.filter(tx.split_list(value), lambda x: ~F.contains(F.lower(x), F.lit("prognosis")) & (F.lower(x) != "incurable"))


def treatment_sentence(name: Column, value: Column) -> Column:
    items = treatment_items(value)
    none = fill("No specific treatment principles are recorded for {n}. {t}", n=name, t=TREATMENT_NOTE)
    return F.when(F.size(items) == 0, none).otherwise(fill("Classical Ayurvedic management of {n} includes {i}. {t}", n=name, i=tx.join_list(lowered(items)), t=TREATMENT_NOTE))


def symptoms_sentence(name: Column, value: Column) -> Column:
    return fill("The main symptoms of {n} are {i}.", n=name, i=tx.join_list(lowered(tx.split_list(value))))


def reverse_sentence(modern: Column, names: Column) -> Column:
    return fill("In Ayurveda, {m} corresponds to {n}.", m=modern, n=tx.join_list(names))


def reference_sentence(name: Column, references: Column) -> Column:
    """Where the books (struct book, place) describe it."""
    parts = F.transform(references, lambda r: F.concat(F.lit("the "), r["book"], F.lit(" ("), r["place"], F.lit(")")))
    return fill("{n} is described in {p}.", n=tx.capitalize(name), p=tx.join_list(parts))


def named_names(name: Column, hindi: Column, marathi: Column) -> Column:
    more = F.when((marathi != "") & (marathi != hindi), fill(" In Marathi it is called {m}.", m=marathi)).otherwise("")
    return F.concat(fill("In Hindi, {n} is called {h}.", n=name, h=hindi), more)


def constitution(value: Column) -> Column:
    return F.array_join(factor_phrases(factor_list(value)), "-")


def condition_overview(e: str = "") -> Column:
    """All that is known of a condition (columns of kind ak)."""
    c = lambda x: F.col(e + x)
    return fill(
        "{n} is a condition described in the {s} that corresponds to {m} in modern medicine. {y} {d} Its main symptoms are {i}. {p}",
        n=c("name"), s=c("source_text"), m=c("modern_equivalent"), y=system_sentence(F.lit("It"), c("body_system")), d=dosha_sentence(F.lit("It"), c("dosha")),
        i=tx.join_list(lowered(tx.split_list(c("symptoms")))), p=prognosis_sentence(c("name"), c("prognosis")),
    )


def disease_overview(e: str = "") -> Column:
    """All that is known of a disease (columns of kind ag)."""
    c = lambda x: F.col(e + x)
    listed = lambda x: tx.join_list(tx.split_list(c(x)))
    base = fill(
        "In Ayurveda, {n} is associated with an imbalance of {d}, and people with a {p} constitution are considered more prone to it. Common symptoms include {i}.",
        n=c("name"), d=tx.join_list(factor_phrases(factor_list(c("doshas")))), p=constitution(c("prakriti")), i=tx.join_list(lowered(tx.split_list(c("symptoms")))),
    )
    herbs = F.when(c("herbs") != "", fill(" Herbs traditionally used include {h}.", h=listed("herbs"))).otherwise("")
    yoga = F.when(c("yoga") != "", fill(" Helpful yoga includes {y}.", y=listed("yoga"))).otherwise("")
    return F.concat(base, herbs, yoga)


def english_slug(value: Column) -> Column:
    """A stable part of an id for an English name: its slug's beginning and four digits of its hash."""
    from .hashing import stable_int

    return F.concat(F.substring(tx.slug(tx.unmarked(value)), 1, 80), F.lit("-"), F.lpad((stable_int("slug", value) % 10_000).cast("string"), 4, "0"))


def topic(question: Column, answer: Column, topics: tuple[str, ...], also: dict[str, str], otherwise: str) -> Column:
    """The first topic that the two mention, whatever its case; else the topic of a word in ``also``."""
    both = F.lower(F.concat(question, F.lit(" "), answer))
    out = F.when(F.lit(False), "")
    for t in topics:
        out = out.when(F.contains(both, F.lit(t.lower())), t)
    for word, t in also.items():
        out = out.when(F.contains(both, F.lit(word)), t)
    return out.otherwise(otherwise)


# Cards: (title, text) of each kind


def condition_card() -> tuple[Column, Column]:
    text = fill(
        "{n} (Ayurvedic condition, code {c}). Modern equivalent: {m}. Body system: {b}. Dosha predominance: {d}. Prognosis: {p}. Symptoms: {s}. Treatment principles: {t}. Source: {x}.",
        n=F.col("name"), c=F.col("code"), m=F.col("modern_equivalent"), b=F.col("body_system"), d=F.col("dosha"), p=F.col("prognosis"), s=F.col("symptoms"), t=F.col("treatment"), x=F.col("source_text"),
    )
    return F.col("name"), text


def _if(value: Column, template: str) -> Column:
    return F.when(value != "", fill(template, x=value)).otherwise("")


def disease_card() -> tuple[Column, Column]:
    names = F.array_join(F.filter(F.array(_if(F.col("hindi_name"), "Hindi: {x}"), _if(F.col("marathi_name"), "Marathi: {x}")), lambda x: x != ""), "; ")
    parts = [F.col("name"), F.when(names != "", F.concat(F.lit(" ("), names, F.lit(")"))).otherwise(""), F.lit(". ")]
    parts += [fill("Doshas: {d}. Prakriti: {p}. Symptoms: {s}. ", d=F.col("doshas"), p=F.col("prakriti"), s=F.col("symptoms"))]
    parts += [_if(F.col("herbs"), "Ayurvedic herbs: {x}. "), _if(F.col("yoga"), "Yoga: {x}. "), fill("Diet and lifestyle: {x}", x=F.col("diet_lifestyle"))]
    return F.col("name"), F.trim(F.concat(*parts))


def _spaced(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def _defined() -> Column:
    short = tx.sentence(tx.capitalize(tx.short_definition(F.col("definition"))))
    return F.when(F.col("definition") != "", short).otherwise("")


def _synonyms() -> Column:
    return F.when(F.size("synonyms") > 0, fill("Also called {x}.", x=tx.join_list(F.col("synonyms")))).otherwise("")


def diagnosis_card() -> tuple[Column, Column]:
    """Of a diagnostic term (kind nm) with its parent's columns (parent_name, parent_english; null without one)."""
    codes = F.concat(F.lit("NAMASTE code "), F.col("code"), _if(F.col("tm2"), ", ICD-11 TM2 {x}"))
    head = fill("{n} ({d}; {c}): {e}.", n=F.col("name"), d=F.col("devanagari"), c=codes, e=F.col("english"))
    category = F.when(F.col("parent_name").isNotNull(), fill("Category: {e} ({n}).", e=F.col("parent_english"), n=F.col("parent_name"))).otherwise("")
    title = F.array_join(F.concat(F.array("name"), F.col("synonyms"), F.array("english")), " ")
    return title, _spaced(head, _synonyms(), category, _defined(), _if(F.col("reference"), "Classical references: {x}."))


def terminology_card() -> tuple[Column, Column]:
    """Of a term (kind sat), cf. ``diagnosis_card``."""
    head = F.concat(fill("{n} ({d}; SAT {c})", n=F.col("name"), d=F.col("devanagari"), c=F.col("code")), F.when(F.col("english") != "", F.concat(F.lit(": "), F.col("english"), F.lit("."))).otherwise("."))
    label = F.when(F.col("parent_english") != "", F.col("parent_english")).otherwise(F.col("parent_name"))
    category = F.when(F.col("parent_name").isNotNull(), fill("Category: {e} ({n}).", e=label, n=F.col("parent_name"))).otherwise("")
    return F.array_join(F.concat(F.array("name"), F.col("synonyms")), " "), _spaced(head, _synonyms(), _defined(), category, _if(F.col("reference"), "Classical references: {x}."))
