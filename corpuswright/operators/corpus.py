"""A whole corpus from drafts: filtered, opened, made into rows, guarded and published at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from ..sources.build import Build
from ..sources.files import prompt_hash
from . import assembly, splits

#: Of each published table, the column that its digest's order is made of.
KEY_OF = {"rows": "id", "listed": "id", "contexts": "id", "cards": "card_id", "entities": "id", "dropped": "reason"}


def corpus(spark: SparkSession, path: str, drafts: DataFrame, cards: DataFrame, entities: DataFrame, caps: DataFrame) -> Build:
    """The build of a corpus: ``drafts`` as in ``assembly``, cards (card_id, title, source, text), entities (id, kind, name, group).

    Tables: ``rows`` with messages and meta data, ``listed`` with what checks compare, ``contexts`` (each row's cards), ``cards``, ``entities`` and
    ``dropped`` (counts by reason). It is published only if no evaluation question, entity, spelling twin or held-out card is known from
    training, ids are unique, and every card and entity that a row names is there.
    """
    held_out = entities.where(F.col("group").startswith("heldout")).select(F.col("id").alias("card_id"))
    kept, dropped = assembly.evaluation_rows(drafts, caps)
    kept = cut(kept, "corpus-kept")
    rows = cut(assembly.rows(kept, cut(assembly.entries(kept, cards, held_out), "corpus-entries")), "corpus-rows")
    own = F.when(F.col("source").isin("ak", "ag", "nm", "sat"), F.col("entity"))
    listed = kept.select("split", "id", "group", "source", "question", "entity", "name", own.alias("told_entity"))
    contexts = rows.select("split", "id", F.posexplode("meta.context_ids").alias("place", "card_id"))

    def held_out_in_training(t: dict[str, DataFrame]) -> DataFrame:
        kept_out = t["entities"].where("startswith(`group`, 'heldout')").select(F.col("id").alias("card_id"))
        return splits.context_overlap(t["contexts"].where("split = 'train'"), kept_out).select("id", "card_id")

    return Build(
        spark, path,
        {"rows": rows, "listed": listed, "contexts": contexts, "cards": cards, "entities": entities.select("id", "kind", "name", "group"), "dropped": dropped},
        {"rows": ["split", "id"], "cards": ["card_id"], "entities": ["id"], "contexts": ["split", "id", "place"]},
        [("contexts", ["card_id"], "cards", ["card_id"]), ("contexts", ["split", "id"], "rows", ["split", "id"]), ("listed", ["told_entity"], "entities", ["id"]), ("listed", ["split", "id"], "rows", ["split", "id"])],
        {
            "evaluation questions in training": lambda t: splits.question_overlap(t["listed"]),
            "unseen entities in training": lambda t: splits.entity_overlap(t["listed"]),
            "spelling twins in training": lambda t: splits.twin_overlap(t["listed"].where("source IN ('nm', 'sat')")),
            "held-out cards in training": held_out_in_training,
        },
    )


def publish(spark: SparkSession, path: str, drafts: DataFrame, cards: DataFrame, entities: DataFrame, caps: DataFrame, prompt: str) -> dict[str, object]:
    """Publishes the corpus; the manifest, with the prompt's hash. A violated rule raises ``BuildError`` and leaves the version before."""
    return corpus(spark, path, drafts, cards, entities, caps).commit(KEY_OF, {"system_prompt_sha256": prompt_hash(prompt)})
