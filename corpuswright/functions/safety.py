"""Safety routing of questions and guarding of answers, by the ordered patterns of a policy file."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compatible, squeeze

#: Routes in the order in which they are tried.
ORDER = ("self_harm", "urgent", "dose")


@dataclass(frozen=True)
class Policy:
    """Patterns of each route's questions, of doses in answers, and each route's fixed reply, if it has one."""

    routes: tuple[tuple[str, tuple[str, ...]], ...]
    dose_in_answer: str
    responses: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(config: dict, need_responses: bool = False) -> Policy:
        """From a mapping with query_patterns, dose_in_answer and perhaps responses; a missing route or a pattern that isn't one raises."""
        patterns, responses = config["query_patterns"], config.get("responses", {})
        for name in ORDER:
            if not patterns.get(name) or need_responses and name not in responses:
                raise ValueError(f"the safety policy is missing {name}")
        for p in [config["dose_in_answer"], *(p for listed in patterns.values() for p in listed)]:
            re.compile(p)
        return Policy(tuple((n, tuple(map(str, patterns[n]))) for n in ORDER), str(config["dose_in_answer"]), tuple((n, str(responses[n])) for n in ORDER if n in responses))

    @staticmethod
    def read(path: str | Path, need_responses: bool = False) -> Policy:
        """From a JSON file, or a YAML one, which needs yaml."""
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return Policy.of(json.loads(text), need_responses)
        import yaml

        return Policy.of(yaml.safe_load(text), need_responses)


#: The policy that comes with the library; a user's own is read and passed on.
POLICY = Policy.read(Path(__file__).parent.parent / "policies" / "safety.json")


def normalize(text: Column) -> Column:
    """Lower case, compatibility characters as what they stand for, plain apostrophes, single spaces."""
    return squeeze(F.replace(F.lower(compatible(text)), F.lit("’"), F.lit("'")))


def route(text: Column, policy: Policy = POLICY) -> Column:
    """self_harm, urgent, dose or answer: the first route that has a pattern in the text, one scan for each."""
    t = normalize(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, patterns in policy.routes:
        out = out.when(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), name)
    return out.otherwise("answer")


def response(route_: Column, policy: Policy = POLICY) -> Column:
    """The fixed reply of a route; null if it has none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in policy.responses:
        out = out.when(route_ == name, text)
    return out


def states_dose(answer: Column, policy: Policy = POLICY) -> Column:
    return F.coalesce(answer, F.lit("")).rlike("(?i)" + policy.dose_in_answer)


def guard(answer: Column, instead: Column, policy: Policy = POLICY) -> Column:
    """struct(answer, replaced): another answer where one states a dose."""
    bad = states_dose(answer, policy)
    return F.struct(F.when(bad, instead).otherwise(answer).alias("answer"), bad.alias("replaced"))
