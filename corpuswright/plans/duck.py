"""Pieces of DuckDB SQL that the oracles share: the same functions, written for the other engine."""

from __future__ import annotations

from ..functions.text import SCORE_STOPWORDS, STOPWORDS


def fold(x: str) -> str:
    return f"replace(lower(strip_accents({x})), 'ß', 'ss')"


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def words(x: str, stop: tuple[str, ...]) -> str:
    return f"list_filter(regexp_extract_all({fold(x)}, '[a-z0-9]+'), lambda t: NOT list_contains({_listed(stop)}, t))"


def tokenize(x: str) -> str:
    cut = "CASE WHEN (length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss') OR (length(t) > 3 AND regexp_matches(t, '[^aeiou][aiu]h$')) THEN t[:-2] ELSE t END"
    return f"list_transform({words(x, STOPWORDS)}, lambda t: {cut})"


def content_tokens(x: str) -> str:
    a = f"list_transform({words(x, SCORE_STOPWORDS)}, lambda t: replace(replace(t, 'ae', 'e'), 'oe', 'e'))"
    a = f"list_transform({a}, lambda t: CASE WHEN length(t) > 5 AND t LIKE '%our' THEN t[:-4] || 'or' ELSE t END)"
    a = f"list_transform({a}, lambda t: CASE WHEN length(t) > 4 AND t LIKE '%es' AND t NOT LIKE '%ses' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END)"
    return f"list_transform({a}, lambda t: regexp_replace(t, '^(.{{3,}}?)(ness|ing|ed|ly|y)$', '\\1'))"


def stable_int(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 12))::BIGINT"


def entity_group(key: str) -> str:
    b = f"({stable_int(chr(39) + 'bucket' + chr(39), key)} % 100)"
    half = stable_int("'half'", key)
    return f"CASE WHEN {b} < 8 THEN CASE WHEN {half} % 2 = 1 THEN 'heldout_val' ELSE 'heldout_test' END WHEN {b} < 16 THEN 'rag_only' ELSE 'seen' END"
