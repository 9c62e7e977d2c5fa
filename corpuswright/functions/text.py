"""Text functions as column expressions: folding, tokens, stems, slugs and cleaners.

``fold`` is exact but for characters outside the Latin blocks that fold to several; ``fold_exact`` is a pandas
UDF for those. ``nfc`` and ``nfkc`` normalise source cells and questions, which are few; Spark has no built-in for it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that retrieval ignores, and words that scoring ignores.
STOPWORDS = tuple(
    """a about above after again all also am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further had has have
    having he her here hers him his how i if in into is it its itself just me more most my no nor not of
    off on once only or other our out over own same she should so some such than that the their them then
    there these they this those through to too under until up very was we were what when where which while
    who whom why will with would you your yours ayurveda ayurvedic tell explain describe described give
    name list called call known mean means please according main mainly involved involve predominant
    predominance affect affected doctor hi hey hello thanks thank ok okay""".split()
)
SCORE_STOPWORDS = tuple(
    dict.fromkeys(
        """a an and are as at be by for from has have in into is it its of on or that the this to was were
        which with within without e g eg i ie etc also may can their them they usually often mainly mostly
        especially more less very per""".split()
    )
)
# Words that stand for nothing, in the two kinds of source tables.
NULL_WORDS = ("", "none", "none specific", "nan", "n/a", "na", "-")
TERM_NULL_WORDS = ("", "none", "nan", "null", "-")


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@lru_cache(maxsize=2)
def _letters(cased: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters, their one-character foldings, then marks to delete; and Latin letters that fold to several.

    By a rule over all characters up to the mathematical letters; characters that fold to several outside
    the Latin blocks (fractions, units, Hangul syllables) are left as they are.
    """
    one, several = {}, {}
    latin = [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        folded = _bare(c) if cased else _bare(c).casefold()
        if len(folded) == 1 and folded != c:
            one[c] = folded
    for cp in latin:
        c = chr(cp)
        folded = _bare(c) if cased else _bare(c).casefold()
        if c.isalpha() and len(folded) > 1 and (cased or c.lower() == c):  # capitals are gone otherwise
            several[c] = folded
    marks = "".join(chr(cp) for cp in range(0x300, 0x1E950) if unicodedata.combining(chr(cp)))
    return "".join(one) + marks, "".join(one.values()), tuple(several.items())


def _without_marks(text: Column, cased: bool) -> Column:
    source, target, several = _letters(cased)
    spread = text
    for a, b in several:
        spread = F.replace(spread, F.lit(a), F.lit(b))
    # most texts are ASCII, and hardly any holds a letter that folds to several; its class is only looked up for what isn't ASCII
    spread = F.when(text.rlike(r"[^\x00-\x7F](?<=[" + "".join(a for a, _ in several) + "])"), spread).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(spread, source, target)).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case without diacritics; marks that stand alone go too."""
    return _without_marks(F.lower(text), False)


def unmarked(text: Column) -> Column:
    """Without diacritics, case kept."""
    return _without_marks(text, True)


@lru_cache(maxsize=1)
def _compatibles() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that stand for one other (full-width, mathematical, circled), and ligatures."""
    one, several = {}, {}
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif 0xFB00 <= cp < 0xFB07:
            several[c] = plain
    return "".join(one), "".join(one.values()), tuple(several.items())


def compatible(text: Column) -> Column:
    """Compatibility characters as the characters they stand for, one by one; ``nfkc`` also composes."""
    source, target, several = _compatibles()
    out = F.translate(text, source, target)
    for a, b in several:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Folding of any character: NFKD, without combining marks, case-folded."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else _bare(t).casefold())


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility characters as what they stand for, composed."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed characters."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row.

    Within a lambda an expression is evaluated for every element; an explode of one element keeps the
    optimiser from copying it there.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), 0)


#: Retrieval's endings: plural s of words of five letters and more, h after a short vowel of words of four and more. The letter is
#: met first and what stands before it then, so that most places of a text are passed by.
_RETRIEVAL_STEM = ((r"[sh]\b(?<=[a-z0-9]{3}[a-rt-z0-9]s|[a-z0-9][b-df-hj-np-tv-z0-9][aiu]h)", ""),)
#: Scoring's: spelling variants, plurals, then the longest common ending that leaves three letters.
_SCORE_STEM = (("ae", "e"), ("oe", "e"), (r"our\b(?<=[a-z0-9]{3}our)", "or"), (r"es\b(?<=[a-z0-9]{2}[a-rt-z0-9]es)|s\b(?<=[a-z0-9]{2}[a-rt-z0-9]s)", ""), ("|".join(rf"{x}\b(?<=[a-z0-9]{{3}}{x})" for x in ("ness", "ing", "ed", "ly", "y")), ""))


def _stemmed(listed: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    """Words without their endings: all words of a text in one string, a pass for each step."""
    t = F.array_join(listed, " ")
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    return F.array_remove(F.split(t, " "), "")


def tokenize(text: Column) -> Column:
    """Retrieval tokens: folded words without stop words, plural s and final h after a short vowel."""
    return _stemmed(F.filter(words(fold(text)), lambda t: ~t.isin(*STOPWORDS)), _RETRIEVAL_STEM)


#: The same of one word: those that lose their last letter.
_RETRIEVAL_ENDING = "^[a-z0-9]*([a-z0-9]{3}[a-rt-z0-9]s|[a-z0-9][b-df-hj-np-tv-z0-9][aiu]h)$"


def word_stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Stems of distinct folded words as ``tokenize`` makes them, and which of the words are tokens (not empty, no stop words)."""
    stems = pc.if_else(pc.match_substring_regex(words, _RETRIEVAL_ENDING), pc.utf8_slice_codeunits(words, 0, -1), words)
    return stems, ~pc.is_in(words, pa.array(["", *STOPWORDS])).to_numpy(zero_copy_only=False)


def stem(token: Column) -> Column:
    """Spelling variants, plurals and common endings of a lower-case word."""
    for pattern, by in _SCORE_STEM:
        token = F.regexp_replace(token, pattern, by)
    return token


def stem_word(word: str) -> str:
    """``stem`` of a word that is known before a query runs."""
    for pattern, by in _SCORE_STEM:
        word = re.sub(pattern, by, word)
    return word


def folded_tokens(folded: Column) -> Column:
    """``content_tokens`` of a text that is folded already."""
    return _stemmed(F.filter(words(folded), lambda t: ~t.isin(*SCORE_STOPWORDS)), _SCORE_STEM)


def content_tokens(text: Column) -> Column:
    """Stems of the words that scoring counts."""
    return folded_tokens(fold(text))


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0B\x1C-\x1F\u0085   -     　]+", " "))


def clean(text: Column, normalised: bool = False) -> Column:
    """Squeezed text; null and words for nothing are empty. ``normalised`` cells are in NFKC."""
    t = squeeze(F.coalesce(text if not normalised else nfkc(text), F.lit("")))
    return F.when(F.lower(t).isin(*NULL_WORDS), "").otherwise(t)


#: Anything but plain ASCII whose words stand apart by one space each.
_UNEVEN = r"[^!-~ ]| (?: |\z)|\A "


def clean_cells(cells: Column) -> Column:
    """An array of cells as ``clean`` makes them, each made once; one that is even already is only looked through."""
    squeezed = F.transform(cells, lambda x: F.when(x.rlike(_UNEVEN), squeeze(x)).otherwise(F.coalesce(x, F.lit(""))))
    return F.transform(squeezed, lambda x: F.when(F.lower(x).isin(*NULL_WORDS), "").otherwise(x))


#: What ``clean_term`` may change: mark-up, arrows, white space but for single spaces between words.
_UNEVEN_TERM = r"[#\u21d2\t\n\f\r\x0B\x1C-\x1F\u0085   -     　]| (?: |\z)|\A "


def clean_term(text: Column, normalised: bool = False) -> Column:
    """A cell of a terminology table: without arrows, hard spaces and ``#san@..#`` mark-up. ``normalised`` cells are in NFC."""
    raw = F.coalesce(text if not normalised else nfc(text), F.lit(""))
    squeezed = squeeze(F.regexp_replace(F.translate(raw, "\u00a0\u21d2", "  "), "#san@([^#]+)#", "$1"))
    t = F.when(raw.rlike(_UNEVEN_TERM), squeezed).otherwise(raw)
    return F.when(F.lower(t).isin(*TERM_NULL_WORDS), "").otherwise(t)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def group_key(text: Column) -> Column:
    """Spelling-insensitive key: folded letters and digits only."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\([^)]*\)", ""))


def term_name(text: Column) -> Column:
    """struct(name, synonyms): the first of "a/ b/ c", without a leading "(x) "."""
    whole = F.regexp_replace(clean_term(text), r"^\([a-z]\)\s*", "")
    parts = F.filter(F.transform(F.split(whole, "/"), lambda x: F.btrim(x, F.lit(" ,;"))), lambda x: x != "")
    # as the variable of a lambda, the parts are made once
    return F.transform(F.array(parts), lambda p: F.struct(F.coalesce(F.try_element_at(p, F.lit(1)), F.lit("")).alias("name"), F.slice(p, 2, 1000).alias("synonyms")))[0]


def english_name(text: Column) -> Column:
    return F.btrim(squeeze(F.replace(clean_term(text), F.lit("(TM2)"), F.lit(""))), F.lit(" ,;"))


def short_definition(text: Column, most: int = 70) -> Column:
    """At most so many words, cut back to the last sentence or clause end past the middle."""
    parts = F.split(squeeze(text), " ")
    cut = F.array_join(F.slice(parts, 1, most), " ")
    # position before the last mark, counted from 0; -1 if there is none
    before = lambda mark: F.when(F.instr(F.reverse(cut), mark[::-1]) > 0, F.length(cut) - F.instr(F.reverse(cut), mark[::-1]) - 1).otherwise(-1)
    end = F.greatest(before(". "), before("; "))
    kept = F.when(end > F.floor(F.length(cut) / 2), F.substring(cut, F.lit(1), end)).otherwise(cut)
    return F.when(F.size(parts) <= most, F.rtrim(text, F.lit(" ."))).otherwise(F.rtrim(kept, F.lit(" .;,")))


def sentence(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def lower_first(text: Column) -> Column:
    """First letter in lower case unless the first word is in capitals or has a later one."""
    kept = text.rlike(r"^\s*\S\S*\p{Lu}") | text.rlike(r"^\s*\p{Lu}(\s|$)") | text.rlike(r"^\s") | (text == "")
    return F.when(kept, text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def split_list(text: Column, separators: str = ",;") -> Column:
    """Items of a list; separators within parentheses, also nested or open to the end, don't count."""
    plain = F.split(F.coalesce(text, F.lit("")), f"[{separators}]")
    # with parentheses: a piece that ends inside some goes on in the next
    depth = lambda x: F.length(F.regexp_replace(x, "[^(]", "")) - F.length(F.regexp_replace(x, "[^)]", ""))
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{separators}]"), 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("at"), F.lit(0).alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        whole = F.concat(acc["now"], piece)
        still = acc["open"] + depth(piece)
        closed = still <= 0
        done = F.when(closed, F.array_append(acc["done"], whole)).otherwise(acc["done"])
        mark = F.coalesce(F.try_element_at(marks, acc["at"] + 1), F.lit(""))
        return F.struct(done.alias("done"), F.when(closed, F.lit("")).otherwise(F.concat(whole, mark)).alias("now"), (acc["at"] + 1).alias("at"), still.alias("open"))

    nested = F.aggregate(plain, start, step, lambda acc: F.array_append(acc["done"], acc["now"]))
    items = F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("(")), nested).otherwise(plain)
    return F.filter(F.transform(items, lambda x: F.btrim(squeeze(x), F.lit(" ."))), lambda x: x != "")


def join_list(items: Column) -> Column:
    """"a", "a and b", "a, b and c"."""
    full = F.filter(items, lambda x: x != "")
    several = F.concat(F.array_join(F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(full, F.lit(-1)))
    return F.when(F.size(full) <= 1, F.array_join(full, "")).otherwise(several)


def split_code(text: Column) -> Column:
    """struct(code, tm2) of "X (SN3Y)": the second kind is told by its pattern, and stands for a missing first."""
    parts = F.filter(F.split(clean_term(text), r"[\s()]+"), lambda x: x != "")
    tm2 = lambda p: F.coalesce(F.try_element_at(F.filter(p, lambda x: x.rlike("^S[A-Z][0-9][0-9A-Z]$")), F.lit(1)), F.lit(""))
    code = lambda p, t: F.coalesce(F.try_element_at(F.filter(p, lambda x: x != t), F.lit(1)), t)
    # as variables of lambdas, the parts and the second kind are made once
    return F.transform(F.array(parts), lambda p: F.transform(F.array(tm2(p)), lambda t: F.struct(code(p, t).alias("code"), t.alias("tm2")))[0])[0]


def glossed(text: Column, most: int = 12) -> Column:
    """Pairs "term [gloss]" of a definition as structs (term, gloss)."""
    pattern = r"([^,\[\]]+?)\s*\[([^\]]+)\]"
    term = lambda a: F.trim(F.element_at(F.split(F.btrim(a, F.lit(" ,;:")), " by "), -1))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda a, b: F.struct(term(a).alias("term"), F.trim(b).alias("gloss")))
    return F.slice(F.filter(pairs, lambda x: x["gloss"] != ""), 1, most)


def features(definition: Column, most: int = 12) -> Column:
    """struct(clause, items): the glosses of a definition, or else its own clause cut at commas and "and"."""
    # as variables of lambdas, pairs and clause are made once
    return F.transform(F.array(glossed(definition, most)), lambda pairs: _features(definition, pairs, most))[0]


def _features(definition: Column, pairs: Column, most: int) -> Column:
    named = F.transform(pairs, lambda x: F.when(x["term"] == "", x["gloss"]).otherwise(F.concat(x["gloss"], F.lit(" ("), x["term"], F.lit(")"))))
    body = F.element_at(F.split(definition, r"(?i)characteri[sz]ed by:?", 2), -1)
    clause = short_definition(F.btrim(F.split(body, r"\. This may be explained by")[0], F.lit(" .")))
    own = lambda c: F.struct(c.alias("clause"), F.slice(F.filter(F.transform(F.split(c, r",|\band\b|;"), lambda x: F.trim(x)), lambda x: x != ""), 1, most).alias("items"))
    glosses = F.struct(join_list(named).alias("clause"), F.transform(pairs, lambda x: x["gloss"]).alias("items"))
    return F.when(F.size(pairs) > 0, glosses).otherwise(F.transform(F.array(clause), own)[0])


def first_references(text: Column, books: dict[str, str]) -> Column:
    """The first reference to each known book of "Ca.Su.20/17; ...", in order, as structs (book, place)."""
    parts = F.filter(F.transform(F.split(clean_term(text), ";"), lambda x: F.trim(x)), lambda x: x != "")
    known = F.create_map(*(F.lit(x) for kv in books.items() for x in kv))
    named = F.transform(parts, lambda x: F.struct(F.try_element_at(known, F.regexp_extract(x, r"^([A-Z][a-z]{0,2})\.", 1)).alias("book"), F.replace(x, F.lit(" "), F.lit("")).alias("place")))
    found = F.filter(named, lambda x: x["book"].isNotNull())
    first = lambda f: F.filter(f, lambda x, i: ~F.exists(F.slice(f, F.lit(1), i), lambda y: y["book"] == x["book"]))
    return F.transform(F.array(found), first)[0]


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null or blank text."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def question_key(text: Column) -> Column:
    """Folded text with runs of anything but letters, digits and underscore as one space."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def plain_words(text: Column) -> Column:
    """Folded text with runs of anything but a-z and 0-9 as one space."""
    return F.regexp_replace(fold(text), "[^a-z0-9]+", " ")
