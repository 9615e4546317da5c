"""Text normalisation as column expressions; the few that Spark lacks are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tessera.functions.hashes import fnv1a_32

# English stop-words.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with would could should have has had do does did i you he she we what which who when where why how "
    "all each every both few more most other some any only own same so than too very can just also now here about after before "
    "between during from through under above below up down out off over again further once am been being were its your him her my "
    "me our us them his hers ours theirs yours"
).split()

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "usa": "united states of america", "us": "united states", "uk": "united kingdom", "ussr": "soviet union", "nyc": "new york city",
    "la": "los angeles", "dc": "district of columbia", "st": "saint", "mt": "mount", "dr": "doctor", "mr": "mister", "mrs": "misses",
    "jr": "junior", "sr": "senior", "inc": "incorporated", "corp": "corporation", "ltd": "limited", "co": "company", "vs": "versus", "etc": "et cetera",
}

# Suffixes in the order in which they are tried.
SUFFIXES = {"ies": "y", "ves": "f", "oes": "o", "ses": "s", "xes": "x", "ches": "ch", "shes": "sh", "s": "", "ied": "y", "ing": "", "ed": "", "ier": "y", "iest": "y", "er": "", "est": ""}

TOKEN = "[a-zA-Z0-9À-ɏḀ-ỿ]+"
NAMESPACES = ("file", "image", "category", "template", "wikipedia", "help", "portal", "special", "mediawiki")


def title_key(c: Column) -> Column:
    """Lower case, underscores to spaces, trimmed, runs of white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "_", " "), r"\s+", " "))


def search_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "_", " "), r"[^A-Za-z0-9_\s]", ""))


def underscore_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"\s+", "_"), "_+", "_")


def title_case_key(c: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(F.trim(c), "_", " "), r"\s+", " "))


def wiki_title(c: Column) -> Column:
    """A link's page title; null for empty ones and those of other namespaces."""
    t = F.trim(c)
    space = F.lower(F.trim(F.substring_index(t, ":", 1)))
    skip = (t == "") | (t.contains(":") & space.isin(*NAMESPACES))
    return F.when(~skip, F.regexp_replace(F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))), "_", " "))


def infobox_type(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"^infobox\s+", ""), "_", " "))


def place(c: Column) -> Column:
    """A place in infobox text: the first link's page, or else what stands before the first comma."""
    link = wiki_title(F.regexp_extract(c, r"\[\[([^\]|#]+)", 1))
    plain = F.trim(F.substring_index(c, ",", 1))
    return F.coalesce(link, F.when(plain != "", plain))


def shortened(c: Column, size: int = 200, least: int = 100) -> Column:
    """At most ``size`` characters; a longer text is cut at its last space beyond ``least`` and gets three dots."""
    head = F.substring(c, 1, size)
    at = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when(F.contains(head, F.lit(" ")) & (at > least), F.substr(head, F.lit(1), at.cast("int"))).otherwise(head)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(cut, F.lit("...")))


def summary(c: Column) -> Column:
    """The first paragraph, at most 500 characters."""
    return shortened(F.trim(F.substring_index(c, "\n\n", 1)), 500, 400)


def strip_markup(c: Column) -> Column:
    """Tags removed, the five named entities decoded (``&amp;`` before ``&quot;``)."""
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def stemmed_suffix(word: Column) -> Column:
    """The first suffix rule that applies, for words of more than three letters with two left."""
    out = None
    for suffix, put in SUFFIXES.items():
        made = F.concat(F.substr(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put))
        test = F.endswith(word, F.lit(suffix)) & (F.length(made) >= 2)
        out = F.when(test, made) if out is None else out.when(test, made)
    return F.when(F.length(word) <= 3, word).otherwise(out.otherwise(word))


def expanded(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.coalesce(F.element_at(table, F.regexp_replace(w, r"\.$", "")), w)), " ")


def normalised_term(text: str | None, expand: bool = False, stem: bool = False, size: int = 256) -> str | None:
    if text is None:
        return None
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).lower().translate(str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d"})))
    t = re.sub("[̀-ͯ]", "", t)
    if expand:
        t = " ".join(ABBREVIATIONS.get(w.removesuffix("."), w) for w in t.split())
    t = " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split())
    if stem:
        t = " ".join(next((m for s, p in SUFFIXES.items() if w.endswith(s) and len(m := w[: len(w) - len(s)] + p) >= 2), w) if len(w) > 3 else w for w in t.split())
    return t[:size]


def each_once(f: Callable, s: pd.Series) -> pd.Series:
    """f of each value, called once for each distinct one; nulls stay."""
    codes, distinct = pd.factorize(s)
    made = np.array([f(x) for x in distinct] + [None], object)
    return pd.Series(made[codes])


@F.pandas_udf(StringType())
def normalise_term(s: pd.Series) -> pd.Series:
    return each_once(normalised_term, s)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty terms are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity plus 0.1 for each of up to four shared first letters, at any Jaro value."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, first = list(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, left in zip(b, free, strict=True) if left is None]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    shared = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + shared * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)])


def title_score(title: Column, query: str) -> Column:
    """1 exact, 0.9 prefix, 0.7 contained, half the share of query words found, 0.3 scaled for small edit distances."""
    t, q = search_key(title), search_key(F.lit(query))
    words, asked = F.split(t, r"\s+"), F.split(q, r"\s+")
    found = F.size(F.filter(asked, lambda w: F.array_contains(words, w)))
    far = F.levenshtein(t, q) / F.greatest(F.length(t), F.length(q), F.lit(1))
    return F.when(t == q, 1.0).when(F.startswith(t, q), 0.9).when(F.contains(t, q), 0.7).when(found > 0, 0.5 * found / F.size(asked)).when(far < 0.3, 0.3 * (1 - far)).otherwise(0.0)


def words(c: Column) -> Column:
    """Lower-case words of 2 to 50 letters, stop-words too, in order.

    A text is put in lower case as a whole, unless it holds a letter whose lower case enters or leaves the letters of words.
    """
    found = F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))
    one_by_one = F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: F.length(w).between(2, 50))
    letter = TOKEN.removesuffix("+")
    whole = F.regexp_extract_all(F.lower(c), F.lit(f"(?<!{letter})({letter}{{2,50}})(?!{letter})"), F.lit(1))
    return F.when(c.rlike("[\u0130\u023A\u023E\u212A\u212B]"), one_by_one).otherwise(whole)


def tokens(c: Column) -> Column:
    """Index terms: words without stop-words, in order."""
    return F.filter(words(c), lambda w: ~w.isin(*STOP_WORDS))


# A byte table for letters up to U+00FF: those of words in lower case, all else blank.
LATIN = bytes(ord(chr(i).lower()) if re.match(TOKEN, chr(i)) else 32 for i in range(256))
FOUND, BEYOND, CHANGING = re.compile(TOKEN), re.compile("[\u0100-\u024F\u1E00-\u1EFF\u212A\u212B]"), re.compile("[\u0130\u023A\u023E\u212A\u212B]")


def cut(text: str) -> bytes | list[str]:
    """A text with the letters of words in lower case and all else blank; of texts with letters beyond U+00FF, the lower-case words."""
    try:
        low = text.encode("latin-1")
    except UnicodeEncodeError:
        if BEYOND.search(text):
            return [w.lower() for w in FOUND.findall(text)] if CHANGING.search(text) else FOUND.findall(text.lower())
        low = text.encode("latin-1", "replace")  # what is lost is no letter of a word
    return low.translate(LATIN)


def pieces_of(text: str) -> list[str]:
    """Lower-case words of any length, in order."""
    found = cut(text)
    return found if isinstance(found, list) else found.decode("latin-1").split()


def words_of(text: str) -> list[str]:
    """The same words as ``words`` gives, in a Python worker: nearly all texts are cut by one table and one split."""
    return [w for w in pieces_of(text) if 2 <= len(w) <= 50]


def vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for c in word:
        out.append(c in "aeiou" or (c == "y" and bool(out) and not out[-1]))
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", "".join("v" if v else "c" for v in vowels(word))))


def porter_step1(word: str) -> str:
    """Steps 1a, 1b and 1c of the Porter stemmer."""
    if len(word) <= 2:
        return word
    w = word[:-2] if word.endswith(("sses", "ies")) else word[:-1] if word.endswith("s") and not word.endswith("ss") else word
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and any(vowels(w[:-cut])):
            w = w[:-cut]
            v = vowels(w)
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) >= 2 and w[-1] == w[-2] and not v[-1] and w[-1] not in "lsz":
                w = w[:-1]
            elif len(w) >= 3 and not v[-3] and v[-2] and not v[-1] and w[-1] not in "wxy" and measure(w) == 1:
                w += "e"
    return w[:-1] + "i" if w.endswith("y") and any(vowels(w[:-1])) else w


@F.pandas_udf(ArrayType(StringType()))
def porter_stems(s: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return s.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, porter_step1(w)) for w in ws])


@F.pandas_udf(StringType())
def porter_stem(s: pd.Series) -> pd.Series:
    return each_once(porter_step1, s)


@F.pandas_udf(ArrayType(StringType()))
def term_variants(s: pd.Series) -> pd.Series:
    """The normalised term, its stemmed, expanded and accented forms, and the words of three letters or more if there are several."""
    return each_once(lambda t: None if t is None else variants_of(t), s)


def variants_of(term: str) -> list[str]:
    base = normalised_term(term)
    words_ = base.split(" ")
    out = [base, normalised_term(term, stem=True), normalised_term(term, expand=True), accented_term(term)]
    return list(dict.fromkeys(out + ([w for w in words_ if len(w) >= 3] if len(words_) > 1 else [])))


def accented_term(text: str, size: int = 256) -> str:
    """A normalised term with its diacritics."""
    lower = unicodedata.normalize("NFC", text).lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in lower).split())[:size]


def terms_match(a: Column, b: Column, fuzzy: bool = False) -> Column:
    """Equal when normalised, or with ``fuzzy`` if any of their variants are."""
    same = normalise_term(a) == normalise_term(b)
    return same | F.arrays_overlap(term_variants(a), term_variants(b)) if fuzzy else same


def plain_title_score(title: Column, query: str) -> Column:
    """For titles without an index: 1 equal, 0.8 begins so, 0.5 holds it, else null."""
    key, asked = F.lower(title), F.lit(query.lower().strip())
    return F.when(key == asked, 1.0).when(F.startswith(key, asked), 0.8).when(F.contains(key, asked), 0.5)


def article_place(title: Column) -> Column:
    """``kind, partition, hash`` of a title: one of 1000 partitions, in four digits."""
    h = fnv1a_32(F.lower(title))
    kind = F.when(F.startswith(title, F.lit("Category:")), "category").when(F.startswith(title, F.lit("Template:")), "template").when(F.startswith(title, F.lit("File:")), "file").when(F.startswith(title, F.lit("Portal:")), "portal")
    kind = kind.when(F.contains(title, F.lit("(disambiguation)")), "disambiguation").otherwise("article")
    return F.struct(kind.alias("kind"), F.lpad((h % 1000).cast("string"), 4, "0").alias("partition"), h.alias("hash"))
