"""Column functions for cleaning, coercion, tokens and tags. Built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions import lexicons as L

HAN = r"\x{4e00}-\x{9fff}"
LEADING, TRAILING = "\"'“”‘’#＃([（【{", "\"'“”‘’#＃)]）】}"
#: Token modes: pattern, lower-cased before matching, shortest token.
TOKENS = {
    "chunk4": (rf"[A-Za-z0-9]+|[{HAN}]{{1,4}}", False, 1),
    "unigram": (rf"[a-z0-9]+|[{HAN}]", True, 1),
    "title": (rf"[A-Za-z0-9]+|[{HAN}]{{2,}}", False, 1),
    "mixed": (rf"[A-Za-z0-9][A-Za-z0-9\-]*|[{HAN}]{{1,4}}", False, 1),
    "compare": (rf"[A-Za-z0-9]+|[{HAN}]{{2,4}}", False, 2),
}


def _class(chars: str) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def clean_text(col: Column) -> Column:
    """Null as empty; Unicode white space stripped at both ends."""
    return F.coalesce(F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """The first value that is not blank, cleaned; empty if there is none."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cols], F.lit(""))


def safe_int(col: Column, default: int = 0) -> Column:
    """A whole number, else the truncated number, else the default. Never fails; infinite and not-a-number give the default."""
    text = F.trim(col.cast("string"))
    number = text.try_cast("double")
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), number.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(col: Column, default: float = 0.0) -> Column:
    return F.coalesce(col.cast("string").try_cast("double"), F.lit(default))


def category_path(*levels: Column) -> Column:
    """Levels joined by ' > ', without blank and UNKNOWN ones."""
    kept = F.filter(F.array(*map(clean_text, levels)), lambda x: (x != "") & (F.upper(x) != "UNKNOWN"))
    return F.array_join(kept, " > ")


def normalize_query(col: Column) -> Column:
    """Stripped, inner white space single, quotes, hashes and brackets gone at the ends; the cleaned text if nothing is left."""
    one = F.regexp_replace(clean_text(col), r"(?U)\s+", " ")
    body = F.regexp_replace(one, rf"^(?:{_class(LEADING)} *)+", "")
    body = F.regexp_replace(body, rf"(?: *{_class(TRAILING)})+$", "")
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), clean_text(col))


def compare_text(col: Column) -> Column:
    """Letters, digits and Han only, lower-cased."""
    return F.lower(F.regexp_replace(clean_text(col), rf"[^0-9a-zA-Z{HAN}]+", ""))


def _compared(values: Sequence[str]) -> list[str]:
    return sorted({re.sub(r"[^0-9a-zA-Z一-鿿]+", "", v).lower() for v in values})


def is_placeholder_brand(brand: Column, placeholders: Sequence[str] = L.PLACEHOLDER_BRANDS) -> Column:
    return compare_text(brand).isin(_compared(placeholders))


def title_contains_brand(title: Column, brand: Column) -> Column:
    """Whether the title holds the brand or one of its aliases (parts between slashes and bars)."""
    names = F.concat(F.array(brand), F.split(brand, r"[\\/|｜]+"))
    return F.exists(F.transform(names, compare_text), lambda n: (n != "") & F.contains(compare_text(title), n))


def major_category(path: Column) -> Column:
    return clean_text(F.split(path, ">")[0])


def leaf_category(path: Column) -> Column:
    return clean_text(F.element_at(F.split(path, ">"), -1))


def simplify_category(path: Column, suffixes: Sequence[str] = L.GENERIC_SUFFIXES) -> Column:
    """The leaf without one generic suffix, if at least two characters stay."""
    label = F.coalesce(F.nullif(leaf_category(path), F.lit("")), major_category(path))
    short = [
        F.when(F.endswith(label, F.lit(s)) & (F.char_length(F.trim(F.left(label, F.char_length(label) - len(s)))) >= 2), F.trim(F.left(label, F.char_length(label) - len(s))))
        for s in suffixes
    ]
    return F.coalesce(*short, label)


def tokens(col: Column, mode: str) -> Column:
    """All tokens in order, repeats included (see TOKENS)."""
    pattern, lowered, shortest = TOKENS[mode]
    text = normalize_query(col) if mode == "chunk4" else clean_text(col)
    found = F.regexp_extract_all(F.lower(text) if lowered else text, F.lit(pattern), F.lit(0))
    if mode == "compare":
        found = F.transform(found, F.lower)
    return F.filter(found, lambda t: F.char_length(t) >= shortest) if shortest > 1 else found


def short_title(title: Column, limit: int = 18) -> Column:
    """At most `limit` characters; a cut title loses trailing punctuation and gets a mark."""
    text = clean_text(title)
    cut = F.regexp_replace(F.left(text, F.lit(limit)), "[，。；、 ]+$", "")
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("等")))


def length_bucket(col: Column, short: int = 6, medium: int = 15) -> Column:
    size = F.char_length(col)
    return F.when(size <= short, "short").when(size <= medium, "medium").otherwise("long")


def _any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def tag_first_match(text: Column, lexicon: Sequence[tuple[str, Sequence[str]]] = L.QUERY_CATEGORIES, default: str = "misc") -> Column:
    """The first category of the lexicon with a keyword in the lower-cased text."""
    low, out = F.lower(text), None
    for name, words in lexicon:
        test = _any(low, [w.lower() for w in words])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def tag_all_matches(text: Column, terms: Sequence[str], pattern: str | None = None, finding: str = "") -> Column:
    """The terms that the text contains, in the lexicon's order, and a finding if it matches the pattern."""
    clean = clean_text(text)
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(clean, t))
    return found if pattern is None else F.concat(found, F.when(clean.rlike(pattern), F.array(F.lit(finding))).otherwise(F.array().cast("array<string>")))


def suspicious_claims(text: Column) -> Column:
    return tag_all_matches(text, L.SUSPICIOUS_CLAIMS, L.PRICE_PATTERN, L.PRICE_FINDING)


def query_too_noisy(query: Column) -> Column:
    return ~compare_text(query).rlike(rf"[a-zA-Z{HAN}]")


def related_to_evidence(copy: Column, query: Column, evidence_texts: Column, stopwords: Sequence[str] = L.STOPWORDS) -> Column:
    """Whether the copy shares a token, stop words aside, with the query or one of the evidence texts (array<string>)."""
    stops = F.array(*map(F.lit, stopwords))
    words = F.concat(tokens(query, "compare"), F.flatten(F.transform(F.coalesce(evidence_texts, F.array().cast("array<string>")), lambda t: tokens(t, "compare"))))
    return F.coalesce(F.arrays_overlap(F.array_except(tokens(copy, "compare"), stops), F.array_except(words, stops)), F.lit(False))
