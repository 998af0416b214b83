"""Column expressions for text: tokens, identifiers, previews. All stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# The reserved characters of a full-text query.
RESERVED = '?*()"+-^{}~'

_FOLD = {}
for _c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
    _base = "".join(x for x in unicodedata.normalize("NFD", chr(_c)) if not unicodedata.combining(x))
    if len(_base) == 1 and _base != chr(_c):
        _FOLD[chr(_c)] = _base
_FROM, _TO = "".join(_FOLD), "".join(_FOLD.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics. ASCII texts, which have none, are not searched for them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(F.regexp_replace(text, r"\p{M}+", "")), _FROM, _TO))


def fold_text(text: str) -> str:
    """fold() of one string, on the driver."""
    kept = "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower()
    return "".join(_FOLD.get(c, c) for c in kept)


def fts_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded: the tokens of the full-text index."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def sanitize_query(query: Column) -> Column:
    """The query without reserved characters, white space collapsed."""
    bare = F.translate(query, RESERVED, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def vocabulary_tokens(text: Column) -> Column:
    """A letter and at least two letters, digits, _ or -; lower-cased. ASCII only."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z][a-zA-Z0-9_-]{2,})"), 1)
    return F.transform(found, F.lower)


def split_compound(token: Column, camel: bool = False) -> Column:
    """The token and its parts at _ and - of three letters or more, each once; camel: at capitals, where there is no _ or -."""
    parts = F.split(token, "[_-]")
    if camel:
        parts = F.when(token.rlike("[_-]"), parts).otherwise(split_camel(token))
    return F.array_distinct(F.concat(F.array(F.lower(token)), F.transform(F.filter(parts, lambda p: F.length(p) >= 3), F.lower)))


def split_camel(token: Column) -> Column:
    """Cut before each capital."""
    return F.split(token, r"(?<!^)(?=\p{Lu})")


def sanitize_id(name: Column) -> Column:
    """Node ids: lower case, anything but letters and digits becomes _."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "_")


def sanitize_relation(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def preview(content: Column, chars: int = 200) -> Column:
    return F.regexp_replace(F.substring(content, 1, chars), "\n", " ")


def lines(content: Column) -> Column:
    """Lines without their ends; a final newline adds none."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"\r?\n\z", "")
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def document_input(title: Column, text: Column) -> Column:
    """How a document is handed to an embedding model that takes titles."""
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), text)


def query_input(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"task: {task} | query: "), query)


def snippet(content: Column, terms: list[str], words: int = 32) -> Column:
    """The `words` words that hold the most of the terms, each counted once in a run of so many, then the first such run; ... where something is left out."""
    tokens = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    folded = [fold_text(t) for t in dict.fromkeys(terms)]
    hit = F.transform(tokens, lambda w: F.array_intersect(fts_tokens(w), F.array(*[F.lit(t) for t in folded]).cast("array<string>")))
    # runs start at a hit, or as far back as the text's end asks
    starts = F.transform(F.filter(F.transform(hit, lambda h, i: F.struct(i.alias("i"), F.size(h).alias("n"))), lambda x: x["n"] > 0), lambda x: F.greatest(F.lit(0), F.least(x["i"], F.size(tokens) - words)))
    scored = F.transform(starts, lambda i: F.struct(F.size(F.array_distinct(F.flatten(F.slice(hit, i + 1, F.lit(words))))).alias("n"), (-i).alias("i")))
    start = F.coalesce(-F.array_max(scored)["i"], F.lit(0))
    body = F.array_join(F.slice(tokens, start + 1, F.lit(words)), " ")
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + words < F.size(tokens), "...").otherwise(""))
