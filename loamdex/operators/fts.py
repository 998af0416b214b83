"""Full-text search: a small query grammar and BM25.

An index is a postings table, sorted by term: one row per term and
document with its positions, made inside each document's row, without a
shuffle. A query reads the postings of its own terms, brings those of a
document together, and scores. Without an index, search() scans: tf of
each phrase is a higher-order expression on the token array."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from loamdex.functions.text import RESERVED, fold_text, fts_tokens, sanitize_query

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class QuerySyntaxError(ValueError):
    pass


@dataclass
class Query:
    """A condition over phrases. kind: phrase, and, or, not; phrases: in order of the text, repeats included."""

    kind: str
    parts: list = field(default_factory=list)
    phrase: int = -1


def sanitize(text: str) -> str:
    return " ".join(text.translate({ord(c): None for c in RESERVED}).split())


def tokenize(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


def parse_query(text: str, strict: bool = False) -> tuple[Query | None, list[list[str]]]:
    """Implicit AND, AND, OR, NOT (NOT binds closest, then AND); a word of several tokens is a phrase of adjacent ones.

    strict: characters that the grammar reserves raise; else they separate."""
    text = sanitize(text)
    if strict and (bad := re.search(r"[.,'/#;=]", text)):
        raise QuerySyntaxError(f"syntax error near {bad[0]!r}")
    phrases: list[list[str]] = []
    items: list = []
    for word in text.split():
        if word in ("AND", "OR", "NOT"):
            items.append(word)
            continue
        tokens = tokenize(word)
        groups = [tokens] if "_" in word and tokens else [[t] for t in tokens]
        for group in groups:
            phrases.append(group)
            items.append(Query("phrase", phrase=len(phrases) - 1))

    def level(items: list, operator: str, below) -> Query | None:
        runs, now = [], []
        for x in items:
            if x == operator:
                runs.append(now)
                now = []
            else:
                now.append(x)
        runs.append(now)
        if strict and len(runs) > 1 and not all(runs):
            raise QuerySyntaxError(f"{operator} needs both sides")
        parts = [q for r in runs if (q := below(r))]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else Query(operator.lower(), parts)

    def factors(items: list) -> Query | None:
        groups: list[list] = []
        for x in items:
            if isinstance(x, Query) and groups and groups[-1][-1:] == ["NOT"] or x == "NOT" and groups:
                groups[-1].append(x)
            elif x != "NOT":
                groups.append([x])
            elif strict:
                raise QuerySyntaxError("NOT needs both sides")
        parts = []
        for g in groups:
            q = [x for x in g if x != "NOT"]
            parts.append(Query("not", q) if len(q) > 1 else q[0])
        return None if not parts else parts[0] if len(parts) == 1 else Query("and", parts)

    return level(items, "OR", lambda r: level(r, "AND", factors)), phrases


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    # each token padded on both sides, so that occurrences that overlap count each
    padded = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.regexp_count(padded, F.lit(f" {phrase[0]} (?={''.join(f' {w} ' for w in phrase[1:])})"))


def _condition(q: Query, tf: list[Column]) -> Column:
    if q.kind == "phrase":
        return tf[q.phrase] > 0
    parts = [_condition(p, tf) for p in q.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if q.kind == "and" else out | p if q.kind == "or" else out & ~p
    return out


def _counted(q: Query, tf: list[Column], out: dict[int, Column], within: Column) -> dict[int, Column]:
    """Where each phrase adds to the score: every part of the query around it matches the row. What NOT excludes adds nothing."""
    if q.kind == "phrase":
        out[q.phrase] = within
        return out
    for i, part in enumerate(q.parts):
        _counted(part, tf, out, F.lit(False) if q.kind == "not" and i else within & _condition(part if q.kind == "or" else q, tf))
    return out


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def gain(tf: Column, length: Column, average: Column) -> Column:
    """A phrase's share of a score, without its idf."""
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average))


def search(docs: DataFrame, query: str, text: str = "content", keys: tuple[str, ...] = ("doc_id",), limit: int | None = 10, strict: bool = False) -> DataFrame:
    """docs matching the query with `score`, best first; ties by keys."""
    parsed, phrases = parse_query(query, strict)
    if parsed is None:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    number = {tuple(p): i for i, p in enumerate(distinct)}
    counted = docs.withColumn("_tokens", fts_tokens(F.col(text)))
    counted = counted.select(*docs.columns, F.size("_tokens").alias("_length"), *[phrase_count(F.col("_tokens"), p).alias(f"_tf{i}") for i, p in enumerate(distinct)])
    stats = counted.agg(F.count("*").cast("double").alias("_n"), F.avg("_length").alias("_average"), *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(distinct))])
    # stats is one row
    return _scored(counted, stats, parsed, phrases, number, docs.columns, keys, limit)


#: Tokens that a task inverts at a time.
STEP = 1_000_000


def _inverted(batch: pa.RecordBatch, sizes: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows of keys and tokens to a row per key and term."""
    n = batch.num_columns - 1
    coded = batch.column(n).flatten().dictionary_encode()
    terms = np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = row * len(coded.dictionary) + terms
    order = np.argsort(key, kind="stable")  # keeps places in order
    edges = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    first = order[edges]
    offsets = np.append(edges, len(order)).astype(np.int32)
    at = pa.array(row[first])
    columns = [batch.column(k).take(at) for k in range(n)]
    columns += [coded.dictionary.take(pa.array(terms[first])), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype(np.int32))), pa.array(sizes[row[first]].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names)


def postings(docs: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, term, tf, positions, length): one row per term and document, made where the document lies."""
    tokens = docs.select(*keys, fts_tokens(F.col(text)).alias("_tokens"))
    added = "term string, tf int, positions array<int>, length int"
    schema = StructType([*(docs.schema[k] for k in keys), *StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(len(keys)).value_lengths().fill_null(0))
            # about STEP tokens at a time; a longer document is a step of its own
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // STEP, prepend=0))
            for first, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if sizes[first:end].sum():
                    yield _inverted(batch.slice(first, end - first), sizes[first:end], schema.names)

    return tokens.mapInArrow(run, schema)


def lengths(docs: DataFrame, text: str = "content", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, tokens): documents and their tokens."""
    counted = docs.select(*by, F.size(fts_tokens(F.col(text))).alias("_length"))
    return counted.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_length").alias("tokens"))


def corpus_stats(counted: DataFrame) -> DataFrame:
    """lengths() summed up to one row: n, tokens, average length."""
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("average", F.col("tokens") / F.greatest(F.col("n"), F.lit(1)))


def search_index(index: DataFrame, counted: DataFrame, query: str, keys: tuple[str, ...] = ("doc_id",), limit: int | None = 10, strict: bool = False) -> DataFrame:
    """(keys, score) of documents that match, best first, ties by keys. index: postings(), counted: lengths() of all documents.

    Only postings of the query's terms are read; one shuffle brings a document's together, a row for each of them."""
    parsed, phrases = parse_query(query, strict)
    if parsed is None:
        return index.select(*keys, F.lit(0.0).alias("score")).limit(0)
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    number = {tuple(p): i for i, p in enumerate(distinct)}
    terms = sorted({t for p in distinct for t in p})
    in_phrase = {t for p in distinct if len(p) > 1 for t in p}
    found = index.where(F.col("term").isin(terms))
    picked = [F.max("length").alias("_length"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"_n{i}") for i, t in enumerate(terms)]]
    picked += [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(terms) if t in in_phrase]
    rows = found.groupBy(*keys).agg(*picked)

    def back(positions: Column, k: int) -> Column:
        return F.transform(positions, lambda x: x - k)

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            return F.coalesce(F.col(f"_n{terms.index(p[0])}"), F.lit(0))
        first = F.col(f"_p{terms.index(p[0])}")
        for k, t in enumerate(p[1:], 1):
            first = F.array_intersect(first, back(F.col(f"_p{terms.index(t)}"), k))
        return F.coalesce(F.size(first), F.lit(0))

    def counted_phrase(p: list[str]) -> Column:
        some = count(p)
        return F.when(some > 0, some).otherwise(0)

    rows = rows.select(*keys, "_length", *[counted_phrase(p).alias(f"_tf{i}") for i, p in enumerate(distinct)])
    stats = corpus_stats(counted).select(F.col("n").cast("double").alias("_n"), F.col("average").alias("_average"))
    df = rows.agg(*[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(distinct))])
    # stats and df are one row each
    return _scored(rows, stats.crossJoin(F.broadcast(df)), parsed, phrases, number, keys, keys, limit)


def _scored(rows: DataFrame, stats: DataFrame, parsed: Query, phrases: list[list[str]], number: dict, columns, keys, limit: int | None) -> DataFrame:
    """Rows with _length and _tf0, _tf1, ... against one row of statistics: the matching ones with their scores."""
    tf = [F.col(f"_tf{number[tuple(p)]}") for p in phrases]
    counted_in = _counted(parsed, tf, {}, F.lit(True))
    score = F.lit(0.0)
    for i, (p, t) in enumerate(zip(phrases, tf, strict=True)):
        part = idf(F.col("_n"), F.col(f"_df{number[tuple(p)]}")) * gain(t, F.col("_length"), F.col("_average"))
        score = score + F.when(counted_in[i], part).otherwise(0.0)
    hits = rows.where(_condition(parsed, tf)).crossJoin(F.broadcast(stats)).select(*columns, F.round(score, 6).alias("score"))
    return hits.orderBy(F.desc("score"), *keys).limit(limit) if limit else hits


def search_many(index: DataFrame, queries: DataFrame, counted: DataFrame, key: str = "doc_id", limit: int = 10, require_all: bool = True) -> DataFrame:
    """BM25 of every query (qid, query) against postings(): (qid, key, score, rank).

    Only postings of the queries' terms are joined; counted: lengths() of all documents."""
    terms = queries.select("qid", F.explode(fts_tokens(sanitize_query(F.col("query")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    # a row per query and term, with what its query asks in all
    terms = terms.withColumn("wanted", F.count("*").over(Window.partitionBy("qid")))
    stats = corpus_stats(counted).select(F.col("n").cast("double").alias("n"), "average")
    found = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    scored = found.select("term", key, "tf", "length").join(terms.join(df, "term"), "term").crossJoin(F.broadcast(stats))
    part = F.col("times") * idf(F.col("n"), F.col("df")) * gain(F.col("tf"), F.col("length"), F.col("average"))
    hits = scored.groupBy("qid", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"), F.max("wanted").alias("wanted"))
    hits = hits.where("matched = wanted") if require_all else hits
    hits = hits.select("qid", key, F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)
