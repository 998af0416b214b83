"""Vocabulary and query correction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from loamdex.functions.text import split_compound, vocabulary_tokens


def build_vocabulary(docs: DataFrame, text: str = "content", camel: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, word, frequency) over whole documents; tokens count with their compound parts. Partial counts are made before the shuffle."""
    words = docs.select(*by, F.explode(vocabulary_tokens(F.col(text))).alias("token")).groupBy(*by, "token").count()
    return words.select(*by, F.explode(split_compound(F.col("token"), camel)).alias("word"), "count").groupBy(*by, "word").agg(F.sum("count").alias("frequency"))


#: Unknown words whose substrings are broadcast; more are joined by shuffle.
BROADCAST_WORDS = 2_000


def _segment(length, cap, i):
    """Start (from 0) and length of the i-th of cap + 1 nearly equal segments of a word."""
    parts = cap + 1
    base = F.floor(length / parts).cast("int")
    longer = length - base * parts
    return i * base + F.greatest(F.lit(0), i - parts + longer), base + (i >= parts - longer).cast("int")


def _segments(vocabulary: DataFrame) -> DataFrame:
    """(candidate, frequency, cap, n, i, piece): a word's segments, one of which any word within cap edits holds whole, at most cap places away."""
    grid = F.array(*[F.struct(F.lit(cap).alias("cap"), F.lit(i).alias("i")) for cap in (2, 3) for i in range(cap + 1)])
    rows = vocabulary.select(F.col("word").alias("candidate"), "frequency", F.length("word").alias("n"), F.explode(grid).alias("g")).select("candidate", "frequency", "n", "g.*")
    start, size = _segment(F.col("n"), F.col("cap"), F.col("i"))
    return rows.withColumn("piece", F.substr("candidate", start + 1, size))


def _substrings(words: DataFrame) -> DataFrame:
    """words (word, cap) to (word, cap, n, i, piece): what they hold where segments of words within cap edits may lie."""
    grid = words.sparkSession.createDataFrame([(cap, more, i, shift) for cap in (2, 3) for more in range(-cap, cap + 1) for i in range(cap + 1) for shift in range(-cap, cap + 1)], "cap int, more int, i int, shift int")
    rows = words.join(F.broadcast(grid), "cap").withColumn("n", F.length("word") + F.col("more")).where("n > 0")
    start, size = _segment(F.col("n"), F.col("cap"), F.col("i"))
    rows = rows.withColumn("at", start + F.col("shift")).withColumn("size", size).where("at >= 0 and at + size <= length(word)")
    return rows.select("word", "cap", "n", "i", F.substr("word", F.col("at") + 1, F.col("size")).alias("piece")).distinct()


def correct_words(words: DataFrame, vocabulary: DataFrame, least: int = 1) -> DataFrame:
    """words (word) to (word, corrected): itself if known or nothing is near; else the vocabulary's nearest within 2 edits
    (3 if longer than 8 bytes), then the most frequent, then the first by name.

    Candidates come from an equi join: a word cut into cap + 1 segments has one that cap edits leave whole, and that lies at most cap
    places away. Each is verified by its edit distance."""
    known = vocabulary.select("word").withColumn("_known", F.lit(True))
    asked = words.select("word").distinct().join(known, "word", "left")
    unknown = asked.where(F.col("_known").isNull() & (F.length("word") >= least)).select("word", F.when(F.octet_length("word") <= 8, 2).otherwise(3).alias("cap"))
    parts = _substrings(unknown)
    parts = F.broadcast(parts) if unknown.count() <= BROADCAST_WORDS else parts
    near = _segments(vocabulary).join(parts, ["cap", "n", "i", "piece"])
    near = near.withColumn("distance", F.levenshtein("word", "candidate", 3)).where("distance >= 0 and distance <= cap")
    # the best as one aggregate, so partial results are combined before the shuffle
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("frequency")).alias("f"), "candidate")).alias("best"))
    return asked.select("word").join(best, "word", "left").select("word", F.coalesce("best.candidate", "word").alias("corrected"))


def correct_queries(queries: DataFrame, vocabulary: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """queries (qid, query) to the corrected ones (qid, query, corrected) and the changes (qid, pos, from_word, to_word)."""
    words = queries.select("qid", F.posexplode(F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "")).alias("pos", "word"))
    fixed = words.join(correct_words(words, vocabulary, least), "word")
    whole = fixed.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "corrected"))), lambda x: x["corrected"]), " ").alias("corrected"))
    changes = fixed.where("word <> corrected").select("qid", "pos", F.col("word").alias("from_word"), F.col("corrected").alias("to_word"))
    return queries.join(whole, "qid", "left").withColumn("corrected", F.coalesce("corrected", F.lit(""))), changes


#: Words of one query that each vocabulary word is held against; more go by segments.
FEW = 16


def correct_query(query: str, vocabulary: DataFrame, least: int = 1) -> tuple[str, list[tuple[int, str, str]]]:
    """One query as correct_queries() corrects it, and its changes (pos, from_word, to_word).

    vocabulary: (word, frequency), a word in any number of rows. Its few words are literals of one scan, whose partial results are
    combined before the shuffle; frequencies are summed for the words that are near only."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", query.lower()) if w]
    asked = list(dict.fromkeys(w for w in words if len(w) >= least))
    if not asked:
        return " ".join(words), []
    if len(asked) > FEW:
        whole = vocabulary.groupBy("word").agg(F.sum("frequency").alias("frequency"))
        found = correct_words(vocabulary.sparkSession.createDataFrame([(w,) for w in asked], "word string"), whole).select("word", "corrected")
    else:
        each = F.explode(F.array(*[F.struct(F.lit(w).alias("asked"), F.lit(2 if len(w.encode()) <= 8 else 3).alias("cap")) for w in asked])).alias("a")
        near = vocabulary.select("word", "frequency", each).select("word", "frequency", "a.*").where(F.abs(F.length("word") - F.length("asked")) <= F.col("cap"))
        near = near.withColumn("distance", F.levenshtein("asked", "word", 3)).where("distance >= 0 and distance <= cap")
        near = near.groupBy("asked", "distance", "word").agg(F.sum("frequency").alias("frequency"))
        best = F.min(F.struct("distance", (-F.col("frequency")).alias("f"), "word"))
        found = near.groupBy("asked").agg(best.alias("best")).select("asked", "best.word")
    to = {a: b for a, b in found.collect()}
    fixed = [to.get(w, w) for w in words]
    return " ".join(fixed), [(i, a, b) for i, (a, b) in enumerate(zip(words, fixed, strict=True)) if a != b]


def suggest(vocabulary: DataFrame, word: str, limit: int = 5) -> DataFrame:
    """The nearest words of a vocabulary to one word."""
    cap = 2 if len(word.encode()) <= 8 else 3
    near = vocabulary.withColumn("distance", F.levenshtein("word", F.lit(word), cap)).where("distance >= 0")
    return near.orderBy("distance", F.desc("frequency"), "word").limit(limit)
