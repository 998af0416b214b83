"""Raw line scan: exact substrings and fuzzy subsequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loamdex.functions.text import lines

_MATCH, _RUN, _BOUNDARY, _GAP = 16, 16, 8, 1


#: Characters that a task scores at a time; a longer line is scored alone.
STEP = 1_000_000
# a segment's own offset, and what stands for no alignment; both far beyond any score and any place
_APART, _NONE = 1 << 42, -(1 << 40)


def fuzzy_score(line: str, query: str) -> float:
    """How well the query's characters, in order, match the line: 0 if they don't, at most 1.

    Points for each match, for runs and for starts of words, less for gaps; the best alignment counts. Case is ignored unless the query has capitals."""
    return float(fuzzy_scores([line], query)[0])


def fuzzy_scores(rows: list[str], query: str) -> np.ndarray:
    """fuzzy_score() of many lines, some STEP characters at a time."""
    out, first, held = np.zeros(len(rows)), 0, 0
    for i, line in enumerate(rows):
        if held and held + len(line) > STEP:
            out[first:i] = _scores(rows[first:i], query)
            first, held = i, 0
        held += len(line)
    out[first:] = _scores(rows[first:], query)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _scores(rows: list[str], query: str) -> np.ndarray:
    """All lines in one array; only places of the query's characters are looked at."""
    size = np.array([len(x) for x in rows], np.int64)
    if not query or not size.sum():
        return np.zeros(len(rows))
    raw = _codes("".join(rows))
    if query == query.lower():
        text = _codes("".join(low if len(low := x.lower()) == len(x) else x for x in rows))
    else:
        text = raw
    wanted = np.unique(_codes(query))
    place = np.flatnonzero(np.isin(text, wanted)).astype(np.int64)
    if not len(place):
        return np.zeros(len(rows))
    code = text[place]
    ends = np.cumsum(size)
    row = np.searchsorted(ends, place, "right")
    start = place == (ends - size)[row]
    # 1: letter or digit, 2: lower case, 4: upper case
    kind = np.zeros(int(raw.max()) + 1, np.uint8)
    for c in np.flatnonzero(np.bincount(raw)).tolist():
        kind[c] = chr(c).isalnum() | chr(c).islower() << 1 | chr(c).isupper() << 2
    before, here = kind[raw[place - 1]], kind[raw[place]]
    edge = start | (before & 1 == 0) | (before & 2 > 0) & (here & 4 > 0)
    points = _MATCH + _BOUNDARY * edge.astype(np.int64)
    run = np.concatenate(([False], place[1:] == place[:-1] + 1)) & ~start
    apart = row * _APART
    # best: of alignments whose last match stands at this place
    best = np.where(code == ord(query[0]), points, _NONE)
    for q in query[1:]:
        # any earlier place of the line less what the gap costs, or the place before with what a run gains
        reached = np.maximum.accumulate(best + _GAP * place + apart)
        earlier = np.full(len(place), _NONE)
        earlier[1:] = reached[:-1] - (apart + _GAP * (place - 1))[1:]
        earlier[1:] = np.maximum(earlier[1:], np.where(run[1:], best[:-1] + _RUN, _NONE))
        best = np.where((code == ord(q)) & (earlier > _NONE // 2), earlier + points, _NONE)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    out = np.zeros(len(rows))
    out[row[first]] = np.clip(np.maximum.reduceat(best, first) / 256.0, 0.0, 1.0)
    return out


def line_rows(docs: DataFrame, text: str = "content", file: str = "file") -> DataFrame:
    """(file, line_no, line): trimmed, non-empty lines, numbered from 1."""
    rows = docs.select(file, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    return rows.select(file, (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def search(docs: DataFrame, query: str, limit: int | None = 10, exact: bool = False, text: str = "content", file: str = "file") -> DataFrame:
    """(file, line_no, line, score), best first. exact: a substring, whatever its case, scores 1."""
    if exact:
        # documents without the words never have their lines exploded
        some = docs.where(F.lower(F.col(text)).contains(query.lower()))
        hits = line_rows(some, text, file).where(F.lower(F.col("line")).contains(query.lower())).withColumn("score", F.lit(1.0))
    else:
        # the query as a subsequence; each part stops at its character, so the match never backtracks
        pattern = "^" + "".join(f"[^{re.escape(c)}]*{re.escape(c)}" for c in query)
        subject = F.col("line") if query != query.lower() else F.lower(F.col("line"))

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(fuzzy_scores(s.tolist(), query))

        hits = line_rows(docs, text, file).where(subject.rlike(pattern)).withColumn("score", score("line")).where("score > 0")
    return hits.orderBy(F.desc("score"), file, "line_no").limit(limit) if limit else hits
