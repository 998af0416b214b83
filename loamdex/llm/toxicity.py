"""Toxicity (operator 1): Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled rows: whole words, and stems that
many different words share, which toxic documents hold and clean ones do
not. It is a trie; the automaton that accepts everything within one edit
(insertion, deletion, substitution, transposition) of an entry is
intersected with it and made deterministic lazily, so a word is checked in
a few steps and most words die after two or three letters.

Each hit is weighed by its window of `WINDOW` words on either side: inside
quotation marks, or beside words of reporting, it counts as quotation
rather than abuse. A logistic regression on the abuse weight (piecewise),
the quoted weight and the hits per hundred words gives the score.

Learning uses a bounded sample: about `SAMPLE_ROWS` labelled rows per
label, chosen by a hash of doc_id, never a held-out one; of their words
all that tell are learned, short, long or many. Stems and misspellings
need a few letters (`STEM`, `FUZZY`), or nearly every word would be one. The
score uses the text alone, all of it.

Defined results: null and empty texts have no hits and get the score of a
document without any; rows without a label are scored alike; a label of
null teaches nothing; without labelled rows every score is 0; repeated
rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_sample, held_out, slices, with_id

SAMPLE_ROWS, THRESHOLD, WINDOW = 2_500, 0.7, 8
#: A stem has at least so many letters; a word or stem may be misspelt from so many letters on.
STEM, FUZZY = 4, 5
#: Words that a worker keeps as known to be clean, and as hits, before it forgets them and looks them up again.
CLEAN = 300_000
_PARTS = re.compile(r"[\w@$*!'’+]+")
_EDGES = "@$*!'’+_"
# Marks of quotation and words of reporting.
OPENING, CLOSING = "\"“«„‘‹'", "\"”»“’›'"
REPORTING = frozenset("said says wrote quoted quote quotes called calls word term phrase reported claimed dit écrit cité mot sagte schrieb zitat wort dijo escribió cita palabra".split())


class Lexicon:
    """A trie of whole words and stems, and the lazily built automaton that finds them within one edit."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], benign: list[str] = ()):
        self.entries = [*words, *stems]
        self.weights = [*words.values(), *stems.values()]
        self.benign = frozenset(benign)
        self.next: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        for i, w in enumerate(self.entries):
            at = 0
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            (self.word_at if i < len(words) else self.stem_at)[at] = i
        self.letters = {c for n in self.next for c in n}
        self.depth_ok = {i: len(w) >= FUZZY for i, w in enumerate(self.entries)}
        start = self._close({(0, 0)})
        self.states: dict[frozenset, int] = {start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.final: list[tuple[int, str] | None] = [self._final(start)]
        self.stem: list[tuple[int, str] | None] = [None]

    def weight(self, hit: tuple[int, str]) -> float:
        return self.weights[hit[0]] * (NEAR if hit[1] == "near" else 1.0)

    def _close(self, states: set) -> frozenset:
        """With the letters of an entry that a word may leave out."""
        out = set(states)
        for s in states:
            if len(s) == 2 and s[1] == 0:
                out.update((child, 1) for child in self.next[s[0]].values())
        return frozenset(out)

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for s in states:
            if len(s) == 3:  # the second letter of a transposition
                if c == s[1]:
                    out.add((s[0], 1))
                continue
            node, edits = s
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, edits))
            if not edits:
                out.add((node, 1))
                for first, there in self.next[node].items():
                    if first != c:
                        out.add((there, 1))
                        swapped = self.next[there].get(c)
                        if swapped is not None:
                            out.add((swapped, first, 1))
        # nothing is as far as a state without edits that stands at the same node
        return self._close({s for s in out if not (len(s) == 2 and s[1] == 1 and (s[0], 0) in out)})

    def _final(self, states: frozenset) -> tuple[int, str] | None:
        exact = [self.word_at[s[0]] for s in states if len(s) == 2 and s[1] == 0 and s[0] in self.word_at]
        near = [i for s in states if len(s) == 2 and s[1] == 1 and (i := self.word_at.get(s[0])) is not None and self.depth_ok[i]]
        return (min(exact), "exact") if exact else (min(near), "near") if near else None

    def _state(self, states: frozenset) -> int:
        if states not in self.states:
            self.states[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.final.append(self._final(states))
            stems = [self.stem_at[s[0]] for s in states if len(s) == 2 and s[1] == 0 and s[0] in self.stem_at]
            self.stem.append((min(stems), "stem") if stems else None)
        return self.states[states]

    def look(self, word: str) -> tuple[int, str] | None:
        """(entry, kind) of a word: exact, stem or near (one edit away); None if it is none."""
        at, moves, letters, stem = 0, self.moves, self.letters, None
        for c in word:
            c = c if c in letters else "\0"
            to = moves[at].get(c)
            if to is None:
                to = moves[at][c] = self._state(self._step(self.sets[at], c)) if self.sets[at] else at
            at = to
            if not self.sets[at]:
                return stem
            stem = stem or self.stem[at]
        found = self.final[at]
        if found and found[1] == "near" and (stem or word in self.benign):
            return stem
        return found or stem


class Scanner:
    """Hits of a text and their weights; words known to be clean and known hits are kept from text to text, which changes the speed only."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.clean: set[str] = set()
        self.bad: dict[str, tuple[int, str]] = {}

    def _token(self, token: str) -> tuple[int, str] | None:
        best = None
        for part in _PARTS.findall(token):
            word = part.strip(_EDGES)
            found = self.lexicon.look(word) if word else None
            if found and (best is None or self.lexicon.weight(found) > self.lexicon.weight(best)):
                best = found
        return best

    def hits(self, text: str | None) -> tuple[list[tuple[int, tuple[int, str], bool]], int]:
        """(place, (entry, kind), quoted) of each hit, and the number of words."""
        if not text:
            return [], 0
        tokens = text.lower().split()
        if len(self.clean) > CLEAN:
            self.clean = set()
        if len(self.bad) > CLEAN:
            self.bad = {}
        seen = set(tokens)
        for token in seen - self.clean:
            if token not in self.bad:
                found = self._token(token)
                if found is None:
                    self.clean.add(token)
                else:
                    self.bad[token] = found
        if seen.isdisjoint(self.bad):
            return [], len(tokens)
        places = [i for i, t in enumerate(tokens) if t in self.bad]
        return [(i, self.bad[tokens[i]], quoted(tokens, i)) for i in places], len(tokens)

    def features(self, text: str | None) -> tuple[float, ...]:
        """The abuse weight in three pieces (to 1, to 2, to 6), the quoted weight, the density; then hits and quoted hits."""
        hits, n = self.hits(text)
        abuse = sum(self.lexicon.weight(h) for _, h, q in hits if not q)
        quote = sum(self.lexicon.weight(h) for _, h, q in hits if q)
        return min(abuse, 1.0), min(max(abuse - 1, 0.0), 1.0), min(max(abuse - 2, 0.0), 4.0), min(quote, 6.0), min(100 * abuse / n, 3.0) / 3 if n else 0.0, len(hits), sum(q for *_, q in hits)


def quoted(tokens: list[str], at: int) -> bool:
    """Whether the window around a hit is a quotation: marks open before it and close after it, or a word of reporting next to a mark."""
    before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
    opened = False
    for t in before:
        opened = t[0] in OPENING or opened and (t is before[-1] or t.rstrip(".,;:!?")[-1:] not in CLOSING)
    closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING and len(t) > 1 for t in after)
    if opened and closed:
        return True
    return (opened or closed) and any(t.strip(".,;:!?\"'") in REPORTING for t in before + after)


def learn_lexicon(rows: DataFrame, toxic: int, clean: int, share: float = 0.015, precision: float = 0.95) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems of a sample (columns text, toxic) that tell, with their weights: words in `share` of the toxic rows, stems four times as often."""
    # a word counts once per word before it, so that copies of one passage count once, whatever their number
    found = F.expr("regexp_extract_all(lower(text), '\\\\p{L}+', 0)")
    pairs = rows.select("toxic", found.alias("w")).withColumn("b", F.expr("concat(array(''), w)")).select("toxic", F.explode(F.arrays_zip("w", "b")).alias("x"))
    pairs = pairs.select("toxic", F.col("x.w").alias("w"), F.xxhash64("x.b").alias("before")).distinct()
    keys = F.array_distinct(F.transform(F.sequence(F.lit(STEM), F.lit(8)), lambda n: F.left(F.col("w"), n)))
    docs = pairs.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    least = max(5, int(toxic * share))

    def telling(t, c):
        return (t >= least) & (t / toxic >= precision * (t / toxic + c / max(clean, 1)))

    def weight(t: int, c: int) -> float:
        odds = (min(t, toxic) + 1) / (toxic + 2) / ((min(c, clean) + 1) / (clean + 2))
        return min(1.0, max(0.1, math.log(odds) / 4))

    found = {r.w: weight(r.t, r.c) for r in docs.where(telling(F.col("t"), F.col("c"))).orderBy(F.desc("t"), "w").collect()}
    heads = docs.where(F.length("w") >= STEM).withColumn("p", F.explode(keys)).groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.max("t").alias("one"), F.count("*").alias("words"))
    heads = heads.where(telling(F.col("t"), F.col("c")) & (F.col("t") >= 4 * least) & (F.col("t") >= 1.5 * F.col("one")) & (F.col("words") >= 5))
    heads = {r.p: (r.t, r.c) for r in heads.orderBy(F.desc("t"), "p").collect()}
    stems = []
    for p in sorted(heads, key=lambda p: (len(p), p)):
        if any(p.startswith(s) for s in stems):
            continue
        while longer := next((q for q in heads if len(q) == len(p) + 1 and q.startswith(p) and heads[q][0] >= 0.97 * heads[p][0]), None):
            p = longer
        stems.append(p)
    return {w: x for w, x in found.items() if not any(w.startswith(s) for s in stems)}, {p: weight(*heads[p]) for p in stems}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 25, count: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Newton's method. count: how often each row counts."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    count = np.ones(len(y)) if count is None else count
    scale = count.sum() / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.append(np.full(x.shape[1] - 1, ridge * scale), 1e-3)
        w -= np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (count * (p - y)) + keep * w)
    return w


#: What a misspelt entry weighs against the entry itself.
NEAR = 0.9


def train(df: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict | None:
    """The model, or None without both labels. df needs doc_id and text, labels doc_id and the label."""
    labels = labels.select("doc_id", F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    some = bounded_sample(labels, rows, "toxic").dropDuplicates(["doc_id"])
    # at most about 2 * rows labels: bounded, so broadcast
    sample = df.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").where("text is not null").select("text", "toxic")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    words, stems = learn_lexicon(sample, n[1], n[0])
    counted = sample.mapInArrow(_near_words(words, stems), "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    benign = [r.word for r in counted.where("c > 0").orderBy(F.desc("c"), "word").collect()]
    x = sample.mapInArrow(_features(words, stems, benign), "x array<double>, toxic int").collect()
    y = np.array([r.toxic for r in x], float)
    fitted = logistic(np.array([r.x for r in x]), y)
    return {"words": words, "stems": stems, "benign": benign, "logistic": fitted.tolist()}


def _near_words(words, stems):
    """The words of each row that are one edit from an entry, to learn which of them clean rows use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Lexicon(words, stems))
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                hits, _ = scanner.hits(text)
                tokens = text.lower().split() if hits else []
                parts = {part.strip(_EDGES) for i, (_, k), _ in hits if k == "near" for part in _PARTS.findall(tokens[i])}
                rows.extend((part, toxic) for part in parts)
            columns = zip(*rows, strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32()), strict=True)], ["word", "toxic"])

    return run


def _features(words, stems, benign):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Lexicon(words, stems, benign))
        for batch in batches:
            rows = [scanner.features(t)[:5] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per input row: the id, score, predicted, n_hits and n_quoted."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scanner = Scanner(Lexicon(m["words"], m["stems"], m["benign"])) if m else None
        for batch in batches:
            for part in slices(batch, "text"):
                if scanner is None:
                    zero = [0] * part.num_rows
                    got, p = [zero, zero], np.zeros(part.num_rows)
                else:
                    found = [scanner.features(t) for t in part.column("text").to_pylist()]
                    x = np.array([f[:5] for f in found])
                    w = np.array(m["logistic"])
                    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                    got = [[f[5] for f in found], [f[6] for f in found]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), *(pa.array(g, pa.int32()) for g in got)], ["doc_id", "score", "predicted", "n_hits", "n_quoted"])

    return df.mapInArrow(run, with_id(df, "score double, predicted int, n_hits int, n_quoted int"))
