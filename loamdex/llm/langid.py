"""Language ID (operator 8): segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public
vocabulary. A word's probability is the sum over all its segmentations
into pieces, by the forward algorithm; a text's is the product over its
words. Piece probabilities are fitted by expectation maximisation over
word counts of a bounded sample of training documents (`SAMPLE_ROWS` per
language, chosen by a hash of doc_id; all their words count); scoring
covers every word of every text.

Words: runs of letters, lower-cased; longer ones are cut every
`WORD_CUT` letters. A letter that is no piece has a small probability,
the same in all languages.

Defined results: `und` with score 0 for a null text or one without
letters; repeated rows give repeated rows; a table without training rows
yields `und` everywhere; an empty table gives an empty table; other
columns are ignored; ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_sample, held_out, slices, with_id

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_ROWS, ROUNDS, WORD_CUT = 600, 4, 30
UNKNOWN, FLOOR = 1e-7, 1e-9
#: Words whose probabilities a worker keeps.
CACHED = 250_000
_RUN = re.compile(r"[^\W\d_]+")
_START = "▁"


def words_of(text: str) -> list[str]:
    found = _RUN.findall(text.lower())
    if max(map(len, found), default=0) <= WORD_CUT:
        return found
    return [w[i : i + WORD_CUT] for w in found for i in range(0, len(w), WORD_CUT)]


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if (s := p.removeprefix(_START)).isalpha() and s == s.lower()} | {_START})


class Lattice:
    """Where pieces lie in words: prefix hashes of the code points, looked up in a sorted table."""

    def __init__(self, pieces: list[str]):
        rng = np.random.default_rng(7)
        self.base = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(WORD_CUT, self.longest) + 1, self.base, np.uint64), dtype=np.uint64)))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.base) + ord(c) * 0x9E3779B97F4A7C15) % 2**64
        return h

    def spans(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths with the start mark, and for each (end, length) the words where a piece lies there and which."""
        lengths = np.array([len(w) + 1 for w in words])
        width = int(lengths.max())
        codes = np.frombuffer("".join((_START + w).ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(len(words), width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        prefix = np.zeros((width + 1, len(words)), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * self.base + codes[:, i]
        out = []
        for end in range(1, width + 1):
            alive = np.flatnonzero(lengths >= end)
            if not len(alive):
                break
            for n in range(1, min(end, self.longest) + 1):
                key = prefix[end, alive] - prefix[end - n, alive] * self.powers[n]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                if hit.any():
                    out.append((end, n, alive[hit], self.order[at[hit]]))
        return lengths, out


def forward(lengths: np.ndarray, spans, weights: np.ndarray) -> np.ndarray:
    """Per position, word and language, the summed probability of all segmentations up to there. weights: piece x language."""
    alpha = np.zeros((int(lengths.max()) + 1, len(lengths), weights.shape[1]))
    alpha[0] = 1
    todo = iter([*spans, (1 << 30, 0, None, None)])
    end, n, who, piece = next(todo)
    for at in range(1, alpha.shape[0]):
        alpha[at] = alpha[at - 1] * UNKNOWN
        while end == at:
            alpha[at, who] += alpha[at - n, who] * weights[piece]
            end, n, who, piece = next(todo)
    return alpha


#: Words that one step of the fit works on.
FIT_STEP = 8_192


def _expect(n: np.ndarray, lengths: np.ndarray, spans, w: np.ndarray, expected: np.ndarray) -> None:
    """Add each piece's expected uses in n copies of the words, over all segmentations."""
    every = np.arange(len(lengths))
    alpha = forward(lengths, spans, w)[:, :, 0]
    beta = np.zeros_like(alpha)
    beta[lengths, every] = 1
    share = n / alpha[lengths, every]
    at = len(spans)
    for end in range(alpha.shape[0] - 1, 0, -1):
        beta[end - 1] += beta[end] * UNKNOWN
        while at and spans[at - 1][0] == end:
            at -= 1
            _, m, who, piece = spans[at]
            back = beta[end, who] * w[piece, 0]
            beta[end - m, who] += back
            expected += np.bincount(piece, alpha[end - m, who] * back * share[who], len(expected))


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, the pieces that matter, and their probabilities (piece x language), from word counts by language."""
    languages = sorted(counts)
    lattice = Lattice(pieces)
    weights = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for k, language in enumerate(languages):
        words = sorted(counts[language], key=len)
        # by length, so that words of a chunk take positions alike
        chunks = [(np.array([counts[language][w] for w in part], float), *lattice.spans(part)) for i in range(0, len(words), FIT_STEP) for part in [words[i : i + FIT_STEP]]]
        for _ in range(rounds if words else 0):
            expected = np.full(len(pieces), 1e-3)
            for n, lengths, spans in chunks:
                _expect(n, lengths, spans, weights[:, [k]], expected)
            weights[:, k] = expected / expected.sum()
    used = np.flatnonzero(weights.max(axis=1) > FLOOR * 100)
    return languages, [pieces[i] for i in used], weights[used]


class Scorer:
    """Log probabilities of words under each language, cached up to a bound."""

    def __init__(self, languages: list[str], pieces: list[str], weights: np.ndarray, cached: int = CACHED):
        # with more than four languages fewer words at a time, so that many take no more memory
        self.languages, self.weights, self.cached, self.step = languages, weights, cached * 4 // max(4, len(languages)), max(1, 16_384 // max(4, len(languages)))
        self.lattice = Lattice(pieces) if pieces else None
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), self.step):
            some = order[i : i + self.step]
            lengths, spans = self.lattice.spans([words[j] for j in some])
            alpha = forward(lengths, spans, self.weights)
            out[some] = np.log(np.maximum(alpha[lengths, np.arange(len(some))], 1e-300))
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [words_of(t) if t else [] for t in texts]
        seen = set().union(*docs)
        new = seen - self.known.keys()
        if len(self.known) + len(new) > self.cached:
            self.known, self.table, new = {}, self.table[:0], seen
        if new and self.lattice:
            new = list(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate((self.table, self.word_scores(new)))
        out = []
        for text, words in zip(texts, docs, strict=True):
            if not words or not self.lattice or not any(c.isalpha() for w in words[:50] for c in w) and not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS, path: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """Fit on a bounded sample of rows with a language; df needs doc_id."""
    df = df.select("doc_id", F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    some = bounded_sample(df, rows, "lang")
    runs = "regexp_extract_all(lower(text), '\\\\p{L}+', 0)"
    cut = f"flatten(transform({runs}, w -> transform(sequence(0, (length(w) - 1) div {WORD_CUT}), i -> substring(w, int(i * {WORD_CUT} + 1), {WORD_CUT}))))"
    counted = some.select("lang", F.explode(F.expr(cut)).alias("word")).groupBy("lang", "word").count()
    counts: dict[str, dict[str, int]] = {}
    for r in counted.collect():  # the words of a bounded sample
        counts.setdefault(r.lang, {})[r.word] = r["count"]
    return fit(counts, vocabulary_pieces(path)) if counts else ([], [], np.zeros((0, 0)))


def identify(df: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per input row: the id, lang_pred and score. training: rows to learn from; by default those of df that are not held out."""
    model = train(df.where(~held_out(F.col("doc_id"))) if training is None else training, text_col=text_col, **options)
    model = df.sparkSession.sparkContext.broadcast(model)
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                got = scorer.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.mapInArrow(score, with_id(df, "lang_pred string, score double"))
