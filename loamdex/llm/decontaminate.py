"""Benchmark decontamination (operator 5): a broadcast hash set of the
benchmark's word windows; document windows are scanned, looked up and
verified word by word.

Words: A-Z lower-cased, runs of letters, digits and characters beyond
ASCII. A window is `width` consecutive words of an item; an item of fewer
words, but not none, is one window. Only the benchmark is broadcast, as
flat arrays (the words' bytes, their ends, sorted window hashes and where
each window starts), and only up to `block_bytes` of its words at a time,
which take about `5 * block_bytes` of memory, and a table of the block's
distinct words in each worker; long items are cut into pieces that overlap by a window less a word. A larger benchmark is worked
through in blocks, one after the other: the driver builds one, a pass over
the documents writes the spans and items that it hits, one row for each
document hit, and the block is dropped. The spans of all blocks are merged
by row number at the end. So nothing depends on the benchmark's size but
the number of passes.

Defined results: null and empty texts have no words and no hits; repeated
items count once per item_id; items without an id are searched like others,
count as one item together and are left out of items_sha256; repeated
documents are judged each; an empty benchmark hits nothing; other columns
are ignored, and clash with nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import as_bytes, materialise, slices, with_id

WIDTH, BLOCK_BYTES = 10, 8_000_000
#: Words of one piece of a long item.
PIECE = 50_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Hasher:
    """Hashes of windows of words, as sums of the words' own hashes times an odd number for each place."""

    def __init__(self, width: int = WIDTH):
        self.odd = np.random.default_rng(20240229).integers(0, 2**63, max(width, 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def words(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def windows(self, words: np.ndarray, n: int) -> np.ndarray:
        """The hash of every n words in a row."""
        out = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            out += words[j : j + len(out)] * self.odd[j]
        return out ^ out >> np.uint64(29)

    def at(self, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """The same at some places only."""
        out = np.zeros(len(starts), np.uint64)
        for j in range(n):
            out += words[starts + j] * self.odd[j]
        return out ^ out >> np.uint64(29)


#: Owners of windows that a worker keeps.
_OWNERS = 25_000


class Windows:
    """The windows of one block of items, as flat arrays: by number of words, sorted hashes and the first word of each.

    items: (item, its words joined by blanks); repeated windows keep each of their places."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        self.width, self.names = width, [item for item, _ in items]
        self.blob = b" ".join(text for _, text in items) + b" "
        ends = np.flatnonzero(np.frombuffer(self.blob, np.uint8) == 32)
        self.ends = ends.astype(np.uint32 if len(self.blob) < 1 << 32 else np.uint64)
        counts = np.array([text.count(b" ") + 1 for _, text in items], np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # of each item, the number of its first word
        hasher, found = Hasher(width), {}
        for start in range(0, len(items), 256):  # the words of few items at a time are objects
            some = items[start : start + 256]
            hashes = hasher.words(list(chain.from_iterable(text.split(b" ") for _, text in some)))
            base = int(self.first[start])
            for n in {min(width, int(c)) for c in counts[start : start + 256]}:
                rolled = hasher.windows(hashes, n)
                for i in np.flatnonzero(np.minimum(counts[start : start + 256], width) == n) + start:
                    at, many = int(self.first[i]) - base, int(counts[i]) - n + 1
                    found.setdefault(n, []).append((rolled[at : at + many], np.arange(at + base, at + base + many, dtype=np.uint32)))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in sorted(found.items()):
            hashes, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.tables[n] = hashes[order], at[order]
        self._numbers: dict[bytes, int] | None = None

    def _text(self, word: int, n: int) -> bytes:
        start = int(self.ends[word - 1]) + 1 if word else 0
        return self.blob[start : int(self.ends[word + n - 1])]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_numbers": None}

    def _prepare(self) -> None:
        """In a worker: a number for each distinct word of the block, its hash, and owners known so far."""
        self._numbers = {w: i for i, w in enumerate(dict.fromkeys(self.blob.split()), 1)}
        self._hasher, self._owned = Hasher(self.width), {}
        self._hashes = np.concatenate(([np.uint64(0)], self._hasher.words(list(self._numbers))))

    def _owners(self, text: bytes, n: int, places: np.ndarray) -> set[str | None]:
        return {self.names[int(np.searchsorted(self.first, w, "right")) - 1] for w in places.tolist() if self._text(w, n) == text}

    def find(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, set[str | None]]]:
        """(document, first word, number of words, items) of each occurrence, verified word by word."""
        if self._numbers is None:
            self._prepare()
        if len(self._owned) > _OWNERS:
            self._owned.clear()
        lengths = np.array([len(d) + 1 for d in docs], np.int64)
        base = np.concatenate(([0], np.cumsum(lengths)))
        # one more word, which no item has, after each document
        numbers = np.zeros(base[-1], np.int64)
        inside = np.ones(len(numbers), bool)
        inside[base[1:] - 1] = False
        numbers[inside] = np.fromiter(map(self._numbers.get, chain.from_iterable(docs), repeat(0)), np.int64, int(inside.sum()))
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        words = self._hashes[numbers]
        for n, (hashes, places) in self.tables.items():
            if len(numbers) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[: len(unknown) - n])
            if not len(starts):
                continue
            rolled = self._hasher.at(words, starts, n)
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for k in np.flatnonzero(hashes[at] == rolled).tolist():
                doc = int(np.searchsorted(base, starts[k], "right")) - 1
                start = int(starts[k] - base[doc])
                text = b" ".join(docs[doc][start : start + n])
                own = self._owned.get((n, text))
                if own is None:
                    own = self._owned[n, text] = self._owners(text, n, places[int(at[k]) : int(np.searchsorted(hashes, rolled[k], "right"))])
                if own:
                    yield doc, start, n, own


def _pieces(width: int):
    """Items (item, text) to (item, words), long ones in pieces of `PIECE` words that overlap by width - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                items, words = [], []
                for item, text in zip(part.column("item").to_pylist(), as_bytes(part.column("text")), strict=True):
                    found = words_of(text) if text else []
                    for i in range(0, max(1, len(found) - width + 1), PIECE) if found else ():
                        items.append(item)
                        words.append(b" ".join(found[i : i + PIECE + width - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.binary())], ["item", "words"])

    return run


_SPANS = "array<struct<first:int,end:int>>"
_HITS = f"spans {_SPANS}, items array<string>, unnamed boolean"
_RESULT = f"n_words long, n_hit long, n_items long, items_sha256 string, spans {_SPANS}"
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, spans (first word, word after the last) of the hit words, contaminated."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = with_id(df, _RESULT)
    pieces = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).mapInArrow(_pieces(width), "item string, words binary")
    pieces = materialise(pieces, "benchmark-words")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    sc = df.sparkSession.sparkContext
    if n == 1:
        out = df.mapInArrow(_judge(_broadcast(sc, pieces, width)), schema)
        return out.withColumn("contaminated", F.col("n_hit") > 0)
    rows = materialise(df.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = []
    for k in range(n):
        table = _broadcast(sc, pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k), width)
        found.append(materialise(rows.mapInArrow(_hits(table), f"row long, {_HITS}"), "decontaminate-hits"))
        table.destroy()
    hits = found[0]
    for part in found[1:]:
        hits = hits.unionByName(part)
    merged = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("unnamed").alias("unnamed"))
    out = rows.join(merged, "row", "left").select("doc_id", "text", "spans", "items", "unnamed").mapInArrow(_merge, schema)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _broadcast(sc, pieces: DataFrame, width: int):
    return sc.broadcast(Windows([(r.item, bytes(r.words)) for r in pieces.toLocalIterator()], width))


def _marked(docs: list[list[bytes]], windows: Windows) -> tuple[dict[int, np.ndarray], dict[int, set[str | None]]]:
    hit: dict[int, np.ndarray] = {}
    items: dict[int, set[str | None]] = {}
    for i, at, n, own in windows.find(docs):
        if i not in hit:
            hit[i], items[i] = np.zeros(len(docs[i]), bool), set()
        hit[i][at : at + n] = True
        items[i] |= own
    return hit, items


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _words(part: pa.RecordBatch) -> list[list[bytes]]:
    return [words_of(t) if t else [] for t in as_bytes(part.column("text"))]


def _results(part: pa.RecordBatch, docs: list[list[bytes]], hit: dict[int, np.ndarray], items: dict[int, set[str | None]]) -> pa.RecordBatch:
    k = range(len(docs))
    columns = [
        pa.array([len(d) for d in docs], pa.int64()), pa.array([int(hit[i].sum()) if i in hit else 0 for i in k], pa.int64()), pa.array([len(items.get(i, ())) for i in k], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(x for x in items.get(i, ()) if x is not None)).encode()).hexdigest() for i in k], pa.string()),
        pa.array([_runs(hit[i]) if i in hit else [] for i in k], _ARROW_SPANS),
    ]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"])


def _judge(table):
    """One block is all: results where the documents lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                docs = _words(part)
                yield _results(part, docs, *_marked(docs, table.value))

    return run


def _hits(table):
    """One block of several: a row for each document that it hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hit, items = _marked(_words(part), table.value)
                if hit:
                    k = sorted(hit)
                    rows, own = part.column("row").take(pa.array(k)), [sorted(x for x in items[i] if x is not None) for i in k]
                    yield pa.RecordBatch.from_arrays([rows, pa.array([_runs(hit[i]) for i in k], _ARROW_SPANS), pa.array(own, pa.list_(pa.string())), pa.array([None in items[i] for i in k])], ["row", "spans", "items", "unnamed"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the spans and items of all blocks to results."""
    for batch in batches:
        for part in slices(batch, "text"):
            docs = _words(part)
            hit, items = {}, {}
            for i, (spans, own, unnamed) in enumerate(zip(*(part.column(c).to_pylist() for c in ("spans", "items", "unnamed")), strict=True)):
                if spans:
                    hit[i], items[i] = np.zeros(len(docs[i]), bool), {*own, *([None] if unnamed else [])}
                    for s in spans:
                        hit[i][s["first"] : s["end"]] = True
            yield _results(part, docs, hit, items)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, p = [], 0
    for first, end in spans:
        out.append(text[p : at[first][0]])
        p = at[end - 1][1]
    return "".join([*out, text[p:]])


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without contaminated documents, or (remove="spans") with the hit words cut out of their texts. Rows are matched by the text itself, so repeated ids do no harm."""
    found = contamination(df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text")), benchmark, "row", "text", **options)
    if remove == "documents":
        return found.where("not contaminated").select("doc_id.*")
    cut = F.udf(lambda t, s: without_spans(t, [(x.first, x.end) for x in s]) if s else t, "string")
    return found.select(*[cut(F.col(f"doc_id.`{c}`"), F.col("spans")).alias(c) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in df.columns])
