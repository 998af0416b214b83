"""Token counts (operator 9): a map-side two-tier lookup of pre-token lengths.

Tier one is a compact table of frequent pre-tokens, fitted on a bounded
sample of rows (a parameter) and broadcast; tier two is a cache in each
Python worker, also bounded. What neither knows is encoded by the
tokenizer library itself, so the tables change the speed only, never a
count. No pre-token is ever shuffled.

A pre-token here is a run without ASCII white space. The tokenizer drops
white space and its pattern never crosses it, so a text's ids are the
concatenation of its pre-tokens' ids. Two cases go to the library as
whole texts: special strings (`<|`) and combining marks of U+0300-037F
(lower-casing and composition do not commute there).

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated
rows give repeated rows; an empty table gives an empty table; columns of
the input other than the two named are ignored, so they cannot clash.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import as_bytes, bounded_sample, slices

VOCABULARY = "word_bpe_49k.json"
#: Tier one: at most so many pre-tokens, from about so many rows.
FREQUENT, SAMPLE_ROWS = 50_000, 4_000
#: Tier two: at most so many pre-tokens a worker.
CACHED = 300_000
_WHOLE = re.compile(rb"<\||[\xcc\xcd]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TAIL = b".,;:!?*&%$#@)]}\"~^_+=/|>-"
#: Words of ASCII lower-case and Latin-1 letters: normalised letter by letter, one pre-token each, so the merges alone apply.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict):
    """Pre-tokens and their values; one that is missing is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes):
        core = word.rstrip(_TAIL)
        if core and len(core) < len(word) and _PLAIN(core):
            value = self[core] + self[word[len(core) :]]
        else:
            value = self.encode(word)
        self[word] = value
        return value


class Coder:
    """ids of texts as little-endian uint32 bytes, by two tiers of known pre-tokens.

    lengths_only: keep counts instead of ids."""

    def __init__(self, path: str, frequent: Iterable[bytes] = (), lengths_only: bool = False, cached: int = CACHED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths_only, self.cached = lengths_only, cached
        self.merges = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c).lower())[0][0] for c in range(0xC0, 0x100)}
        self.frequent: dict[bytes, object] = {}
        self.known = Known(self._encode)
        for w in frequent:
            self.known[w]
        self.frequent = dict(self.known)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _value(self, ids) -> object:
        return len(ids) if self.lengths_only else np.asarray(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()

    def _encode(self, word: bytes) -> object:
        """Plain words by the model's merges alone, others by the whole tokenizer."""
        if not _PLAIN(word):
            return self._value(self._ids(word.decode()))
        got = self.merges(word.decode() if word.isascii() else word.decode().translate(self.letters))
        return len(got) if self.lengths_only else self._value([t.id for t in got])

    def text(self, text: bytes) -> object:
        """The ids of a text, or their number."""
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return self._value(self._ids(text.decode()))
        got = map(self.known.__getitem__, text.translate(_LOWER).split())
        return sum(got) if self.lengths_only else b"".join(got)

    def texts(self, texts: list[bytes]) -> list:
        out = [self.text(t) for t in texts]
        if len(self.known) > self.cached + len(self.frequent):
            self.known.clear()
            self.known.update(self.frequent)
        return out


def frequent_pretokens(df: DataFrame, text_col: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> bytes:
    """Tier one, compact: the most frequent pre-tokens of a bounded sample, joined by blanks."""
    some = bounded_sample(df.withColumn("_all", F.lit(1)), rows, "_all") if rows else df.limit(0)
    words = F.split(F.translate(F.lower(F.col(text_col)), "\t\n\r\x0b\x0c", "     "), " ")
    top = some.select(F.explode(words).alias("w")).where("w <> '' and length(w) <= 40").groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most)
    return " ".join(r.w for r in top.select("w").collect()).encode()


_CODERS: dict = {}


def worker_coder(path: str, frequent, lengths_only: bool) -> Coder:
    """One coder per Python worker; the broadcast table is read once."""
    key = (path, lengths_only)
    if key not in _CODERS:
        words = [w for w in frequent.value.split() if not _WHOLE.search(w)]
        _CODERS[key] = Coder(path, {w.translate(_LOWER) for w in words}, lengths_only)
    return _CODERS[key]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 2048, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path = vocabulary or tokenizer_path()
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    frequent = df.sparkSession.sparkContext.broadcast(frequent_pretokens(df, "text", sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, frequent, True)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in as_bytes(part.column("text"))]
                n = pa.array(coder.texts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    out = df.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
