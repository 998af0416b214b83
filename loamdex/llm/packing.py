"""Best-fit packing (operator 3): bounded-space online best-fit.

Each task packs its own rows. Open bins are kept by free space: a bitset
(one Python integer) says which amounts of free space occur, so the
best bin for a piece is the lowest set bit at or above its length. At
most `open_bins` are open; to open one more, the fullest closes first.
What is still open when a task ends and is not nearly full is taken
apart; these pieces, a bounded number per task, are dealt to a second,
smaller set of tasks, which pack them longest first by the same rule, with
as many bins open as there are pieces, so that none closes early.

Defined results: a null text is empty and yields one piece, the closing
id alone; a document longer than the capacity is cut into pieces of the
capacity and a rest; repeated rows are packed each; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from ._common import as_bytes, materialise, slices

CAPACITY, END_ID, OPEN_BINS = 4096, 1, 1024
#: A bin left open by a task is kept if so full, else its pieces are packed again.
NEARLY = 0.998
#: Pieces that one task of the second pass packs.
SECOND_ROWS = 12_000


class Packer:
    """Bounded-space best-fit; add() gives the bins that closed, as (items, used)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.mask, self.count = 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _put(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.mask |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        held = self.by_free[free]
        items = held.pop()
        if not held:
            self.mask &= ~(1 << free)
        self.count -= 1
        return items

    def add(self, item, length: int) -> list[tuple[list, int]]:
        if length >= self.capacity:
            return [([item], length)]
        closed = []
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.count >= self.open_bins:
                fullest = (self.mask & -self.mask).bit_length() - 1
                closed.append((self._take(fullest), self.capacity - fullest))
            free, items = self.capacity, []
        items.append(item)
        if free == length:
            closed.append((items, self.capacity))
        else:
            self._put(free - length, items)
        return closed

    def rest(self) -> list[tuple[list, int]]:
        out = []
        while self.mask:
            free = (self.mask & -self.mask).bit_length() - 1
            out.append((self._take(free), self.capacity - free))
        return out


_SCHEMA = "doc_id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long{}"


def _rows(bins, number, out: list) -> None:
    for items, _ in bins:
        at, seq = 0, number()
        for item in items:
            out.append((*item, seq, at))
            at += item[3]


def _batches(rows: list, names: list[str], types: list, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), step):
        columns = zip(*rows[i : i + step], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_TYPES = [pa.int32(), *[pa.int64()] * 5]


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, which are uint32 bytes."""
    return [(k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), 4 * capacity)) for part in [ids[at : at + 4 * capacity]]]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids (little-endian uint32, binary)."""
    path = vocabulary or tokens.tokenizer_path()
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    frequent = df.sparkSession.sparkContext.broadcast(tokens.frequent_pretokens(df, "text"))
    end = end_id.to_bytes(4, "little")
    extra = ", ids binary" if with_ids else ""
    names, more = _NAMES + ["ids"] * with_ids, [pa.binary()] * with_ids

    def order(row: tuple) -> tuple:  # (doc_id, piece, start, length, crc[, ids], seq, offset) -> column order
        return row[:5] + row[-2:] + row[5:-2]

    def numbers(base: int):
        at = [base]

        def number() -> int:
            at[0] += 1
            return at[0]

        return number

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = tokens.worker_coder(path, frequent, False)
        number, packer, type_of = numbers(TaskContext.get().partitionId() << 36), Packer(capacity, open_bins), None
        for batch in batches:
            type_of = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                out: list = []
                ids = part.column("doc_id").to_pylist()
                for doc, got in zip(ids, coder.texts([t or b"" for t in as_bytes(part.column("text"))]), strict=True):
                    whole = got + end
                    for piece in pieces_of(whole, capacity):
                        item = (doc, *piece, whole[4 * piece[1] : 4 * (piece[1] + piece[2])]) if with_ids else (doc, *piece)
                        _rows(packer.add(item, piece[2]), number, out)
                yield from _batches([order(r) for r in out], names, [type_of, *_TYPES, *more])
        out = []
        for items, used in packer.rest():
            if used >= NEARLY * capacity:
                _rows([(items, used)], number, out)
            else:
                out.extend((*item, None, None) for item in items)
        if out:
            yield from _batches([order(r) for r in out], names, [type_of, *_TYPES, *more])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, type_of = [], None
        for batch in batches:
            type_of = batch.schema.field("doc_id").type
            cols = [batch.column(n).to_pylist() for n in names if n not in ("sequence_id", "offset")]
            items.extend(zip(*cols, strict=True))
        items.sort(key=lambda r: (-r[3], str(r[0]), r[1]))
        packer, out = Packer(capacity, len(items)), []
        number = numbers((1 << 60) + (TaskContext.get().partitionId() << 36))
        for item in items:
            _rows(packer.add(item, item[3]), number, out)
        _rows(packer.rest(), number, out)
        if out:
            yield from _batches([order(r) for r in out], names, [type_of, *_TYPES, *more])

    schema = _SCHEMA.format(kind, extra)
    done = materialise(df.mapInArrow(first, schema), "packed")
    left = done.where("sequence_id is null")
    n = left.count()
    closed = done.where("sequence_id is not null")
    if not n:
        return closed
    # dealt by hash of the piece, so every second-pass task gets a mixture of lengths
    parts = -(-n // SECOND_ROWS)
    again = left.repartition(parts, F.xxhash64("doc_id", "piece", "start")).mapInArrow(second, schema)
    return closed.unionByName(materialise(again, "packed-again"))
