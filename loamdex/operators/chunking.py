"""Documents to chunks: markdown, code and plain text, each line-addressed (from 1, both ends included)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Sizes in bytes and lines.
LEAST_BYTES, MOST_BYTES, MOST_LINES = 30, 8000, 100
# Extensions by kind, and how a line that starts a definition begins.
MARKDOWN = ("md", "markdown")
CODE = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "kt", "c", "cpp", "h", "cs", "rb", "swift", "zig", "lua")
BOUNDARIES = (
    "fn ", "pub fn ", "async fn ", "pub async fn ", "impl ", "pub impl ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "mod ", "pub mod ",
    "def ", "async def ", "class ",
    "function ", "async function ", "export function ", "export async function ", "export class ", "export default function", "export default class",
    "func ",
    "public class ", "private class ", "protected class ", "fun ",
)

Chunk = tuple[str, int, int, str]


def split_lines(text: str) -> list[str]:
    """Lines without ends; a final newline adds none."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def _bytes(text: str) -> int:
    return len(text.encode())


class _Chunks:
    """Gathers lines; flush() makes a chunk of them unless it is too short."""

    def __init__(self):
        self.out: list[Chunk] = []
        self.held: list[str] = []
        self.first = 1
        self.size = 0

    def add(self, number: int, line: str) -> None:
        if not self.held:
            self.first = number
        self.held.append(line)
        self.size += _bytes(line) + 1

    def flush(self, kind: str, keep: int | None = None) -> None:
        """Close the first `keep` lines, all by default."""
        keep = len(self.held) if keep is None else keep
        text = "\n".join(self.held[:keep])
        if keep and _bytes(text.strip()) >= LEAST_BYTES:
            self.out.append((text, self.first, self.first + keep - 1, kind))
        self.held, self.first = self.held[keep:], self.first + keep
        self.size = sum(_bytes(x) + 1 for x in self.held)


def _whole(text: str, lines: list[str], kind: str, out: list[Chunk]) -> list[Chunk]:
    return out or ([(text, 1, max(1, len(lines)), kind)] if text.strip() else [])


def chunk_markdown(text: str) -> list[Chunk]:
    lines, chunks, start = split_lines(text), _Chunks(), 0
    if lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
        if end is not None:
            for i in range(end + 1):
                chunks.add(i + 1, lines[i])
            chunks.flush("frontmatter")
            start = end + 1
    kind, fence = "paragraph", None
    for i in range(start, len(lines)):
        line, bare = lines[i], lines[i].lstrip()
        if fence:
            chunks.add(i + 1, line)
            if bare.startswith(fence):
                chunks.flush("code_block")
                fence, kind = None, "paragraph"
        elif bare.startswith(("```", "~~~")):
            chunks.flush(kind)
            fence, kind = bare[:3], "paragraph"
            chunks.add(i + 1, line)
        else:
            if line.startswith("#"):
                chunks.flush(kind)
                kind = "heading_section"
            chunks.add(i + 1, line)
            if chunks.size > MOST_BYTES:
                # after the last blank line of the second half, else in the middle
                half = len(chunks.held) // 2
                chunks.flush(kind, next((k + 1 for k in range(len(chunks.held) - 1, half - 1, -1) if not chunks.held[k].strip()), half))
    chunks.flush(kind)
    return _whole(text, lines, "paragraph", chunks.out)


def chunk_code(text: str) -> list[Chunk]:
    lines, chunks = split_lines(text), _Chunks()
    for i, line in enumerate(lines, 1):
        if chunks.held and line.lstrip().startswith(BOUNDARIES):
            chunks.flush("function")
        chunks.add(i, line)
        if chunks.size > MOST_BYTES or len(chunks.held) >= MOST_LINES:
            chunks.flush("code_block")
    chunks.flush("function")
    return _whole(text, lines, "code_block", chunks.out)


def chunk_text(text: str) -> list[Chunk]:
    lines, chunks = split_lines(text), _Chunks()
    for i, line in enumerate(lines, 1):
        if not line.strip():
            chunks.flush("paragraph")
            continue
        chunks.add(i, line)
        if chunks.size > MOST_BYTES:
            chunks.flush("paragraph")
    chunks.flush("paragraph")
    return _whole(text, lines, "paragraph", chunks.out)


def chunk(path: str, text: str | None) -> list[Chunk]:
    """The chunks of one document, by its extension."""
    if not text:
        return []
    kind = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if path else ""
    return chunk_markdown(text) if kind in MARKDOWN else chunk_code(text) if kind in CODE else chunk_text(text)


def chunk_documents(docs: DataFrame, key: str = "doc_id", path: str = "path", content: str = "content", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, path, ordinal, content, line_start, line_end, chunk_type). Each document is chunked where it lies: no shuffle."""
    import pyarrow as pa

    added = StructType.fromDDL("path string, ordinal int, content string, line_start int, line_end int, chunk_type string")
    held = [key, *also]
    schema = StructType([*(docs.schema[c] for c in held), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n = schema.names, len(held)
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows, place = [], []
            for i, (p, text) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                for k, c in enumerate(chunk(p, text)):
                    rows.append((p, k, *c))
                    place.append(i)
            if rows:
                at = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(n)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return docs.select(*held, F.col(path).alias("path"), content).mapInArrow(run, schema)
