"""What people and tools read: driver-side formatting of a few rows."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

PREVIEW = 200


def format_size(size: int) -> str:
    """Bytes in units of 1024, with one decimal from KB on."""
    value, unit = float(size), "B"
    for unit in ("B", "KB", "MB", "GB"):
        if value < 1024 or unit == "GB":
            break
        value /= 1024
    return f"{size} B" if unit == "B" else f"{value:.1f} {unit}"


def tilde_path(path: str, home: str | None = None) -> str:
    """The path with ~ for the home folder."""
    home = home or str(Path.home())
    return "~" + path[len(home) :] if path.startswith(home.rstrip("/") + "/") else path


def preview(text: str | None) -> str:
    return (text or "")[:PREVIEW].replace("\n", " ")


def _place(row: dict) -> str:
    if not row.get("line_start"):
        return ""
    return f":{row['line_start']}" if row["line_start"] == row.get("line_end") else f":{row['line_start']}-{row['line_end']}"


def results(rows: list[dict]) -> str:
    """Merged results, with what found them."""
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r['file']}{_place(r)}  {r['score']:.4f}  [{', '.join(r['sources'])}]")
        out += [f"   {preview(r.get('content'))}"] * bool(r.get("content"))
    return "\n".join(out) or "No results."


def text_results(rows: list[dict]) -> str:
    """Results of one engine: no sources, the chunk that retrieves more."""
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r['file']}{_place(r)}" + (f"  chunk {r['chunk_id']}" if r.get("chunk_id") is not None else ""))
        out += [f"   {preview(r.get('content'))}"] * bool(r.get("content"))
    return "\n".join(out) or "No results."


def line_results(rows: list[dict]) -> str:
    """Lines as file:number: line."""
    return "\n".join(f"{r['file']}{_place(r)}: {preview(r.get('content'))}" for r in rows) or "No results."


def corrections(rows: Iterable[dict]) -> str:
    told = [f"{r['from_word']} -> {r['to_word']}" for r in rows]
    return f"Corrected: {', '.join(told)}" if told else ""


def sections(lists: dict[str, list[dict]], smart_queries: list[str] = ()) -> str:
    """Each engine's own list under its heading, for tools that read text."""
    titles = {"fts": "Text", "vector": "Vector", "graph": "Graph", "fuzzy": "Lines"}
    out = [f"Searched for: {', '.join(smart_queries)}"] if smart_queries else []
    for name, title in titles.items():
        if lists.get(name):
            out += [f"## {title}", line_results(lists[name]) if name == "fuzzy" else text_results(lists[name])]
    return "\n\n".join(out) if lists and any(lists.values()) else "No results."


def status(rows: list[dict], data_dir: str) -> str:
    out = [f"Store: {tilde_path(data_dir)}"]
    for r in rows:
        vectors = "none" if r["vectors"] < 0 else str(r["vectors"])
        out += [f"{r['kb']}" + (f" - {r['description']}" if r.get("description") else ""), f"  documents  {r['documents']} ({format_size(r['bytes'])}), {r['extracted']} extracted", f"  chunks     {r['chunks']}", f"  vocabulary {r['vocabulary']}", f"  vectors    {vectors}", f"  graph      {r['node_count']} nodes, {r['edge_count']} edges", f"  last sync  {r.get('last_sync') or 'never'}"]
    return "\n".join(out)


def bases(rows: list[dict]) -> str:
    out = []
    for r in rows:
        out += [f"{r['kb']}" + (f" - {r['description']}" if r.get("description") else "") + (" [auto]" if r["auto_sync"] else ""), *(f"  {tilde_path(p)}" for p in r["watch_paths"]), f"  {r['documents']} documents, last sync {r.get('last_sync') or 'never'}"]
    return "\n".join(out) or "No knowledge bases."


def report(rows: list[dict]) -> str:
    """Syncs, a line each."""
    out = []
    for r in rows:
        told = [f"{r[k]} {k}" for k in ("new", "updated", "deleted", "resumed") if r[k]] or ["no changes"]
        if r["status"] == "synced":
            told += [f"{r['chunks']} chunks", f"{r['vocabulary_words']} words", f"{r['entities_extracted']} entities", f"{r['relationships_extracted']} relationships", f"{r['vectors_embedded']} vectors"]
        out.append(f"{r['kb']}: {r['status']}: " + ", ".join(told) + (f", {r['errors']} failed extractions" if r["errors"] else ""))
    return "\n".join(out)


def chunk(row: dict) -> str:
    """A chunk with what stands around it."""
    out = [f"{row['kb']}:{row['path']}{_place(row)}  chunk {row['chunk_id']}  {row['chunk_type']}"]
    out += [f"[{c['offset']}] {c['content']}" for c in row["chunks_before"]] + row["context_before_lines"] + [row["content"]] + row["context_after_lines"] + [f"[+{c['offset']}] {c['content']}" for c in row["chunks_after"]]
    return "\n".join(out)
