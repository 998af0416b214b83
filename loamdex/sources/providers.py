"""Models behind interfaces: HTTP providers, and deterministic offline defaults.

A provider that is not known, or that lacks its key, raises when the engine is made; nothing falls back in silence."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.functions import text as T
from loamdex.sources.config import Model

EXTRACTION = "struct<entities: array<struct<name: string, type: string, description: string>>, relationships: array<struct<source: string, target: string, relation: string, description: string>>>"
# What an extraction may name, and the tasks of the first generation of embedding models.
ENTITY_TYPES = ("person", "project", "service", "tool", "config", "decision", "concept")
RELATION_TYPES = ("depends_on", "decided_by", "deployed_to", "relates_to", "replaces", "configures", "uses", "created_by")
TASKS = {"document": "RETRIEVAL_DOCUMENT", "search result": "RETRIEVAL_QUERY", "code retrieval": "CODE_RETRIEVAL_QUERY"}
#: Texts of one request, and seconds to wait for its reply.
BATCH, TIMEOUT = 100, 60


class Embedder(Protocol):
    """embed() takes inputs as document_input() and query_input() make them."""

    dimension: int

    def embed(self, texts: list[str], task: str = "document") -> list[list[float]]: ...

    def document_input(self, title: Column, content: Column) -> Column: ...

    def query_input(self, task: str, query: str) -> str: ...


class Extractor(Protocol):
    def extract(self, content: str, path: str) -> dict: ...


class Decomposer(Protocol):
    def decompose(self, text: str) -> list[str]: ...


class ProviderError(RuntimeError):
    pass


def post_json(url: str, body: dict, headers: dict[str, str] | None = None) -> dict:
    """The JSON reply to a JSON request; an error reply raises with its message."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        try:
            told = json.loads(e.read())["error"]
            told = told.get("message", told) if isinstance(told, dict) else told
        except (ValueError, KeyError, TypeError):
            told = e.reason
        raise ProviderError(f"{url.split('?')[0]}: {e.code}: {told}") from None
    except (urllib.error.URLError, ValueError, TimeoutError) as e:
        raise ProviderError(f"{url.split('?')[0]}: {e}") from None


#: Where providers listen unless base_url says otherwise, and which need a key.
ADDRESSES = {"gemini": "https://generativelanguage.googleapis.com/v1beta", "openai": "https://api.openai.com/v1", "ollama": "http://localhost:11434"}
KEYED = ("gemini", "openai")


class _Remote:
    """What HTTP providers share: the address, the key, one request."""

    def __init__(self, model: Model, post: Callable[..., dict] = post_json):
        if model.provider not in ADDRESSES:
            raise ValueError(f"unknown provider: {model.provider}")
        if model.provider in KEYED and not model.api_key:
            raise ValueError(f"provider {model.provider} needs an api_key")
        self.provider, self.model, self.key, self.post = model.provider, model.model, model.api_key, post
        self.base = (model.base_url or ADDRESSES[model.provider]).rstrip("/")

    def ask(self, method: str, body: dict) -> dict:
        if self.provider == "gemini":
            return self.post(f"{self.base}/models/{self.model}:{method}?key={self.key}", body)
        return self.post(f"{self.base}/{method}", body, {"Authorization": f"Bearer {self.key}"} if self.key else None)

    def complete(self, prompt: str) -> str:
        """The text of a model's JSON reply to a prompt."""
        try:
            if self.provider == "gemini":
                got = self.ask("generateContent", {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"responseMimeType": "application/json"}})
                return got["candidates"][0]["content"]["parts"][0]["text"]
            if self.provider == "openai":
                return self.ask("chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "response_format": {"type": "json_object"}})["choices"][0]["message"]["content"]
            return self.ask("api/generate", {"model": self.model, "prompt": prompt, "format": "json", "stream": False})["response"]
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"{self.provider}: a reply without {e}") from None


class RemoteEmbedder(_Remote):
    """Embeddings over HTTP, in batches. Models of the second generation on take the task as a prefix of the text, those before as a parameter."""

    def __init__(self, model: Model, post: Callable[..., dict] = post_json):
        super().__init__(model, post)
        self.dimension = model.dimensions
        self.prefixed = self.provider == "gemini" and any(x in self.model for x in ("embedding-2", "embedding-3"))

    def document_input(self, title: Column, content: Column) -> Column:
        return T.document_input(title, content) if self.prefixed else content

    def query_input(self, task: str, query: str) -> str:
        return f"task: {task} | query: {query}" if self.prefixed else query

    def embed(self, texts: list[str], task: str = "document") -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), BATCH):
            out += self._embed([t or "" for t in texts[i : i + BATCH]], task)
        if wrong := {len(v) for v in out} - {self.dimension}:
            raise ProviderError(f"{self.provider}: vectors of {sorted(wrong)} dimensions, not {self.dimension}")
        return out

    def _embed(self, texts: list[str], task: str) -> list[list[float]]:
        try:
            if self.provider == "gemini":
                more = {"outputDimensionality": self.dimension} | ({} if self.prefixed else {"taskType": TASKS[task]})
                got = self.ask("batchEmbedContents", {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, **more} for t in texts]})
                return [e["values"] for e in got["embeddings"]]
            if self.provider == "openai":
                got = self.ask("embeddings", {"model": self.model, "input": texts, "dimensions": self.dimension})
                return [e["embedding"] for e in sorted(got["data"], key=lambda e: e.get("index", 0))]
            return self.ask("api/embed", {"model": self.model, "input": texts})["embeddings"]
        except (KeyError, TypeError) as e:
            raise ProviderError(f"{self.provider}: a reply without {e}") from None


def extraction_prompt(content: str, path: str) -> str:
    """What an extraction model is asked."""
    shape = '{"entities": [{"name": "", "type": "", "description": ""}], "relationships": [{"source": "", "target": "", "relation": "", "description": ""}]}'
    return f"Name the entities of the document below and how they relate.\nAn entity is one of: {', '.join(ENTITY_TYPES)}.\nA relation is one of: {', '.join(RELATION_TYPES)}.\nAnswer with JSON of this shape and nothing else: {shape}\n\nThe document, {path}:\n\n{content}\n"


def queries_prompt(text: str) -> str:
    """What a decomposing model is asked."""
    return f'Which two to five short search queries, of one to five words each, would find the documents that the text below is about? Name its concepts and entities, do not repeat it. Answer with a JSON array of strings, as ["one query", "another"].\n\n{text}\n'


class RemoteExtractor(_Remote):
    """Entities and relationships over HTTP, one request a document. A reply that is no JSON object raises, so the document counts as not extracted."""

    def extract(self, content: str, path: str) -> dict:
        got = json.loads(strip_fences(self.complete(extraction_prompt(content, path))))
        if not isinstance(got, dict):
            raise ProviderError(f"{self.provider}: the reply is no object")
        return {"entities": got.get("entities") or [], "relationships": got.get("relationships") or []}


class RemoteDecomposer(_Remote):
    def decompose(self, text: str) -> list[str]:
        return parse_queries(self.complete(queries_prompt(text)))


def make_embedder(model: Model | None) -> Embedder:
    if model is None or model.provider == "offline":
        return HashingEmbedder(model.dimensions if model else 64)
    return RemoteEmbedder(model)


def make_extractor(model: Model | None) -> Extractor | None:
    """None if extraction is switched off: documents then stay as not extracted."""
    if model is not None and not model.enabled:
        return None
    return RuleExtractor() if model is None or model.provider == "offline" else RemoteExtractor(model)


def make_decomposer(model: Model | None) -> Decomposer:
    return KeywordDecomposer() if model is None or model.provider == "offline" or not model.enabled else RemoteDecomposer(model)


class HashingEmbedder:
    """Words hashed into signed buckets, normalised: deterministic on every worker."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def document_input(self, title: Column, content: Column) -> Column:
        return content

    def query_input(self, task: str, query: str) -> str:
        return query

    def embed(self, texts: list[str], task: str = "document") -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h >> 16 & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class RuleExtractor:
    """Capitalised runs of words as entities; those of one sentence are related."""

    def extract(self, content: str, path: str) -> dict:
        entities, relations = {}, []
        for sentence in re.split(r"(?<=[.!?])\s+|\n", content or ""):
            names = list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*", sentence)))
            for n in names:
                entities.setdefault(n, {"name": n, "type": "concept", "description": None})
            relations += [{"source": a, "target": b, "relation": "relates_to", "description": None} for a, b in zip(names, names[1:])]
        return {"entities": list(entities.values()), "relationships": relations}


class KeywordDecomposer:
    """A text cut at conjunctions and punctuation: at most five queries."""

    def decompose(self, text: str) -> list[str]:
        parts = [p.strip() for p in re.split(r"[,;?!.]|\b(?:and|or|und|et|y)\b", text) if p.strip()]
        return (parts or [text])[:5]


def parse_queries(reply: str) -> list[str]:
    """A model's JSON reply: an array, or the first array of an object, else the reply itself; at most five."""
    try:
        got = json.loads(strip_fences(reply))
    except ValueError:
        return [reply]
    if isinstance(got, dict):
        got = next((v for v in got.values() if isinstance(v, list)), None)
    return [str(x) for x in got][:5] if isinstance(got, list) else [reply]


def strip_fences(text: str) -> str:
    return re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text)


def parse_extraction(reply: Column) -> Column:
    """A model's fenced JSON reply as entities and relationships; malformed replies give empty lists (`ok` says whether it parsed)."""
    body = F.regexp_replace(F.regexp_replace(reply, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")
    ok = F.is_valid_json(body) if hasattr(F, "is_valid_json") else F.get_json_object(body, "$").isNotNull()
    parsed = F.from_json(body, EXTRACTION)
    none = F.from_json(F.lit('{"entities": [], "relationships": []}'), EXTRACTION)
    return F.struct(
        F.when(ok, F.coalesce(parsed["entities"], none["entities"])).otherwise(none["entities"]).alias("entities"),
        F.when(ok, F.coalesce(parsed["relationships"], none["relationships"])).otherwise(none["relationships"]).alias("relationships"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def embed_column(df: DataFrame, embedder: Embedder, text: str = "content", into: str = "embedding", batch: int = BATCH) -> DataFrame:
    """df with an embedding column; the model gets batches of at most `batch` texts."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), batch):
            out.extend(embedder.embed(list(texts.iloc[i : i + batch])))
        return pd.Series(out)

    return df.withColumn(into, embed(text))


def extract_column(df: DataFrame, extractor: Extractor | None, content: str = "content", path: str = "path") -> DataFrame:
    """df with entities, relationships and ok: whether the extractor gave any answer; if it raised, both are empty."""

    @F.pandas_udf("string")
    def extract(texts: pd.Series, paths: pd.Series) -> pd.Series:
        def one(text: str, name: str) -> str | None:
            try:
                return json.dumps(extractor.extract(text, name))
            except Exception:  # noqa: BLE001 - the document is tried again at the next sync
                return None

        return pd.Series([one(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)

    got = df.withColumn("_x", F.from_json(extract(content, path), EXTRACTION))
    none = F.from_json(F.lit('{"entities": [], "relationships": []}'), EXTRACTION)
    return got.select(*df.columns, F.coalesce("_x.entities", none["entities"]).alias("entities"), F.coalesce("_x.relationships", none["relationships"]).alias("relationships"), F.col("_x").isNotNull().alias("ok"))
