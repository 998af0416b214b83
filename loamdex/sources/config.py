"""Configuration: TOML to dataclasses, on the driver."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

NAME = "loamdex.toml"


@dataclass
class KnowledgeBase:
    watch_paths: list[str] = field(default_factory=list)
    auto_sync: bool = False
    description: str | None = None


@dataclass
class Model:
    provider: str = "offline"
    model: str = ""
    dimensions: int = 64
    enabled: bool = True
    api_key: str | None = None
    base_url: str | None = None


@dataclass
class Config:
    knowledge_bases: dict[str, KnowledgeBase] = field(default_factory=dict)
    embeddings: Model | None = None
    extraction: Model | None = None
    data_dir: str = ""
    interval: int = 300
    folder: Path = field(default_factory=Path.cwd)


def expand_variables(text: str) -> str:
    """${NAME} anywhere; a missing variable is empty."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), text)


def expand_path(path: str, folder: Path) -> str:
    """Variables, a leading ~, and relative to the configuration's folder. Paths with a scheme stay."""
    path = expand_variables(path)
    if "://" in path:
        return path
    path = os.path.expanduser(path)
    return path if os.path.isabs(path) else str(folder / path)


def find_config(start: Path | None = None) -> Path | None:
    """The nearest file in the working folder or above it, else that of the home folder."""
    here = (start or Path.cwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / NAME).is_file():
            return folder / NAME
    home = Path.home() / ".loamdex" / NAME
    return home if home.is_file() else None


def parse_config(text: str, folder: Path) -> Config:
    raw = tomllib.loads(text)
    providers = raw.get("providers", {})

    def model(section: dict | None) -> Model | None:
        if section is None:
            return None
        own = providers.get(section.get("provider", ""), {})
        key = section.get("api_key", own.get("api_key"))
        return Model(section.get("provider", "offline"), section.get("model", ""), section.get("dimensions", 64), section.get("enabled", True), expand_variables(key) if key else None, section.get("base_url", own.get("base_url")))

    bases = {}
    for name, kb in raw.get("knowledge_bases", {}).items():
        bases[name] = KnowledgeBase([expand_path(p, folder) for p in kb.get("watch_paths", [])], kb.get("auto_sync", False), kb.get("description"))
    return Config(bases, model(raw.get("embeddings")), model(raw.get("extraction")), expand_path(raw.get("data_dir", ".loamdex"), folder), raw.get("watch", {}).get("interval", 300), folder)


def load_config(path: str | None = None) -> Config:
    found = Path(path) if path else find_config()
    if found is None or not found.is_file():
        raise FileNotFoundError(f"no {NAME} here or above")
    return parse_config(found.read_text(), found.resolve().parent)


def render_config(bases: dict[str, KnowledgeBase], data_dir: str = ".loamdex", dimensions: int = 64) -> str:
    """A configuration file."""
    import json

    out = [f"data_dir = {json.dumps(data_dir)}", "", "[embeddings]", 'provider = "offline"', f"dimensions = {dimensions}"]
    for name, kb in bases.items():
        out += ["", f"[knowledge_bases.{json.dumps(name)}]", f"watch_paths = {json.dumps(kb.watch_paths)}", f"auto_sync = {str(kb.auto_sync).lower()}"]
        out += [f"description = {json.dumps(kb.description)}"] * (kb.description is not None)
    return "\n".join(out) + "\n"
