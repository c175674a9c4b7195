"""Settings: file, then environment, then overrides; values keep the type of their default."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from pathlib import Path
from typing import Any


@dataclasses.dataclass(frozen=True)
class Retrieval:
    rrf_k_vec: int = 30
    rrf_k_fts: int = 60
    top_k_chunks: int = 12
    max_facts_in_context: int = 0
    token_budget: int = 1800
    rerank_mode: str = "off"
    rerank_pool: int = 24
    fact_sources: str = "all"
    fact_fts_top_k: int = 10
    fact_vec_mode: str = "off"
    fact_vec_top_k: int = 10
    fact_expand_names: int = 2


@dataclasses.dataclass(frozen=True)
class Ingest:
    chunk_tokens: int = 512
    overlap_sentences: int = 1


@dataclasses.dataclass(frozen=True)
class Models:
    temperature: float = 0.4
    max_tokens: int = 512
    vec_dim: int = 64
    no_think: bool = False


@dataclasses.dataclass(frozen=True)
class Judging:
    command: str = ""
    max_chars: int = 12_000


@dataclasses.dataclass(frozen=True)
class Config:
    retrieval: Retrieval = Retrieval()
    ingest: Ingest = Ingest()
    models: Models = Models()
    judging: Judging = Judging()


def as_toml(config: Config) -> str:
    """The settings as a file that load reads."""
    parts = []
    for section, values in dataclasses.asdict(config).items():
        shown = [f"{k} = {str(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else chr(34) + v + chr(34)}" for k, v in values.items()]
        parts.append(f"[{section}]\n" + "\n".join(shown))
    return "\n\n".join(parts) + "\n"


PREFIX = "QUERN_"


def _typed(value: Any, default: Any) -> Any:
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return type(default)(value)


def load(path: str | None = None, overrides: dict[str, Any] | None = None, environ: dict[str, str] | None = None) -> tuple[Config, dict[str, str]]:
    """The configuration, and where each value that isn't a default came from; unknown keys are errors."""
    config, origin = Config(), {}
    layers: list[tuple[str, dict[str, Any]]] = []
    if path and Path(path).exists():
        data = tomllib.loads(Path(path).read_text())
        layers.append(("file", {f"{s}.{k}": v for s, part in data.items() for k, v in (part.items() if isinstance(part, dict) else [("", part)])}))
    env = os.environ if environ is None else environ
    layers.append(("environment", {k[len(PREFIX) :].lower().replace("__", ".", 1): v for k, v in env.items() if k.startswith(PREFIX)}))
    layers.append(("override", overrides or {}))
    for name, values in layers:
        for key, value in values.items():
            section, _, field = key.partition(".")
            part = getattr(config, section, None)
            if part is None or not hasattr(part, field):
                raise ValueError(f"unknown setting {key} ({name})")
            part = dataclasses.replace(part, **{field: _typed(value, getattr(part, field))})
            config = dataclasses.replace(config, **{section: part})
            origin[key] = name
    return config, origin
