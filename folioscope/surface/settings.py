"""Settings out of environment variables, each with its default; a value that makes no sense is an error."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

PREFIX = "FOLIOSCOPE_"


def whole_number(env: Mapping[str, str], name: str, default: int, least: int | None = None, most: int | None = None) -> int:
    raw = env.get(name)
    if not raw:
        return default
    try:
        value = int(raw)
    except ValueError:
        raise ValueError(f"{name} is no whole number: {raw}") from None
    if least is not None and value < least:
        raise ValueError(f"{name} has to be {least} or more: {value}")
    if most is not None and value > most:
        raise ValueError(f"{name} has to be {most} or less: {value}")
    return value


def one_of(env: Mapping[str, str], name: str, default: str, allowed: tuple[str, ...]) -> str:
    value = env.get(name) or default
    if value not in allowed:
        raise ValueError(f"{name} has to be one of {', '.join(allowed)}: {value}")
    return value


@dataclass(frozen=True)
class Settings:
    root: str
    authors: str
    imports: str
    name: str
    engine: str
    max_results: int
    max_response_chars: int
    host: str
    port: int
    api_key: str | None
    rate_limit: int
    cors_origin: str
    embedding_provider: str
    embedding_model: str
    embedding_dimension: int

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        key = lambda name: PREFIX + name
        root = env.get(key("ROOT")) or "data"
        return cls(
            root=root, authors=env.get(key("AUTHORS")) or f"{root}/authors", imports=env.get(key("IMPORT_DIR")) or f"{root}/imports", name=env.get(key("NAME")) or "folioscope",
            engine=one_of(env, key("ENGINE"), "index", ("index", "scan")), max_results=whole_number(env, key("MAX_RESULTS"), 20, 1), max_response_chars=whole_number(env, key("MAX_RESPONSE_CHARS"), 50_000, 1),
            host=env.get(key("HOST")) or "127.0.0.1", port=whole_number(env, key("PORT"), 3000, 1, 65_535), api_key=env.get(key("API_KEY")) or None,
            rate_limit=whole_number(env, key("RATE_LIMIT_RPM"), 60, 1), cors_origin=env.get(key("CORS_ORIGIN")) or "*", embedding_provider=one_of(env, "EMBED_PROVIDER", "openai", ("openai", "kimi")),
            embedding_model=env.get("EMBED_MODEL") or "text-embedding-3-small", embedding_dimension=whole_number(env, "EMBED_DIMENSION", 1536, 1),
        )
