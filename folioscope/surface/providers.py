"""Model providers by name, whether they are ready, and guards. Only the local ones answer: nothing here goes over a network."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

# Other names of providers, and the variable that each of those that need a key has it in.
ALIASES = {"openai": "openai-compatible", "claude": "claude-code"}
KEYS = {"openai-compatible": "OPENAI_API_KEY", "codex": "CODEX_AUTH", "claude-code": "CLAUDE_CODE_OAUTH", "kimi": "KIMI_API_KEY"}
LOCAL = ("ollama", "fake")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def named(name: str | None) -> str:
    found = ALIASES.get(name or "openai", name or "openai")
    if found not in KEYS and found not in LOCAL:
        raise ValueError(f"no such provider: {name}")
    return found


def required(env: Mapping[str, str], name: str) -> str:
    if not env.get(name):
        raise ValueError(f"{name} is not set")
    return env[name]


def local_url(text: str, remote: bool = False) -> str:
    """``text`` if it is on this machine, or if others are allowed."""
    if not remote and urlsplit(text).hostname not in LOCAL_HOSTS:
        raise ValueError(f"not an address of this machine: {text}")
    return text


def status(name: str, env: Mapping[str, str] | None = None) -> dict:
    """(provider, ready, detail); the key itself is never told."""
    env = os.environ if env is None else env
    name = named(name)
    if name in LOCAL:
        return {"provider": name, "ready": True, "detail": "local provider configured"}
    ready = bool(env.get(KEYS[name]))
    return {"provider": name, "ready": ready, "detail": f"{KEYS[name]}=<redacted>" if ready else f"Missing {KEYS[name]}"}


def completer(name: str) -> Callable[[str], str]:
    """A function from a prompt to an answer: the stand-in of tests. Nothing here calls a model, so other names are an error."""
    if named(name) != "fake":
        raise NotImplementedError(f"no answers of {name} here")
    return lambda prompt: json.dumps({"provider": "fake", "text": f"fake:{prompt[:24]}"})


@dataclass
class Diagnostics:
    """How the last calls of an embedding provider went."""

    provider: str = "openai"
    model: str = "text-embedding-3-small"
    last_success_at: str | None = None
    last_failure_at: str | None = None
    last_error: str | None = None
    env: Mapping[str, str] = field(default_factory=lambda: os.environ)

    def report(self) -> dict:
        key = KEYS["kimi" if self.provider == "kimi" else "openai-compatible"]
        source = "env" if self.env.get(key) else f"login:{self.provider}"
        error = re.sub(r"sk-[A-Za-z0-9_-]{8,}", "<redacted>", self.last_error) if self.last_error else None
        return {"provider": self.provider, "model": self.model, "authenticated": source == "env", "auth_source": source, "last_success_at": self.last_success_at, "last_failure_at": self.last_failure_at, "last_error": error}
