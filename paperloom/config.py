"""Settings, from defaults, a ``.env`` file and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Order in which a provider is taken when none is named.
PROVIDERS = ("groq", "gemini", "ollama", "mock")
RETRIEVAL_MODES = ("auto", "tfidf", "hybrid", "hybrid+rerank")


@dataclass(frozen=True)
class Settings:
    # fixed values: limits and weights that decide results
    max_candidates: int = 5
    chunk_size: int = 800
    chunk_overlap: int = 150
    top_k: int = 4
    lexical_threshold: float = 0.05
    dense_threshold: float = 0.55
    rerank_pool: int = 20
    rrf_k: int = 60
    title_weight: float = 0.6
    abstract_weight: float = 0.4
    recency_weight: float = 0.3
    recency_days: int = 3 * 365
    context_chars: int = 14_000
    least_share: int = 200
    excerpt_chars: int = 120
    max_references: int = 30
    short_text: int = 300
    # choices of a deployment
    retrieval_mode: str = "auto"
    provider: str = "mock"
    model: str = ""
    api_key: str = ""
    base_url: str = ""
    fallback_models: tuple[str, ...] = ()


def read_env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines; comments after ' #' and quotes are stripped."""
    found: dict[str, str] = {}
    if not os.path.exists(path):
        return found
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                value = value.split(" #", 1)[0].strip()
                found[key.strip()] = value.strip("\"'")
    return found


def _key(env: Mapping[str, str], name: str) -> str:
    """A key's value; placeholders count as unset."""
    value = env.get(name, "").strip()
    return "" if value.lower().startswith("your_") else value


def load_settings(env: Mapping[str, str] | None = None, env_file: str = ".env") -> Settings:
    """Settings of this deployment; real environment variables win over the file."""
    env = {**read_env_file(env_file), **(os.environ if env is None else env)}
    keys = {"groq": _key(env, "GROQ_API_KEY"), "gemini": _key(env, "GEMINI_API_KEY")}
    provider = env.get("LLM_PROVIDER", "").strip().lower()
    if env.get("MOCK_LLM", "").strip().lower() in ("1", "true", "yes"):
        provider = "mock"
    elif not provider:
        provider = next((p for p in ("groq", "gemini") if keys[p]), "ollama" if env.get("OLLAMA_BASE_URL") else "mock")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; one of {', '.join(PROVIDERS)}")
    mode = env.get("RETRIEVAL_MODE", "auto").strip().lower() or "auto"
    if mode not in RETRIEVAL_MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}")
    settings = Settings(
        provider=provider,
        api_key=keys.get(provider, ""),
        model=env.get(f"{provider.upper()}_MODEL", ""),
        base_url=env.get("OLLAMA_BASE_URL", "") if provider == "ollama" else "",
        fallback_models=tuple(x.strip() for x in env.get("GEMINI_FALLBACK_MODELS", "").split(",") if x.strip()),
        retrieval_mode=mode,
    )
    numbers = {f.name: f.type for f in fields(Settings) if f.type in ("int", "float")}
    changed = {n: (int if t == "int" else float)(env[n.upper()]) for n, t in numbers.items() if env.get(n.upper())}
    return replace(settings, **changed)
