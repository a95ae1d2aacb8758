"""Language models, embedders and rerankers behind small protocols."""

from __future__ import annotations

from paperloom.config import Settings
from paperloom.providers.base import LanguageModel, ProviderConfigError, ProviderError
from paperloom.providers.hosted import Gemini, Groq, Ollama
from paperloom.providers.offline import OfflineModel


def get_provider(settings: Settings) -> LanguageModel:
    """The configured provider; a missing key is an error, never a silent stand-in."""
    if settings.provider in ("groq", "gemini") and not settings.api_key:
        raise ProviderConfigError(f"provider {settings.provider} needs an API key")
    if settings.provider == "groq":
        return Groq(settings.api_key, settings.model or Groq.default_model)
    if settings.provider == "gemini":
        return Gemini(settings.api_key, settings.model or Gemini.default_model, settings.fallback_models)
    if settings.provider == "ollama":
        return Ollama(settings.base_url or Ollama.default_url, settings.model or Ollama.default_model)
    return OfflineModel()


def describe_provider(settings: Settings) -> str:
    model = settings.model or {"groq": Groq.default_model, "gemini": Gemini.default_model, "ollama": Ollama.default_model}.get(settings.provider, "offline placeholder")
    return f"{settings.provider} ({model})"


__all__ = ["Gemini", "Groq", "LanguageModel", "OfflineModel", "Ollama", "ProviderConfigError", "ProviderError", "describe_provider", "get_provider"]
