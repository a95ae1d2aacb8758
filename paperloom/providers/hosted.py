"""Hosted and local model servers.

A server is a wire format: how a request is written, and where an answer's text lies.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from paperloom.providers.base import ATTEMPTS, ProviderError, Transport, http_post, post_json

# fixed value
TEMPERATURE = 0.2


@dataclass(frozen=True)
class Ask:
    prompt: str
    system: str | None
    json: bool

    def given(self, **fields: object) -> dict:
        """The fields that have a value."""
        return {k: v for k, v in fields.items() if v is not None}


def text_at(answer: object, *path: str | int) -> str:
    """The text at a path of an answer; an answer without it (a blocked one) is an error of this request."""
    for step in path:
        try:
            answer = answer[step]  # type: ignore[index]
        except (KeyError, IndexError, TypeError):
            raise ProviderError(f"the answer has no {step!r}") from None
    if not isinstance(answer, str):
        raise ProviderError("the answer has no text")
    return answer


class Groq:
    """An OpenAI-style chat endpoint."""

    name = "groq"
    default_model = "llama-3.3-70b-versatile"
    url = "https://api.groq.com/openai/v1/chat/completions"

    def __init__(self, api_key: str, model: str = default_model, transport: Transport = http_post):
        self.api_key, self.model, self.transport = api_key, model, transport

    def request(self, ask: Ask) -> dict:
        said = ask.given(system=ask.system or None, user=ask.prompt)
        return ask.given(
            model=self.model,
            temperature=TEMPERATURE,
            messages=[{"role": role, "content": text} for role, text in said.items()],
            response_format={"type": "json_object"} if ask.json else None,
        )

    def generate(self, prompt: str, system_prompt: str | None = None, json_mode: bool = False) -> str:
        answer = post_json(self.url, self.request(Ask(prompt, system_prompt, json_mode)), {"Authorization": f"Bearer {self.api_key}"}, transport=self.transport)
        return text_at(answer, "choices", 0, "message", "content")


class Gemini:
    """Tries its models in order, and remembers for its lifetime which the server refuses.

    A model that another one can stand in for gets one short attempt.  An answer
    without text (a blocked one) says nothing about the model, and is not remembered.
    """

    name = "gemini"
    default_model = "gemini-2.0-flash"
    url = "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent"
    short = 20.0

    def __init__(self, api_key: str, model: str = default_model, fallback_models: tuple[str, ...] = (), transport: Transport = http_post):
        self.api_key, self.transport = api_key, transport
        self.models = list(dict.fromkeys((model, *fallback_models)))
        self.failed: set[str] = set()

    def request(self, ask: Ask) -> dict:
        said = lambda text: {"parts": [{"text": text}]}
        return ask.given(
            contents=[{"role": "user"} | said(ask.prompt)],
            systemInstruction=said(ask.system) if ask.system else None,
            generationConfig=ask.given(temperature=TEMPERATURE, responseMimeType="application/json" if ask.json else None),
        )

    def generate(self, prompt: str, system_prompt: str | None = None, json_mode: bool = False) -> str:
        body = self.request(Ask(prompt, system_prompt, json_mode))
        trusted = [m for m in self.models if m not in self.failed] or self.models
        problems = []
        for left, model in zip(range(len(trusted) - 1, -1, -1), trusted, strict=True):
            patience = {"attempts": 1, "timeout": self.short} if left else {"attempts": ATTEMPTS}
            try:
                answer = post_json(self.url.format(model=quote(model)), body, {"x-goog-api-key": self.api_key}, transport=self.transport, **patience)
            except ProviderError as refused:
                self.failed.add(model)
                problems.append(str(refused))
                continue
            try:
                return self.spoken(answer)
            except ProviderError as empty:
                problems.append(str(empty))
        raise ProviderError(f"no model answered: {problems[-1]}")

    @staticmethod
    def spoken(answer: dict) -> str:
        """The parts of the answer that are not thoughts."""
        parts = ((answer.get("candidates") or [{}])[0].get("content") or {}).get("parts") or []
        texts = [p["text"] for p in parts if "text" in p and not p.get("thought")]
        if not texts:
            raise ProviderError("the answer has no text")
        return "".join(texts)


class Ollama:
    """A local server; one attempt, as a refusal there does not pass by waiting."""

    name = "ollama"
    default_model = "llama3.1"
    default_url = "http://localhost:11434"

    def __init__(self, base_url: str = default_url, model: str = default_model, transport: Transport = http_post):
        self.base_url, self.model, self.transport = base_url.rstrip("/"), model, transport

    def request(self, ask: Ask) -> dict:
        return ask.given(model=self.model, prompt=ask.prompt, system=ask.system or "", stream=False, format="json" if ask.json else None)

    def generate(self, prompt: str, system_prompt: str | None = None, json_mode: bool = False) -> str:
        return text_at(post_json(f"{self.base_url}/api/generate", self.request(Ask(prompt, system_prompt, json_mode)), attempts=1, transport=self.transport), "response")
