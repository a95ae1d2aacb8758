"""The protocols, and HTTP with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Protocol

# fixed values
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
ATTEMPTS = 3
BASE_DELAY = 2.0


class ProviderError(RuntimeError):
    """A provider could not complete a request."""


class ProviderConfigError(ValueError):
    """The chosen provider lacks configuration."""


class LanguageModel(Protocol):
    name: str

    def generate(self, prompt: str, system_prompt: str | None = None, json_mode: bool = False) -> str: ...


class Embedder(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        """A unit vector for each text."""

    def embed_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]:
        """Larger is more relevant."""


Response = tuple[int, dict[str, str], str]
Transport = Callable[[str, bytes, dict[str, str], float], Response]


def http_post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> Response:
    """(status, lower-cased headers, text); raises OSError if there is no response."""
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode("utf-8", "replace")


def messages(tree: object) -> Iterator[str]:
    """Every text under a key ``message`` of a JSON tree, outermost first."""
    level = [tree]
    while level:
        objects = [x for x in level if isinstance(x, dict)]
        yield from (x["message"] for x in objects if isinstance(x.get("message"), str))
        level = [v for x in objects for v in x.values()] + [v for x in level if isinstance(x, list) for v in x]


def asked_pause(header: str | None) -> float:
    """Seconds that a Retry-After header asks for: a number of them, or a date."""
    if not header:
        return 0.0
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, (parsedate_to_datetime(header) - datetime.now(UTC)).total_seconds())
    except (TypeError, ValueError):
        return 0.0


@dataclass(frozen=True)
class Outcome:
    """What one request came to: an answer, or a problem that may pass by waiting."""

    answer: dict | None = None
    problem: str = ""
    passing: bool = False
    pause: float = 0.0


def judge(response: Response) -> Outcome:
    status, headers, text = response
    try:
        tree = json.loads(text)
    except ValueError:
        tree = None
    if status == 200:
        return Outcome(tree) if isinstance(tree, dict) else Outcome(problem="the reply is no JSON object")
    told = next(messages(tree), text).strip().split("\n", 1)[0]
    return Outcome(problem=f"HTTP {status}: {told[:200]}", passing=status in RETRY_STATUS, pause=asked_pause(headers.get("retry-after")))


def post_json(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 90.0, attempts: int = ATTEMPTS, transport: Transport = http_post, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object that a server answers with.

    Overload, rate limits and lost connections are met by a plan of pauses, each twice
    the one before; a server that asks for a longer pause gets it.
    """
    body = json.dumps(payload).encode()
    sent = {"Content-Type": "application/json"} | (headers or {})
    plan = [BASE_DELAY * (1 << i) for i in range(attempts - 1)]
    while True:
        try:
            outcome = judge(transport(url, body, sent, timeout))
        except OSError as lost:
            outcome = Outcome(problem=f"no connection: {lost}", passing=True)
        if outcome.answer is not None:
            return outcome.answer
        if not outcome.passing:
            raise ProviderError(outcome.problem)
        if not plan:
            raise ProviderError(f"no answer in {attempts} attempts; the last one: {outcome.problem}")
        sleep(max(plan.pop(0), outcome.pause))
