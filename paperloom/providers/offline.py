"""Stand-ins that need no network and always give the same result; their output says so."""

from __future__ import annotations

import hashlib
import json
import math
import re

TAG = "[offline placeholder]"


class OfflineModel:
    """Quotes its first source, or fills a briefing's fields with placeholders."""

    name = "mock"

    def generate(self, prompt: str, system_prompt: str | None = None, json_mode: bool = False) -> str:
        if json_mode and '"chosen"' in prompt:
            return json.dumps({"chosen": 0, "reason": TAG})
        if json_mode:
            text = {k: f"{TAG} {k}" for k in ("summary_plain_english", "problem_statement")}
            lists = {k: [f"{TAG} {k}"] for k in ("method_approach", "key_results_claims", "limitations", "suggested_followup_questions")}
            return json.dumps({**text, **lists})
        source = re.search(r"\[Source 1\][^\n]*\n(.*?)(?:\n|$)", prompt)
        if not source:
            return f"NOT IN PAPER: {TAG} no source was given."
        return f"{TAG} {source[1][:200]} [Source 1]"


class HashingEmbedder:
    """Words hashed to signed dimensions; unit vectors.  Good enough to test plans with."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_query(self, text: str) -> list[float]:
        vector = [0.0] * self.dimensions
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            vector[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / norm for x in vector]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


class OverlapReranker:
    """The share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(r"\w+", query.lower()))
        return [len(asked & set(re.findall(r"\w+", t.lower()))) / max(1, len(asked)) for t in texts]
