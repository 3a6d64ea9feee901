"""Boundaries to models: an interface, and the offline stand-in that makes callers take their local path."""

from __future__ import annotations

from typing import Protocol


class LLMClient(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]:
        """An answer for each prompt, None where there is none."""


class NullLLM:
    """Answers nothing, so every caller uses its deterministic local path."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [None] * len(prompts)


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]:
        """A unit vector for each text."""


class HashEmbedder:
    def encode(self, texts: list[str]) -> list[list[float]]:
        from corpusloom.functions.udfs import hash_embedding

        return [hash_embedding(t) for t in texts]
