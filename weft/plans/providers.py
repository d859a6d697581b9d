"""Language-model steps as pluggable providers, with deterministic defaults that need no model.

The defaults are rules, not models: embeddings hash features, extraction finds
capitalised phrases and frequent words, synthesis quotes sentences.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from typing import Protocol

import numpy as np

from weft.functions.native import byte_prefix
from weft.functions.text import ENTITY_TYPES, STOP_WORDS

SUMMARY_BYTES, MAX_TAGS = 400, 8


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LLM(Protocol):
    def chat(self, system: str, user: str, temperature: float, max_tokens: int) -> str | None: ...


class MediaDeriver(Protocol):
    def derive(self, content: bytes, mime: str, modality: str) -> str | None: ...


class MediaEmbedder(Protocol):
    def embed_media(self, content: bytes, mime: str) -> list[float] | None: ...


class HashEmbedder:
    """Unit vectors of hashed words and word pairs."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            words = re.findall(r"[A-Za-z0-9]+", text.lower())
            for f in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            length = np.sqrt((v * v).sum())
            out.append((v / length if length else v).astype(np.float32).tolist())
        return out


_PHRASE = re.compile(r"[A-Z][\w'-]+(?:[ \t]+[A-Z][\w'-]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class RuleLLM:
    """Answers the extraction prompt with JSON, any other with the sentences that share most words with the question."""

    def chat(self, system: str, user: str, temperature: float = 0.0, max_tokens: int = 2048) -> str | None:
        return self.extract(user) if system == EXTRACT_PROMPT else self.quote(user)

    def extract(self, text: str) -> str:
        names = [n for n, _ in Counter(_PHRASE.findall(text)).most_common(12)]
        words = Counter(w for w in re.findall(r"[a-z]{5,}", text.lower()) if w not in STOP_WORDS)
        sentences = _SENTENCE.split(text.strip())
        relations = []
        for s in sentences:
            found = [n for n in _PHRASE.findall(s) if n in names]
            m = re.search(rf"{re.escape(found[0])}\s+(\w+(?:\s+(?:by|in|of|for|to|on|with))?)\s+{re.escape(found[1])}", s) if len(found) > 1 else None
            if m:
                relations.append({"subject": found[0], "predicate": m[1], "object": found[1], "confidence": 0.5})
        return json.dumps(
            {
                "summary": sentences[0] if sentences else "", "tags": [w for w, _ in words.most_common(5)],
                "entities": [{"name": n, "type": "concept"} for n in names], "relations": relations,
            }
        )

    def quote(self, prompt: str) -> str:
        question, _, context = prompt.partition("\n\n")
        wanted = set(re.findall(r"[a-z0-9]{3,}", question.lower())) - set(STOP_WORDS)
        best = []
        for n, body in re.findall(r"(?ms)^\[(\d+)\][^\n]*\n(.*?)(?=^\[\d+\]|^Relations:|\Z)", context):
            for s in _SENTENCE.split(body.strip()):
                shared = len(wanted & set(re.findall(r"[a-z0-9]{3,}", s.lower())))
                if shared:
                    best.append((-shared, int(n), s.strip()))
        return " ".join(f"{s} [{n}]" for _, n, s in sorted(best)[:3]) or "The sources do not answer this."


EXTRACT_PROMPT = "Give JSON with summary, tags, entities (name, type) and relations (subject, predicate, object, confidence) of the text."
ANSWER_PROMPT = "Answer the question from the numbered sources only and cite them like [1]."


def slug_of(text: str) -> str:
    return re.sub(r"^-|-$", "", re.sub(r"[^A-Za-z0-9]+", "-", text)).lower()


class ExtractionError(ValueError):
    """An answer that is no extraction."""


def parse_extraction(answer: str) -> dict:
    """summary, tags, entities, relations of a model's answer; what is missing is empty, what has a wrong type is an error."""
    m = re.search(r"(?s)\{.*\}", answer)
    try:
        j = json.loads(m[0] if m else answer)
    except ValueError as e:
        raise ExtractionError(f"no JSON: {e}") from e
    if not isinstance(j, dict):
        raise ExtractionError("the top level is no object")

    def typed(value, kind, what):
        if not isinstance(value, kind) or isinstance(value, bool):
            raise ExtractionError(f"{what} has a wrong type")
        return value

    summary = typed(j.get("summary", ""), str, "summary")
    tags = [t for t in typed(j.get("tags", []), list, "tags") if isinstance(t, str) and slug_of(t)]
    entities = []
    for e in typed(j.get("entities", []), list, "entities"):
        if isinstance(e, dict) and "name" in e and slug_of(typed(e["name"], str, "name")):
            kind = typed(e.get("type", "concept"), str, "type")
            entities.append({"name": e["name"], "type": kind if kind in ENTITY_TYPES else "concept"})
    known = {slug_of(e["name"]) for e in entities}
    relations = []
    for r in typed(j.get("relations", []), list, "relations"):
        if isinstance(r, dict):
            s, p, o = (typed(r.get(x, ""), str, x) for x in ("subject", "predicate", "object"))
            confidence = float(typed(r.get("confidence", 0.0), (int, float), "confidence"))
            if slug_of(s) in known and slug_of(o) in known and p:
                relations.append({"subject": s, "predicate": p, "object": o, "confidence": confidence})
    return {"summary": byte_prefix(summary, SUMMARY_BYTES), "tags": tags[:MAX_TAGS], "entities": entities, "relations": relations}


def extract(llm: LLM, text: str) -> dict | None:
    """One try, and one more with the error; None if both fail."""
    user = text
    for _ in range(2):
        answer, error = llm.chat(EXTRACT_PROMPT, user, 0.1, 2048), "no answer"
        if answer is not None:
            try:
                return parse_extraction(answer)
            except ExtractionError as e:
                error = str(e)
        user = f"{text}\n\nYour last answer was not valid ({error}). Answer with valid JSON of the given form only."
    return None
