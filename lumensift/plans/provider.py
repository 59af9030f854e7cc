"""Language models as an interface: structured answers, one corrective retry, closed schemas."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol


class ProviderError(Exception):
    """A model could not answer; tasks pass it on."""


class ConfigError(ProviderError):
    pass


class SchemaError(ProviderError):
    pass


@dataclass(frozen=True)
class Field:
    """A field of an answer: a type, and the values it may have."""

    kind: type
    values: tuple = ()
    default: Any = None
    required: bool = True


#: A schema is a name to field map; lists hold answers of one schema.
Schema = dict[str, Field]

CONFIDENCE = ("high", "medium", "low")
ASSESSMENT: Schema = {"evidence_id": Field(str), "requested_concept": Field(str), "classification": Field(str), "extracted_definition": Field(str), "confidence": Field(str, CONFIDENCE), "concept_match": Field(str)}
POINT: Schema = {"point_id": Field(str, required=False), "statement": Field(str), "type": Field(str, required=False), "facet": Field(str, required=False), "evidence_ids": Field(list), "source_excerpt": Field(str, required=False), "confidence": Field(str, CONFIDENCE, "medium", False), "explicitly_stated": Field(bool, required=False)}
EXAMPLE: Schema = {"example_id": Field(str, required=False), "statement": Field(str), "example_type": Field(str, required=False), "concept_match": Field(str), "source_excerpt": Field(str, required=False), "evidence_ids": Field(list), "confidence": Field(str, CONFIDENCE)}


def without_fences(content: str) -> str:
    flat = content.strip()
    if flat.startswith("```") and flat.endswith("```") and len(flat) >= 6:
        return flat[7 if flat.startswith("```json") else 3 : -3].strip()
    return flat


def validated(rows: Any, schema: Schema) -> list[dict]:
    """Rows that fit the schema exactly: no unknown field, no missing one, closed values."""
    if not isinstance(rows, list):
        raise SchemaError("a list is expected")
    out = []
    for row in rows:
        if not isinstance(row, dict) or set(row) - set(schema):
            raise SchemaError(f"unknown fields: {sorted(set(row) - set(schema)) if isinstance(row, dict) else row!r}")
        one = {}
        for name, f in schema.items():
            if name not in row or row[name] is None:
                if f.required:
                    raise SchemaError(f"missing: {name}")
                one[name] = f.default
            elif not isinstance(row[name], f.kind) or f.values and row[name] not in f.values:
                raise SchemaError(f"{name}: {row[name]!r}")
            else:
                one[name] = row[name]
        out.append(one)
    return out


class Provider(Protocol):
    def answer(self, messages: list[dict[str, str]], task: str) -> str: ...

    def available(self) -> bool: ...


def structured(provider: Provider, messages: list[dict[str, str]], schema: Schema, task: str, retry: bool = True) -> list[dict]:
    """A validated answer; one that does not fit is sent back once with what is wrong."""
    text = provider.answer(messages, task)
    for last in (not retry, True):
        try:
            return validated(json.loads(without_fences(text)), schema)
        except (ValueError, SchemaError) as e:
            if last:
                raise SchemaError(str(e)) from e
            text = provider.answer([*messages, {"role": "assistant", "content": text}, {"role": "user", "content": f"The answer does not fit: {e}. Return the JSON list only."}], task)
    raise AssertionError


@dataclass
class Scripted:
    """A deterministic provider: answers by a function of the task and its last message."""

    reply: Callable[[str, str], Any]
    calls: list[str] = field(default_factory=list)

    def answer(self, messages: list[dict[str, str]], task: str) -> str:
        self.calls.append(task)
        got = self.reply(task, messages[-1]["content"])
        return got if isinstance(got, str) else json.dumps(got)

    def available(self) -> bool:
        return True


@dataclass
class Chat:
    """A service with the widespread chat-completions interface: POST {base}/chat/completions, GET {base}/models."""

    base: str
    model: str
    key: str | None = None
    timeout: float = 120.0

    def _request(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        data = json.dumps(body).encode() if body is not None else None
        try:
            with urllib.request.urlopen(urllib.request.Request(self.base.rstrip("/") + path, data, headers), timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise (ConfigError if e.code in (401, 403, 404) else ProviderError)(f"{path}: {e.code} {e.reason}") from e
        except (OSError, ValueError) as e:
            raise ProviderError(f"{path}: {e}") from e

    def answer(self, messages: list[dict[str, str]], task: str) -> str:
        got = self._request("/chat/completions", {"model": self.model, "messages": messages, "temperature": 0})
        try:
            return got["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"{task}: no message in the answer") from e

    def available(self) -> bool:
        try:
            self._request("/models")
        except ProviderError:
            return False
        return True


REGISTRY: dict[str, Callable[..., Provider]] = {"scripted": Scripted, "chat": Chat}


def create(name: str, **options: Any) -> Provider:
    """A provider by name; other providers are entered into REGISTRY by their packages."""
    if name not in REGISTRY:
        raise ConfigError(f"unknown provider: {name}")
    return REGISTRY[name](**options)
