"""Providers answer requests. Real ones are given by the user; those here are deterministic."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any, Protocol


class ProviderError(Exception):
    """A failed call. Only retryable ones are tried again."""

    def __init__(self, message: str, retryable: bool = False, retry_after: str | float | None = None):
        super().__init__(message)
        self.retryable, self.retry_after = retryable, retry_after


class Provider(Protocol):
    """``kind``: an endpoint name, ``embedding`` or ``transcription``. Opened once for each partition."""

    async def call(self, kind: str, request: Any, deployment: Any, options: dict[str, Any]) -> dict[str, Any]: ...


def words(request: Any) -> int:
    return len(json.dumps(request)) // 4 + 1


def first_text(request: Any) -> str:
    if isinstance(request, list):
        content = request[0].get("content") if request else ""
        return content if isinstance(content, str) else json.dumps(content)
    if isinstance(request, dict):
        v = request.get("input", "")
        return v if isinstance(v, str) else json.dumps(v)
    return str(request)


class EchoProvider:
    """Answers with the request's own text; ``rule`` may change the answer or raise."""

    def __init__(self, rule: Callable[[str, Any], str | None] | None = None):
        self.rule = rule

    async def call(self, kind: str, request: Any, deployment: Any, options: dict[str, Any]) -> dict[str, Any]:
        seen = request if kind in ("embedding", "transcription") else first_text(request)
        text = self.rule(kind, seen) if self.rule else None
        name = hashlib.md5(json.dumps([kind, repr(request)]).encode()).hexdigest()[:12]
        used = words(seen if not isinstance(seen, bytes) else len(seen))
        base = {
            "id": f"req-{name}", "model": getattr(deployment, "model", "echo"),
            "_hidden_params": {"deployment": getattr(deployment, "label", None)},
        }
        if kind == "embedding":
            vectors = [[float(b) / 255 for b in hashlib.md5(t.encode()).digest()[:4]] for t in request]
            return base | {"data": [{"embedding": v} for v in vectors], "usage": {"prompt_tokens": used, "total_tokens": used}}
        if kind == "transcription":
            return base | {"text": text or f"{len(request)} bytes", "duration": len(request) / 16_000, "language": "en"}
        text = seen if text is None else text
        out = words(text)
        if kind == "responses":
            return base | {
                "output": [{"type": "message", "content": [{"type": "output_text", "text": text}]}],
                "usage": {"input_tokens": used, "output_tokens": out, "total_tokens": used + out},
            }
        choice = {"text": text} if kind == "text_completion" else {"message": {"content": text}}
        return base | {
            "choices": [choice | {"finish_reason": "stop"}],
            "usage": {"prompt_tokens": used, "completion_tokens": out, "total_tokens": used + out},
        }


class ScriptedProvider(EchoProvider):
    """Echo whose failures follow from the number that begins each text (``17 some text``).

    Multiples of ``refuse`` fail for good. Of the others, those one above a multiple of ``stumble``
    fail as often as their remainder by 5 says, in a way that may be retried. Usage counts
    characters; the cost is the option ``price`` for each.
    """

    def __init__(self, refuse: int = 7, stumble: int = 3, rule: Callable[[str, Any], str | None] | None = None):
        super().__init__(rule)
        self.refuse, self.stumble = refuse, stumble
        self.tried: dict[int, int] = {}

    def _check(self, text: str) -> None:
        n = int(text.split(" ", 1)[0])
        if n % self.refuse == 0:
            raise ProviderError(f"refused {n}")
        if self.stumble and n % self.stumble == 1:
            self.tried[n] = self.tried.get(n, 0) + 1
            if self.tried[n] <= n % 5:
                raise ProviderError(f"busy {n}", retryable=True)

    async def call(self, kind: str, request: Any, deployment: Any, options: dict[str, Any]) -> dict[str, Any]:
        texts = [first_text(request)] if kind not in ("embedding", "transcription") else request if kind == "embedding" else []
        for text in texts:
            self._check(text)
        answer = await super().call(kind, request, deployment, options)
        n = sum(map(len, texts))
        if kind == "embedding":
            return answer | {"usage": {"prompt_tokens": n, "total_tokens": n}}
        if kind != "transcription":
            name, other = ("input_tokens", "output_tokens") if kind == "responses" else ("prompt_tokens", "completion_tokens")
            answer["usage"] = {name: n, other: n, "total_tokens": 2 * n}
            answer["_hidden_params"] = answer["_hidden_params"] | {"response_cost": n * options.get("price", 0.0)}
        return answer


class ShortProvider(EchoProvider):
    """Leaves out a vector wherever a text begins with a multiple of ``short``."""

    def __init__(self, short: int = 61):
        super().__init__()
        self.short = short

    async def call(self, kind: str, request: Any, deployment: Any, options: dict[str, Any]) -> dict[str, Any]:
        answer = await super().call(kind, request, deployment, options)
        if kind == "embedding" and any(int(t.split(" ", 1)[0]) % self.short == 0 for t in request):
            answer["data"].pop()
        return answer
