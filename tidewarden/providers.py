"""Investigation providers: the interface, a JSON-over-HTTP client with retries, and grounding checks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol


class NotConfigured(RuntimeError):
    """No provider is configured."""


class NotGrounded(ValueError):
    """The response names another incident, or evidence that wasn't supplied."""


class RequestFailed(RuntimeError):
    """The provider couldn't be reached, or answered with nonsense."""


class Provider(Protocol):
    def generate(self, request: dict) -> dict: ...


def _send(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
        return answer.read()


@dataclass
class HttpProvider:
    """Posts the request as JSON. 408, 429, 5xx and connection errors are tried again, with doubling waits."""

    endpoint: str
    timeout_seconds: float = 10.0
    max_retries: int = 2
    backoff_seconds: float = 0.5
    transport: Callable[[str, bytes, dict[str, str], float], bytes] = _send
    sleeper: Callable[[float], None] = time.sleep
    counters: dict[str, int] = field(default_factory=lambda: {"requests": 0, "retries": 0, "failures": 0, "successes": 0})

    def __post_init__(self) -> None:
        if not 0 <= self.max_retries <= 3 or not 0 < self.timeout_seconds <= 60:
            raise ValueError("at most 3 retries and 60 seconds")

    def generate(self, request: dict) -> dict:
        self.counters["requests"] += 1
        body = json.dumps(request, sort_keys=True, default=str).encode()
        attempt = 0
        while True:
            try:
                found = json.loads(self.transport(self.endpoint, body, {"Content-Type": "application/json"}, self.timeout_seconds))
                self.counters["successes"] += 1
                return found
            except ValueError as bad:
                problem, again = bad, False
            except urllib.error.HTTPError as refused:
                problem, again = refused, refused.code in (408, 429) or refused.code >= 500
            except OSError as lost:  # URLError and timeouts among them
                problem, again = lost, True
            if not again or attempt >= self.max_retries:
                self.counters["failures"] += 1
                raise RequestFailed(str(problem)) from problem
            self.sleeper(self.backoff_seconds * 2**attempt)
            self.counters["retries"] += 1
            attempt += 1


def grounded(request: dict, response: dict) -> dict:
    """The response, if it is about the same incident and cites only what was supplied."""
    key = lambda refs: {r["reference_id"] for r in refs}
    cited = key(response.get("cited_evidence", ()))
    used: Iterable[str] = {c for h in response.get("hypotheses", ()) for c in h["citations"]}
    if response.get("incident_id") != request["incident_id"]:
        raise NotGrounded("the response is about another incident")
    if missing := sorted(set(used) - cited):
        raise NotGrounded(f"hypotheses cite evidence that isn't listed: {', '.join(missing)}")
    if missing := sorted(cited - key(request["evidence"])):
        raise NotGrounded(f"evidence that wasn't supplied: {', '.join(missing)}")
    return response


def investigate(request: dict, provider: Provider | None) -> dict:
    if provider is None:
        raise NotConfigured("no investigation provider is configured")
    return grounded(request, provider.generate(request))
