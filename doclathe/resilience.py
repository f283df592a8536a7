"""Circuit breaker and HTTP with retries, for use inside executors' tasks."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable

WAITS = (1, 3, 5, 10, 30)
#: Agents that a client names, one at random for each request.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Safari/605.1.15",
)


class CircuitOpen(Exception):
    pass


class StatusError(Exception):
    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


class RetriesExhausted(Exception):
    pass


class CircuitBreaker:
    """Closed; open after ``threshold`` failures in a row; after ``timeout`` seconds half open for ``probes`` calls."""

    def __init__(self, threshold: int = 5, timeout: float = 60, probes: int = 1, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.timeout, self.probes, self.clock = threshold, timeout, probes, clock
        self.reset()

    def reset(self) -> None:
        self.failures, self.opened, self.tried = 0, None, 0

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.timeout else "open"

    def call(self, f: Callable, *args, **kw):
        state = self.state
        if state == "open" or state == "half_open" and self.tried >= self.probes:
            raise CircuitOpen("circuit is open")
        self.tried += state == "half_open"
        try:
            out = f(*args, **kw)
        except Exception:
            self.failures += 1
            if state == "half_open" or self.failures >= self.threshold:
                self.opened, self.tried = self.clock(), 0
            raise
        self.reset()
        return out


def waits(n: int) -> list[float]:
    """The first ``n`` waits: the fixed ones, then doubling."""
    return [WAITS[i] if i < len(WAITS) else WAITS[-1] * 2.0 ** (i - len(WAITS) + 1) for i in range(n)]


class HttpClient:
    """Requests with retries on transport errors and on 429 and 5xx. ``opener`` maps (method, url, headers, body) to
    (status, body)."""

    def __init__(self, retries: int = 3, timeout: float = 30, breaker: CircuitBreaker | None = None, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep):
        self.retries, self.timeout, self.sleep = retries, timeout, sleep
        self.breaker = breaker or CircuitBreaker(max(3, retries))
        self.opener = opener or self._open

    def _open(self, method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=self.timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def request(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> bytes:
        own = {"User-Agent": random.choice(AGENTS), "Accept-Language": "en"} | (headers or {})
        last: Exception | None = None
        for wait in [*waits(self.retries), None]:
            try:
                status, got = self.breaker.call(self.opener, method.upper(), url, own, body)
                if status < 400:
                    return got
                if status != 429 and status < 500:
                    raise StatusError(status)
                last = StatusError(status)
            except (CircuitOpen, StatusError):
                raise
            except Exception as e:
                last = e
            if wait is not None:
                self.sleep(wait)
        raise RetriesExhausted(f"{self.retries + 1} attempts failed: {last}") from last

    def get(self, url: str, headers: dict[str, str] | None = None) -> bytes:
        return self.request("GET", url, headers)

    def post_json(self, url: str, value: object, headers: dict[str, str] | None = None) -> object:
        """Sends and receives JSON."""
        return json.loads(self.request("POST", url, {"Content-Type": "application/json"} | (headers or {}), json.dumps(value).encode()))
