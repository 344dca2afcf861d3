"""A server of language models that speaks the common chat protocol over HTTP.

Requests of all tasks together stay below a rate; answers that say "too many" or "broken" are
asked again after growing waits; everything that goes wrong with one text is a row's error.
"""

from __future__ import annotations

import http.client
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame

from cairnworks.functions.text import KINDS

DEFAULT_BASE = "http://localhost:8080/v1"
DEFAULT_PORT = 8080
BASE_VARIABLE = "CAIRN_LLM_BASE"
KEY_VARIABLES = ("CAIRN_LLM_API_KEY", "OPENAI_API_KEY")
PROBE_SECONDS = 2.0
#: Texts in a row that a task finds the server out of reach for before it stops asking.
GIVE_UP = 3
UNREACHED = "out of reach"
ASKED = (
    "You sort files of an archive by subject. Answer with one JSON object and nothing else, with the keys topic (the subject in up to "
    f"three words), slug (the topic in lower case, words joined by hyphens), kind (one of {', '.join(KINDS)}) and confidence (0 to 1). "
    "Use only what the text says."
)


def server_base(base: str | None = None) -> str:
    """The base of the API: the one given, the environment's or the default one.

    A scheme is added if there is none, the default port if there is none, and /v1 at the end once.
    """
    raw = (base or os.environ.get(BASE_VARIABLE) or DEFAULT_BASE).strip().rstrip("/")
    parts = urlsplit(raw if "://" in raw else f"http://{raw}")
    host = parts.netloc if parts.port else f"{parts.netloc.rstrip(':')}:{DEFAULT_PORT}"
    path = parts.path if parts.path.endswith("/v1") else f"{parts.path}/v1"
    return urlunsplit((parts.scheme, host, path, "", ""))


def server_key(key: str | None = None) -> str:
    """The key given, or the first one set in the environment, or none."""
    return next((k.strip() for k in (key, *map(os.environ.get, KEY_VARIABLES)) if k and k.strip()), "")


def _headers(key: str) -> dict[str, str]:
    return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})


def probe(base: str | None = None, key: str | None = None, timeout: float = PROBE_SECONDS) -> tuple[bool, list[str]]:
    """(whether the server answers in time, its models)."""
    request = urllib.request.Request(f"{server_base(base)}/models", headers=_headers(server_key(key)))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return True, [m.get("id", "") for m in json.load(reply).get("data") or []]
    except (OSError, ValueError, AttributeError, http.client.HTTPException):
        return False, []


def choose_backend(wanted: str = "auto", base: str | None = None) -> str:
    """``server`` or ``heading``; auto is the server if it answers."""
    if wanted == "auto":
        return "server" if probe(base)[0] else "heading"
    if wanted not in ("server", "heading"):
        raise ValueError(f"unknown back end: {wanted}")
    return wanted


class Pace:
    """Lets a request through every ``gap`` seconds."""

    def __init__(self, gap: float):
        self.gap, self.next = gap, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


@dataclass(frozen=True)
class ChatServer:
    """``tries`` requests a text at most; the first wait between them doubles up to ``longest_wait`` seconds."""

    base: str
    model: str
    key: str = ""
    timeout: float = 120.0
    tries: int = 5
    first_wait: float = 0.5
    longest_wait: float = 60.0

    def _request(self, text: str) -> urllib.request.Request:
        body = {
            "model": self.model,
            "messages": [{"role": "system", "content": ASKED}, {"role": "user", "content": text}],
            "temperature": 0,
            "max_tokens": 512,
            "stream": False,
            "response_format": {"type": "json_object"},
            "chat_template_kwargs": {"enable_thinking": False},
        }
        return urllib.request.Request(f"{self.base}/chat/completions", json.dumps(body).encode(), _headers(self.key))

    def ask(self, text: str, pace: Pace) -> tuple[str | None, str | None]:
        """(what the model says, what went wrong); one of them is null."""
        error = None
        for k in range(self.tries):
            pace.wait()
            wait = min(self.longest_wait, self.first_wait * 2**k) * random.uniform(0.5, 1)
            try:
                with urllib.request.urlopen(self._request(text), timeout=self.timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"] or "", None
            except urllib.error.HTTPError as e:
                error = f"status {e.code}"
                if e.code != 429 and e.code < 500:
                    return None, error
                after = e.headers.get("Retry-After", "")
                wait = min(self.longest_wait, float(after)) if after.isdigit() else wait
            except (ValueError, LookupError, TypeError) as e:  # not the protocol's JSON
                error = f"broken reply: {type(e).__name__}"
            except (OSError, http.client.HTTPException) as e:
                error = f"{UNREACHED}: {e}"
            if k + 1 < self.tries:
                time.sleep(wait)
        return None, error


def ask_all(rows: DataFrame, server: ChatServer, at_once: int, per_second: float | None = None) -> DataFrame:
    """rows(text_key, t) to (text_key, model, answer, error), by ``at_once`` tasks that share the rate.

    A task that finds the server out of reach ``GIVE_UP`` times in a row asks no more and says so in its rows.
    """
    gap = at_once / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, lost = Pace(gap), 0
        for batch in batches:
            out = []
            for text in batch["t"]:
                answer, error = server.ask(text, pace) if lost < GIVE_UP else (None, f"{UNREACHED}: not asked")
                lost = lost + 1 if error and error.startswith(UNREACHED) else 0
                out.append((answer, error))
            yield pd.DataFrame({"text_key": batch["text_key"], "model": server.model, "answer": [a for a, _ in out], "error": [e for _, e in out]})

    return rows.select("text_key", "t").repartition(at_once).mapInPandas(run, "text_key string, model string, answer string, error string")
