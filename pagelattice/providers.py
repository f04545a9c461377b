"""Providers of judgements and readings (language and vision models, recognisers): a function from a batch of requests to answers.

A provider is any callable list[dict] -> list[str | Exception | None], or the HTTP provider below. It runs inside mapInArrow: requests of a
partition are sent in parallel by a pool of threads; an answer of None or an exception is a failure, whose reason stands beside it. Endpoints that can't be reached are left alone
for a minute by that worker, so a dead endpoint costs one attempt and not one for each request.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RETRIED = frozenset((*range(502, 505), 500, 429, 409, 408))
_DOWN: dict[tuple[str, str], tuple[float, str]] = {}


class Unreachable(ConnectionError):
    """An endpoint that couldn't be reached a short while ago."""


def chat_url(url: str) -> str:
    """The chat endpoint of a base address."""
    u = url.rstrip("/")
    return u if u.endswith("/chat/completions") else u + ("/chat/completions" if u.endswith("/v1") else "/v1/chat/completions")


class HttpProvider:
    """A chat-completions endpoint, with retries, a pause after connection errors, and another endpoint for when it is down."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60, fallback: HttpProvider | None = None, retries: int = 4, pause: float = 60, threads: int = 8):
        self.url, self.model, self.key, self.timeout, self.fallback, self.retries, self.pause, self.threads = chat_url(url), model, key, timeout, fallback, retries, pause, max(1, threads)

    def ask(self, prompt: str, images: list[str] | None = None) -> str:
        try:
            return self._ask(prompt, images)
        except Unreachable:
            if self.fallback is None:
                raise
            return self.fallback.ask(prompt, images)

    def _ask(self, prompt: str, images: list[str] | None) -> str:
        at = (self.url, self.model)
        if at in _DOWN and _DOWN[at][0] > time.monotonic():
            raise Unreachable(_DOWN[at][1])
        content = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": x}} for x in images or [])]
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": content if images else prompt}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})})
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or k == self.retries:
                    raise
                wait = e.headers.get("Retry-After", "")
                time.sleep(min(60.0, float(wait)) if wait.replace(".", "", 1).isdigit() else min(30.0, 2.0**k))
            except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
                _DOWN[at] = (time.monotonic() + self.pause, str(e))
                raise Unreachable(str(e)) from e
        raise AssertionError

    def __call__(self, requests: list[dict]) -> list[str | Exception]:
        def one(r: dict) -> str | Exception:
            try:
                return self.ask(r["prompt"], r.get("images"))
            except Exception as e:  # noqa: BLE001  one failed request must not fail the job
                return e

        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(one, requests))


def from_options(o: dict) -> dict[str, Callable | None]:
    """The providers that options name: text (judgements, repairs, outlines) and picture (readings); null where there is no address.

    llm_adapter, "module:function", is called with all options and gives the text provider itself, for models that run in the worker.
    """
    threads = int(o["llm_concurrency"])
    if o["llm_adapter"]:
        module, _, name = o["llm_adapter"].partition(":")
        text = getattr(importlib.import_module(module), name or "create")(dict(o))
    else:
        url, model = o["llm_url"] or o["picture_url"], o["llm_model"] or o["picture_model"]
        spare = None
        if o["fallback_enabled"] and o["fallback_url"]:
            own = o["fallback_key"] or (o["openai_key"] if "openai" in o["fallback_url"] else "")
            spare = HttpProvider(o["fallback_url"], o["fallback_model"], own, o["fallback_timeout"], threads=threads)
        text = HttpProvider(url, model, o["llm_key"] or (o["openai_key"] if "openai" in url else ""), o["llm_timeout"], spare, threads=threads) if url else None
    picture = HttpProvider(o["picture_url"], o["picture_model"], o["picture_key"] or o["llm_key"], o["llm_timeout"], threads=threads) if o["picture_enabled"] and o["picture_url"] else text
    return {"text": text, "picture": picture}


def ask(requests: DataFrame, provider: Callable[[list[dict]], list], batch: int = 32) -> DataFrame:
    """requests with answer STRING and, where that is null, failure STRING. Write the result before using it twice: providers may answer differently the next time."""
    requests = requests.drop("answer", "failure")
    schema = T.StructType(requests.schema.fields + [T.StructField("answer", T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                got = provider(part.to_pylist())
                why = [f"{type(a).__name__}: {a}" if isinstance(a, Exception) else "no answer" if a is None else None for a in got]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if w else a for a, w in zip(got, why)], pa.string()), pa.array(why, pa.string())], names=schema.names)

    return requests.mapInArrow(run, schema)
