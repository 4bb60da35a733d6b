"""Completion sources: where the answers of tier-1, tier-2 and the judge come from."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..session import stage
from .cache import COMPLETION, CompletionCache, lookup, params_of

# fixed values: known endpoints
ENDPOINTS = {
    "nvidia": "https://integrate.api.nvidia.com/v1",
    "openrouter": "https://openrouter.ai/api/v1",
}
# fixed values: retry rules
MAX_RETRIES = 2
LENGTH_FACTOR = 4
MAX_TOKENS_CAP = 8192
#: error of a request that may only be answered from the cache and is not in it
REPLAY_MISS = "replay only: no cached completion"


class CompletionSource(Protocol):
    """Adds ``completion`` (struct) and ``error`` (string) to rows with ``messages, wanted``."""

    def complete(self, requests: DataFrame, tier: str) -> DataFrame: ...


@dataclass(frozen=True)
class TableSource:
    """Completions from the cache table only."""

    cache: CompletionCache
    models: dict[str, dict[str, str]]  # tier -> provider -> model
    cfg: Config = Config()

    def complete(self, requests: DataFrame, tier: str) -> DataFrame:
        found = lookup(requests, self.cache.entries(), self.models[tier], self.cfg)
        missing = F.col("wanted") & F.col("completion").isNull()
        miss = REPLAY_MISS if self.cfg.replay_only else "no cached completion"
        return found.withColumn("error", F.when(missing, F.lit(miss)))


Reply = tuple[int, dict[str, Any] | None, str | None, float]
Transport = Callable[[str, dict[str, Any], str, int], Reply]


def http_transport(url: str, payload: dict[str, Any], api_key: str, timeout: int) -> Reply:
    """POST a JSON payload: (status, body, error text, seconds); status 0 when unreachable."""
    request = urllib.request.Request(
        url,
        data=json.dumps(payload).encode(),
        headers={"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"},
        method="POST",
    )
    started = time.perf_counter()
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            body = json.loads(reply.read())
            return reply.status, body, None, time.perf_counter() - started
    except urllib.error.HTTPError as error:
        text = error.read().decode(errors="replace").strip()
        return error.code, None, text, time.perf_counter() - started
    except Exception as error:
        return 0, None, str(error), time.perf_counter() - started


@dataclass(frozen=True)
class RemoteSource:
    """Completions from remote endpoints, asked inside ``mapInPandas`` batches.

    ``connections`` tasks share the request rate; equal requests of a batch are asked once. The result is staged, so a retried or re-read
    plan never repeats a call, and new completions go to the cache when one is given.
    """

    models: dict[str, dict[str, str]]
    api_keys: dict[str, str]
    cfg: Config = Config()
    cache: CompletionCache | None = None
    transport: Transport = http_transport
    connections: int = 3
    endpoints: dict[str, str] = field(default_factory=lambda: dict(ENDPOINTS))

    def complete(self, requests: DataFrame, tier: str) -> DataFrame:
        models = self.models[tier]
        if self.cache:
            known = lookup(requests, self.cache.entries(), models, self.cfg)
        else:
            known = requests.withColumn("completion", F.lit(None).cast(COMPLETION))
        open_ = F.col("wanted") & F.col("completion").isNull()
        if self.cfg.replay_only:
            return known.withColumn("error", F.when(open_, F.lit(REPLAY_MISS)))
        # cached completions are read once; the calls below see only the small request columns
        known = stage(known.withColumn("_row", F.when(open_, F.sha2(F.to_json("messages"), 256))), f"{tier}-requests")
        # equal requests are asked once and share the reply
        asked = known.where(open_).groupBy("_row").agg(F.any_value(F.to_json("messages")).alias("messages"))
        replies = asked.repartition(self.connections).mapInPandas(
            self._caller(models), f"_row string, completion {COMPLETION}, error string"
        )
        replies = stage(replies, f"{tier}-replies")
        answered = known.join(
            replies.withColumnRenamed("completion", "_new"), "_row", "left"
        ).withColumn("completion", F.coalesce("completion", "_new"))
        if self.cache:
            fresh = answered.where(F.col("_new").isNotNull()).groupBy("_row").agg(
                F.any_value("_new").alias("completion"), F.any_value("messages").alias("messages")
            )
            self.cache.put(
                fresh.select(
                    F.col("completion")["provider"].alias("provider"),
                    F.col("completion")["model"].alias("model"),
                    "messages",
                    params_of(self.cfg).alias("params"),
                    "completion",
                )
            )
        return answered.drop("_row", "_new")

    def _caller(self, models: dict[str, str]) -> Callable:
        gap = 0.0
        if self.cfg.requests_per_minute > 0:
            gap = 60.0 * self.connections / self.cfg.requests_per_minute
        ask = _Chain(self.cfg, models, self.api_keys, self.endpoints, self.transport, gap)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                replies = [ask(json.loads(m)) for m in batch["messages"]]
                yield pd.DataFrame(
                    {
                        "_row": batch["_row"],
                        "completion": [r[0] for r in replies],
                        "error": [r[1] for r in replies],
                    }
                )

        return run


class _Chain:
    """One completion: providers in order, each with its retries."""

    def __init__(self, cfg, models, api_keys, endpoints, transport, gap):
        self.cfg, self.models, self.api_keys = cfg, models, api_keys
        self.endpoints, self.transport, self.gap = endpoints, transport, gap
        self.last_start = 0.0

    def __call__(self, messages: list[dict[str, str]]) -> tuple[dict | None, str | None]:
        faults = []
        for provider in self.cfg.provider_order:
            if provider not in self.endpoints:
                continue
            if not self.api_keys.get(provider):
                faults.append(f"{provider}: Missing API key")
                continue
            size, bigger = self.cfg.max_tokens, self.cfg.max_tokens * LENGTH_FACTOR
            text, fault, cut = self._ask(provider, messages, size)
            if cut and min(bigger, MAX_TOKENS_CAP) > size:
                text, fault, cut = self._ask(provider, messages, min(bigger, MAX_TOKENS_CAP))
            if text is not None:
                return text, None
            faults.append(f"{provider}: {fault}")
        order = list(self.cfg.provider_order)
        return None, f"All providers in chain {order} failed. Details: {'; '.join(faults)}"

    def _send(self, provider: str, payload: dict) -> Reply:
        url = f"{self.endpoints[provider]}/chat/completions"
        return self.transport(url, payload, self.api_keys[provider], self.cfg.timeout_seconds)

    def _pace(self) -> None:
        pause = self.last_start + self.gap - time.time()
        if pause > 0:
            time.sleep(pause)
        self.last_start = time.time()

    def _ask(self, provider: str, messages: list, max_tokens: int):
        """(completion, fault, cut by length) of one provider at one token limit."""
        payload = {
            "model": self.models[provider],
            "messages": messages,
            "temperature": self.cfg.temperature,
            "seed": self.cfg.seed,
            "max_tokens": max_tokens,
        }
        plain = dict(payload)
        if self.cfg.reasoning_effort:
            payload["extra_body"] = {"reasoning_effort": self.cfg.reasoning_effort}
        for retry in range(MAX_RETRIES + 1):
            self._pace()
            status, body, error, seconds = self._send(provider, payload)
            if status == 400 and payload != plain:
                status, body, error, seconds = self._send(provider, plain)
            if status != 429 or retry == MAX_RETRIES:
                break
            time.sleep(2.0**retry)
        if status != 200 or not body:
            detail = _snippet(body if body is not None else error)
            return None, f"HTTP {status}: {detail}" if detail else f"HTTP {status}", False
        choice = (body.get("choices") or [{}])[0]
        content = str((choice.get("message") or {}).get("content") or "").strip()
        reason = choice.get("finish_reason", "unknown")
        if not content:
            what = "Received empty content" if choice else "Empty choices array"
            return None, f"HTTP {status}: {what}: {_snippet(body)}", False
        if reason == "length":
            return None, f"HTTP {status}: truncated at max_tokens={max_tokens}", True
        done = {
            "text": content,
            "provider": provider,
            "model": self.models[provider],
            "latency": round(seconds, 2),
            "finish_reason": reason,
        }
        return done, None, False


def _snippet(body: Any) -> str:
    """First 200 characters of the error field or of the whole body."""
    if isinstance(body, str):
        try:
            parsed = json.loads(body)
        except ValueError:
            return body[:200]
        body = parsed if isinstance(parsed, dict) and "error" in parsed else body
    error = body.get("error", body) if isinstance(body, dict) else body
    if isinstance(error, dict):
        error = error.get("message") or json.dumps(error)
    return str(error or "")[:200]
