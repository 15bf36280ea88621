"""Optional language-model calls: a client protocol, a test double, strict JSON replies, and a batched operator."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("foliomill")


class Client(Protocol):
    """Anything that answers a prompt."""

    def complete(self, system: str, user: str, max_tokens: int = 512) -> str: ...


class FakeClient:
    """FN-31: the reply of the first key found in the prompt, else the default; remembers its calls."""

    def __init__(self, replies: dict[str, str] | None = None, default: str = "{}"):
        self.replies, self.default, self.calls = replies or {}, default, []

    def complete(self, system: str, user: str, max_tokens: int = 512) -> str:
        self.calls.append((system, user))
        return next((reply for key, reply in self.replies.items() if key in user), self.default)


def extract_json(reply: str) -> Any:
    """FN-19: the JSON value in a reply that may stand in a code fence or after words."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply)
    begins = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not begins:
        raise ValueError("no JSON in the reply")
    return json.JSONDecoder().raw_decode(body[min(begins) :])[0]


def validated(reply: str, fields: dict[str, type | tuple[type, ...]]) -> dict[str, Any]:
    """FN-20: an object with exactly these fields, each of its type."""
    value = extract_json(reply)
    if not isinstance(value, dict) or set(value) != set(fields):
        raise ValueError(f"fields {sorted(fields)} are asked for")
    for name, kind in fields.items():
        if not isinstance(value[name], kind) or isinstance(value[name], bool) and kind is not bool:
            raise ValueError(f"{name} is not {kind}")
    return value


def with_retry[T](call: Callable[[], T], retries: int = 3, delay_seconds: float = 0.05, retry_on: tuple[type[Exception], ...] = (Exception,)) -> T:
    """OPS-1: tries again after a wait that grows by the same amount each time."""
    for turn in range(1, retries + 1):
        try:
            return call()
        except retry_on:
            if turn == retries:
                raise
            log.warning("attempt %d failed", turn)
            time.sleep(delay_seconds * turn)
    raise ValueError("retries must be positive")


def completed(rows: DataFrame, make_client: Callable[[], Client], system: str, fallback: str = "", retries: int = 2) -> DataFrame:
    """``rows`` (with a column ``prompt``) and the reply, ``fallback`` where a call fails; clients are made in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            replies = []
            for prompt in batch.prompt:
                try:
                    replies.append(with_retry(lambda p=prompt: client.complete(system, p), retries))
                except Exception:
                    log.exception("a call failed")
                    replies.append(fallback)
            yield batch.assign(reply=replies)

    return rows.mapInPandas(run, rows.withColumn("reply", F.lit("")).schema)
