"""The judge: an external call with a cache, retries and one repair.

Prompts are told apart by their cache key; each distinct one that the cache
lacks is asked once, inside ``mapInPandas``, and the answers are written before
anything reads them, so that neither a retried task's sibling nor a second
action asks again.  Only answers that parse are cached.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical, canonical_json, version_of
from ..session import ship, staged

PARSER_VERSION = "1"
PROVIDERS = ("anthropic", "openai_compat", "mock")
RETRIED = (429, 500, 502, 503, 504)
ANSWER = "cache_key string, parsed string, error string, latency_ms long, cost_usd double, tokens_in long, tokens_out long, raw string"
CACHE = "cache_key string, parsed string"


class ProviderError(Exception):
    """A provider's failure; ``status`` decides on retries."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Reply:
    text: str
    tokens_in: int | None = None
    tokens_out: int | None = None
    cost_usd: float | None = None


#: (prompt, response schema, configuration) -> Reply
Provider = Callable[[dict, dict, "JudgeConfig"], Reply]


@dataclass(frozen=True)
class JudgeConfig:
    provider: str
    model: str
    temperature: float = 0.0
    top_p: float | None = None
    max_tokens: int = 1024
    base_url: str | None = None
    api_key_env: str | None = None
    timeout_s: float = 60
    max_retries: int = 3

    def __post_init__(self):
        if self.provider not in PROVIDERS:
            raise ValueError(f"provider {self.provider!r} is none of {', '.join(PROVIDERS)}")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature must be from 0 to 2")

    def identity(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k in ("provider", "model", "temperature", "top_p", "max_tokens")}

    def version_hash(self, system: str | None, questions: object, schema: dict) -> str:
        return version_of({"judge": self.identity(), "system": system, "questions": questions, "schema": schema, "parser": PARSER_VERSION})


def mock(prompt: dict, schema: dict, config: JudgeConfig) -> Reply:
    """A fixed answer for each property of the schema."""
    answer = {}
    for name, s in schema.get("properties", {}).items():
        kind = s.get("type")
        if s.get("enum"):
            answer[name] = s["enum"][0]
        elif kind == "array":
            answer[name] = [s["items"]["enum"][0]] if s.get("items", {}).get("enum") else []
        else:
            answer[name] = {"boolean": True, "object": {}, "number": 0, "integer": 0}.get(kind, "mock answer")
    return Reply(json.dumps(answer), 100, 20, 0.001)


def parse_reply(text: str) -> dict | None:
    """The object in a reply: bare, fenced, or between the outermost braces."""
    text = text.strip()
    if m := re.fullmatch(r"```[A-Za-z0-9]*\s*\n?(.*?)\n?```", text, re.S):
        text = m[1].strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text and not text.startswith("[") else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def _call(provider: Provider, prompt: dict, schema: dict, config: JudgeConfig) -> Reply:
    for n in range(config.max_retries + 1):
        try:
            return provider(prompt, schema, config)
        except ProviderError as e:
            if e.status not in RETRIED or n == config.max_retries:
                raise
            time.sleep(min(2**n, 8) * (0.5 + random.random() / 2))
    raise AssertionError


def _plus(a, b):
    return None if a is None or b is None else a + b


def ask_one(provider: Provider, prompt: dict, schema: dict, config: JudgeConfig) -> tuple:
    """(parsed, error, latency_ms, cost_usd, tokens_in, tokens_out, raw); never raises.  ``raw`` is the text of a reply that stayed unusable."""
    began = time.monotonic()
    took = lambda: int((time.monotonic() - began) * 1000)
    try:
        reply = _call(provider, prompt, schema, config)
    except Exception as e:
        return None, f"{type(e).__name__}: {e}", took(), None, None, None, None
    cost, t_in, t_out = reply.cost_usd, reply.tokens_in, reply.tokens_out
    parsed, raw = parse_reply(reply.text), reply.text
    if parsed is None:
        messages = [*prompt["messages"], {"role": "assistant", "content": reply.text}, {"role": "user", "content": "Reply with one JSON object that fits the schema, and nothing else."}]
        try:
            again = _call(provider, {**prompt, "messages": messages}, schema, config)
            parsed, raw = parse_reply(again.text), again.text
            # both calls are billed, whether the repair worked or not
            cost, t_in, t_out = _plus(cost, again.cost_usd), _plus(t_in, again.tokens_in), _plus(t_out, again.tokens_out)
        except Exception:
            parsed = None
    return canonical(parsed) if parsed is not None else None, None, took(), cost, t_in, t_out, raw if parsed is None else None


def ask(prompts: DataFrame, schema: Column, version: Column, config: JudgeConfig, provider: Provider, cache: DataFrame | None = None, order: str = "trace_id") -> tuple[DataFrame, DataFrame]:
    """(``prompts`` with the answers' columns, new cache rows).

    ``prompts`` has a column ``prompt``: JSON text {system, messages}, null where
    nothing is to be asked.  ``schema`` is JSON text.  Of the rows that share a
    prompt the first by ``order`` is billed; the others are hits if it parsed.
    """
    ship(prompts.sparkSession)
    keyed = prompts.withColumn("_schema", schema).withColumn("judge_config_hash", version)
    whole = F.concat(F.lit('{"judge":"'), F.col("judge_config_hash"), F.lit('","prompt":'), canonical_json("prompt"), F.lit(',"schema":'), canonical_json("_schema"), F.lit("}"))
    keyed = staged(keyed.withColumn("cache_key", F.when(F.col("prompt").isNotNull(), F.sha2(whole, 256))), "prompts")
    missing = keyed.where("prompt is not null").select("cache_key", "prompt", "_schema")
    if cache is not None:
        missing = missing.join(cache.select("cache_key"), "cache_key", "left_anti")
    missing = missing.groupBy("cache_key").agg(F.first("prompt").alias("prompt"), F.first("_schema").alias("_schema"))

    def asked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *ask_one(provider, json.loads(p), json.loads(s), config)) for k, p, s in part.itertuples(index=False)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])
            yield frame.astype({"latency_ms": "Int64", "tokens_in": "Int64", "tokens_out": "Int64", "cost_usd": "Float64"})

    fresh = staged(missing.mapInPandas(asked, ANSWER), "answers")
    got = fresh.withColumn("hit", F.lit(False))
    if cache is not None:
        known = cache.select("cache_key", "parsed", *[F.lit(v).cast(t).alias(n) for n, t, v in (("raw", "string", None), ("error", "string", None), ("latency_ms", "long", 0), ("cost_usd", "double", 0.0), ("tokens_in", "long", 0), ("tokens_out", "long", 0))], F.lit(True).alias("hit"))
        got = got.unionByName(known)
    # the row of each prompt that is billed: an aggregate, which is partial ahead of the shuffle
    billed = keyed.where("cache_key is not null").groupBy("cache_key").agg(F.min(F.col(order)).alias("_billed"), F.count("*").alias("_rows"))
    # a table of its own, so that the join can split a prompt that many rows share; the commonest, 1000 at most, are broadcast
    answers = staged(got.join(billed, "cache_key"), "billed")
    total = keyed.count()
    often = answers.where(F.col("_rows") * 1000 >= F.lit(total)).withColumn("_often", F.lit(True))
    seldom = answers.where(F.col("_rows") * 1000 < F.lit(total))
    names = [c for c in answers.columns if c != "cache_key"]
    met = keyed.join(F.broadcast(often), "cache_key", "left")
    rest = met.where("_often is null").drop(*names, "_often").join(seldom, "cache_key", "left")
    joined = met.where("_often").drop("_often").unionByName(rest)
    later = ~F.col(order).eqNullSafe(F.col("_billed"))
    hit = F.coalesce(F.col("hit") | (later & F.col("parsed").isNotNull()), F.lit(False))
    zero = lambda c, v: F.when(F.col("cache_hit"), F.lit(v)).otherwise(F.col(c)).alias(c)
    out = joined.withColumn("cache_hit", hit).select(*prompts.columns, "cache_key", "judge_config_hash", "cache_hit", "parsed", "raw", "error", zero("latency_ms", 0), zero("cost_usd", 0.0), zero("tokens_in", 0), zero("tokens_out", 0))
    return out, fresh.where("parsed is not null").select("cache_key", "parsed")
