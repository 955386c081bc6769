"""Asking a model about contexts: prompts, a pluggable transport, verdicts, accuracy."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import parsing
from graphloom.operators import datasets

Send = Callable[[str], str | None]


def prompt(text: Column, messages: Column | None = None) -> Column:
    notes = F.lit("") if messages is None else F.coalesce(F.concat(F.lit("Analyzer notes:\n"), F.array_join(messages, "\n"), F.lit("\n")), F.lit(""))
    ask = 'Is this code vulnerable? End with one JSON object: {"vulnerable": true or false, "severity": "CRITICAL|HIGH|MEDIUM|LOW", "cwe_id": number, "description": "one sentence"}.\n'
    return F.concat(F.lit(ask), notes, F.lit("Code:\n"), text)


def _within(send: Send, text: str, timeout: float) -> str | None:
    """An answer in time, or an error; a request that is stuck is left behind in a thread that holds up nothing."""
    got: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            got.put((send(text), None))
        except Exception as e:  # noqa: BLE001  whatever the transport raises belongs to this request
            got.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        answer, error = got.get(timeout=timeout)
    except queue.Empty:
        raise TimeoutError(f"no answer within {timeout:g} s") from None
    if error is not None:
        raise error
    return answer


def ask(prompts: DataFrame, send: Send, concurrency: int = 8, timeout: float = 600.0, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """``prompts (sample_id, prompt)`` with ``response`` and ``error``; a failed request costs its own row only.

    A request that fails or has no answer within ``timeout`` seconds is made again up to ``retries`` times, after a pause that doubles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> tuple[str | None, str | None]:
            for attempt in range(retries + 1):
                try:
                    return _within(send, p, timeout), None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(pause * 2**attempt)
            return None, error

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(one, b["prompt"]))
                yield pd.DataFrame({"sample_id": b["sample_id"], "prompt": b["prompt"], "response": [g[0] for g in got], "error": [g[1] for g in got]})

    return prompts.select("sample_id", "prompt").mapInPandas(run, "sample_id string, prompt string, response string, error string")


class Batches(Protocol):
    """A server that takes many requests at once: ``submit`` gives a name, ``status`` says how it stands, ``results`` come by id."""

    def submit(self, requests: list[dict]) -> str: ...

    def status(self, name: str) -> str: ...

    def results(self, name: str) -> Iterable[tuple[str, str | None, str | None]]: ...


#: States after which a batch does not change.
FINAL = frozenset({"ended", "canceled", "expired"})


def ask_batches(prompts: DataFrame, connect: Callable[[], Batches], size: int = 10_000, every: float = 30.0, timeout: float = 86_400.0, **options) -> DataFrame:
    """As :func:`ask`, in batches of at most ``size`` requests of a partition; what a batch does not answer is an error row.

    A task that is run again submits its batch again, so a lost executor costs requests, never answers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server, held = connect(), []
        for frame in frames:
            held += list(zip(frame["sample_id"], frame["prompt"], strict=True))
            while len(held) >= size:
                yield _batch(server, held[:size], every, timeout, options)
                held = held[size:]
        if held:
            yield _batch(server, held, every, timeout, options)

    return prompts.select("sample_id", "prompt").mapInPandas(run, "sample_id string, prompt string, response string, error string")


def _batch(server: Batches, held: list[tuple[str, str]], every: float, timeout: float, options: dict) -> pd.DataFrame:
    name = server.submit([{"custom_id": i, **request(p, **options)} for i, p in held])
    end = time.monotonic() + timeout
    while (status := server.status(name)) not in FINAL and time.monotonic() < end:
        time.sleep(every)
    got = {i: (t, e) for i, t, e in server.results(name)} if status in FINAL else {}
    missing = (None, "no result" if status in FINAL else f"no end within {timeout:.0f} s")
    return pd.DataFrame([(i, p, *got.get(i, missing)) for i, p in held], columns=["sample_id", "prompt", "response", "error"])


def request(prompt: str, system: str | None = None, max_tokens: int = 1024, temperature: float = 0.0, seed: int = 42, **more) -> dict:
    """A chat request; ``more`` (a repetition penalty, a response format) goes along where it is set."""
    said = [{"role": "system", "content": system}] if system else []
    return {"messages": [*said, {"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature, "seed": seed, **{k: v for k, v in more.items() if v is not None}}


def reply(message: dict) -> str:
    """The text of an answer; of one that is all reasoning, the reasoning."""
    return (message.get("content") or "").strip() or (message.get("reasoning_content") or message.get("reasoning") or "").strip()


def answered(samples: DataFrame, responses: DataFrame) -> DataFrame:
    """``samples`` with the responses of a table; a missing one is an error row."""
    r = responses.select("sample_id", "response")
    return samples.join(r, "sample_id", "left").withColumn("error", F.when(F.col("response").isNull(), F.lit("no response")))


def review(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_v", parsing.review_verdict(F.coalesce("response", F.lit("")))).select(*rows.columns, "_v.*")


def judge(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy over ``rows (label 0/1, response)``."""
    said = rows.withColumn("predicted", parsing.judge_verdict(F.coalesce("response", F.lit(""))).cast("int"))
    return datasets.accuracy(said, by)
