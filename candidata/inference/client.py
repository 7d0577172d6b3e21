"""The Python stages: asking a model for every row of a DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ANSWERS = "array<struct<attempt:int,provider:string,model:string,body:string,error:string>>"
#: Rows whose answers a task holds at a time; a batch of Spark may hold thousands of long texts.
SLICE = 64


class Client(Protocol):
    def __call__(self, prompt: str, provider: str, model: str) -> str | None:
        """The body of the answer, or None if there is none. May raise; may run in many threads."""


def _asked(client: Client, prompt: str, provider: str, model: str) -> tuple[str | None, str | None]:
    """The body, or why there is none."""
    try:
        body = client(prompt, provider, model)
        return body, None if body is not None else "no answer"
    except Exception as failure:
        return None, f"{type(failure).__name__}: {failure}"


def answered(
    batches: Iterator[pd.DataFrame],
    client_factory: Callable[[], Client],
    answer: Callable[[Client, dict], dict],
    added: Sequence[str],
    columns: Sequence[str],
    in_flight: int,
) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most `SLICE` rows with the columns `added`; one call of `answer` per row.

    What is made for a row, its request as a dictionary and its answers, is held for one part only.
    """
    client = client_factory()
    with ThreadPoolExecutor(in_flight) as pool:
        for batch in batches:
            # An empty batch is passed on, so that there is one at least.
            for first in range(0, max(1, len(batch)), SLICE):
                part = batch.iloc[first : first + SLICE]
                rows = part[list(columns)].to_dict("records")
                found = list(pool.map(lambda row: answer(client, row), rows))
                yield part.assign(**{name: [x[name] for x in found] for name in added})


def _rows(
    requests: DataFrame,
    schema: T.StructType,
    client_factory: Callable[[], Client],
    answer: Callable[[Client, dict], dict],
    columns: Sequence[str],
    concurrency: int | None,
    in_flight: int,
) -> DataFrame:
    """One call of `answer` per row, at most `in_flight` at a time in each task."""
    added = [name for name in schema.names if name not in requests.columns]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return answered(batches, client_factory, answer, added, columns, in_flight)

    if concurrency is not None:
        requests = requests.repartition(concurrency)
    return requests.mapInPandas(ask, schema)


def infer(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    prompt: str = "prompt",
    provider: str = "provider",
    model: str = "model",
    out: str = "body",
    error: str = "call_error",
    concurrency: int | None = None,
    in_flight: int = 8,
) -> DataFrame:
    """Add the model's answer to every row, or why the call failed; a null prompt gives neither.

    One client is made per task and asked by `in_flight` threads. `concurrency` sets the number
    of tasks; by default every task of the input makes its own calls. Nothing is pushed through
    this stage, so decide before it what is worth a call.
    """
    text = T.StringType()
    schema = T.StructType([*requests.schema.fields, T.StructField(out, text), T.StructField(error, text)])

    def answer(client: Client, row: dict) -> dict:
        if row[prompt] is None:
            return {out: None, error: None}
        body, why = _asked(client, row[prompt], row[provider], row[model])
        return {out: body, error: why}

    return _rows(requests, schema, client_factory, answer, (prompt, provider, model), concurrency, in_flight)


def _strictly(text: str) -> object:
    """The value of a JSON text by the rules of the parser that reads the answers later: no NaN or
    infinities, and no object with a repeated key."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("repeated key")
        return found

    def refuse(constant: str) -> None:
        raise ValueError(constant)

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def readable(body: str | None, chat: bool, required: Sequence[str] = ()) -> bool:
    """Whether a body holds its provider's envelope, and in it an object with the required keys.

    As `operators.records` decides it for the answers kept, so that no model is asked in vain and none
    is left out: fences go, and what stands from the first to the last brace is one strict object.
    """
    try:
        outer = json.loads(body)
        if chat:
            text = outer["choices"][0]["message"]["content"]
        else:
            text = outer["candidates"][0]["content"]["parts"][0]["text"]
        if text is None:
            return False
        text = text if isinstance(text, str) else json.dumps(text)
        text = re.sub(r"```\s*$", "", re.sub(r"```json\s*", "", text))
        found = _strictly(text[text.index("{") : text.rindex("}") + 1])
    except (TypeError, ValueError, KeyError, IndexError, RecursionError):
        return False
    return isinstance(found, dict) and all(k in found for k in required)


def infer_attempts(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    chat_providers: Sequence[str],
    prompt: str = "prompt",
    attempts: str = "attempts",
    out: str = "answers",
    required: Sequence[str] = (),
    concurrency: int | None = None,
    in_flight: int = 8,
) -> DataFrame:
    """Ask the models listed in `attempts` one after the other until an answer can be read.

    `attempts` is a list of (provider, model); `chat_providers` use the envelope of chats. Adds the list of all answers got; a null prompt
    or an empty list gives an empty one. No row is asked for again once it has its answer.
    """
    dtype, chats = T._parse_datatype_string(ANSWERS), frozenset(chat_providers)
    schema = T.StructType([*requests.schema.fields, T.StructField(out, dtype)])

    def answer(client: Client, row: dict) -> dict:
        got = []
        planned = row[attempts] if row[prompt] is not None and row[attempts] is not None else ()
        for number, step in enumerate(planned, 1):
            body, why = _asked(client, row[prompt], step["provider"], step["model"])
            got.append(
                {"attempt": number, "provider": step["provider"], "model": step["model"], "body": body, "error": why}
            )
            if readable(body, step["provider"] in chats, required):
                break
        return {out: got}

    return _rows(requests, schema, client_factory, answer, (prompt, attempts), concurrency, in_flight)


class OfflineClient:
    """A stand-in for tests: answers with a record that depends on the prompt alone.

    Models end in the number of their attempt. Some documents get no answer or one without a
    record at the first attempt, and some never get a record.
    """

    def __init__(self, chat_providers: frozenset[str] = frozenset({"p2"})):
        self.chat_providers = chat_providers

    def envelope(self, text: str, provider: str) -> str:
        if provider in self.chat_providers:
            return json.dumps({"choices": [{"message": {"content": text}}]})
        return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})

    def __call__(self, prompt: str, provider: str, model: str) -> str | None:
        n = len(prompt.split("Document:\n", 1)[-1])
        if n % 4 == 1 and model[-1] == "1":
            raise ConnectionError("no connection")
        if n % 4 == 2 and (model[-1] == "1" or n % 8 == 2):
            return self.envelope(f"No record for {n} characters", provider)
        record = {
            "personal_info": {
                "name": f"Reader of {n}",
                "email": f"Write to r{n}@mail.example.org today",
                "phone": f"Tel. +49 (30) 555-{n % 10000:04d}",
            },
            "summary": f"{model} read {n} characters",
            "skills": ["python", "Python", " sql ", f"skill {n % 7}", ""],
            "experience": ["Reader", {"title": "Author", "company": f"Company {n % 5}"}],
            "education": {"degree": "Letters"},
            "projects": [{"name": "P", "technologies": "Spark"}],
        }
        text = json.dumps(record)
        return self.envelope(f"```json\n{text}\n```" if n % 4 == 3 else text, provider)


class OfflineFitClient(OfflineClient):
    """A stand-in for tests that judges a candidate by the end of the phone number in the prompt."""

    def __call__(self, prompt: str, provider: str, model: str) -> str | None:
        n = int(re.search(r"555-(\d{4})", prompt)[1])
        if n % 4 == 3 and model[-1] != "3":
            raise TimeoutError("too slow")
        record = {
            "summary": f"{model} judged {n}",
            "fit_percentage": f"{n % 101}%",
            "key_matches": ["reading", f"number {n % 9}"],
            "key_gaps": [],
        }
        if n % 4 == 2 or (n % 4 == 1 and model[-1] == "1"):
            del record["key_gaps"]
        return self.envelope(json.dumps(record), provider)


class OfflineBrokenClient(OfflineClient):
    """A stand-in for tests whose first model writes what looks like JSON to some parsers only."""

    BROKEN = ('{"summary": NaN}', '{"summary": "one", "summary": "two"}', '{"skills": [Infinity], "summary": "x"}')

    def __call__(self, prompt: str, provider: str, model: str) -> str | None:
        n = len(prompt.split("Document:\n", 1)[-1])
        if model[-1] == "1" and n % 4 < 3:
            return self.envelope(self.BROKEN[n % 4], provider)
        # The other provider's envelope, which nobody unwraps.
        if model[-1] == "2" and n % 5 == 0:
            return self.envelope(json.dumps({"summary": "lost"}), "p1" if provider in self.chat_providers else min(self.chat_providers))
        return self.envelope(json.dumps({"summary": f"{model} read {n} characters"}), provider)
