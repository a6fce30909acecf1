"""Asking a provider of completions from Spark tasks: calls in flight together, a shared rate, and a log from which a rerun goes on.

Prompts are dealt by hash into the folders of a log, and a folder is one task's. A task reads the log of its folders first, asks only what
it doesn't find there, and adds the answers in small files as they come. So whatever stops a run, task or job, no answered prompt is
asked again.
"""

from __future__ import annotations

import asyncio
import inspect
import json
import os
import posixpath
import random
import time
import urllib.request
import uuid
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a log, and answers after which a task adds a file to it.
FOLDERS, FLUSH = 64, 50
LOG = "prompt_hash string, completion string"
#: Makes, on an executor, what turns a prompt into text; plain or async.
Client = Callable[[], Callable[[str], str | Awaitable[str]]]


@dataclass(frozen=True)
class Limits:
    """Calls in flight over all tasks, tasks, calls a minute over all tasks (None: any number), turns of a failing call, and the wait
    before the second turn, which doubles with each further one."""

    calls: int = 5
    tasks: int = 2
    per_minute: float | None = None
    turns: int = 3
    wait: float = 1.0

    @property
    def in_flight(self) -> int:
        """A task's share of the calls."""
        return max(1, self.calls // self.tasks)


class _Pace:
    """Starts of calls, so far apart that all tasks together keep the rate."""

    def __init__(self, per_minute: float | None, tasks: int):
        self.gap, self.next = (60.0 * tasks / per_minute if per_minute else 0.0), 0.0

    async def turn(self) -> None:
        now = time.monotonic()
        at = self.next = max(self.next + self.gap, now)
        if at > now:
            await asyncio.sleep(at - now)


async def _answers(prompts: list[tuple[str, str]], call: Callable, limits: Limits, pace: _Pace) -> Iterator[tuple[str, str | None]]:
    """(hash, completion) as they come, at most in_flight at a time; null where all turns failed."""
    is_async = inspect.iscoroutinefunction(call) or inspect.iscoroutinefunction(getattr(call, "__call__", None))

    async def one(key: str, prompt: str) -> tuple[str, str | None]:
        for turn in range(limits.turns):
            await pace.turn()
            try:
                return key, (await call(prompt) if is_async else await asyncio.to_thread(call, prompt))
            except Exception:  # noqa: BLE001 - a provider's errors are its own
                if turn + 1 < limits.turns:
                    await asyncio.sleep(limits.wait * 2**turn * random.uniform(0.75, 1.25))
        return key, None

    waiting, left = set(), iter(prompts)
    while True:
        while len(waiting) < limits.in_flight and (p := next(left, None)):
            waiting.add(asyncio.ensure_future(one(*p)))
        if not waiting:
            return
        done, waiting = await asyncio.wait(waiting, return_when=asyncio.FIRST_COMPLETED)
        for d in done:
            yield d.result()


class _Folder:
    """The log of some prompts."""

    def __init__(self, log: str, number: int):
        self.store, base = fs.FileSystem.from_uri(log) if "://" in log else (fs.LocalFileSystem(), log.removeprefix("file:"))
        self.path = posixpath.join(base, f"folder={number}")

    def known(self) -> set[str]:
        files = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        out = set()
        for f in files:
            if f.base_name.endswith(".json"):
                with self.store.open_input_stream(f.path) as s:
                    out |= {json.loads(x)["prompt_hash"] for x in s.read().decode().splitlines()}
        return out

    def add(self, rows: list[tuple[str, str]]) -> None:
        """One file, under its name only when it is whole."""
        if rows:
            self.store.create_dir(self.path)
            at = posixpath.join(self.path, f"{uuid.uuid4().hex}.json")
            with self.store.open_output_stream(f"{at}.part") as s:
                s.write("".join(json.dumps({"prompt_hash": k, "completion": v}) + "\n" for k, v in rows).encode())
            self.store.move(f"{at}.part", at)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """prompt_hash, completion of all answers; of a prompt that two attempts of a task asked at the same time, both."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log}/folder=*/*.json")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return spark.read.schema(LOG).json(f"{log}/folder=*/*.json") if found is not None and len(found) else spark.createDataFrame([], LOG)


def ask(prompts: DataFrame, client: Client, log: str, limits: Limits = Limits()) -> DataFrame:
    """The log (prompt_hash, completion) after every distinct prompt (prompt_hash, prompt) that it lacked has been asked.

    log is a folder that all executors share. A call that fails is tried again; after the last turn it has no answer, and the next ask
    tries anew. Null prompts are not asked.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, pace, folder, known = client(), _Pace(limits.per_minute, limits.tasks), None, set()
        asked = failed = 0
        loop = asyncio.new_event_loop()

        async def through(rows: list[tuple[str, str]]) -> int:
            came, bad = [], 0
            try:
                async for key, text in _answers(rows, call, limits, pace):
                    bad += text is None
                    if text is not None:
                        came.append((key, text))
                    if len(came) >= FLUSH:
                        folder.add(came)
                        came = []
            finally:
                folder.add(came)
            return bad

        try:
            for frame in frames:
                for number, own in frame.groupby("folder", sort=False):
                    if folder is None or not folder.path.endswith(f"folder={number}"):
                        folder = _Folder(log, number)
                        known = folder.known()
                    rows = [(k, p) for k, p in zip(own["prompt_hash"], own["prompt"], strict=True) if k not in known]
                    asked, failed = asked + len(rows), failed + loop.run_until_complete(through(rows))
        finally:
            loop.close()
        yield pd.DataFrame({"asked": [asked], "failed": [failed]})

    distinct = prompts.select("prompt_hash", "prompt").where("prompt is not null and prompt_hash is not null").dropDuplicates(["prompt_hash"])
    folder = F.pmod(F.xxhash64("prompt_hash"), F.lit(FOLDERS)).cast("int")
    dealt = distinct.withColumn("folder", folder).repartition(limits.tasks, "folder").sortWithinPartitions("folder")
    dealt.mapInPandas(run, "asked bigint, failed bigint").write.format("noop").mode("overwrite").save()
    return read_log(prompts.sparkSession, log)


def http_client(base_url: str, model: str, key: str = "", system: str = "", timeout: float = 3000.0, temperature: float = 0.1, max_tokens: int = 20_000) -> Client:
    """A client of a chat completions address, base_url/chat/completions."""

    def make() -> Callable[[str], str]:
        def call(prompt: str) -> str:
            said = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
            body = json.dumps({"model": model, "messages": said, "temperature": temperature, "max_tokens": max_tokens, "stop": ["<END>"]}).encode()
            request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]

        return call

    return make


def client_from_environment() -> Client | None:
    """The client that LLM_BASE_URL, LLM_MODEL_NAME and OPENAI_API_KEY describe; None without an address."""
    base = os.environ.get("LLM_BASE_URL")
    return http_client(base, os.environ.get("LLM_MODEL_NAME", "gpt-4"), os.environ.get("OPENAI_API_KEY", "")) if base else None
