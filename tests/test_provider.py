"""Asking providers: the log, failures, limits, the address, and the stages that ask."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindrift.plans import pipeline
from spindrift.sources import config, provider


def prompts(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("prompt")).withColumn("prompt_hash", F.sha2("prompt", 256))


def counting(folder, fails=0.0, hold=0.0, dies_after=None):
    """A client that notes each answer in a file and fails at random; it ends its process after so many answers."""

    def make():
        import os
        import random
        import time
        import uuid

        n = 0

        async def call(prompt):
            nonlocal n
            import asyncio

            if random.random() < fails:
                raise OSError("busy")
            began = time.time()
            await asyncio.sleep(hold)
            n += 1
            if dies_after and n > dies_after and not os.path.exists(f"{folder}/died"):
                Path(f"{folder}/died").touch()
                os._exit(1)
            Path(f"{folder}/{uuid.uuid4().hex}").write_text(f"{prompt} {began} {time.time()}")
            return f"answer to {prompt}"

        return call

    return make


def noted(folder):
    return [p.read_text().split() for p in Path(folder).iterdir() if p.name != "died"]


@pytest.mark.parametrize("fails", [0.0, 0.5])
def test_every_prompt_is_answered_once(spark, tmp_path, fails):
    (tmp_path / "calls").mkdir()
    df = prompts(spark, 60)
    limits = provider.Limits(calls=8, tasks=3, turns=3, wait=0.01)
    for _ in range(12):
        got = provider.ask(df.unionByName(df), counting(tmp_path / "calls", fails), str(tmp_path / "log"), limits)
    assert {(r.prompt_hash, r.completion) for r in got.collect()} == {(r.prompt_hash, f"answer to {r.prompt}") for r in df.collect()} and got.count() == 60
    assert sorted(x[0] for x in noted(tmp_path / "calls")) == sorted(r.prompt for r in df.collect())


def test_a_run_that_broke_off_goes_on_from_the_log(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    monkeypatch.setattr(provider, "FLUSH", 1)
    df, limits = prompts(spark, 40), provider.Limits(calls=1, tasks=1)
    with pytest.raises(Exception):  # noqa: B017 - the worker is gone
        provider.ask(df, counting(tmp_path / "calls", dies_after=15), str(tmp_path / "log"), limits)
    before = provider.read_log(spark, str(tmp_path / "log")).count()
    assert 0 < before < 40
    got = provider.ask(df, counting(tmp_path / "calls", dies_after=15), str(tmp_path / "log"), limits)
    assert got.count() == 40 and len(noted(tmp_path / "calls")) == 40


def test_calls_in_flight_and_rate(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider.ask(prompts(spark, 24), counting(tmp_path / "calls", hold=0.3), str(tmp_path / "log"), provider.Limits(calls=8, tasks=2))
    spans = [(float(a), float(b)) for _, a, b in noted(tmp_path / "calls")]
    most = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert 3 <= most <= 8
    (tmp_path / "slow").mkdir()
    provider.ask(prompts(spark, 8), counting(tmp_path / "slow"), str(tmp_path / "log2"), provider.Limits(calls=8, tasks=1, per_minute=600))
    starts = sorted(float(a) for _, a, _ in noted(tmp_path / "slow"))
    assert starts[-1] - starts[0] >= 0.6


def test_chat_address():
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            out = json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        call = provider.http_client(f"http://127.0.0.1:{server.server_port}/v1/", "m", "k", "be brief")()
        assert call("hé") == "HÉ"
    finally:
        server.shutdown()
    path, key, body = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["model"] == "m" and body["temperature"] == 0.1
    assert body["messages"] == [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hé"}]


def test_environment(monkeypatch):
    monkeypatch.delenv("LLM_BASE_URL", raising=False)
    assert provider.client_from_environment() is None
    monkeypatch.setenv("LLM_BASE_URL", "http://localhost:1")
    assert callable(provider.client_from_environment()())


def test_stages_ask_and_take_up_where_answers_lack(spark, tmp_path):
    settings = config.EnhancedTasks(max_concurrent_llm_calls=6, max_concurrent_commits=2)
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"), config.Config(enhanced_tasks=settings))
    commits = spark.createDataFrame([("r", i, f"h{i}", f"diff {i}", ("a", "e", "d", "m"), []) for i in range(4)], "repo string, commit_no int, commit_hash string, diff string, metadata struct<author_name:string,author_email:string,commit_date:string,commit_message:string>, files_modified array<struct<file_path:string,content:string>>")
    ws.write("commits", commits, commits)
    assert pipeline.tasks(ws) == 0

    def partly():
        def call(prompt):
            if "diff 2" in prompt:
                raise OSError
            return '{"tasks": ["t"]}'

        return call

    ws.client = partly
    assert pipeline.tasks(ws) == 3 and {r.commit_no for r in ws.read("tasks").collect()} == {0, 1, 3}
    ws.client = lambda: lambda prompt: '{"tasks": ["late"]}'
    assert pipeline.tasks(ws) == 1 and {r.commit_no: r.tasks for r in ws.read("tasks").collect()} == {0: ["t"], 1: ["t"], 2: ["late"], 3: ["t"]}
