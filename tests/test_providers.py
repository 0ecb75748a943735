import json
import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corvane.operators import vector
from corvane.plans import providers


class Service(BaseHTTPRequestHandler):
    """Vectors of each text's length, and answers that repeat the question in capitals; a text ``bad`` fails."""

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/embed":
            answer = None if "bad" in asked["input"] else {"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}
        else:
            said = [m["content"] for m in asked["messages"]]
            answer = {"message": {"content": said[-1].upper()}, "prompt_eval_count": len(said), "eval_count": asked["options"]["num_predict"]}
        self.send_response(200 if answer else 500)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_embedder(spark, service):
    pages = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "abcd"), (4, None)], "page_id long, text string").coalesce(1)
    found = {r.page_id: r.embedding for r in vector.embed(pages, vector.HttpEmbedder(f"{service}/embed", "m", 2)).collect()}
    assert found == {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [4.0, 1.0], 4: [0.0, 1.0]}


def test_http_chat(spark, service):
    prompts = spark.createDataFrame([("q", "what")], "query_id string, prompt string")
    r = providers.ask(prompts, providers.HttpChat(f"{service}/chat", "m"), max_tokens=7).first()
    assert (r.content, r.prompt_tokens, r.completion_tokens, r.error) == ("WHAT", 2, 7, False)
    r = providers.ask(prompts, providers.HttpChat("http://127.0.0.1:1/none", "m", 2.0)).first()
    assert r.error and r.content.startswith("Error: ") and r.latency_ms >= 0


def test_backends():
    assert vector.backend() and vector.backend("clamped") and not vector.backend("plain") and not vector.backend("missing")


def counting(folder):
    """Answers in capitals and leaves a file for each call; ``bad`` fails."""
    folder = str(folder)

    def answer(prompt, system, temperature=0.0, max_tokens=2048):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if prompt == "bad":
            raise RuntimeError("no")
        return providers.Answer(prompt.upper(), 1, 2)

    return answer


def test_answers_outlive_a_run(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    provider, made = counting(calls), lambda: len(os.listdir(calls))
    prompts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one"), ("d", "bad")], "query_id string, prompt string")
    first = {r.query_id: (r.content, r.error) for r in providers.ask_cached(prompts, provider, cache).collect()}
    assert first == {"a": ("ONE", False), "b": ("TWO", False), "c": ("ONE", False), "d": ("Error: no", True)}
    assert made() == 3  # equal prompts are sent once
    again = {r.query_id: (r.content, r.error) for r in providers.ask_cached(prompts.filter("query_id <> 'd'"), provider, cache).collect()}
    assert again == {k: v for k, v in first.items() if k != "d"} and made() == 3
    providers.ask_cached(prompts, provider, cache).count()
    assert made() == 4  # the failure alone was sent again
    providers.ask_cached(prompts.limit(1), provider, cache, max_tokens=7).count()
    providers.ask_cached(prompts.limit(1), provider, cache, name="other").count()
    assert made() == 6  # other settings are other questions
    assert providers.ask_cached(prompts.limit(0), provider, cache).collect() == [] and made() == 6


def test_expansion_from_the_cache(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    queries = spark.createDataFrame([(1, "where is Router.add"), (2, "where is Router.add"), (3, "why")], "query_id long, query string")
    first = sorted(map(str, providers.expand(queries, counting(calls), cache).collect()))
    assert len(os.listdir(calls)) == 2
    assert sorted(map(str, providers.expand(queries, counting(calls), cache).collect())) == first and len(os.listdir(calls)) == 2
    assert sorted(map(str, providers.expand(queries).collect())) == first  # no JSON: by patterns
