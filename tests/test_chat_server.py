"""Topics from a chat server: retries, pace, answers that are kept, and runs that died."""

from __future__ import annotations

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cairnworks.index import Index
from cairnworks.sources import chat
from cairnworks.sources.chat import ChatServer, Pace, ask_all, choose_backend, probe, server_base, server_key


@pytest.fixture
def stub():
    """A server that obeys words in the texts and counts how often it was asked what."""
    asked, keys = Counter(), set()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, status, body, **headers):
            self.send_response(status)
            for k, v in {"Content-Length": str(len(body)), **{k.replace("_", "-"): v for k, v in headers.items()}}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.reply(200, b'{"data": [{"id": "small"}, {"id": "large"}]}')

        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            asked[text] += 1
            keys.add(self.headers.get("Authorization"))
            first = asked[text] == 1
            if "busy" in text and first:
                return self.reply(429, b"", Retry_After="0")
            if ("fault" in text and asked[text] < 3) or "down" in text:
                return self.reply(500, b"")
            if "refused" in text:
                return self.reply(400, b"")
            if "garbled" in text and first:
                return self.reply(200, b"<html>")
            says = "no idea" if "vague" in text else 'Sure: {"topic": "Boats", "slug": "Boats!", "kind": "note", "confidence": "x"}'
            return self.reply(200, json.dumps({"choices": [{"message": {"content": says}}]}).encode())

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}", asked, keys
    server.shutdown()


def client(host, **more):
    return ChatServer(server_base(host), "small", **{"timeout": 5, "tries": 3, "first_wait": 0.01} | more)


def test_bases_and_keys(monkeypatch):
    for name in (chat.BASE_VARIABLE, *chat.KEY_VARIABLES):
        monkeypatch.setenv(name, "")
    assert [server_base(x) for x in ("h", "h:1", "https://h/api/", "http://h/v1", "[::1]", None)] == ["http://h:8080/v1", "http://h:1/v1", "https://h:8080/api/v1", "http://h:8080/v1", "http://[::1]:8080/v1", "http://localhost:8080/v1"]
    assert server_key() == ""
    monkeypatch.setenv(chat.KEY_VARIABLES[1], " b ")
    assert server_key() == "b" and server_key("c") == "c"
    monkeypatch.setenv(chat.KEY_VARIABLES[0], "a")
    monkeypatch.setenv(chat.BASE_VARIABLE, "other:9")
    assert server_key() == "a" and server_base() == "http://other:9/v1"


def test_probe_and_choice(stub):
    host = stub[0]
    assert probe(host) == (True, ["small", "large"]) and probe("127.0.0.1:1") == (False, [])
    assert [choose_backend("auto", host), choose_backend("auto", "127.0.0.1:1"), choose_backend("heading", host)] == ["server", "heading", "heading"]
    with pytest.raises(ValueError):
        choose_backend("other")


def test_what_goes_wrong_is_asked_again_or_told(stub):
    host, asked, keys = stub
    ask = lambda text: client(host, key="k").ask(text, Pace(0))
    assert all(ask(t)[1] is None for t in ("fine", "busy", "fault", "garbled")) and keys == {"Bearer k"}
    assert [asked[t] for t in ("fine", "busy", "fault", "garbled")] == [1, 2, 3, 2]
    assert ask("down") == (None, "status 500") and ask("refused") == (None, "status 400")
    assert asked["down"] == 3 and asked["refused"] == 1
    answer, error = client("127.0.0.1:1", tries=1).ask("x", Pace(0))
    assert answer is None and error.startswith(chat.UNREACHED)


def test_tasks_share_the_rate_and_stop_asking_a_server_out_of_reach(spark, stub):
    rows = spark.createDataFrame([(str(k), f"t{k}") for k in range(12)], "text_key string, t string")
    began = time.time()
    got = ask_all(rows, client(stub[0]), at_once=2, per_second=10).collect()
    assert time.time() - began >= 0.9 and all(r["answer"] for r in got) and len(got) == 12
    got = ask_all(rows, client("127.0.0.1:1", tries=1), at_once=1).collect()
    assert sum("not asked" in r["error"] for r in got) == 12 - chat.GIVE_UP
    assert ask_all(rows.limit(0), client(stub[0]), at_once=2).count() == 0


def drive(folder, texts):
    folder.mkdir()
    for k, text in enumerate(texts):
        (folder / f"{k}.txt").write_text(text)
    return str(folder)


def test_topics_of_an_index_from_a_server(spark, stub, tmp_path):
    host, asked, _ = stub
    index = Index(spark, str(tmp_path / "index"))
    index.ingest(drive(tmp_path / "disk", ["one", "busy two", "vague three", "down four", ""]))
    assert index.topics(server=client(host), share=2) == {"tagged": 3, "skipped": 2, "clusters": 1, "errors": 1}
    assert {(r["value"], r["source"]) for r in index.tags.where("key = 'topic_slug'").collect()} == {("boats", "llm")}
    before = Counter(asked)
    assert index.topics(server=client(host), share=2)["errors"] == 1  # only the text without an answer is asked again
    assert asked - before == Counter({"down four": 3})


def test_a_run_that_died_is_taken_up_after_its_last_round(spark, stub, tmp_path):
    host, asked, _ = stub
    marker = str(tmp_path / "died")

    class Dying(ChatServer):
        def ask(self, text, pace):
            if text == "t4" and not os.path.exists(marker):
                open(marker, "w").close()
                os._exit(1)
            return super().ask(text, pace)

    index = Index(spark, str(tmp_path / "index"))
    index.ingest(drive(tmp_path / "disk", [f"t{k}" for k in range(10)]))
    with pytest.raises(Exception, match="."):
        index.topics(server=Dying(server_base(host), "small"), at_once=1, share=2)
    kept = index.answers.count()
    assert 0 < kept < 10
    again = Index(spark, str(tmp_path / "index"))
    out = again.topics(server=client(host), at_once=1, share=2)
    assert out["tagged"] == 10 and out["errors"] == 0 and again.answers.count() == 10
    assert sum(asked.values()) <= 10 + 10 - kept and sum(n == 1 for n in asked.values()) >= kept
