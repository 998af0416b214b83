import io
import json
import socket
import threading
import time

import pytest

from loamdex.engine import Engine
from loamdex.server import serve
from loamdex.sources import config as C, files, providers
from loamdex.sources.config import KnowledgeBase


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "notes"
    (root / "deep" / "node_modules").mkdir(parents=True)
    (root / "alpha.md").write_text("# Bridges\nThe Bridge Authority builds bridges over the river near Lisbon.\n# Costs\nThe costs of the bridge were reviewed by Anna Petrov in the spring.\n")
    (root / "beta.txt").write_text("Ferries cross the harbour every morning and every evening.\n\nThe Harbour Office sells the tickets for the ferries.\n")
    (root / "deep" / "gamma.py").write_text("def ferry_price():\n    return 'a price list of the ferries in euro'\n")
    (root / "deep" / "node_modules" / "skip.md").write_text("never read me, please, I am in a skipped folder")
    (root / "photo.png").write_bytes(b"\x89PNG")
    (root / "secret.txt").write_text("a private note that must be ignored entirely")
    (tmp_path / ".loamignore").write_text("# ignored\n\n*secret*\n")
    return tmp_path


def engine(spark, tree, **parts):
    config = C.parse_config(f'data_dir = "{tree}/data"\n[knowledge_bases.main]\nwatch_paths = ["notes"]\nauto_sync = true\n[embeddings]\nprovider = "offline"\ndimensions = 32\n', tree)
    return Engine(spark, config, **parts)


def test_life_cycle(spark, tree):
    e = engine(spark, tree)
    assert e.sync(dry_run=True).first().status == "dry run"
    first = e.sync().first()
    assert (first.new, first.updated, first.deleted) == (3, 0, 0) and first.vectors_embedded == first.chunks > 3
    assert e.sync().first().status == "up to date"
    got = e.search("harbuor ferries", engines=("fuzzy",)).collect()
    assert got[0].file == "main:beta.txt" and [r.to_word for r in e.corrections("harbuor ferries").collect()] == ["harbour"]
    assert "main:alpha.md" in [r.file for r in e.search("Petrov", engines=("graph",)).collect()]
    assert e.search("bridge costs").count() > 0 and e.search("bridge", doc_score=True).first().chunk_id is None
    assert e.search("TICKETS", exact=True).first().sources == ["fuzzy"]
    assert e.search("bridges, ferries", smart=True).count() > 0
    chunk = e.search("Authority", engines=("text",)).first()
    row = e.retrieve(chunk.chunk_id, 1, 1, 1, 1).first()
    assert row.path == "alpha.md" and len(row.chunks_after) == 1 and row.chunks_before == []
    (tree / "notes" / "beta.txt").write_text("Nothing about boats is left in this file, only words about trains.\n")
    (tree / "notes" / "alpha.md").unlink()
    (tree / "notes" / "delta.md").write_text("A new note about lighthouses and their keepers, long enough.\n")
    second = e.sync().first()
    assert (second.new, second.updated, second.deleted, second.unchanged) == (1, 1, 1, 1)
    assert e.search("Authority", engines=("text",)).count() == 0 and e.search("Petrov", engines=("graph",)).count() == 0
    status = e.status().first()
    assert (status.documents, status.chunks, status.vectors) == (3, 3, 3)
    assert e.list_kbs().first().last_sync is not None
    with pytest.raises(KeyError):
        e.search("x", kb="nope")


def test_resume_and_errors(spark, tree):
    class Flaky:
        def extract(self, content, path):
            if (tree / "broken").exists() and "Ferries" in content:
                raise RuntimeError("no reply")
            return {"entities": [{"name": path, "type": "tool", "description": None}], "relationships": []}

    e = engine(spark, tree, extractor=Flaky())
    (tree / "broken").touch()
    first = e.sync().first()
    assert (first.errors, first.entities_extracted, first.resumed) == (1, 2, 0) and e.status().first().extracted == 2
    again = e.sync().first()
    assert (again.resumed, again.errors, again.new, again.updated) == (1, 1, 0, 0)
    (tree / "broken").unlink()
    third = e.sync().first()
    assert (third.resumed, third.errors, third.entities_extracted) == (1, 0, 1) and e.status().first().extracted == 3
    assert e.sync().first().status == "up to date"
    assert "main:beta.txt" in [r.file for r in e.search("beta", engines=("graph",)).collect()]


def test_only_changed_partitions_are_written_and_a_crash_leaves_the_last_snapshot(spark, tree, monkeypatch):
    e = engine(spark, tree)
    e.sync()
    before = e.store.manifest()
    (tree / "notes" / "beta.txt").write_text("Trains, and nothing else, are what this file is about from now on.\n")
    real = e.store._publish
    steps = []

    def crash(manifest):
        steps.append(manifest)
        raise OSError("the disk is full")

    monkeypatch.setattr(e.store, "_publish", crash)
    with pytest.raises(OSError):
        e.sync()
    assert e.store.manifest() == before and e.search("ferries", engines=("text",)).count() > 0 and len(steps) == 1
    e.store._write_text(f"{e.store.folder}/manifests/halfway.tmp", '{"version": 99')  # what a crash before the rename leaves
    monkeypatch.setattr(e.store, "_publish", real)
    assert e.store.manifest() == before
    assert e.sync().first().updated == 1
    after = e.store.manifest()
    for name in ("documents", "chunks", "postings", "vectors"):
        parts = after["tables"][name]
        assert len(parts) == 3 and sum(before["tables"][name][p] != f for p, f in parts.items()) == 1, name
    assert e.search("trains", engines=("text",)).first().file == "main:beta.txt"
    found = e.search("ferries", engines=("text",)).collect()
    assert [r.file for r in found] == ["main:deep/gamma.py"]
    assert e.store._names(f"{e.store.folder}/manifests")[0] == f"{before['version']:012d}.json"


def test_fallback_to_documents(spark, tree):
    e = engine(spark, tree)
    e.sync()
    got = e.search("gamma", engines=("text",)).collect()
    assert [(r.file, r.chunk_id) for r in got] == [("main:deep/gamma.py", None)] and "ferry_price" in got[0].content


def test_lock(spark, tree):
    e = engine(spark, tree)
    assert e.store.lock() and not e.store.lock()
    with pytest.raises(RuntimeError):
        e.sync()
    e.store.unlock()
    for stale in ('{"host": "%s", "pid": 99999999}' % socket.gethostname(),):
        e.store._write_text(f"{e.store.folder}/LOCK", stale)
        assert e.store.lock()
        e.store.unlock()
    e.store._write_text(f"{e.store.folder}/LOCK", '{"host": "elsewhere", "pid": 1}')
    assert not e.store.lock()
    e.store.unlock()


def test_migration_of_an_older_store(spark, tree):
    e = engine(spark, tree)
    e.sync()
    old = e.store.manifest()
    e.store._publish(old | {"version": old["version"] + 1, "schema_version": 0})
    again = engine(spark, tree)
    assert again.store.manifest()["schema_version"] == 2 and again.status().first().extracted == 0
    assert again.sync().first().resumed == 3


def test_reembedding(spark, tree):
    e = engine(spark, tree)
    made = e.sync().first().vectors_embedded
    again = e.sync(reembed=True).first()
    assert (again.vectors_embedded, again.vectors_reembedded) == (made, made) and e.status().first().vectors == made
    other = engine(spark, tree, embedder=providers.HashingEmbedder(16))
    assert other.sync().first().vectors_embedded == made and {len(r.embedding) for r in other.store.read("vectors").collect()} == {16}


def test_remote_providers():
    asked = []

    def post(url, body, headers=None):
        asked.append((url, body, headers))
        if "batchEmbedContents" in url:
            return {"embeddings": [{"values": [1.0, 0.0]} for _ in body["requests"]]}
        if "embeddings" in url:
            return {"data": [{"index": 1, "embedding": [0.0, 1.0]}, {"index": 0, "embedding": [1.0, 0.0]}]}
        if "api/embed" in url:
            return {"embeddings": [[1.0, 0.0]]}
        if "generateContent" in url:
            return {"candidates": [{"content": {"parts": [{"text": '["a", "b"]'}]}}]}
        if "chat" in url:
            return {"choices": [{"message": {"content": '{"entities": [{"name": "A"}]}'}}]}
        return {"response": "no json"}

    model = lambda provider, name="m", key="k": C.Model(provider, name, 2, True, key)
    assert len(providers.RemoteEmbedder(model("gemini", "embedding-001"), post).embed(["x"] * 150, "code retrieval")) == 150
    assert [len(b["requests"]) for _, b, _ in asked] == [100, 50] and asked[0][1]["requests"][0]["taskType"] == "CODE_RETRIEVAL_QUERY" and asked[0][0].endswith("key=k")
    second = providers.RemoteEmbedder(model("gemini", "embedding-2"), post)
    assert second.query_input("search result", "q") == "task: search result | query: q"
    second.embed(["x"])
    assert "taskType" not in asked[-1][1]["requests"][0]
    assert providers.RemoteEmbedder(model("openai"), post).embed(["x", "y"]) == [[1.0, 0.0], [0.0, 1.0]] and asked[-1][2] == {"Authorization": "Bearer k"}
    assert providers.RemoteEmbedder(model("ollama", key=None), post).embed([None]) == [[1.0, 0.0]]
    assert providers.RemoteDecomposer(model("gemini"), post).decompose("t") == ["a", "b"]
    assert providers.RemoteExtractor(model("openai"), post).extract("c", "p")["entities"] == [{"name": "A"}]
    with pytest.raises(ValueError):
        providers.RemoteExtractor(model("ollama"), post).extract("c", "p")
    with pytest.raises(ValueError, match="unknown provider"):
        providers.make_embedder(model("nobody"))
    with pytest.raises(ValueError, match="api_key"):
        providers.make_extractor(model("openai", key=None))
    with pytest.raises(providers.ProviderError, match="dimensions"):
        providers.RemoteEmbedder(C.Model("ollama", "m", 3), post).embed(["x"])


def test_http():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = self.path.startswith("/bad")
            self.send_response(429 if bad else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"error": {"message": "slow down"}} if bad else {"got": body, "key": self.headers.get("Authorization")}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        assert providers.post_json(f"{base}/x", {"a": 1}, {"Authorization": "Bearer t"}) == {"got": {"a": 1}, "key": "Bearer t"}
        with pytest.raises(providers.ProviderError, match="429: slow down"):
            providers.post_json(f"{base}/bad?key=secret", {})
    finally:
        server.shutdown()


def test_watch_once(spark, tree):
    from loamdex.streaming.watch import watch

    e = engine(spark, tree)
    query = watch(e, interval=1)
    try:
        for _ in range(90):
            if e.store.current():
                break
            time.sleep(1)
    finally:
        query.stop()
    assert e.status().first().documents == 3


def test_server(spark, tree):
    e = engine(spark, tree)
    e.sync()
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "memory_search", "arguments": {"query": "ferries", "mode": "text"}}}, {"jsonrpc": "2.0", "id": 3, "method": "nope"}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "retrieve_chunk", "arguments": {}}}]
    sink = io.StringIO()
    serve(e, ["\n", *(json.dumps(x) + "\n" for x in asked), "{bad\n"], sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(got[0]["result"]["tools"]) == 5 and "beta.txt" in got[1]["result"]["content"][0]["text"]
    assert got[2]["error"]["code"] == -32603 and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32700


def test_command_line(spark, tree, capsys, monkeypatch):
    from loamdex import cli

    (tree / C.NAME).write_text('data_dir = "data"\n[knowledge_bases.main]\nwatch_paths = ["notes"]\nauto_sync = true\n[embeddings]\nprovider = "offline"\ndimensions = 16\n')

    def run(*argv):
        assert cli.main(["--config", str(tree / C.NAME), *argv]) == 0
        return capsys.readouterr().out

    assert "main: synced: 3 new" in run("sync") and json.loads(run("sync", "--json"))[0]["status"] == "up to date"
    assert "Corrected: harbuor -> harbour" in run("search", "harbuor ferries", "--fuzzy")
    got = json.loads(run("search", "bridges, ferries", "--smart", "--text", "--json"))
    assert got["smart_queries"] == ["bridges", "ferries"] and got["results"]
    assert run("search", "TICKETS", "--exact").startswith("main:beta.txt:3: The Harbour Office")
    chunk = json.loads(run("search", "Authority", "--text", "--json"))["results"][0]["chunk_id"]
    assert "main:alpha.md" in run("retrieve", str(chunk)) and run("retrieve", "1") == "No such chunk.\n"
    assert "documents  3 (" in run("status") and "[auto]" in run("list")
    assert run("watch", "--stop") == "not watching\n"


def test_views():
    from loamdex import views

    assert [views.format_size(x) for x in (0, 1023, 1024, 1536, 5 << 20, 3 << 30, 5000 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", "5000.0 GB"]
    assert views.tilde_path("/home/a/b", "/home/a") == "~/b" and views.tilde_path("/home/ab", "/home/a") == "/home/ab"
    assert views.sections({}) == "No results." and views.sections({"graph": [{"file": "f"}]}, ["a", "b"]) == "Searched for: a, b\n\n## Graph\n\n1. f"


def test_daemon(tmp_path):
    import sys

    from loamdex.streaming import daemon

    folder = str(tmp_path / "data")
    assert daemon.stop(folder) == "not watching"
    told = daemon.start(folder, ["import time; time.sleep(60)"], [sys.executable, "-c"])
    assert told.startswith("watching: process") and daemon.start(folder, []).startswith("already watching")
    assert daemon.stop(folder).startswith("stopped") and daemon.running(folder) is None
    (tmp_path / "data" / "watch.pid").write_text("99999999")
    assert daemon.running(folder) is None


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("LOAM_KEY", "s3")
    text = C.render_config({"a b": KnowledgeBase(["x", "/abs"], True, 'say "hi"')}) + '[extraction]\nprovider = "p"\nmodel = "m"\n[providers.p]\napi_key = "k-${LOAM_KEY}"\n'
    got = C.parse_config(text, tmp_path)
    assert got.knowledge_bases["a b"] == KnowledgeBase([f"{tmp_path}/x", "/abs"], True, 'say "hi"')
    assert got.extraction.api_key == "k-s3" and got.data_dir == f"{tmp_path}/.loamdex"
    (tmp_path / C.NAME).write_text(text)
    (tmp_path / "d").mkdir()
    assert C.find_config(tmp_path / "d") == tmp_path / C.NAME
    with pytest.raises(FileNotFoundError):
        C.load_config(str(tmp_path / "none.toml"))


def test_sources(spark, tree):
    assert sorted(r.path for r in files.read_watch_path(spark, str(tree / "notes"), ["*secret*"]).collect()) == ["alpha.md", "beta.txt", "deep/gamma.py"]
    assert [r.path for r in files.read_watch_path(spark, str(tree / "notes" / "photo.png")).collect()] == ["photo.png"]
    assert files.read_watch_path(spark, str(tree / "notes" / "*.txt")).count() == 2
    assert files.read_watch_path(spark, str(tree / "nothing")) is None
    paths = spark.createDataFrame([("a/x.log",), ("b/keep.md",), ("private/k.md",)], "path string")
    assert [r.path for r in paths.where(~files.ignored(paths.path, ["*.log", "private/"])).collect()] == ["b/keep.md"]


def test_providers(spark):
    assert providers.parse_queries('```json\n{"q": ["a", "b"]}\n```') == ["a", "b"] and providers.parse_queries("plain") == ["plain"]
    df = spark.createDataFrame([('```json\n{"entities": [{"name": "A"}], "relationships": []}\n```',), ("{broken",), ("",)], "r string")
    got = [r.x for r in df.select(providers.parse_extraction(df.r).alias("x")).collect()]
    assert [len(x.entities) for x in got] == [1, 0, 0] and [x.ok for x in got] == [True, False, False]
    assert providers.HashingEmbedder(8).embed(["a b"]) == providers.HashingEmbedder(8).embed(["b a"])


def test_registry():
    from loamdex.plans.registry import ORACLE, QUERIES

    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 55
