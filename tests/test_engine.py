"""A small tree, end to end: index, search, lookups, refresh, front ends."""

import io
import json
import os
import tarfile
import urllib.error
import urllib.request

import pytest

from lodestrata import cli
from lodestrata.answer import ModelUnavailable, ask, chat_model, messages_model, register_model
from lodestrata.engine import CodeIndex
from lodestrata.http_api import serve
from lodestrata.sources.index import IndexOptions, build_index, make_embedder
from lodestrata.sources.repos import RepoError, RepoMirror, read_archives
from lodestrata.sources.tree import discover
from lodestrata.streaming.refresh import current_chunks, start_refresh
from lodestrata.tools import AgentTools, serve_stdio

AUTH = '''from app.storage import load_user


def hash_password(raw):
    """Digest of a password."""
    return raw[::-1]


def authenticate(name, raw):
    """Check the login credentials of a user."""
    user = load_user(name)
    return user and user.password == hash_password(raw)


class Session:
    def open(self):
        return authenticate("a", "b")


class WebSession(Session):
    pass
'''
STORAGE = "ROWS = {}\n\n\ndef load_user(name):\n    return ROWS.get(name)\n"
BILLING = "import { fmt } from './fmt';\n\nexport function invoiceTotal(items) {\n  // total price of an invoice\n  return fmt(items);\n}\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "app").mkdir()
    (root / "generated").mkdir()
    (root / "node_modules").mkdir()
    for path, text in {"app/__init__.py": "", "app/auth.py": AUTH, "app/storage.py": STORAGE, "billing.js": BILLING, "fmt.js": "const fmt = (x) => x;\n", "generated/junk.py": "def junk(): pass\n", "node_modules/x.js": "x", ".gitignore": "generated/\n", ".conf.json": "{}", "logo.png": "x"}.items():
        (root / path).write_text(text)
    (root / "latin.md").write_bytes(b"caf\xe9 menu\n")
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree):
    stats = build_index(spark, tree)
    assert stats["files_indexed"] == 7 and stats["files_removed"] == 0
    return CodeIndex(spark, tree)


def test_discovery(tree):
    assert discover(tree) == [".conf.json", "app/__init__.py", "app/auth.py", "app/storage.py", "billing.js", "fmt.js", "latin.md"]
    assert discover(tree, exclude=["*.js"], include=["app"]) == ["app/__init__.py", "app/auth.py", "app/storage.py"]


def test_search(index):
    hits = index.search("login credentials of user", k=3)
    assert hits[0]["chunk"]["symbol"] == "authenticate" and hits[0]["sources"] == ["bm25", "dense"]
    assert {"relation": "callee", "symbol": "load_user", "file": "app/storage.py", "line": 4} in hits[0]["related"]
    assert [h["chunk"]["language"] for h in index.search("invoice total price", language="javascript")][0] == "javascript"
    assert all(h["chunk"]["kind"] == "class" for h in index.search("session", kind="class"))
    assert index.search("the of", k=2)  # the dense leg ranks everything
    assert index.search("the of", use_dense=False) == []


def test_lookups(index):
    assert [r.file_path for r in index.find_symbol("load_user").collect()] == ["app/storage.py"]
    assert [r.qualified_name for r in index.find_symbol("SESSION").collect()] == ["Session", "Session.open", "WebSession"]
    assert [r.symbol for r in index.callers("load_user").collect()] == ["authenticate"]
    impact = {r.name: (r.depth, r.via) for r in index.impact("hash_password").collect()}
    assert impact["authenticate"] == (1, "calls") and impact["Session.open"] == (2, "calls") and impact["WebSession"] == (3, "inherits")
    assert [r.name for r in index.outline("app/auth.py").collect()] == ["hash_password", "authenticate", "Session", "Session.open", "WebSession"]
    edges = {(r.src, r.dst) for r in index.table("edges").where("edge_type = 'imports'").collect()}
    assert edges == {("file:app/auth.py", "file:app/storage.py"), ("file:billing.js", "file:fmt.js")}
    assert index.stats()["embedder"] == "hashing-512"


def test_answers_and_models(index):
    assert "`authenticate`" in ask(index, "login credentials", k=2, provider="none")["answer"]
    with pytest.raises(ModelUnavailable):
        ask(index, "x", provider="missing")
    register_model("echo", lambda prompt: prompt[:9])
    assert ask(index, "login")["answer"] == "Question:"


def test_model_adapters():
    sent = []

    def post(url, headers, body):
        sent.append((url, headers, json.loads(body)))
        if "completions" in url:
            return 200, b'{"choices": [{"message": {"content": " yes [1] "}}]}'
        return 200, b'{"content": [{"type": "text", "text": "so"}, {"type": "image"}, {"type": "text", "text": " [2]"}]}'

    assert chat_model(post, "m", "http://here/v1/", "k")("why?") == "yes [1]" and messages_model(post, "m", "http://there", "k")("why?") == "so [2]"
    assert sent[0][0] == "http://here/v1/chat/completions" and sent[0][1]["Authorization"] == "Bearer k" and sent[0][2]["messages"][-1] == {"role": "user", "content": "why?"}
    assert sent[1][1]["x-api-key"] == "k" and sent[1][2]["system"]
    for reply in ((500, b""), (200, b"{}"), (200, b'{"content": [], "stop_reason": "refusal"}'), (200, b"no json")):
        with pytest.raises(ModelUnavailable):
            messages_model(lambda *a, reply=reply: reply, "m")("why?")


def test_http(index):
    server = serve(index, 0, background=True)
    base = f"http://127.0.0.1:{server.server_address[1]}"
    read = lambda path, data=None: json.load(urllib.request.urlopen(base + path, data))
    assert read("/api/search?q=login&k=1")["results"]
    assert read("/api/outline?file=app/auth.py")["outline"] and read("/api/stats")["chunks"] > 4
    assert read("/api/ask", b'{"question": "login", "provider": "none"}')["mode"] == "extractive"
    for path, data, status in (("/api/search", None, 400), ("/none", None, 404), ("/api/ask", b"{", 400), ("/api/ask", b'{"question": "x", "provider": "none such"}', 502)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path, data)
        assert e.value.code == status
    server.shutdown()


def test_refresh_parses_only_what_changed(spark, tmp_path):
    (tmp_path / "a.py").write_text("def one():\n    return 1\n")
    (tmp_path / "b.py").write_text("def two():\n    return one()\n")
    assert build_index(spark, str(tmp_path))["files_indexed"] == 2
    (tmp_path / "b.py").write_text("def three():\n    return one()\n")
    (tmp_path / "c.py").write_text("x = 1\n")
    os.remove(tmp_path / "a.py")
    stats = build_index(spark, str(tmp_path))
    assert (stats["files_indexed"], stats["files_skipped"], stats["files_removed"]) == (2, 0, 1)
    index = CodeIndex(spark, str(tmp_path))
    assert [r.name for r in index.table("symbols").collect()] == ["three"] and index.search("three")[0]["chunk"]["symbol"] == "three"
    assert build_index(spark, str(tmp_path))["files_skipped"] == 2
    index = CodeIndex(spark, str(tmp_path))
    assert index.search("three")[0]["chunk"]["symbol"] == "three" and sorted(r.ord for r in index.table("chunks").collect()) == [0, 1]


def test_missing_index_and_embedder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        CodeIndex(spark, str(tmp_path))
    with pytest.raises(ValueError):
        make_embedder("st:some-model")
    assert make_embedder("hashing-512")[0] == make_embedder(None)[0] == "hashing-512"


def test_empty_tree(spark, tmp_path):
    assert build_index(spark, str(tmp_path), options=IndexOptions())["chunks"] == 0
    assert CodeIndex(spark, str(tmp_path)).search("anything") == []


def test_tools_and_cli(spark, tree, index, capsys):
    tools = AgentTools(spark, tree)
    assert tools.call("find_callers", {"name": "load_user"})[0]["symbol"] == "authenticate"
    assert tools.call("search_code", {"query": "login", "k": 1}) and tools.call("index_stats", {})["symbols"] > 5
    with pytest.raises(ValueError):
        tools.call("_index", {})
    asked = [{"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "find_callers", "arguments": {"name": "load_user"}}}]
    asked += [{"id": 4, "method": "tools/call", "params": {"name": "find_callers", "arguments": {"nome": "x"}}}, {"id": 5, "method": "tools/call", "params": {"name": "call"}}, {"id": 6, "method": "none"}]
    replies = io.StringIO()
    serve_stdio(spark, tree, io.StringIO("".join(json.dumps({"jsonrpc": "2.0", **a}) + "\n" for a in asked) + "no json\n"), replies)
    got = [json.loads(line) for line in replies.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, None] and got[0]["result"]["capabilities"] == {"tools": {}}
    listed = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert len(listed) == 7 and listed["impact_analysis"] == {"type": "object", "properties": {"name": {"type": "string"}, "max_depth": {"type": "integer"}}, "required": ["name"]}
    assert json.loads(got[2]["result"]["content"][0]["text"])[0]["symbol"] == "authenticate" and not got[2]["result"]["isError"]
    assert got[3]["result"]["isError"] and [r["error"]["code"] for r in got[4:]] == [-32602, -32601, -32700]
    assert cli.build_parser().parse_args(["repos", "search", "x", "--k", "3"]).k == 3
    hits = index.search("login", k=1)
    cli.show_hits(hits, 2, False)
    assert "authenticate" in capsys.readouterr().out


def _archive(files):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for path, text in files.items():
            info = tarfile.TarInfo(path)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    return data.getvalue()


def test_repositories(spark, tmp_path):
    repos = [{"full_name": f"me/r{k}", "name": f"r{k}", "owner": {"login": "me"}, "pushed_at": "t1", "fork": k == 2, "size": k} for k in (1, 2, 3)]
    archive = _archive({"me-r1-abc/src/a.py": b"x = 1\n", "me-r1-abc/../evil.py": b"bad"})

    def fetcher(url, headers):
        if "/tarball/" in url:
            return (500, b"") if "/r3/" in url else (200, archive)
        return (200, json.dumps(repos if "page=1" in url else []).encode()) if "/users/me" in url else (404, b"")

    mirror = RepoMirror(spark, token=None, workspace=str(tmp_path / "w"), fetcher=fetcher)
    assert [r["full_name"] for r in mirror.list_repos("me")] == ["me/r1", "me/r3"]
    assert mirror.sync("me", include_forks=True) == {"synced": ["me/r1", "me/r2"], "skipped": [], "failed": ["me/r3"]}
    assert mirror.sync("me")["skipped"] == ["me/r1"] and os.path.exists(tmp_path / "w/me__r1/src/a.py") and not os.path.exists(tmp_path / "w/evil.py")
    with pytest.raises(RepoError):
        mirror.list_repos("nobody")
    files = read_archives(spark.createDataFrame([("me/r1", bytearray(archive))], "full_name string, data binary")).collect()
    assert [(f.file_path, bytes(f.content)) for f in files] == [("src/a.py", b"x = 1\n")]


def test_stream_refresh(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put = lambda name, *rows: (source / name).write_text("".join(json.dumps(dict(zip(("file_path", "language", "content", "version"), r))) + "\n" for r in rows))
    run = lambda: start_refresh(spark, str(source), target, str(tmp_path / "ck")).awaitTermination()
    put("1.json", ("a.py", "python", "def f():\n    pass\n", 1), ("b.py", "python", "def g():\n    pass\n", 1))
    run()
    put("2.json", ("a.py", "python", "def h():\n    pass\n", 2), ("b.py", "python", None, 2))
    run()
    assert [(r.file_path, r.symbol) for r in current_chunks(spark, target).collect()] == [("a.py", "h")]


def test_query_terms_reach_the_scan(spark, index, capsys):
    asked = spark.createDataFrame([("login",), ("user",)], "term string")
    index._only(index.table("postings"), "term", asked).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(term, [login,user])]" in plan or "PushedFilters: [In(term, [user,login])]" in plan
