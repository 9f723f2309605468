import io
import json
import random
import urllib.error
import urllib.request
from threading import Event, Thread

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.functions.markdown import parse_notes
from lodestone.operators.providers import ChatContext, HashEmbedder, PlainRerank
from lodestone.operators.retrieval import corpus_stats, fuse, search_knowledge
from lodestone.server import http_server, serve_lines
from lodestone.service import Service
from lodestone.sources import store
from lodestone.sources.files import Config, load_config, load_gold, load_span_gold
from lodestone.sources.store import VaultIndex
from lodestone.sources.vault import scan_vault
from lodestone.streaming.watch import watch_changes, watch_vault


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    for name, text in (("a.md", "# Violin\nstrings and bow\n## More\nzyxw"), ("b.md", "# Cello\nlow strings"), ("e.md", " \n")):
        (root / name).write_text(text)
    return root


def test_incremental_index(spark, vault, tmp_path):
    index = VaultIndex(spark, str(tmp_path / "index"))
    scan = lambda: scan_vault(spark, str(vault))
    assert index.stats()["notes"] == 0 and index.fingerprint() == ""
    s = index.reindex(scan())
    assert (s["notes"], s["chunks"]) == (2, 3)
    first = index.pointer()["segments"]
    (vault / "e.md").unlink()
    assert index.reindex(scan())["chunks"] == 3 and index.pointer()["segments"] == first
    (vault / "b.md").write_text("# Cello\nchanged\n## New\nx")
    assert [r.path for r in index.diff(scan()).where("changed").collect()] == ["b.md"]
    assert index.reindex(scan())["chunks"] == 4
    (vault / "a.md").unlink()
    assert index.reindex(scan())["notes"] == 1
    (vault / "b.md").write_text("")
    assert index.reindex(scan())["notes"] == 0
    (vault / "b.md").write_text("# B\ny")
    index.reindex(scan())
    other = VaultIndex(spark, str(tmp_path / "index"), HashEmbedder(16))
    assert other.diff(scan()).where("changed").count() == 1
    assert len(other.reindex(scan()) and other.chunks().first().embedding) == 16
    other.upsert(other.notes(), other.chunks())
    assert other.stats()["chunks"] == 1 and other.postings().where("term = 'y'").count() == 1
    other.delete(["b.md"])
    assert other.stats()["notes"] == 0 and other.postings().count() == 0


def test_segments_equal_one_index_and_are_merged(spark, vault, tmp_path, monkeypatch):
    """After every change, the live rows and sums are those of an index that is made afresh; old segments stay small in number."""
    index, rng = VaultIndex(spark, str(tmp_path / "many")), random.Random(5)
    monkeypatch.setattr(store, "MOST_SEGMENTS", 3)
    for step in range(6):
        for name in "abcd":
            if rng.random() < 0.5:
                (vault / f"{name}.md").write_text(f"# {name}\nword{step} " + "tone " * rng.randint(0, 4) if rng.random() < 0.8 else "")
            elif rng.random() < 0.3:
                (vault / f"{name}.md").unlink(missing_ok=True)
        told = index.reindex(scan_vault(spark, str(vault)))
        assert len(index.pointer()["segments"]) <= 3
        one = VaultIndex(spark, str(tmp_path / f"one{step}"))
        want = one.reindex(scan_vault(spark, str(vault)))
        assert (told["notes"], told["chunks"]) == (want["notes"], want["chunks"])
        for name in ("notes", "chunks", "postings"):
            rows = lambda x, name=name: sorted(map(str, (r.asDict() | {"mtime": 0} for r in x.table(name).collect())))
            assert rows(index) == rows(one), (step, name)
        assert index.corpus_stats().collect() == corpus_stats(index.chunks()).collect() or not want["chunks"]


def test_a_note_is_told_to_the_chat_once(spark, vault, tmp_path):
    class Counting:
        def __init__(self, path):
            self.path = path

        def complete(self, system, user):
            with open(self.path, "a") as f:
                f.write("x")
            return "about it"

    index = VaultIndex(spark, str(tmp_path / "once"), contextualizer=ChatContext(Counting(str(tmp_path / "calls")), "m"))
    index.reindex(scan_vault(spark, str(vault)))
    assert (tmp_path / "calls").read_text() == "x" * 3


def test_context_makes_a_note_findable(spark, vault, tmp_path):
    class Echo:  # local, so that it travels to the workers by value
        def complete(self, system, user):
            if "fails" in user:
                raise RuntimeError("down")
            return "about " + user.split("\n")[0]

    (vault / "f.md").write_text("fails here")
    index = VaultIndex(spark, str(tmp_path / "i"), contextualizer=ChatContext(Echo(), "m"))
    index.reindex(scan_vault(spark, str(vault)))
    rows = {(r.note_path, r.ordinal): r for r in index.chunks().collect()}
    assert rows["a.md", 1].embedding_text == "about Violin\n\n## More\nzyxw" and rows["f.md", 0].context_blurb is None
    assert index.postings().where("term = 'violin'").count() == 2 and "llm:m" in index.fingerprint()


def test_service_and_command_line(spark, vault, tmp_path, capsys):
    service = Service(spark, Config(str(vault), index_path=str(tmp_path / "s"), rerank=False))
    assert service.reindex()["notes"] == 2
    got = service.search_knowledge("zyxw", 1)["results"][0]
    assert (got["note_path"], got["heading_path"]) == ("a.md", ["Violin", "More"])
    assert service.search_sources("strings", 5)["sources"][0]["hit_count"] >= 1
    assert {x["note_path"] for x in service.search_knowledge("strings", 5, paths=["b*"])["results"]} == {"b.md"} and service.search_sources("strings", tags=["none"]) == {"sources": []}
    assert service.get_note("a.md")["title"] == "Violin" and service.get_note("no") == {"found": False}
    out = io.StringIO()
    ask = lambda n, method, **params: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    lines = [ask(1, "initialize", protocolVersion="2025-03-26"), '{"jsonrpc": "2.0", "method": "notifications/initialized"}', ask(2, "tools/list"), ask(3, "tools/call", name="status"), "bad", ask(4, "tools/call", name="drop")]
    serve_lines(service, [*lines, ask(5, "odd"), ask(6, "tools/call", name="get_note", arguments={"path": 1, "x": 2}), ask(7, "tools/call", name="search_sources", arguments={"query": "strings", "k": "many"}), "[]"], out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines()) if r["id"]}
    assert got[1]["result"]["protocolVersion"] == "2025-03-26" and [t["name"] for t in got[2]["result"]["tools"]] == ["status", "reindex", "search_knowledge", "search_sources", "get_note"]
    assert got[3]["result"]["structuredContent"]["notes"] == 2 and not got[3]["result"]["isError"] and got[7]["result"]["isError"]
    assert [got[k]["error"]["code"] for k in (4, 5, 6)] == [-32602, -32601, -32602] and len(out.getvalue().splitlines()) == 9
    server = http_server(service, port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        post = lambda path, text: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", text.encode(), timeout=60)
        assert json.loads(post("/mcp", ask(8, "ping")).read()) == {"jsonrpc": "2.0", "id": 8, "result": {}} and post("/mcp", lines[1]).status == 202
        with pytest.raises(urllib.error.HTTPError):
            post("/other", lines[0])
    finally:
        server.shutdown()
        server.server_close()
    toml = tmp_path / "c.toml"
    toml.write_text(f'[vault]\npath = "{vault}"\n[index]\npath = "{tmp_path}/s"\n')
    models = tmp_path / "m.toml"
    models.write_text(f'[vault]\npath = "{vault}"\n[embedding]\nprovider = "http"\ndimension = 3\nbase_url = "http://x"\nmodel = "e"\n[rerank]\nprovider = "no_such:thing"\n')
    other = Service(spark, load_config(str(models)))
    assert other.index.config_fingerprint.startswith("http:e:3|") and isinstance(other.reranker, PlainRerank)
    assert load_config(str(toml)).pool == 100 and main(["nothing"]) == 2
    assert main(["status", str(toml)]) == 0 and '"notes": 2' in capsys.readouterr().out


def test_own_parser_chunker_and_fuser(spark, vault, tmp_path):
    upper = lambda files: parse_notes(files.withColumn("raw", F.upper("raw")))
    one = lambda notes, most: notes.select(F.col("path").alias("note_path"), F.lit(0).alias("ordinal"), F.array().cast("array<string>").alias("heading_path"), F.col("body").alias("text"), F.lit(most).alias("token_count"))
    index = VaultIndex(spark, str(tmp_path / "own"), max_tokens=9, parser=upper, chunker=one)
    index.reindex(scan_vault(spark, str(vault)))
    rows = {r.note_path: r for r in index.chunks().collect()}
    assert len(rows) == 3 and rows["a.md"].text.startswith("# VIOLIN") and rows["a.md"].token_count == 9
    seen = []
    fuser = lambda near, matched, k: seen.append(k) or fuse(near, matched, k)
    asked = spark.createDataFrame([(0, "cello")], "query_id long, text string")
    got = search_knowledge(index.chunks(), index.postings(), index.corpus_stats(), asked, index.embedder, 1, pool=7, fuser=fuser).first()
    assert got.note_path == "b.md" and seen == [7]


def test_watch(spark, vault, tmp_path):
    index = VaultIndex(spark, str(tmp_path / "w"))
    ticks = tmp_path / "ticks"
    ticks.mkdir()
    stream = spark.readStream.schema("value string").text(str(ticks))
    q = watch_vault(spark, index, str(vault), str(tmp_path / "cp"), interval="0 seconds", ticks=stream)
    try:
        (vault / "b.md").unlink()
        (ticks / "t1.txt").write_text("go")
        q.processAllAvailable()
        assert index.stats()["notes"] == 1
    finally:
        q.stop()
    stop, seen = Event(), []
    assert watch_changes(lambda: seen.append(1), [{1}, {2}], stop) == 3
    stop.set()
    assert watch_changes(lambda: seen.append(1), [{1}], stop) == 1


def test_gold_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"query": "q", "query_lang": "en", "expected": ["a.md"], "scenario": "same"}]')
    assert load_gold(spark, str(tmp_path / "g.json")).first().expected == ["a.md"]
    (tmp_path / "w.json").write_text('[{"query": "q", "query_lang": "en", "type": "buried", "scenario": "s", "expected_notes": ["a"], "answer_spans": [{"note": "a", "text": "t"}]}]')
    assert load_span_gold(spark, str(tmp_path / "w.json")).first().answer_spans[0].text == "t"
