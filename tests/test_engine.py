import io
import json

import pytest
from pyspark.sql import functions as F

from siltstone.__main__ import search_arguments
from siltstone.engine import Engine, NotIndexed
from siltstone.mcp import Server, read_message, write_message
from siltstone.sources.config import Config, from_environment, load, override
from siltstone.sources.embedders import Limits, embed_batch, ordered
from siltstone.sources.files import scan_files
from siltstone.sources.records import read_cases, read_memory
from siltstone.sources.store import from_columns, to_columns
from siltstone.streaming.sync import batch_writer, dedup_stream, keep_current, stream_documents


@pytest.fixture
def code(tmp_path):
    root = tmp_path / "code"
    (root / "sub").mkdir(parents=True)
    (root / "auth.go").write_text("package auth\n\nfunc AuthenticateUser(token string) bool {\n\treturn token != \"\"\n}\n")
    (root / "sub" / "other.go").write_text("package sub\n\nfunc Paint() {}\n")
    return root


def test_scan(spark, tmp_path):
    for p in ("keep/service.go", "main.go", "ignored-dir/x.go", "private/a/b.go", "generated/g.go", "a.tmp", ".hidden/h.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("package x")
    (tmp_path / ".gitignore").write_text("# c\nignored-dir/\n*.tmp\n!x\n")
    (tmp_path / ".contextignore").write_text("private/**\n")
    got = scan_files(spark, str(tmp_path), extensions=(".go", ".tmp"), names=(), patterns=("generated/**",))
    assert sorted(r["relative_path"] for r in got.collect()) == ["keep/service.go", "main.go"]


def test_index_search_sync_clear(spark, tmp_path, code):
    e = Engine(spark, str(tmp_path / "root"), Config(dim=32, limit=3))
    with pytest.raises(NotIndexed):
        e.sync(str(code))
    assert e.index(str(code))["full"] is True
    found = e.search(str(code), "authenticate user token", types="code")
    assert found["results"][0]["location"]["relative_path"] == "auth.go"
    (code / "auth.go").write_text("package auth\n\nfunc Renamed() {}\n")
    (code / "sub" / "other.go").unlink()
    (code / "new.go").write_text("package new\n")
    r = e.sync(str(code))[str(code)]
    assert (r["full"], r["added"], r["modified"], r["removed"], r["files"]) == (False, 1, 1, 1, 2)
    assert e.index(str(code))["modified"] == 0 and e.status(str(code))["status"] == "indexed"
    e.clear(str(code))
    assert e.status(str(code))["status"] == "not_indexed" and e.chunks.count(e.namespace(str(code))) == 0
    e._embed = lambda c, d: F.raise_error(F.lit("no embedding")).cast("array<float>")
    with pytest.raises(Exception):
        e.index(str(code))
    assert e.status(str(code))["status"] == "failed"


def test_only_files_of_another_size_or_time_are_read(spark, tmp_path, code):
    import os

    (code / "od[d]{x}.go").write_text("package odd\n")
    e = Engine(spark, f"file:{tmp_path}/root", Config(dim=32))
    assert e.root == f"file:{tmp_path}/root" and e.index(str(code))["files"] == 3
    seen = os.stat(code / "auth.go")
    text = (code / "auth.go").read_text()
    (code / "auth.go").write_text(text.replace("token", "tokem"))
    os.utime(code / "auth.go", ns=(seen.st_atime_ns, seen.st_mtime_ns))  # same size and time: not read
    (code / "sub" / "other.go").write_text("package sub\n\nfunc Paint() {}\n")
    os.utime(code / "sub" / "other.go", ns=(1, seen.st_mtime_ns + 10**10))  # another time: read, same bytes
    (code / "od[d]{x}.go").write_text("package even\n")
    r = e.index(str(code))
    assert (r["full"], r["added"], r["modified"], r["removed"], r["touched"], r["unchanged"]) == (False, 0, 1, 0, 1, 1)
    rows = {x["relative_path"]: x["content"] for x in e.chunks.read().collect()}
    assert "even" in rows["od[d]{x}.go"] and "tokem" not in rows["auth.go"]


def test_states_without_size_and_time_are_filled(spark, tmp_path, code):
    e = Engine(spark, str(tmp_path / "root"), Config(dim=32))
    e.index(str(code))
    n = e.namespace(str(code))
    old = spark.createDataFrame([tuple(r) for r in e.states.read(n).withColumns({"size": F.lit(None).cast("bigint"), "mod_time_ns": F.lit(None).cast("bigint")}).collect()], "relative_path string, hash string, size bigint, mod_time_ns bigint")
    e.states.write(n, old)
    r = e.index(str(code))
    assert (r["full"], r["added"], r["modified"], r["removed"]) == (False, 0, 0, 0)
    assert all(x["size"] and x["mod_time_ns"] for x in e.states.read(n).collect())


def test_replacing_a_file_leaves_other_parts_alone(spark, tmp_path, code):
    for i in range(20):
        (code / f"f{i}.go").write_text(f"package f{i}\n")
    e = Engine(spark, str(tmp_path / "root"), Config(dim=32))
    e.index(str(code))
    at = tmp_path / "root" / "chunks" / f"namespace={e.namespace(str(code))}"
    names = lambda: {p.name: sorted(f.name for f in p.glob("part-*")) for p in at.iterdir()}
    before = names()
    (code / "f3.go").unlink()
    assert e.index(str(code))["removed"] == 1
    after = names()
    assert len(before) > 3 and sum(before[k] != after.get(k) for k in before) == 1 and e.chunks.read().where("relative_path = 'f3.go'").count() == 0


def test_an_empty_import_replaces_what_was_there(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"), Config(dim=32))
    m = tmp_path / "m.jsonl"
    m.write_text('{"id":"1","content":"the index was slow"}\n{"id":"2","content":"the index is fast"}\n')
    n = e.import_memory(str(m), "conversation")
    assert e.chunks.count(n) == 2 and e.search(None, "index", types="conversation")["result_count"] == 2
    m.write_text("")
    assert e.import_memory(str(m), "conversation") == n and e.chunks.count(n) == 0
    assert e.sources().first()["memory_count"] == 0 and e.search(None, "index", types="conversation")["result_count"] == 0


def test_texts_and_queries_come_from_one_embedder(spark, tmp_path, code):
    from siltstone.sources.embedders import embedder

    def client():  # two numbers: does the text say "Paint"
        return lambda texts: [(i, [1.0, 0.0] if "paint" in t.lower() else [0.0, 1.0]) for i, t in enumerate(texts)]

    root = str(tmp_path / "root")
    e = Engine(spark, root, Config(limit=1), embed=embedder(client), model="paint-2")
    e.index(str(code))
    assert e._query_vectors(["paint", "x"]) == [[1.0, 0.0], [0.0, 1.0]]
    assert e.search(str(code), "paint", types="code")["results"][0]["location"]["relative_path"] == "sub/other.go"
    with pytest.raises(ValueError, match="paint-2"):
        Engine(spark, root, Config(dim=32)).index(str(code))
    with pytest.raises(ValueError, match="key"):
        Engine(spark, root, Config(provider="openai", base_url="http://localhost:1", model="m"))
    with pytest.raises(ValueError, match="unsupported"):
        Engine(spark, root, Config(provider="other"))


def test_checksums_tell_repeated_rows(spark):
    from siltstone.operators.indexing import source_checksum

    one = spark.createDataFrame([("a", "p", "x")], "id string, relative_path string, content string")
    sums = [source_checksum(d, []).first()["checksum"] for d in (one, one.union(one), one.union(one).union(one), one.limit(0))]
    assert len(set(sums)) == 4


def test_imports_and_sessions(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"), Config(dim=32, limit=5))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "guide.md").write_text("# Guide\n> Short\n\n## Usage\nsearch the index\n")
    e.import_knowledge(str(docs))
    (tmp_path / "m.jsonl").write_text('{"id":"1","content":"the index was slow","role":"user","tags":["a","b"]}\n\n{"content":"we sped up search"}\n')
    e.import_memory(str(tmp_path / "m.jsonl"), "chat")
    assert e.sources(source_type="conversation").count() == 1 and e.sources().count() == 2
    s = e.new_session()
    first = e.search(None, "search index", types="doc", session=s)
    again = e.search(None, "search index", types="doc", session=s)
    assert first["result_count"] > 0 and again["result_count"] < first["result_count"] + 1 and again["deduped_count"] >= first["result_count"]
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "c1", "query": "search index", "expected": [{"relative_path": "guide.md"}]}]))
    cases, summary = e.evaluate(None, str(tmp_path / "cases.json"), types="knowledge")
    assert cases.first()["matched"] and summary.first()["hit_rate"] == 1.0
    assert e.clear_sources(source_type="conversation") == 1 and e.sources().count() == 1


def test_record_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"content":"x","tags":["go"]}]')
    (tmp_path / "bad.jsonl").write_text('{"content":" "}\n')
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "w.json").write_text('{"instances":[{"instance_id":"i","problem_statement":"p","patch":"--- a/x.py"}]}')
    assert read_memory(spark, str(tmp_path / "a.json")).first()["tags"] == ["go"] and read_memory(spark, str(tmp_path / "empty.jsonl")).count() == 0
    with pytest.raises(Exception):
        read_memory(spark, str(tmp_path / "bad.jsonl")).collect()
    assert read_cases(spark, str(tmp_path / "w.json")).first()["instance_id"] == "i"
    with pytest.raises(ValueError):
        read_cases(spark, str(tmp_path / "empty.jsonl"))


def test_columns_round_trip(spark):
    rows = spark.createDataFrame([("a", {"symbol_name": "f", "tags": "x", "version": ""})], "id string, metadata map<string,string>")
    assert from_columns(to_columns(rows)).first()["metadata"] == {"symbol_name": "f", "tags": "x"}


def test_mcp(spark, tmp_path, code):
    server, buffer = Server(Engine(spark, str(tmp_path / "root"), Config(dim=32))), io.BytesIO()
    calls = [{"id": 1, "method": "initialize"}, {"method": "note"}, {"id": 2, "method": "tools/call", "params": {"name": "index_codebase", "arguments": {"path": str(code)}}}, {"id": 3, "method": "tools/call", "params": {"name": "search_code", "arguments": {"path": str(code), "query": "authenticate user token", "limit": 3}}}, {"id": 4, "method": "tools/call", "params": {"name": "search_code", "arguments": {"bad": 1}}}, {"id": 5, "method": "x"}]
    for c in calls:
        write_message(buffer, {"jsonrpc": "2.0"} | c)
    buffer.seek(0)
    out = io.BytesIO()
    server.serve(buffer, out)
    out.seek(0)
    answers = [read_message(out) for _ in range(5)]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5]
    assert json.loads(answers[2]["result"]["content"][0]["text"])[0]["relative_path"] == "auth.go"
    assert answers[3]["error"]["code"] == -32602 and answers[4]["error"]["code"] == -32601


def test_embedding_client():
    seen, failures = [], []

    def client(texts):
        seen.append(texts)
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    assert [v[0] for v in embed_batch(client, ["a", "bb", "ccc", "dddd", "eeeee"], Limits(batch=2))] == [1, 2, 3, 4, 5] and len(seen) == 3

    def broken(texts):
        failures.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        embed_batch(broken, ["a"], sleep=lambda s: None)
    assert len(failures) == 4
    for bad in ([(0, [1.0]), (0, [1.0])], [(0, [1.0])], [(0, []), (1, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(5, [1.0])]):
        with pytest.raises(ValueError):
            ordered(bad, 2)


def test_config(tmp_path):
    env = {"SILTSTONE_SEARCH_CODE_SEMANTIC_WEIGHT": "0.2", "SILTSTONE_SEARCH_CODE_KEYWORD_WEIGHT": "0.8", "SILTSTONE_DIM": "-3", "SILTSTONE_LIMIT": "5"}
    c = from_environment(Config(), env)
    assert c.weights["code"] == (0.2, 0.8) and c.dim == 1024 and c.limit == 5
    w = override(Config(), {"weights": {"fact": {"semantic": 2, "keyword": 1}}}).weights["fact"]
    assert w == pytest.approx((2 / 3, 1 / 3))
    (tmp_path / "c.yaml").write_text("dim: 64\nmax_lines: 10\n")
    c = load(str(tmp_path / "c.yaml"), {})
    assert c.dim == 64 and c.max_lines == 10 and c.overlap < 10
    assert search_arguments(["5", "code,fact", "s"]) == (5, "code,fact", "s") and search_arguments(["mysession"]) == (None, None, "mysession")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    q = keep_current(stream_documents(spark, str(tmp_path / "in"), "k int, v string"), batch_writer(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    rows = [("s", 1, "k1", "h1"), ("s", 2, "k1", "h1"), ("s", 3, "k2", "h2"), ("t", 1, "k1", "h1")]
    schema = "session_id string, rank int, result_key string, content_hash string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "hits"))
    q = dedup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "hits")), 10).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert {(r["session_id"], r["rank"]) for r in spark.sql("select * from deduped").collect()} == {("s", 1), ("s", 3), ("t", 1)}


def test_the_limit_holds_for_a_response_in_many_frames(spark, tmp_path):
    schema = "session_id string, response_id int, rank int, result_key string, content_hash string"
    rows = [("s", r, i, f"k{r}-{i}", f"h{r}-{i}") for r in (1, 2) for i in range(500)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "hits"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        q = dedup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "hits")), 7).writeStream.format("memory").queryName("framed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["result_key"] for r in spark.sql("select * from framed").collect()) == sorted(f"k{r}-{i}" for r in (1, 2) for i in range(7))


def folder_client_maker():
    class FolderClient:
        """A store of JSON lines in a folder, so that workers and driver see the same; filters are read as Python."""

        def __init__(self, at):
            self.at = at

        def _meta(self):
            return self.at / "meta.json"

        def describe(self):
            return tuple(json.loads(self._meta().read_text())) if self._meta().exists() else None

        def create(self, dim, fields):
            self._meta().write_text(json.dumps([dim, fields]))

        def insert(self, columns):
            import uuid

            rows = [dict(zip(columns, v)) for v in zip(*columns.values())]
            (self.at / f"{uuid.uuid4().hex}.rows").write_text("\n".join(json.dumps(r) for r in rows))

        def _rows(self):
            return [(p, json.loads(x)) for p in self.at.glob("*.rows") for x in p.read_text().splitlines()]

        def delete(self, expression):
            rows = self._rows()
            for p in {p for p, _ in rows}:
                p.unlink()
            kept = [r for _, r in rows if not eval(expression, {}, r)]
            if kept:
                self.insert({k: [r[k] for r in kept] for k in kept[0]})

        def search(self, vector, limit, expression, fields):
            import math

            norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
            rows = [r for _, r in self._rows() if eval(expression, {}, r)]
            scored = sorted(((sum(a * b for a, b in zip(vector, r["vector"])) / norm(vector) / norm(r["vector"]), r) for r in rows), key=lambda x: (-x[0], x[1]["id"]))[:limit]
            return [s for s, _ in scored], {f: [r[f] for _, r in scored] for f in fields}

        def count(self, expression):
            return sum(bool(eval(expression, {}, r)) for _, r in self._rows())

    return FolderClient  # a class of a function, so that workers get it by value


def test_remote_store(spark, tmp_path, code):
    from siltstone.functions.vectors import embed_query
    from siltstone.operators.search import SearchOptions, remote_search
    from siltstone.sources.remote import RemoteStore, batch_rows, open_store

    e = Engine(spark, str(tmp_path / "root"), Config(dim=16))
    e.index(str(code))
    n, at = e.namespace(str(code)), tmp_path / "store"
    at.mkdir()
    make = folder_client_maker()
    store = open_store(spark, "", "remote", make_client=lambda: make(at))
    assert isinstance(store, RemoteStore) and store.count(n) == 0
    rows = e.chunks.read([n])
    store.put(rows, n)
    store.put(rows, n)  # replaces itself
    assert store.count(n) == rows.count() == e.chunks.count(n)
    options, vector = SearchOptions(query="authenticate user", limit=2, semantic=0.5, keyword=0.5), embed_query("authenticate user", 16)
    same = lambda d: [(r["id"], round(r["score"], 5)) for r in d.collect()]
    assert same(store.search(n, vector, options)) == same(remote_search(from_columns(to_columns(rows)), n, vector, options))  # entries without a column are lost
    store.replace_files(n, rows.where("relative_path = 'auth.go'"), rows.limit(0))
    assert store.count(n) == rows.where("relative_path <> 'auth.go'").count()
    store.clear(n)
    assert store.count(n) == 0
    with pytest.raises(ValueError, match="16"):
        store.put(rows.withColumn("vector", F.array(F.lit(1.0))), n)
    with pytest.raises(ValueError, match="length"):
        store.put(rows.withColumn("vector", F.array().cast("array<float>")), n)
    with pytest.raises(ValueError, match="2 scores"):
        batch_rows([1.0, 0.5], {"id": ["a"]}, ("id",))
    with pytest.raises(ValueError):
        open_store(spark, "", "other")


def test_own_signals_profiles_and_parsers(spark):
    from siltstone.operators import domain, markdown

    own = lambda t: F.array(F.struct(F.lit("mine").alias("source"), F.lit("a/b").alias("domain"), F.when(t.contains("x"), 0.9).otherwise(0.0).alias("score")))
    rows = spark.createDataFrame([("x y",), ("kangaroo care",)], "t string")
    got = [r["d"] for r in rows.select(domain.resolve(F.col("t"), signals=[own])["domain"].alias("d")).collect()]
    assert got == ["a/b", ""]
    table = spark.createDataFrame([("zoo/pouch", "kangaroo care", ["kangaroo", "care"], None)], "domain string, description string, aliases array<string>, examples array<string>")
    profiles = domain.profiles_of(table)
    assert [r["n"] for r in rows.select(F.size(domain.profile_signal(F.col("t"), profiles)).alias("n")).collect()] == [0, 1]
    with pytest.raises(ValueError):
        domain.profiles_of(table.union(table), 1)
    files = spark.createDataFrame([("a.md", ".md", "# T\nx"), ("b.txt", ".txt", "plain")], "relative_path string, extension string, content string")
    whole = lambda f: markdown.parse_markdown(f)
    assert {r["relative_path"] for r in markdown.parse_documents(files).collect()} == {"a.md"}
    assert {r["relative_path"] for r in markdown.parse_documents(files, markdown.PARSERS | {".txt": whole}).collect()} == {"a.md", "b.txt"}
