import json

import pytest
from pyspark.sql import functions as F

from helpers import ts, values
from talkmill.schema import empty_table
from talkmill.sources.files import Adapter, default_adapters, read_files, route_files
from talkmill.sources.generic import read_generic
from talkmill.sources.imports import import_batch_summary, import_files, warnings_by_batch
from talkmill.sources.store import TableStore


def node(key, text=None, parent=None, children=(), role="user", parts=None, **message):
    out = {"id": key, "children": list(children)}
    if parent:
        out["parent"] = parent
    if text is not None or parts is not None:
        body = parts if parts is not None else [text]
        out["message"] = {
            "id": "m" + key, "author": {"role": role}, "content": {"content_type": "text", "parts": body}, **message,
        }
    return out


def conversation(*nodes, **fields):
    return {"mapping": {n["id"]: n for n in nodes}, **fields}


def run(spark, *files, **kwargs):
    df = spark.createDataFrame([(n, c if isinstance(c, str) else json.dumps(c)) for n, c in files], "file_name string, content string")
    sources = kwargs.get("sources", empty_table(spark, "sources"))
    batches = kwargs.get("batches", empty_table(spark, "import_batches"))
    return import_files(df, sources, batches, ts("2024-01-01 00:00:00"), kwargs.get("adapters"))


def texts(result):
    return [r["content_text"] for r in result.messages.orderBy("session_id", "sort_order").collect()]


def orders(result):
    return [r["sort_order"] for r in result.messages.orderBy("session_id", "sort_order").collect()]


def codes(result):
    return values(result.warnings, "code")


def test_branches_are_walked_depth_first_and_empty_messages_leave_gaps(spark):
    conv = conversation(
        node("r", children=["a", "d"]), node("a", "one", "r", ["b", "c"]), node("b", "", "a"), node("c", "three", "a"),
        node("d", "four", "r"), title="T", conversation_id="x1", create_time=1704067200.5, update_time=None,
    )
    result = run(spark, ("e/a.json", [conv]))
    assert texts(result) == ["one", "three", "four"]
    assert orders(result) == [0, 2, 3]
    session = result.sessions.collect()[0]
    assert (session["title"], session["external_id"], session["ended_at"]) == ("T", "x1", None)
    assert session["started_at"].isoformat() == "2024-01-01T00:00:00.500000"


def test_two_roots_shared_child_and_cycle(spark):
    conv = conversation(
        node("a", "a", None, ["s", "c1"]), node("b", "b", "missing", ["s"]), node("s", "s", "a"),
        node("c1", "c1", "a", ["c2"]), node("c2", "c2", "c1", ["c1"]),
    )
    result = run(spark, ("e/a.json", [conv]))
    assert texts(result) == ["a", "s", "c1", "c2", "b"]
    assert values(result.sessions, "title") == [("Untitled",)]


def test_cycle_without_root_warns_twice(spark):
    result = run(spark, ("e/a.json", [conversation(node("a", "a", "b", ["b"]), node("b", "b", "a", ["a"]))]))
    assert codes(result) == [("CHATGPT_EMPTY_CONVERSATION",), ("CHATGPT_NO_ROOT_NODE",)]
    assert texts(result) == []


def test_foreign_role_rejects_the_whole_conversation_only(spark):
    bad = conversation(node("a", "ok", None, ["b"]), node("b", "no", "a", role="critic"))
    good = conversation(node("a", "fine"), title="")
    result = run(spark, ("e/a.json", [bad, good]))
    assert texts(result) == ["fine"]
    assert values(result.sessions.fillna("null"), "title") == [("null",)]
    assert codes(result) == [("CHATGPT_CONVERSATION_PARSE_ERROR",)]


@pytest.mark.parametrize("fields", [{"title": None}, {"title": 3}, {"create_time": "x"}, {"id": None}, {"mapping": []}])
def test_wrong_types_are_rejected(spark, fields):
    result = run(spark, ("e/a.json", [{**conversation(node("a", "x")), **fields}]))
    assert codes(result) == [("CHATGPT_CONVERSATION_PARSE_ERROR",)]


def test_only_text_parts_are_joined(spark):
    conv = conversation(node("a", parts=["x", {"y": 1}, 3, None, " z "], create_time=0))
    result = run(spark, ("e/a.json", [conv]))
    assert texts(result) == ["x\n z"]
    assert result.messages.collect()[0]["timestamp"] is None


def test_code_blocks_become_artifacts(spark):
    body = "see\n```python\nprint(1)\n```\nand\n```\nplain\n```"
    result = run(spark, ("e/a.json", [conversation(node("a", body))]))
    assert values(result.artifacts, "title", "mime_type", "content_text") == [
        ("Code (python)", "text/x-python", "print(1)"), ("Code block", "text/plain", "plain"),
    ]


def test_deep_chain_needs_no_recursion(spark):
    n = 3000
    nodes = [node(str(i), f"t{i}", str(i - 1) if i else None, [str(i + 1)] if i < n - 1 else []) for i in range(n)]
    result = run(spark, ("e/a.json", [conversation(*nodes)]))
    assert orders(result) == list(range(n))


def test_generic_layouts(spark):
    flat = [{"role": "user", "content": "a", "timestamp": "2024-01-01T00:00:00Z"}, {"content": "b"}]
    wrapped = {"title": None, "messages": [{"role": "tool", "content": ""}]}
    result = run(spark, ("e/flat.json", flat), ("e/one.json", wrapped), ("e/many.json", [{"title": "", "messages": flat}, {"messages": []}, {"x": 1}]))
    assert values(result.sessions, "title") == [("",), ("Import conversation 1",), ("Import conversation 1",)]
    assert values(result.messages, "role", "content_text") == [
        ("tool", ""), ("user", "a"), ("user", "a"), ("user", "b"), ("user", "b"),
    ]
    assert codes(result) == [("GENERIC_CONVERSATION_PARSE_ERROR",), ("GENERIC_EMPTY_CONVERSATION",)]
    modes = values(result.sessions.select(F.col("metadata.mode").alias("m")), "m")
    assert modes == [("json_array",), ("json_wrapped",), ("json_wrapped",)]


def test_markdown_edges(spark):
    body = "pre\n## user\r\nhi\r\n## Assistant\n## System\n\n## TOOL  \nx\n\ny\n## User"
    result = run(spark, ("n/a.md", body), ("n/b.txt", "## User\n"), ("n/c.markdown", "##  Userx\n"))
    first = [r for r in result.messages.collect() if r["content_text"] != "" or r["role"] == "system"]
    assert sorted((r["sort_order"], r["role"], r["content_text"]) for r in first) == [
        (0, "user", "hi"), (1, "system", ""), (2, "tool", "x\n\ny"),
    ]
    assert values(result.messages.filter("role = 'user' and content_text = ''"), "sort_order") == [(0,)]
    assert codes(result) == [("GENERIC_EMPTY_CONVERSATION",), ("GENERIC_MARKDOWN_NO_MESSAGES",)]


def test_routing_first_match_wins(spark):
    files = [
        ("a.json", '[{"mapping":{}}]'), ("b.json", ' [{"messages":[]}]'), ("c.json", "{}"), ("d.md", "x\n## user"),
        ("e.md", "no header"), ("f.pdf", "[{}]"), ("g.json", "[]"), ("h.json", "text"), ("i.json", '[{"mapping":null}]'),
    ]
    routed = route_files(spark.createDataFrame(files, "file_name string, content string"))
    got = dict(values(routed.fillna("-", ["source_type"]), "file_name", "source_type"))
    assert got == {
        "a.json": "chatgpt", "b.json": "generic", "c.json": "generic", "d.md": "generic", "e.md": "-", "f.pdf": "-",
        "g.json": "generic", "h.json": "-", "i.json": "chatgpt",
    }


def test_duplicates_failures_and_counts(spark):
    body = json.dumps([{"content": "a"}])
    first = run(spark, ("1.json", body), ("2.json", body), ("3.json", "{}"), ("4.bin", "?"), ("5.json", "[1,"))
    assert values(first.results.fillna("-"), "file_name", "status", "error") == [
        ("1.json", "completed", "-"), ("2.json", "completed", "duplicate"),
        ("3.json", "failed", "Unsupported JSON format"), ("4.bin", "failed", "No adapter could parse file: 4.bin"),
        ("5.json", "failed", "Unsupported JSON format"),
    ]
    assert values(first.batches, "session_count", "warning_count", "status") == [(1, 0, "completed")]
    again = run(spark, ("1.json", body), ("6.json", '[{"content":"b"}]'), sources=first.sources, batches=first.batches)
    assert values(again.results.fillna("-"), "file_name", "error") == [("1.json", "duplicate"), ("6.json", "-")]
    assert again.sources.count() == 1
    assert values(warnings_by_batch(again.warnings), "code", "n") == [("DUPLICATE_IMPORT", 1)]
    failed = first.batches.withColumn("status", F.lit("failed"))
    assert run(spark, ("1.json", body), batches=failed).batches.count() == 1
    assert import_batch_summary(first.batches, first.sessions, first.warnings).count() == 1


def test_own_adapter(spark):
    own = Adapter("generic", "9", lambda name, content: name.endswith(".log"), lambda files: read_generic(
        files.withColumn("file_name", F.lit("x.md")).withColumn("content", F.concat(F.lit("## User\n"), "content"))
    ))
    result = run(spark, ("a.log", "hello"), adapters=[*default_adapters(), own])
    assert texts(result) == ["hello"]
    assert values(result.sources, "adapter_key") == [("generic-9",)]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(chr(0xFEFF) + "## User\nhi\n", encoding="utf-8")
    files = read_files(spark, str(tmp_path / "in"))
    assert files.collect()[0]["content"].startswith("## User")
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.read("sessions").count() == 0
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    for _ in range(2):
        store.write("themes", rows, "0")
    store.write("themes", rows.limit(1), "1")
    assert (store.read("themes").count(), store.read("themes", run="1").count(), store.read("themes", before=1).count()) == (3, 1, 2)
