"""Session-log reader: the reference's fifteen scanner cases plus the extra edge cases."""

import datetime as dt
import json
import os
import tempfile

from refrain.sources.logs import read_session_logs, session_table


def _root():
    return tempfile.mkdtemp(prefix="refrain-logs-")


def _write(root, project, session, records, raw=None):
    d = os.path.join(root, project)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{session}.jsonl"), "w", encoding="utf-8") as f:
        for r in records:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
        if raw:
            f.write(raw)


def _user(text, uuid="u", ts="2024-03-01T10:00:00Z", **kw):
    rec = {"type": "user", "uuid": uuid, "parentUuid": None, "sessionId": "ignored", "cwd": kw.pop("cwd", "/a/b"),
           "timestamp": ts, "message": {"role": "user", "content": text}}
    rec.update(kw)
    return rec


def _texts(df):
    return [r.text for r in df.orderBy("ord").collect()]


def test_plain_string(spark):
    r = _root(); _write(r, "p", "s1", [_user("  hello world  ")])
    assert _texts(read_session_logs(spark, r)) == ["hello world"]


def test_single_block(spark):
    r = _root(); _write(r, "p", "s1", [_user([{"type": "text", "text": " one "}])])
    assert _texts(read_session_logs(spark, r)) == ["one"]


def test_several_blocks(spark):
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_result", "content": "x"}, {"type": "text", "text": "b"}]
    r = _root(); _write(r, "p", "s1", [_user(blocks)])
    assert _texts(read_session_logs(spark, r)) == ["a b"]


def test_empty_array_and_tool_result_only_dropped(spark):
    r = _root(); _write(r, "p", "s1", [_user([], uuid="e"), _user([{"type": "tool_result", "content": "x"}], uuid="t")])
    assert read_session_logs(spark, r).count() == 0


def test_timestamps_valid_empty_invalid(spark):
    r = _root()
    _write(r, "p", "s1", [_user("valid", "1", "2024-01-15T10:30:00Z"), _user("empty", "2", ""), _user("bad", "3", "not-a-date")])
    got = {x.text: x.ts for x in read_session_logs(spark, r).collect()}
    assert got["valid"] == dt.datetime(2024, 1, 15, 10, 30)
    assert got["empty"] is None and got["bad"] is None


def test_timestamp_default_is_scan_time(spark):
    r = _root(); _write(r, "p", "s1", [_user("no time", ts="")])
    as_of = dt.datetime(2024, 5, 1)
    assert read_session_logs(spark, r, as_of=as_of).collect()[0].ts == as_of


def test_basic_session_order(spark):
    r = _root()
    _write(r, "p", "s1", [_user("first", "1", "2024-03-01T10:00:00Z"),
                          {"type": "assistant", "uuid": "a", "message": {"role": "assistant", "content": "reply"}},
                          _user("second", "2", "2024-03-01T10:01:00Z")])
    df = read_session_logs(spark, r)
    assert _texts(df) == ["first", "second"]
    assert {x.session_id for x in df.collect()} == {"s1"}


def test_sidechain_dropped(spark):
    r = _root(); _write(r, "p", "s1", [_user("main", "1", isSidechain=False), _user("side", "2", isSidechain=True)])
    assert _texts(read_session_logs(spark, r)) == ["main"]


def test_empty_text_dropped(spark):
    r = _root(); _write(r, "p", "s1", [_user("", "1"), _user([{"type": "text"}], "2"), _user("kept", "3")])
    assert _texts(read_session_logs(spark, r)) == ["kept"]


def test_lookback(spark):
    r = _root()
    _write(r, "p", "s1", [_user("jan", "1", "2024-01-10T00:00:00Z"), _user("mar", "2", "2024-03-10T00:00:00Z"), _user("none", "3", "")])
    got = set(_texts(read_session_logs(spark, r, since=dt.datetime(2024, 2, 1))))
    assert got == {"mar", "none"}


def test_empty_and_missing_root(spark):
    r = _root()
    assert read_session_logs(spark, r).count() == 0
    df = read_session_logs(spark, os.path.join(r, "does-not-exist"))
    assert df.count() == 0 and "text" in df.columns


def test_malformed_line_skipped(spark):
    r = _root(); _write(r, "p", "s1", [_user("good1", "1"), "{not json", _user("good2", "2")])
    assert sorted(_texts(read_session_logs(spark, r))) == ["good1", "good2"]


def test_extra_edge_cases(spark):
    r = _root()
    _write(r, "p", "s1", [_user("[not an array]", "1"), "[1, 2, 3]", '"just a string"',
                          {"type": "user", "uuid": "n", "message": None}, _user("ok", "2")])
    _write(os.path.join(r, "p"), "subagents", "deep", [_user("nested", "9")])
    assert sorted(_texts(read_session_logs(spark, r))) == ["[not an array]", "ok"]


def test_project_filter_by_component(spark):
    r = _root()
    _write(r, "p", "s1", [_user("in b", "1", cwd="/a/b"), _user("in b/c", "2", cwd="/a/b/c"), _user("in bc", "3", cwd="/a/bc")])
    assert sorted(_texts(read_session_logs(spark, r, project="/a/b"))) == ["in b", "in b/c"]


def test_session_table_uses_last_cwd(spark):
    r = _root()
    _write(r, "p", "s1", [_user("x", "1", "2024-03-01T10:00:00Z", cwd="/a"), _user("y", "2", "2024-03-01T11:00:00Z", cwd="/b")])
    row = session_table(spark, r).collect()[0]
    assert row.n_messages == 2 and row.session_cwd == "/b"
    assert row.start_time == dt.datetime(2024, 3, 1, 10) and row.end_time == dt.datetime(2024, 3, 1, 11)


def test_lines_without_uuid_stay_apart(spark):
    """Equal times and no uuid: three equal messages are one pattern of three."""
    from refrain.plans.scan import scan

    same = "please run the whole linter suite again"
    lines = [{"type": "user", "timestamp": "2024-03-01T10:00:00Z", "cwd": "/a", "message": {"role": "user", "content": t}} for t in (same, same, "something else altogether, said only once", same)]
    r = _root(); _write(r, "p", "s1", lines)
    messages = read_session_logs(spark, r)
    assert _texts(messages) == [x["message"]["content"] for x in lines]
    assert [(p.size, p.label) for p in scan(messages, classify=False).collect()] == [(3, same)]


def test_equal_order_keys_are_refused(spark):
    import pytest

    from refrain.plans.scan import find_patterns

    rows = spark.createDataFrame([(1, "u", "t"), (1, "v", "t")], "ord long, uuid string, text string").withColumn("ts", __import__("pyspark").sql.functions.lit(None).cast("timestamp"))
    with pytest.raises(ValueError):
        find_patterns(rows, classify=False)


def test_file_names_are_decoded(spark):
    r = _root(); _write(r, "pro j%41+x", "s 1+2%", [_user("hello there")])
    rows = read_session_logs(spark, r).collect()
    assert [(m.session_id, m.ord.project_dir, m.ord.file_name) for m in rows] == [("s 1+2%", "pro j%41+x", "s 1+2%.jsonl")]


def test_session_counts_follow_the_filters(spark):
    r = _root(); _write(r, "p", "s1", [_user("one", ts="2024-01-01T00:00:00Z", cwd="/a"), _user("two", ts=None, cwd="/a"), _user("three", cwd="/b")])
    row = session_table(spark, r, project="/a", as_of=dt.datetime(2024, 5, 1)).collect()[0]
    assert (row.n_messages, row.start_time, row.end_time, row.session_cwd) == (2, dt.datetime(2024, 1, 1), dt.datetime(2024, 5, 1), "/b")


def test_rejected_lines_and_unreadable_files(spark):
    import gzip

    from refrain.sources.logs import file_report, read_lines, rejected_lines

    r = _root()
    _write(r, "p", "good", [_user("one"), "", "{broken", "[1]", '{"type": "user"}', _user("side", isSidechain=True), _user("two")])
    _write(r, "p", "empty", [])
    for name, cut in (("whole", 0), ("torn", 25)):
        packed = gzip.compress((json.dumps(_user("zipped")) + "\n").encode())
        with open(os.path.join(r, "p", f"{name}.jsonl.gz"), "wb") as f:
            f.write(packed[: len(packed) - cut])
    glob = "*/*.jsonl*"
    got = {x.file_name: x for x in file_report(spark, r, glob).collect()}
    assert {k: (x.n_lines, x.n_blank, x.n_not_json, x.n_not_an_object, x.n_no_message, x.n_messages, x.unreadable) for k, x in got.items()} == {
        "good.jsonl": (7, 1, 1, 1, 1, 2, False), "whole.jsonl.gz": (1, 0, 0, 0, 0, 1, False), "torn.jsonl.gz": (0, 0, 0, 0, 0, 0, True),
    }
    bad = rejected_lines(read_lines(spark, r, glob)).orderBy("block", "line").collect()
    assert [(x.file_name, x.reason, x.value) for x in bad] == [("good.jsonl", "not json", "{broken"), ("good.jsonl", "not an object", "[1]"), ("good.jsonl", "no message", '{"type": "user"}')]
    assert file_report(spark, _root()).count() == 0
