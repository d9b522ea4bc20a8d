"""Editing sessions in batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from textlens.streaming import session


@pytest.mark.parametrize(
    ("text", "span", "new", "expected"),
    [
        ("abc", None, "x", "x"),
        ("ab\ncd", (1, 1, 1, 2), "X", "ab\ncX"),
        ("a\r\nb\rc", (2, 0, 2, 1), "Z", "a\r\nb\rZ"),
        ("\U0001f600b", (0, 2, 0, 3), "c", "\U0001f600c"),
        ("ab\ncd", (0, 99, 0, 99), "!", "ab!\ncd"),
        ("ab", (9, 9, 9, 9), "!", "ab!"),
        ("ab c", (1, 0, 1, 0), "!", "!ab\u2028c"),  # no line break: the last line, that column
        ("abc", (0, 2, 0, 1), "-", "ab-c"),
    ],
)
def test_changes(text, span, new, expected):
    assert session.apply_change(text, span, new) == expected


EVENTS = [
    ("a", 1, "open", "markdown", None, None, None, None, "one"),
    ("a", 2, "change", None, 0, 3, 0, 3, " two"),
    ("b", 3, "change", None, None, None, None, None, "never open"),
    ("c", 4, "open", None, None, None, None, None, None),
    ("c", 5, "close", None, None, None, None, None, None),
    ("d", 6, "open", None, None, None, None, None, "x"),
    ("d", 7, "open", None, None, None, None, None, "y"),
    (None, 8, "open", None, None, None, None, None, "no uri"),
]
OPEN = [("a", 2, "markdown", "one two"), ("d", 1, "plain", "y")]


def test_replay(spark):
    assert sorted(tuple(r) for r in session.replay(spark.createDataFrame(EVENTS, session.EVENT)).collect()) == OPEN
    assert session.replay(spark.createDataFrame([], session.EVENT)).count() == 0


def test_stream(spark, tmp_path):
    for i, part in enumerate((EVENTS[:1], EVENTS[1:5], EVENTS[5:])):
        spark.createDataFrame(part, session.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    rows = []
    events = spark.readStream.schema(session.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*"))
    query = session.sessions(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: rows.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r[0]: r for r in sorted(rows, key=lambda r: r[1])}
    assert [r[:4] for r in sorted(last.values()) if r[4]] == OPEN


def test_results(spark):
    rows = [("a", 3, "plain", "It is very late."), ("b", 1, "plain", "x" * 50), ("c", 1, "plain", "boom")]
    opened = spark.createDataFrame(rows, "uri string, generation int, format string, text string")

    shown = session.results(opened, 40, F.col("text") == "boom")
    out = {r["uri"]: r for r in shown.collect()}
    assert {k: (r["status"], r["result_id"], [d["code"] for d in r["diagnostics"]]) for k, r in out.items()} == {
        "a": ("accepted", "3", ["weak-word"]), "b": ("oversized", "1", ["textlens/document-too-large"]), "c": ("failed", "1", ["textlens/analysis-failed"]),
    }
    assert out["b"]["diagnostics"][0]["message"] == "document is 50 bytes; the analysis limit is 40 bytes" and out["c"]["data"] == []
    m = session.metrics(spark.createDataFrame(EVENTS, session.EVENT), session.results(session.replay(spark.createDataFrame(EVENTS, session.EVENT)))).first()
    assert (m["active_documents"], m["accepted_results"], m["cancelled_before_compute"], m["stale_results"]) == (2, 2, 3, 0)


def test_messages(spark):
    import json

    from textlens.sources import cases

    shown = session.results(session.replay(session.events_of_messages(cases.messages(spark))))
    sent = {r["uri"]: json.loads(r["json"]) for r in session.messages_of_results(shown).collect()}
    note = sent["file:///b.md"]["params"]["diagnostics"]
    assert [(d["severity"], d["range"]["start"], d["code"]) for d in note] == [(3, {"line": 0, "character": 11}, "weak-word")] and set(sent) == {"file:///a.txt", "file:///b.md"}
