"""Values that a worker turns over in slices."""

from __future__ import annotations

from quern.sources import parsers


def test_slices_are_whole(spark, monkeypatch):
    monkeypatch.setattr(parsers, "SLICE", 3)
    rows = [(n, None if n % 7 == 0 else "x" * (n % 5)) for n in range(50)] + [(50, "y" * (5 << 20)), (51, "z")]
    table = spark.createDataFrame(rows, "n long, text string").coalesce(1)
    got = parsers.in_slices(table, "text", "size string", lambda t: [None if t is None else str(len(t))]).collect()
    assert [(r.n, r.size) for r in got] == [(n, None if t is None else str(len(t))) for n, t in rows]


def test_docx_is_parsed_in_slices(spark, capsys):
    files = spark.createDataFrame([("a", b"x"), ("b", None)], "source_uri string, content binary")
    parsed = parsers.parse_docx(files)
    parsed.explain()
    assert "MapInArrow" in capsys.readouterr().out
    assert {r.error for r in parsed.collect()} == {"bad-archive"}
