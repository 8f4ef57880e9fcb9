"""Batches of event lines by rows: sizes, restarts, files that grow, and the errors."""

import json

import pytest
from conftest import rows

from wagerlens.operators import legs as L
from wagerlens.sources import lines as S, sinks
from wagerlens.streaming import events as E, watch


def reader(tmp_path, **options):
    return S.LineStream({"path": str(tmp_path / "in"), "positions": str(tmp_path / "at"), **options})


def drain(source):
    """The batches that a query would see: lists of lines."""
    start, batches = source._position(), []
    while (end := source.latestOffset())["rows"] > start["rows"]:
        batches.append([v for p in source.partitions(start, end) for b in source.read(p) for v in b.column(0).to_pylist()])
        start = end
    return batches


def test_batches_are_bounded_and_whole(tmp_path):
    assert drain(reader(tmp_path)) == []
    (tmp_path / "in").mkdir()
    assert drain(reader(tmp_path)) == []
    (tmp_path / "in" / "a").write_text("".join(f"a{i}\n\n" for i in range(25)))
    (tmp_path / "in" / "b").write_text("")
    (tmp_path / "in" / "c").write_text("c0\nc1")
    (tmp_path / "in" / "_d").write_text("no\n")
    (tmp_path / "in" / "e").write_text("é\n" + "x" * 3_000_000 + "\nhalf")
    got = drain(reader(tmp_path, max_rows="10", piece="3"))
    assert [len(b) for b in got] == [10, 10, 9] and sum(got, []) == [f"a{i}" for i in range(25)] + ["c0", "c1", "é", "x" * 3_000_000]
    with (tmp_path / "in" / "e").open("a") as file:
        file.write(" and half\nmore\n")
    assert drain(reader(tmp_path, max_rows="10")) == [["half and half", "more"]]  # another reader goes on where the first one ended
    assert drain(reader(tmp_path)) == []


def test_a_batch_is_read_alike_again(tmp_path):
    (tmp_path / "in").mkdir()
    for name in "abc":
        (tmp_path / "in" / name).write_text("".join(f"{name}{i}\n" for i in range(7)))
    source = reader(tmp_path, max_rows="9", piece="2")
    end = source.latestOffset()
    read = lambda: [v for p in source.partitions(S.START, end) for b in source.read(p) for v in b.column(0).to_pylist()]
    assert end["rows"] == 9 and (end["name"], end["row"], end["files"]) == ("b", 2, 1) and read() == read() and len(source.partitions(S.START, end)) == 5


def test_rows_are_never_missed_silently(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b").write_text("1\n2\n")
    source = reader(tmp_path)
    assert drain(source) == [["1", "2"]]
    with pytest.raises(ValueError, match="behind the checkpoint"):
        source.partitions(source._position(), dict(S.START))
    (tmp_path / "in" / "a").write_text("3\n")
    with pytest.raises(ValueError, match="in front of the position"):
        source.latestOffset()


def test_a_stream_by_rows_equals_the_batch_and_restarts(spark, tmp_path):
    events = E.generate(spark, 900)
    lines = [r["value"] for r in sinks.event_lines(events).collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0").write_text("\n".join(lines[:500]) + "\n")
    start = lambda: E.ingest(E.read_event_rows(spark, str(tmp_path / "in"), str(tmp_path / "check"), max_rows=200), str(tmp_path / "log"), str(tmp_path / "check"), drain=False, every="100 milliseconds")
    first = watch.run_until_idle(start, spark, 5.0)
    (tmp_path / "in" / "1").write_text("\n".join(lines[500:]) + "\n")
    second = watch.run_until_idle(start, spark, 5.0)
    assert (first.rows, first.batches) == (500, 3) and (second.rows, second.batches) == (len(lines) - 500, -(-(len(lines) - 500) // 200))
    sizes = [json.loads(p.read_text().splitlines()[-1])["rows"] for p in sorted((tmp_path / "check" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))]
    assert sizes == [200, 400, 500] + [min(500 + 200 * k, len(lines)) for k in range(1, second.batches + 1)]
    log = E.read_log(spark, str(tmp_path / "log"))
    assert log.count() == len(lines) and rows(L.fingerprint(log)) == rows(L.fingerprint(E.canonicalise(events)))
