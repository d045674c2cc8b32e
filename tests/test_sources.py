import io
import os
from datetime import UTC, datetime, timedelta

import pytest
import zstandard
from pyspark.sql import functions as F

from millrace import config
from millrace.operators.library import Library, new_run_id
from millrace.sources import sinks, text


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_encodings(spark, tmp_path):
    put(tmp_path / "in/a.txt", "﻿one\r\n\r\ntwo\nthree".encode())
    put(tmp_path / "in/sub/b.TXT", b"\xff\xfe" + "wide\nzwei".encode("utf-16-le"))
    put(tmp_path / "in/c.txt", b"\xfe\xff" + "big\r\nend\n".encode("utf-16-be"))
    put(tmp_path / "in/d.csv", b"no")
    at = [str(tmp_path / "in")]
    assert sorted(r.line for r in text.read_sniffed(spark, at).collect()) == sorted(["one", "two", "three", "wide", "zwei", "big", "end"])
    assert sorted(r.encoding for r in text.sniffed(spark, at).collect()) == ["UTF-16BE", "UTF-16LE", "UTF-8"]
    assert text.files(spark, at).count() == 3


def test_discovery(spark, tmp_path):
    old, new = put(tmp_path / "old.txt", b"x"), put(tmp_path / "new.txt", b"y")
    os.utime(old, (0, 1_000_000))
    cut = datetime.now(UTC) - timedelta(days=1)
    assert [os.path.basename(r.path) for r in text.files(spark, [str(tmp_path)], since=cut).collect()] == ["new.txt"]
    with pytest.raises(FileNotFoundError):
        text.files(spark, [str(tmp_path)], since=datetime.now(UTC) + timedelta(days=1))
    with pytest.raises(ValueError):
        text.files(spark, ["-"])
    assert os.path.exists(new)


@pytest.mark.parametrize("age, seconds", [("7d", 604800), ("12h", 43200), ("1d6h", 108000), ("90m", 5400)])
def test_age(age, seconds):
    assert text.parse_age(age).total_seconds() == seconds


@pytest.mark.parametrize("bad", ["", "0d", "7", "x7d", "-1h"])
def test_bad_age(bad):
    with pytest.raises(ValueError):
        text.parse_age(bad)


def test_bound(spark):
    df = spark.createDataFrame([("x" * 4096,), ("x" * 4097,)], "line string")
    ok, long = text.bounded(df)
    assert (ok.count(), long.count()) == (1, 1)


def test_zstd_frames(spark, tmp_path):
    z = zstandard.ZstdCompressor()
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    path = put(tmp_path / "a.zst", z.compress(b"one\ntw") + skip + z.compress(b"o\nthree\n"))
    lines, errors = text.zstd_lines(spark, text.frame_index(spark, [str(tmp_path)]))
    assert [r.line for r in lines.orderBy("frame", "seq").collect()] == ["one", "two", "three"] and errors.isEmpty()
    index = str(tmp_path / "index")
    first = text.saved_frame_index(spark, [path], index)
    assert sorted((r.frame, r["size"]) for r in first.collect()) == [(0, 6), (1, 8)]
    os.utime(path, (0, 2_000_000_000))
    put(tmp_path / "b.zst", z.compress(b"x\n"))
    assert text.saved_frame_index(spark, [str(tmp_path)], index).count() == 3
    with pytest.raises(ValueError):
        text.frames(b"nonsense")
    with pytest.raises(ValueError):
        text.frames(z.compress(b"abc" * 100)[:-4])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(str(i),) for i in range(10)], "line string").coalesce(1)
    assert sinks.write(df, str(tmp_path / "t"), "text", per_part=4)
    parts = [p for p in os.listdir(tmp_path / "t") if p.startswith("part")]
    assert len(parts) == 3 and os.path.exists(tmp_path / "t/_SUCCESS")
    assert not sinks.write(df.where("false"), str(tmp_path / "none")) and not os.path.exists(tmp_path / "none")
    assert sinks.write(df, str(tmp_path / "z")) and spark.read.parquet(str(tmp_path / "z")).count() == 10
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "t/x"), inputs=[str(tmp_path / "t")])


def test_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), ["line"])
    make = lambda *v: spark.createDataFrame([(x, i) for i, x in enumerate(v)], "line string, pos int")
    one, two = make("a", "b", "c", "d", "e"), make("a", "b", "c", "x", "y")
    assert lib.add(one, ["pos"], dry=True)[1]["n_new"] == 5 and lib.runs() == []
    first, _ = lib.add(one, ["pos"], "20240101-ABCDEF")
    dry = lib.add(two, ["pos"], dry=True)[1]
    second, stats = lib.add(two, ["pos"], "20240102-ABCDEF")
    assert stats == dry and (stats["n_new"], stats["n_skipped"]) == (2, 3)
    assert lib.add(two, ["pos"])[0] is None
    assert lib.classify() == {first: "fresh", second: "fresh"}
    assert lib.key_table(exclude=first).count() == 2
    import shutil

    shutil.rmtree(tmp_path / f"lib/keys/run_id={first}")
    assert lib.classify()[first] == "missing"
    newer = Library(spark, str(tmp_path / "lib"), ["line"], version=2)
    assert newer.classify() == {first: "missing", second: "stale"} and newer.rebuild() == [first, second]
    assert set(newer.classify().values()) == {"fresh"}
    shutil.rmtree(tmp_path / f"lib/data/run_id={second}")
    assert newer.sweep() == [second] and newer.key_table().count() == 5
    with pytest.raises(ValueError):
        lib.add(make("q"), ["pos"], "not-a-run")
    assert new_run_id(datetime(2024, 5, 6))[:9] == "20240506-"


def test_config(tmp_path):
    path = put(tmp_path / "c.toml", b'[millrace]\noutput = "out"\ninputs = ["in", "/abs"]\nmax_line_bytes = 10\n')
    got = config.load(path, {"max_line_bytes": 20, "library": None})
    assert got.output == str(tmp_path / "out") and got.inputs == (str(tmp_path / "in"), "/abs") and got.max_line_bytes == 20
    assert config.load() == config.Settings()
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "absent.toml"))
    with pytest.raises(ValueError):
        config.load(None, {"nonsense": 1})


@pytest.mark.parametrize("little", [True, False])
@pytest.mark.parametrize("size, read", [(4, 2), (4, 64), (6, 3), (10, 7), (64, 5), (8 << 20, 1 << 20)])
def test_wide_ranges_give_each_line_once(monkeypatch, little, size, read):
    monkeypatch.setattr(text, "READ_BYTES", read)
    order = "utf-16-le" if little else "utf-16-be"
    # U+0A00, U+0A0A and U+000A side by side: line feeds only where units begin
    for body in ["", "\n", "a", "ab\n", "\n\na\n\n", "one\ntwo\n\nthree", "਀\nਊ\nĀ਀\n", "x" * 99 + "\n" + "yz\n" * 20, "😀\n" * 9 + "end\r\n", "\n" * 50]:
        data = (b"\xff\xfe" if little else b"\xfe\xff") + body.encode(order)
        got = []
        for start in range(0, len(data), size):
            for lines in text._wide_lines(io.BytesIO(data), start, start + size, little):
                got += [x.decode(order) for x in lines.to_pylist()]
        assert got == [x for x in body.split("\n") if x]


def test_wide_file_is_read_by_ranges(spark, tmp_path, monkeypatch):
    """No task holds a UTF-16 file: many take its ranges, and none reads much more than its own."""
    monkeypatch.setattr(text, "RANGE_BYTES", 1 << 12)
    say = [f"line {i} é中😀" for i in range(3000)]
    path = put(tmp_path / "in/a.txt", b"\xff\xfe" + "\r\n".join(say).encode("utf-16-le"))
    put(tmp_path / "in/b.txt", b"\xfe\xff" + "\n".join(say[:50]).encode("utf-16-be"))
    put(tmp_path / "in/c.txt", "plain é\n".encode())
    got = text.read_sniffed(spark, [str(tmp_path / "in")])
    assert sorted(r.line for r in got.collect()) == sorted([*say, *say[:50], "plain é"])
    tasks = got.where(got.path.endswith("a.txt")).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks > os.path.getsize(path) // (1 << 12) // 2
    monkeypatch.setattr(text, "seekable", lambda *_: False)
    whole = text.read_sniffed(spark, [str(tmp_path / "in")])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))
