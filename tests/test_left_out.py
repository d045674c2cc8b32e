from millrace.operators import secrets
from millrace.operators.library import Library


def test_corrupt_parts_are_listed(spark, tmp_path):
    lib, run = Library(spark, str(tmp_path), ["line"]), "20240101-ABCDEF"
    folder = tmp_path / f"data/run_id={run}"
    rows = spark.createDataFrame([(f"line {i}",) for i in range(1000)], "line string")
    rows.repartition(3).write.parquet(str(folder))
    head, middle, _ = sorted(folder.glob("part-*"))
    head.write_bytes(b"no Parquet")
    raw = bytearray(middle.read_bytes())
    raw[4 : len(raw) // 2] = b"\xff" * (len(raw) // 2 - 4)
    middle.write_bytes(raw)
    for f in folder.glob(".*.crc"):
        f.unlink()
    assert lib.classify() == {run: "missing"} and lib.rebuild() == [run]
    assert [p.rsplit("/", 1)[1] for p in lib.corrupt] == [head.name, middle.name]
    assert 0 < lib.key_table().count() < 1000
    for f in folder.glob("part-*"):
        f.write_bytes(b"no Parquet")
    assert lib.rebuild() == [] and len(lib.corrupt) == 3


def test_skipped_scans_are_counted(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a")], "doc_id long, text string")
    got = secrets.scan_stats(docs).first()
    assert (got.n_scanned, got.n_skipped_scans) == (2, 2)
