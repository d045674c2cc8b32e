import os
import random

import pytest
import zstandard

from millrace import config
from millrace.operators import file_search, incremental, search, secrets
from millrace.operators.dedup import first_of_content, numbered, once_per_content
from millrace.run import run
from millrace.sources import text


def test_a_line_of_many_hits(spark):
    """Hits of a line in about linear time, overlapping ones too."""
    for needle, line in (("a", "a" * 200_000), ("aa", "xaaa" * 50_000), ("é", "é-" * 30_000)):
        want = [len(line[:i].encode()) for i in range(len(line)) if line.startswith(needle, i)]
        rows = spark.createDataFrame([(1, line), (2, "none here"), (3, needle)], "id int, line string")
        got = search.occurrences(rows, needle).select("id", "offset").collect()
        assert sorted(r.offset for r in got if r.id == 1) == want and [r.offset for r in got if r.id == 3] == [0]


def test_only_the_first_characters(spark):
    rows = spark.createDataFrame([(1, "abcabcabc"), (2, "abc")], "id int, line string")
    got = search.occurrences(rows, "abc", matched=6).collect()
    assert sorted((r.id, r.offset, r.cut, r.line) for r in got) == [(1, 0, True, "abcabcabc"), (1, 3, True, "abcabcabc"), (2, 0, False, "abc")]


def test_lines_cross_frames(spark, tmp_path):
    rng = random.Random(3)
    z = zstandard.ZstdCompressor()
    want = {}
    for k in range(3):
        body = b"\n".join(bytes(rng.choices(b"ab\xc3\xa9 ".replace(b"\xc3\xa9", b"c"), k=rng.choice([0, 3, 500]))) for _ in range(60))
        cuts = sorted(rng.choices(range(len(body) + 1), k=12))
        (tmp_path / f"f{k}.zst").write_bytes(b"".join(z.compress(body[a:b]) for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)))
        want[f"f{k}.zst"] = [x.decode() for x in body.split(b"\n") if x]
    lines, errors = text.zstd_lines(spark, text.frame_index(spark, [str(tmp_path)]))
    got = lines.orderBy("path", "frame", "seq").collect()
    for name, expected in want.items():
        assert [r.line for r in got if r.path.endswith(name)] == expected
    assert errors.isEmpty()


def test_a_damaged_frame_is_listed(spark, tmp_path):
    z = zstandard.ZstdCompressor(write_checksum=True)
    parts = [z.compress(f"part {k} holds a needle\n".encode() * 50) for k in range(3)]
    path = tmp_path / "a.zst"
    path.write_bytes(b"".join(parts))
    (tmp_path / "b.txt").write_text("a needle\nnone\n")
    index = text.saved_frame_index(spark, [str(path)], str(tmp_path / "index")).cache()
    assert index.count() == 3
    raw = bytearray(b"".join(parts))
    raw[len(parts[0]) + len(parts[1]) - 3] ^= 0xFF  # the checksum of the second
    path.write_bytes(raw)
    hits, errors = file_search.search_files(spark, [str(tmp_path)], "needle", index=index)
    assert [(r.path.rsplit("/", 1)[1], r.chunk) for r in errors.collect()] == [("a.zst", 1)]
    assert {r.line for r in hits.collect()} >= {"part 0 holds a needle", "part 2 holds a needle", "a needle"}
    first = file_search.first_hits(hits, 2).collect()
    assert [(r.chunk, r.offset) for r in first] == [(0, 15), (0, 15)]
    assert file_search.search_files(spark, [str(tmp_path)], "needle", per_chunk=1, index=index)[0].where("capped").count() >= 2
    assert [r.frame for r in text.damaged(text.frame_index(spark, [str(path)])).collect()] == [1]


def test_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo\nONE\n" + "x" * 50 + "\n")
    (tmp_path / "in/b.zst").write_bytes(zstandard.ZstdCompressor().compress(b"two\nthree\n"))
    given = {"inputs": (str(tmp_path / "in"),), "library": str(tmp_path / "lib"), "output": str(tmp_path / "out"), "rejected": str(tmp_path / "bad"), "max_line_bytes": 20, "key": "lower(line)", "kind": "text"}
    dry = run(spark, config.load(None, given | {"dry": True}))
    assert not os.path.exists(tmp_path / "out") and not os.path.exists(tmp_path / "lib") and dry["run_id"] is None
    got = run(spark, config.load(None, given))
    assert (got["n_read"], got["n_rejected"], got["n_new"], got["n_duplicates"]) == (6, 1, 3, 2) and {k: v for k, v in got.items() if k != "run_id"} == {k: v for k, v in dry.items() if k != "run_id"}
    assert sorted(r.value.lower() for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one", "three", "two"]
    assert spark.read.text(str(tmp_path / "bad")).count() == 1
    again = run(spark, config.load(None, given | {"output": None, "rejected": None}))
    assert (again["n_new"], again["n_skipped"], again["run_id"]) == (0, 5, None)
    with pytest.raises(ValueError):
        run(spark, config.load(None, given | {"output": str(tmp_path / "in/out")}))
    with pytest.raises(FileNotFoundError):
        run(spark, config.load(None, {"inputs": (str(tmp_path / "lib"),), "since": "7d"}))


def test_equal_texts_are_scanned_once(spark):
    token = 'token = "' + "a1" * 10 + '"'
    docs = spark.createDataFrame([(1, "s", f"x {token} {token}"), (2, "t", f"x {token} {token}"), (3, "u", None), (4, "v", "nothing"), (5, "w", f"{token}")], "doc_id long, source string, text string")
    rules = secrets.select_rules()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(secrets.scan(docs, rules, "s")) == rows(secrets.scan_once(docs, rules, "s")) and secrets.scan(docs, rules, "s").count() == 5
    once = {r.doc_id: r.n_rows for r in once_per_content(docs, "text", ["doc_id"]).collect()}
    assert once == {1: 2, 3: 1, 4: 1, 5: 1}


def test_hot_keys(spark):
    batch = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS line", "id")
    library = spark.createDataFrame([("hot",), ("hot",), ("k1",)], "line string")
    assert incremental.seen(batch, library, ["line"]).count() == 668
    assert incremental.unseen(batch, library, ["line"], ["id"]).count() == 1332
    equal = spark.range(100).selectExpr("1 AS a", "'same' AS b")
    assert sorted(r.number for r in numbered(equal, ["a"]).collect()) == list(range(1, 101))


def test_first_of_content(spark):
    rows = spark.createDataFrame([(3, 1, "a"), (2, 5, "a"), (2, 4, "a"), (1, 0, None), (0, 9, None), (7, 7, "")], "a int, b int, text string")
    for texts in (rows, rows.where("false")):
        got = sorted(tuple(r) for r in first_of_content(texts, "text", ["a", "b"]).select("a", "b").collect())
        assert got == ([(0, 9), (2, 4), (7, 7)] if texts is rows else [])
