"""Tables of findings that follow a tree, and scans that are kept once, with writes that fail half way."""

import pytest
from pyspark.sql import functions as F

from cryptolode.operators import incremental
from cryptolode.sinks import store

SCHEMA = "file_path string, word string"


def tree(spark, files):
    return spark.createDataFrame([(p, v, bytearray(c.encode())) for p, (v, c) in files.items()], "path string, version string, content binary")


def words(files):
    return files.select(F.col("path").alias("file_path"), F.explode(F.split(F.col("content").cast("string"), " ")).alias("word")).where("word <> ''")


def refresh(spark, table, files, unreadable=()):
    asked = []

    def read(paths):
        asked.extend(r.path for r in paths.collect())
        return tree(spark, files).drop("version").where(~F.col("path").isin(*unreadable)).join(paths, "path", "left_semi")

    counts = table.refresh(tree(spark, files).select("path", "version"), read, words)
    return counts, sorted(asked)


def held(table):
    return sorted((r.file_path, r.word) for r in table.findings().collect())


def of(files):
    return sorted((p, w) for p, (_, c) in files.items() for w in c.split(" ") if w)


def test_refreshes_equal_full_scans_and_read_what_changed(spark, tmp_path):
    table = incremental.ScanTable(spark, str(tmp_path / "t"), SCHEMA, 4)
    assert held(table) == [] and table.files().count() == 0
    files = {f"f{i}": ("1", f"a{i} b") for i in range(12)} | {"none": (None, ""), "twice": ("1", "x x")}
    counts, asked = refresh(spark, table, files)
    assert (counts.listed, counts.read, counts.scanned, counts.gone) == (14, 14, 14, 0) and asked == sorted(files) and held(table) == of(files)
    assert refresh(spark, table, files) == (incremental.Refreshed(14, 0, 0, 0), [])
    after = {k: v for k, v in files.items() if k not in ("f1", "f2")} | {"f3": ("2", "changed"), "f4": ("2", "a4 b"), "new": ("1", "n"), "none": (None, "")}
    counts, asked = refresh(spark, table, after)
    assert counts == incremental.Refreshed(13, 3, 2, 2) and asked == ["f3", "f4", "new"] and held(table) == of(after)
    assert {(r.path, r.version) for r in table.files().collect()} == {(p, v) for p, (v, _) in after.items()}
    # another object on the same folder; all files of it go, and so do all findings
    again = incremental.ScanTable(spark, str(tmp_path / "t"), SCHEMA, 4)
    assert refresh(spark, again, {"last": ("1", "z")})[0] == incremental.Refreshed(1, 1, 1, 13) and held(again) == [("last", "z")]
    assert refresh(spark, again, {})[0].gone == 1 and held(again) == [] and again.files().count() == 0


def test_a_refresh_that_is_lost_half_way_is_done_again(spark, tmp_path, monkeypatch):
    table = incremental.ScanTable(spark, str(tmp_path / "t"), SCHEMA, 3)
    files = {f"f{i}": ("1", f"a{i}") for i in range(5)}
    refresh(spark, table, files)
    files |= {"f0": ("2", "other words"), "f9": ("1", "new")}
    replace = incremental.ScanTable._replace

    def lost(self, name, *rest):
        if name == "files":
            raise RuntimeError("lost")
        replace(self, name, *rest)

    monkeypatch.setattr(incremental.ScanTable, "_replace", lost)
    with pytest.raises(RuntimeError):
        refresh(spark, table, files)
    monkeypatch.undo()
    assert refresh(spark, table, files)[0] == incremental.Refreshed(6, 2, 2, 0) and held(table) == of(files)


def test_an_unreadable_file_keeps_what_it_had(spark, tmp_path):
    table = incremental.ScanTable(spark, str(tmp_path / "t"), SCHEMA, 3)
    refresh(spark, table, {"a": ("1", "x"), "b": ("1", "y")})
    files = {"a": ("2", "z"), "b": ("1", "y")}
    assert refresh(spark, table, files, ["a"])[0] == incremental.Refreshed(2, 0, 0, 0) and held(table) == [("a", "x"), ("b", "y")]
    assert refresh(spark, table, files)[0].scanned == 1 and held(table) == [("a", "z"), ("b", "y")]


def test_scans_are_kept_once(spark, tmp_path):
    kept = store.ScanStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("x/2 =", "c")], "scan_run_id string, finding string")
    scans = spark.createDataFrame([("1", 5), ("x/2 =", 6)], "scan_run_id string, at int")
    for _ in range(2):
        kept.save(scans, rows)
    found = lambda: sorted((r.scan_run_id, r.finding) for r in kept.findings().collect())
    assert found() == [("1", "a"), ("1", "b"), ("x/2 =", "c")] and kept.scans().count() == 2
    # a write without its scan's row is not shown; a scan that is written again has the new findings only
    kept.write_findings(spark.createDataFrame([("3", "d")], rows.schema))
    assert len(found()) == 3
    kept.save(spark.createDataFrame([("1", 7), ("4", 8)], scans.schema), spark.createDataFrame([("1", "z")], rows.schema))
    assert found() == [("1", "z"), ("x/2 =", "c")] and {r.scan_run_id: r.at for r in kept.scans().collect()} == {"1": 7, "x/2 =": 6, "4": 8}
    kept.save(spark.createDataFrame([("1", 9)], scans.schema), spark.createDataFrame([], rows.schema))
    assert kept.delete("x/2 =") and not kept.delete("nope") and found() == []
