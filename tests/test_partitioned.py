"""Tables whose folders are replaced one by one."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill.operators import updates
from labelmill.sinks.partitioned import PartitionedTable, delete_cascade

AT = datetime(2026, 2, 1)
SCHEMA = "id long, part string, v string"


def made(spark, path, rows=None):
    table = PartitionedTable(spark, str(path), "part", StructType.fromDDL(SCHEMA))
    rows = rows or [(i, None if i % 7 == 6 else f"p/{i % 7} é", "old") for i in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA)
    table.write(frame)
    return table, frame


def test_an_upsert_rewrites_the_folder_of_its_keys(spark, tmp_path):
    table, frame = made(spark, tmp_path)
    before, folders = table.read(), table.folders()
    # One row of a hundred of one folder, a key that is nowhere, and one patched twice.
    patches = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (9999, "x", 1)], "id long, v string, n int")
    changed = table.upsert(patches, "id", ["v"], AT, "n")
    assert len(changed) == 1 and len(set(table.folders()) - set(folders)) == 1 and len(table.folders()) == 7
    want = updates.upsert(frame, patches, "id", ["v"], AT, "n").drop("modified")
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    # A reader that began before sees the table as it was.
    assert sorted(map(str, before.collect())) == sorted(map(str, frame.collect()))
    assert table.upsert(patches.where("id > 9000"), "id", ["v"], AT) == []
    with pytest.raises(ValueError):
        table.upsert(patches, "id", ["part"], AT)


def test_rows_without_a_part_can_change(spark, tmp_path):
    table, _ = made(spark, tmp_path)
    assert table.delete(spark.createDataFrame([(6,), (13,)], "id long"), "id") == ["null"]
    assert table.read().count() == 698 and table.read(["null"]).count() == 98


def test_a_folder_can_become_empty(spark, tmp_path):
    table, frame = made(spark, tmp_path)
    table.delete(frame.where(F.col("part") == "p/2 é"), "id")
    assert len(table.folders()) == 6 and table.read().where(F.col("part") == "p/2 é").count() == 0
    table.write(frame.where("id < 0"))
    assert table.read().count() == 0 and table.folders() == []


def test_old_folders_go(spark, tmp_path):
    table, frame = made(spark, tmp_path)
    for i in range(8):
        table.upsert(spark.createDataFrame([(1, f"v{i}")], "id long, v string"), "id", ["v"], AT)
    slot = table.slots_of(frame.where("id = 1"), "id")[0]
    kept = [n for n in os.listdir(tmp_path / "rows") if os.path.isdir(tmp_path / "rows" / n / f"slot={slot}")]
    assert len(kept) == 3 and len(os.listdir(tmp_path / "rows" / "write=0")) >= 6
    assert table.read().where("id = 1").first().v == "v7" and table.read().count() == 700


def test_a_second_writer_does_not_win(spark, tmp_path):
    table, _ = made(spark, tmp_path)
    state = table.manifests.newest()
    with pytest.raises(RuntimeError, match="another writer"):
        table.manifests.put(state)
    assert not [n for n in os.listdir(tmp_path / "manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_cascade_in_place_equals_the_rule(spark, tmp_path):
    tables = {
        name: made(spark, tmp_path / name, [(i, f"{i % 3}", str(i // 2)) for i in range(60)])[0] for name in ("a", "b")
    }
    plain = {n: t.read() for n, t in tables.items()}
    children, keys = [("a", "part", ""), ("b", "v", "a")], {"a": "v"}
    doomed = spark.createDataFrame([("1",)], "part string")
    want = updates.delete_cascade(plain, doomed, "part", children, keys)
    want = {n: sorted(map(str, df.select("id", "part", "v").collect())) for n, df in want.items()}
    delete_cascade(tables, doomed, "part", children, keys)
    assert {n: sorted(map(str, t.read().collect())) for n, t in tables.items()} == want
    assert 0 < len(want["b"]) < 60


def test_very_many_values_share_folders(spark, tmp_path):
    rows = [(i, None if i % 600 == 599 else f"p{i % 600}", str(i % 50)) for i in range(3000)]
    table = PartitionedTable(spark, str(tmp_path), "part", StructType.fromDDL(SCHEMA), most=300)
    frame = spark.createDataFrame(rows, SCHEMA)
    written = table.write(frame)
    files = [n for _, _, names in os.walk(tmp_path / "rows") for n in names if n.endswith(".parquet")]
    assert len(written) <= 257 and len(files) == len(written) and "null" in written
    patches = spark.createDataFrame([(7, "new"), (599, "new")], "id long, v string")
    changed = table.upsert(patches, "id", ["v"], AT)
    assert len(changed) == 2 and len(table.folders()) == len(written)
    assert table.slots_of(frame.where("part = 'p7'"), "id") == [s for s in changed if s != "null"]
    dropped = table.delete(frame.where("id % 600 = 8"), "id")
    assert len(dropped) == 1 and table.read(dropped).where("part = 'p8'").isEmpty()
    want = [(i, p, "new" if i in (7, 599) else v) for i, p, v in rows if i % 600 != 8]
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(want, key=str)
    # The table anew with few values has a folder for each again.
    assert len(table.write(frame.where("id < 100"))) == 100
    assert PartitionedTable(spark, str(tmp_path), "part", table.schema).read().count() == 100
