import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill import storage
from labelmill.functions.presence import Cadence
from labelmill.operators import history, presence
from labelmill.schemas import table_type
from labelmill.sources.heartbeats import heartbeat_problem, read_heartbeats
from labelmill.streaming import activity, annotations, imports, sessions
from labelmill.streaming.keyed_state import KeyedState

T0 = datetime(2026, 2, 1, 23, 50)
CADENCE = Cadence(heartbeat_ms=20_000, idle_ms=60_000, offline_ms=180_000)


def beats(seed=4, n=400):
    rng = random.Random(seed)
    t, rows = T0, []
    for i in range(n):
        t += timedelta(milliseconds=rng.choice([0, 5_000, 15_000, 39_999, 50_000, 4_000_000 if rng.random() < 0.05 else 1]))
        user = rng.choice(["u1", "u1", "u1", "u2"])
        rows.append((user, f"session-{rng.choice('ab')}", rng.choice(["active", "idle", "away"]), t, rng.choice([None, "box"]), "asset", str(i)))
    return rows


def in_turn(rows, cap):
    out = {}
    for user, key, state, ts, action, kind, target in sorted(rows, key=lambda r: (r[3], r[2])):
        s = out.setdefault((user, key), dict(active=0, idle=0, n=0, days={}, last=None, state=None))
        if s["last"] is not None:
            gap = min(int((ts - s["last"]) / timedelta(milliseconds=1)), cap)
            if s["state"] == "active":
                s["active"] += gap
                if gap:
                    s["days"][ts.strftime("%Y-%m-%d")] = s["days"].get(ts.strftime("%Y-%m-%d"), 0) + gap
            elif s["state"] == "idle":
                s["idle"] += gap
        s["last"], s["state"] = ts, state
        s["n"] += 1
    return {k: (v["active"], v["idle"], v["n"], v["days"], v["state"]) for k, v in out.items()}


def flat(rows):
    return {(r.user_id, r.session_key): (r.active_ms, r.idle_ms, r.heartbeats, r.active_by_date, r.last_state) for r in rows}


@pytest.mark.parametrize("limit", [9, 10**6])
def test_batch_sessions_equal_the_rule(spark, limit):
    rows = beats()
    df = spark.createDataFrame(rows, table_type("heartbeats"))
    got = presence.sessions(presence.credit_active_time(df, CADENCE, limit))
    assert flat(got.collect()) == in_turn(rows, CADENCE.credit_cap_ms)


def feed(spark, rows, source):
    spark.createDataFrame(rows, table_type("heartbeats")).coalesce(1).write.mode("append").parquet(source)


@pytest.mark.parametrize("limit", [7, 10**6])
def test_stream_sessions_equal_batch(spark, tmp_path, limit):
    rows = sorted(beats(9), key=lambda r: (r[3], r[2]))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], table_type("heartbeats")).write.parquet(source)
    for part in range(4):
        # Rows of the part before come again, and one row twice.
        again = rows[part * 100 - 20:part * 100] if part else []
        feed(spark, again + rows[part * 100:(part + 1) * 100] + rows[part * 100:part * 100 + 1], source)
        stream = read_heartbeats(spark, source, max_files_per_trigger=1)
        query = sessions.stream_sessions(stream, out, str(tmp_path / "cp"), CADENCE, "2 days", buckets=3, limit=limit)
        query.awaitTermination(200)
        assert query.exception() is None
    live = sessions.live_sessions(spark, out, CADENCE)
    assert flat(live.collect()) == in_turn(rows, CADENCE.credit_cap_ms)
    batch = presence.sessions(presence.credit_active_time(spark.createDataFrame(rows, table_type("heartbeats")), CADENCE))
    columns = ["user_id", "session_key", "started_at", "last_seen_at", "last_active_at"]
    assert sorted(live.select(columns).collect()) == sorted(batch.select(columns).collect())


def at(seconds, state="active", key="session-a", action=None):
    return ("u1", key, state, T0 + timedelta(seconds=seconds), action, "asset" if action else None, None)


def test_late_beats_count_and_credit_nothing(spark):
    held = sessions.continued(spark.createDataFrame([at(0), at(20, "idle", action="box")], table_type("heartbeats")), spark.createDataFrame([], sessions.ROW), CADENCE)
    late = spark.createDataFrame([at(5), at(-9), at(30, "away"), at(5, key="session-b")], table_type("heartbeats"))
    rows = {r.session_key: r for r in sessions.continued(late, held, CADENCE).collect()}
    a, b = rows["session-a"], rows["session-b"]
    assert (a.active_ms, a.idle_ms, a.heartbeats, a.last_state, a.last_action) == (20_000, 10_000, 5, "away", "box")
    assert a.started_at == T0 - timedelta(seconds=9) and a.last_seen_at == T0 + timedelta(seconds=30) and a.last_active_at == T0
    assert (b.active_ms, b.heartbeats, b.active_by_date) == (0, 1, {})


def test_old_sessions_are_forgotten(spark, tmp_path):
    state = sessions.session_state(spark, str(tmp_path), CADENCE, buckets=1)
    first = sessions.continued(spark.createDataFrame([at(0)], table_type("heartbeats")), state.rows(), CADENCE)
    state.update(0, first, int(T0.timestamp() * 1000))
    assert state.rows().count() == 1
    later = int((T0 + timedelta(days=CADENCE.retention_days + 1)).timestamp() * 1000)
    other = spark.createDataFrame([at(40 * 86_400, key="session-b")], table_type("heartbeats"))
    state.update(1, sessions.continued(other, state.rows([], 1), CADENCE), later)
    assert [r.session_key for r in state.rows().collect()] == ["session-b"]


# --- Keyed state


def keyed(spark, path, **more):
    schema = StructType.fromDDL("k string, v bigint")
    return KeyedState(spark, str(path), ["k"], schema, **{"buckets": 4, "layers": 3} | more)


def rows_of(state, *args):
    return dict(map(tuple, state.rows(*args).collect()))


def put(state, batch, **values):
    state.update(batch, state.spark.createDataFrame(list(values.items()), state.schema))


def test_state_equals_a_dict_and_reads_stay_bounded(spark, tmp_path):
    state, want, rng = keyed(spark, tmp_path), {}, random.Random(1)
    state.admit(spark.createDataFrame([(f"k{i}", -1) for i in range(20)], state.schema))
    want = {f"k{i}": -1 for i in range(20)}
    for batch in range(14):
        new = {f"k{rng.randrange(26)}": batch for _ in range(3)}
        touched = state.buckets_of(spark.createDataFrame([(k, 0) for k in new], state.schema))
        # A batch opens the folders of its own buckets, a bounded number of each.
        opened = state.folders(touched, batch)
        assert all(int(f.rsplit("=", 1)[1]) in touched for f in opened) and len(opened) <= 3 * len(touched)
        put(state, batch, **new)
        want |= new
        if batch % 3 == 0:
            # Repeated, as after a lost commit.
            assert {k: v for k, v in rows_of(state, None, batch).items() if v == batch} == {}
            put(state, batch, **new)
    assert rows_of(state) == want
    assert len(storage.names(spark, f"{tmp_path}/rows")) <= 3 * 4 + 3
    assert rows_of(keyed(spark, tmp_path, buckets=99)) == want


def test_rows_added_beside_the_stream_survive_a_repeat(spark, tmp_path):
    state = keyed(spark, tmp_path)
    put(state, 0, a=1)
    put(state, 1, a=2)
    state.admit(spark.createDataFrame([("a", 9), ("b", 9)], state.schema))
    assert rows_of(state) == {"a": 2, "b": 9} and rows_of(state, None, 1) == {"a": 1, "b": 9}
    put(state, 1, a=3)
    assert rows_of(state) == {"a": 3, "b": 9}


def test_days_over_many_batches(spark, tmp_path):
    state = activity.day_state(spark, str(tmp_path))
    for batch in range(30):
        days = spark.createDataFrame([(f"2026-01-{1 + batch // 4:02}", batch)], state.schema)
        state.update(batch, days)
        state.update(batch, days)
    assert {r.date: r["count"] for r in activity.newest_days(spark, str(tmp_path)).collect()} == {f"2026-01-{1 + d:02}": min(4 * d + 3, 29) for d in range(8)}
    assert len(state.folders()) <= 8 and len(storage.names(spark, f"{tmp_path}/rows")) <= 12


def test_heartbeat_rules(spark):
    rows = [("u", "session-1", "active", T0), ("u", "short", "active", T0), ("u", "session-1", "busy", T0), ("u", None, "idle", T0), (None, "session-1", "idle", T0)]
    got = [r[0] for r in spark.createDataFrame(rows, "user_id string, session_key string, state string, ts timestamp").select(heartbeat_problem()).collect()]
    assert got == [None, "invalid sessionKey", "invalid state", "sessionKey is required", "user and time are required"]


def test_activity_stream_emits_closed_days(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(T0 + timedelta(hours=7 * i),) for i in range(20)]
    spark.createDataFrame(rows, "created_at timestamp").write.parquet(source)
    stream = activity.stream_activity_by_date(spark.readStream.schema("created_at timestamp").parquet(source))
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    want = {}
    for (t,) in rows:
        want[t.strftime("%Y-%m-%d")] = want.get(t.strftime("%Y-%m-%d"), 0) + 1
    last = max(want)
    got = {r.date: r["count"] for r in spark.read.parquet(out).collect()}
    assert got == {k: v for k, v in want.items() if k != last}


def test_activity_stream_with_the_open_day(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = {}
    for part in range(3):
        rows = [(T0 + timedelta(hours=7 * (5 * part + i)),) for i in range(5)]
        spark.createDataFrame(rows, "created_at timestamp").write.mode("append").parquet(source)
        stream = activity.stream_activity_by_date(spark.readStream.schema("created_at timestamp").parquet(source))
        activity.write_days(stream, out, str(tmp_path / "cp")).awaitTermination(120)
        for (t,) in rows:
            want[t.strftime("%Y-%m-%d")] = want.get(t.strftime("%Y-%m-%d"), 0) + 1
        assert {r.date: r["count"] for r in activity.newest_days(spark, out).collect()} == want


def test_patch_stream_equals_batch(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    base = [(str(i), "d", str(i), "t", "unannotated", "english", "pending", None, None, None, None, None, None, 1, "u", "u", T0, T0) for i in range(6)]
    comments = spark.createDataFrame(base, table_type("comments"))
    options = spark.createDataFrame([("d", ["positive", "negative", "unannotated"], ["english", "unclassified"])], "dataset_id string, sentiments array<string>, types array<string>")
    schema = "comment_id string, seq long, sentiment string, type string, note string, has_note boolean, user_id string, at timestamp"
    rng = random.Random(8)
    log = [
        (str(rng.randrange(7)), i, rng.choice([None, "positive", "negative", "odd"]), None, rng.choice([None, "n"]), rng.random() < 0.4, "u", T0 + timedelta(seconds=i))
        for i in range(90)
    ]
    annotations.prepare(spark, state)
    spark.createDataFrame([], schema).write.parquet(source)
    for part in range(3):
        spark.createDataFrame(log[part * 30:(part + 1) * 30], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = annotations.stream_apply_annotations(stream, comments, options, state, str(tmp_path / "cp"))
        query.awaitTermination(200)
        assert query.exception() is None
    want = history.apply_annotations(comments, spark.createDataFrame(log, schema), options)
    pick = ["comment_id", "version", "snapshot", "changed_fields", "changed_by", "created_at"]
    got = spark.read.parquet(f"{state}/versions").select(*pick).collect()
    assert sorted(map(str, got)) == sorted(map(str, want.versions.select(*pick).collect())) and len(got) > 20
    rejects = spark.read.parquet(f"{state}/rejects").select("comment_id", "seq", "reason").collect()
    assert sorted(rejects) == sorted(want.rejects.collect())
    now = {r.comment_id: (r.sentiment, r.note, r.version, r.status) for r in annotations.current_comments(comments, state).collect()}
    assert now == {r.comment_id: (r.sentiment, r.note, r.version, r.status) for r in want.comments.collect()}


def test_import_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n in range(2):
        (folder / f"f{n}.csv").write_text("id,comment_text,sentiment,type\n" + "".join(f"r{i % 4},text {n} {i},positive,english\n" for i in range(6)))
        stream = imports.read_new_files(spark, str(folder))
        query = imports.stream_imports(stream, out, str(tmp_path / "cp"), "u", "rename", T0)
        query.awaitTermination(200)
        assert query.exception() is None
    comments = spark.read.parquet(f"{out}/comments")
    assert sorted(r.source_id for r in comments.collect()) == sorted(["r0", "r1", "r2", "r3", "r0-dup1", "r1-dup1"] * 2)
    assert spark.read.parquet(f"{out}/report").agg(F.sum("imported_rows"), F.sum("renamed_rows")).first()[:] == (12, 4)
    assert spark.read.parquet(f"{out}/rejects").count() == 0 and spark.read.parquet(f"{out}/messages").count() == 4
    assert spark.read.parquet(f"{out}/versions").count() == 12 and comments.select("dataset_id").distinct().count() == 2
