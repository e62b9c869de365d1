import csv
import io
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from labelmill.operators import ingest
from labelmill.sources.comment_csv import normalize_headers, read_comment_csv, read_records
from labelmill.sources.listing import file_checksums

NOW = datetime(2026, 2, 1)

CSV = '''\ufeffId,Comment Text,SENTIMENT,type
r1,This product is amazing,positive,english
r2,Worst purchase ever,negative,english
r3,It is okay,neutral,english

r4,অসাধারণ পণ্য,positive,bangla
r5,খুব খারাপ,negative,bangla
r6,"Onek
bhalo, ""ok""",neutral,banglish
r1,Duplicate row should be skipped,neutral,english
,empty id row should be skipped,neutral,english
r8,,neutral,english
'''


@pytest.fixture(scope="module")
def csv_rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    (folder / "Bank.CSV").write_text(CSV, encoding="utf-8")
    return read_comment_csv(spark, str(folder))


def test_csv_keeps_file_order_and_quoted_newlines(csv_rows):
    rows = sorted(csv_rows.collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in rows] == list(range(9))
    assert [r.id for r in rows] == ["r1", "r2", "r3", "r4", "r5", "r6", "r1", None, "r8"]
    assert rows[5].comment_text == 'Onek\nbhalo, "ok"' and rows[3].comment_text == "অসাধারণ পণ্য"


def test_csv_without_multiline_numbers_split_files(spark, tmp_path):
    body = "id,text\n" + "".join(f"{i},line {i}\n" for i in range(5000))
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text("id,text\nx,one\ny,two\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_comment_csv(spark, str(tmp_path), multiline=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = {int(r.id): r.row_no for r in rows if r.file.endswith("a.csv")}
    assert a == {i: i for i in range(5000)}
    assert {r.id: r.row_no for r in rows if r.file.endswith("b.csv")} == {"x": 0, "y": 1}


def quoted_file(seed, rows):
    """Random cells of commas, quotes and line ends, as the csv module writes them, and stray quotes inside bare cells."""
    rng, out = random.Random(seed), io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["Id", "Comment Text", "sentiment", "type"])
    cell = lambda: "".join(rng.choices(['"', ",", "\n", "a", "b c", '""', "é"], k=rng.randint(1, 9))).strip() or "x"
    for i in range(rows):
        writer.writerow([f"r{i}", cell(), rng.choice(["positive", "5 in", "x\n\ny"]), "english"])
        if i % 7 == 0:
            out.write(f's{i},12" pipe,a"b,\n\n')
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_file_read_by_many_tasks_equals_one_task(spark, tmp_path, seed):
    text = quoted_file(seed, 400)
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_text('text,ID\n"only\none",1\n')
    (tmp_path / "c.csv").write_text("id,text")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def read(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_comment_csv(spark, str(tmp_path)).collect()
            tasks = read_records(spark, str(tmp_path)).select("record").count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert tasks == len(rows) + 3
        return sorted((r.file[-5:], r.row_no, r.id, r.comment_text, r.sentiment, r.type) for r in rows)

    whole, split = read("128m"), read("700")
    assert whole == split
    # The csv module opens a quote only at a cell's start too.
    want = [r for r in csv.reader(io.StringIO(text, newline=""))][1:]
    want = [[(c.replace("\r\n", "\n").strip() or None) for c in r] for r in want if r]
    assert [list(r[2:]) for r in whole if r[0] == "a.csv"] == want
    assert [r[1] for r in whole if r[0] == "a.csv"] == list(range(len(want)))
    assert [r[2:] for r in whole if r[0] == "b.csv"] == [("1", "only\none", None, None)]


def test_one_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(quoted_file(9, 3000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "a.csv"))
        assert lines.rdd.getNumPartitions() > 8
        rows = read_comment_csv(spark, str(tmp_path)).select("row_no").orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.row_no for r in rows] == list(range(len(rows))) and len(rows) >= 3000


def test_last_header_spelling_wins(spark):
    df = spark.createDataFrame([("1", "a", "b", "c", "z")], "`I D` string, comment string, TEXT string, Sentiment string, junk string")
    row = normalize_headers(df).first()
    assert (row.id, row.comment_text, row.sentiment, row.type) == ("1", "b", "c", None)


@pytest.mark.parametrize("strategy,imported,skipped,renamed", [("skip", 6, 3, 0), ("rename", 7, 2, 1)])
def test_import_counts(csv_rows, strategy, imported, skipped, renamed):
    rows = csv_rows.withColumn("dataset_id", F.lit("d")).drop("file")
    result = ingest.import_comments(rows, "u", NOW, strategy)
    report = result.report.first()
    assert (report.total_rows, report.imported_rows, report.skipped_rows, report.renamed_rows) == (9, imported, skipped, renamed)
    assert report.status == "completed" and result.versions.count() == imported
    expected = 'Row 8: duplicate id "r1" ' + ("skipped" if strategy == "skip" else 'renamed to "r1-dup1"')
    assert report.import_errors == [expected]
    first = result.comments.where("source_id = 'r6'").first()
    assert (first.sentiment, first.type, first.status, first.annotated_by) == ("neutral", "banglish", "annotated", "u")


def test_existing_keys_are_skipped_and_reruns_agree(csv_rows):
    rows = csv_rows.withColumn("dataset_id", F.lit("d")).drop("file")
    first = ingest.import_comments(rows, "u", NOW)
    again = ingest.import_comments(rows, "u", NOW, existing=first.comments.where("source_id <> 'r2'"))
    assert [r.source_id for r in again.comments.collect()] == ["r2"]
    assert again.report.first().skipped_rows == 8
    ids = {r.comment_id for r in first.comments.collect()}
    assert ids >= {r.comment_id for r in again.comments.collect()} and all(len(i) == 24 for i in ids)


def test_nothing_valid_fails(spark):
    rows = spark.createDataFrame([("d", 0, "", "x", None, None), ("d", 1, "a", " ", None, None)], "dataset_id string, row_no long, id string, comment_text string, sentiment string, type string")
    report = ingest.import_comments(rows, "u", NOW).report.first()
    assert (report.status, report.import_error, report.skipped_rows) == ("failed", "No valid rows found", 2)


def test_options_replace_default_labels(spark):
    rows = spark.createDataFrame([("d", 0, "a", "x", " HAPPY ", "en"), ("d", 1, "b", "x", "positive", "fr")], "dataset_id string, row_no long, id string, comment_text string, sentiment string, type string")
    options = spark.createDataFrame([("d", ["happy", "unannotated"], ["en", "unclassified"])], "dataset_id string, sentiments array<string>, types array<string>")
    got = {r.source_id: (r.sentiment, r.type, r.status) for r in ingest.import_comments(rows, "u", NOW, options=options).comments.collect()}
    assert got == {"a": ("happy", "en", "annotated"), "b": ("unannotated", "unclassified", "pending")}


def test_preview(csv_rows, spark, tmp_path):
    p = ingest.import_preview(csv_rows).first()
    assert (p.total_rows, p.valid_rows, p.missing_id_or_text, p.duplicates, p.unique_duplicate_count) == (9, 6, 2, 1, 1)
    assert p.duplicate_ids == ["r1"] and p.errors == ['Row 8: duplicate id "r1" (first at row 2)']
    assert [s.source_id for s in p.sample] == ["r1", "r2", "r3", "r4", "r5", "r6"] and p.suggested_name == "Bank"
    (tmp_path / "x.csv").write_bytes(b"abc")
    digest = file_checksums(spark, str(tmp_path)).first().checksum
    assert digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def rename_in_turn(rows):
    """The rule, one row at a time."""
    raw = {i.strip() for i, _ in rows if i.strip()}
    used, out = set(), []
    for i, text in rows:
        i = i.strip()
        if not i or not text:
            out.append((i, "missing"))
            continue
        outcome = "keep"
        if i in used:
            n = 1
            while f"{i}-dup{n}" in raw or f"{i}-dup{n}" in used:
                n += 1
            i, outcome = f"{i}-dup{n}", "renamed"
        used.add(i)
        out.append((i, outcome))
    return out


@pytest.mark.parametrize("limit", [4, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_rename_equals_the_rule_in_turn(spark, seed, limit):
    rng = random.Random(seed)
    names = ["x", "x", "x", "y", "x-dup1", "x-dup3", "x-dup3", "x-dup4", "x-dup1-dup1", "x-dup03", "y-dup2", "", " x "]
    rows = [(rng.choice(names), rng.choice(["t", "t", "t", ""])) for _ in range(120)]
    df = spark.createDataFrame([("f", n, i, t, None, None) for n, (i, t) in enumerate(rows)], "file string, row_no long, id string, comment_text string, sentiment string, type string")
    got = ingest.dedupe_rows(df, "file", "rename", limit).orderBy("row_no").collect()
    assert [(r.source_id, r.outcome) for r in got] == rename_in_turn(rows)


def moved_texts(plan):
    """Exchanges of a plan that carry a text column."""
    blocks = plan.split("\n\n")
    return [b for b in blocks if re.match(r"\(\d+\) (Shuffle)?Exchange", b) and re.search(r"(comment_text|text)#", b)]


@pytest.mark.parametrize("strategy", ["skip", "rename"])
def test_import_moves_no_text(spark, monkeypatch, strategy):
    rows = [("d", i, f"r{i % 40}", f"text {i}" if i % 9 else "", "positive", "english") for i in range(60)]
    df = spark.createDataFrame(rows, "dataset_id string, row_no long, id string, comment_text string, sentiment string, type string")
    existing = spark.createDataFrame([("d", "r3"), ("d", "r6-dup1"), ("e", "r7"), ("d", "r3")], "dataset_id string, source_id string")
    plans, keep = [], ingest.staged

    def noted(table, name):
        if name == "import":
            plans.append(spark._jvm.PythonSQLUtils.explainString(table._jdf.queryExecution(), "formatted"))
        return keep(table, name)

    monkeypatch.setattr(ingest, "staged", noted)
    result = ingest.import_comments(df, "u", NOW, strategy, existing=existing)
    assert len(plans) == 1 and moved_texts(plans[0]) == []
    monkeypatch.setattr(ingest, "broadcast_if_small", lambda table: table.hint("shuffle_hash"))
    again = ingest.import_comments(df, "u", NOW, strategy, existing=existing)
    assert len(moved_texts(plans[1])) == 1
    for name in ("comments", "rejects", "messages", "report"):
        assert sorted(map(str, getattr(result, name).collect())) == sorted(map(str, getattr(again, name).collect()))
    reasons = {r.source_id: r.reason for r in result.rejects.collect() if r.reason == "exists"}
    assert reasons == ({"r3": "exists", "r6-dup1": "exists"} if strategy == "rename" else {"r3": "exists"})
