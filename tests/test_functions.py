import pytest
from pyspark.sql import functions as F

from labelmill.functions import geometry, labels, numbers, text
from labelmill.functions.presence import Cadence, age_status


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(values):
    return [F.lit(v).cast("double") for v in values]


def test_half_up_is_on_the_double(spark):
    row = one(
        spark, numbers.half_up(F.lit(1.005), 2).alias("a"), numbers.half_up(F.lit(2.5)).alias("b"),
        numbers.half_up(F.lit(-2.5)).alias("c"), numbers.percent(F.lit(1), F.lit(3)).alias("d"),
        numbers.percent(F.lit(0), F.lit(0)).alias("e"), numbers.ratio(F.lit(2), F.lit(3)).alias("f"),
    )
    assert tuple(row) == (1.0, 3.0, -2.0, 33.3, 0.0, 0.67)


@pytest.mark.parametrize(
    "value,shown", [(0.2, "0.2"), (1.0, "1"), (100.0, "100"), (0.00005, "0.00005"), (0.0, "0"), (12.5, "12.5")]
)
def test_plain_number(spark, value, shown):
    assert one(spark, numbers.plain_number(F.lit(value)))[0] == shown


def test_trim_strips_unicode_space_and_keeps_inner(spark):
    assert one(spark, text.trimmed(F.lit(" 　﻿ a b\t\n ")))[0] == "a b"


def test_near_copy_key(spark):
    row = one(
        spark, text.near_dup_key(F.lit("  " + "Ab" * 50), 80).alias("a"), text.near_dup_key(F.lit(" \n ")).alias("b"),
        text.near_dup_key(F.lit(None).cast("string")).alias("c"),
    )
    assert row.a == "ab" * 40 and row.b is None and row.c is None


def test_slugs(spark):
    row = one(
        spark, text.slug(F.lit("  Very  Good! ")).alias("a"), text.slug(F.lit("x" * 70)).alias("b"),
        labels.class_slug(F.lit("Café au-lait")).alias("c"), labels.class_slug(F.lit("日本")).alias("d"),
        text.safe_base_name(F.lit("Bank reviews (2026)/á-b")).alias("e"),
        text.clip_preview(F.lit("x" * 201)).alias("f"),
    )
    assert (row.a, row.c, row.d, row.e) == ("very_good", "cafe_au_lait", "", "Bank_reviews_2026_-b")
    assert len(row.b) == 70 and row.f == "x" * 200 + "…"


def test_label_colors(spark):
    rows = spark.range(4).select(labels.label_color(F.col("id"))).collect()
    assert [r[0] for r in rows] == [
        "hsl(0, 65%, 55%)", "hsl(138, 65%, 55%)", "hsl(275, 65%, 55%)", "hsl(53, 65%, 55%)"
    ]


@pytest.mark.parametrize(
    "lengths,bounds,expected",
    [
        ([3, 3, 12, 250], [0, 10, 50, 100], {"0–9": 2, "10–49": 1, "100+": 1}),
        ([10, 49], [0, 10, 50], {"10–49": 2}),
        ([500], [0, 100, 200], {"200+": 1}),
        ([], [0, 100, 200], {}),
        ([1], [100, 200], {"200+": 1}),
    ],
)
def test_length_buckets(spark, lengths, bounds, expected):
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = df.groupBy(text.length_bucket(F.col("n"), bounds)["label"].alias("l")).count().collect()
    assert {r.l: r["count"] for r in got} == expected


def test_length_counts_code_points(spark):
    assert one(spark, F.length(F.lit("😀é")))[0] == 2


@pytest.mark.parametrize(
    "value,guarded,plain",
    [
        (None, "", ""), ("a", "a", "a"), ("=1+1", "'=1+1", "=1+1"), ("-x", "'-x", "-x"), ('a"b', '"a""b"', '"a""b"'),
        ("a,b", '"a,b"', '"a,b"'), ("a\rb", '"a\rb"', "a\rb"), ("@a,b", '"\'@a,b"', '"@a,b"'), ("a\nb", '"a\nb"', '"a\nb"'),
    ],
)
def test_csv_cells(spark, value, guarded, plain):
    v = F.lit(value).cast("string")
    assert tuple(one(spark, text.csv_cell_guarded(v).alias("g"), text.csv_cell_plain(v).alias("p"))) == (guarded, plain)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "box,clamp,expected",
    [
        ((0.1, 0.2, 0.3, 0.4), True, (0.1, 0.2, 0.3, 0.4)),
        ((-0.5, 0.1, 0.4, 0.2), True, (0.0, 0.1, 0.4, 0.2)),
        ((-0.5, 0.9, 2.0, 0.5), True, (0.0, 0.9, 1.0, 0.1)),
        ((1.5, 0.0, 0.5, 0.5), True, geometry.OUTSIDE),
        ((0.1, 0.1, 0.0, 0.5), True, geometry.NOT_POSITIVE),
        ((0.1, 0.1, 0.5, -1.0), True, geometry.NOT_POSITIVE),
        ((NAN, 0.1, 0.5, 0.5), True, geometry.NOT_NUMERIC),
        ((0.1, INF, 0.5, 0.5), True, geometry.NOT_NUMERIC),
        ((0.1, None, 0.5, 0.5), True, geometry.NOT_NUMERIC),
        ((-0.1, 0.0, 0.5, 0.5), False, geometry.OFF_CANVAS),
        ((0.6, 0.0, 0.5, 0.5), False, geometry.OFF_CANVAS),
        ((0.5, 0.0, 0.5, 0.5), False, (0.5, 0.0, 0.5, 0.5)),
    ],
)
def test_normalize_box(spark, box, clamp, expected):
    row = one(spark, geometry.normalize_box(*lits(box), clamp=clamp).alias("n")).n
    if isinstance(expected, str):
        assert row.reason == expected and row.box is None
    else:
        assert row.reason is None and tuple(row.box) == expected


def test_box_conversions(spark):
    b = geometry.box(*lits((0.1, 0.1, 0.2, 0.4)))
    c = geometry.box(*lits((0.5, 0.25, 0.25, 0.5)))
    row = one(
        spark, geometry.to_yolo(b).alias("yolo"), geometry.to_pixels(c, F.lit(1000), F.lit(800)).alias("px"),
        geometry.to_pixels(c, F.lit(0), F.lit(100)).alias("none"), geometry.box_area(b).alias("area"),
    )
    assert tuple(row.yolo) == (0.2, 0.3, 0.2, 0.4)
    assert tuple(row.px) == (500.0, 200.0, 250.0, 400.0) and row.none is None and row.area == 0.08


def test_pixels_round_trip(spark):
    px = geometry.to_pixels(geometry.box(*lits((0.25, 0.5, 0.25, 0.25))), F.lit(800), F.lit(600))
    back = geometry.from_pixels(px["x"], px["y"], px["width"], px["height"], F.lit(800), F.lit(600))
    assert tuple(one(spark, back["box"].alias("b")).b) == (0.25, 0.5, 0.25, 0.25)
    refused = geometry.from_pixels(*lits((1, 1, 1, 1)), F.lit(0), F.lit(10))
    assert one(spark, refused["reason"])[0] == geometry.NO_DIMENSIONS


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ((0, 0, 0.5, 0.5), (0, 0, 0.5, 0.5), 1.0), ((0, 0, 0.2, 0.2), (0.5, 0.5, 0.2, 0.2), 0.0),
        ((0, 0, 0.5, 0.5), (0.25, 0, 0.5, 0.5), 0.333333), ((0, 0, 0.5, 0.5), (0.5, 0, 0.5, 0.5), 0.0),
    ],
)
def test_iou(spark, a, b, expected):
    left, right = geometry.box(*lits(a)), geometry.box(*lits(b))
    assert tuple(one(spark, geometry.iou(left, right).alias("a"), geometry.iou(right, left).alias("b"))) == (expected,) * 2


@pytest.mark.parametrize(
    "frame,ms,duration,expected",
    [
        (30, 1000.4, 65000, (30, 1000)), (None, 70000, 65000, geometry.PAST_END), (None, -1, None, geometry.NEGATIVE_TIME),
        (1.5, 10, None, geometry.FRACTIONAL_FRAME), (-1, 10, None, geometry.NEGATIVE_FRAME),
        (3, None, None, geometry.FRAME_NEEDS_DURATION), (3, None, 0, (3, None)), (None, None, None, (None, None)),
        (None, NAN, None, geometry.BAD_TIME),
    ],
)
def test_normalize_frame(spark, frame, ms, duration, expected):
    row = one(spark, geometry.normalize_frame(*lits((frame, ms, duration))).alias("f")).f
    if isinstance(expected, str):
        assert row.reason == expected and row.frame_index is None
    else:
        assert row.reason is None and (row.frame_index, row.timestamp_ms) == expected


def test_status_and_labels(spark):
    row = one(
        spark, labels.derive_status(F.lit("positive"), F.lit("english")).alias("a"),
        labels.derive_status(F.lit("positive"), F.lit("unclassified")).alias("b"),
        labels.coerce_label(F.lit(" Positive\n"), ["positive"], "unannotated").alias("c"),
        labels.coerce_label(F.lit("odd"), ["positive"], "unannotated").alias("d"),
        labels.coerce_label(F.lit(None).cast("string"), ["positive"], "unannotated").alias("e"),
    )
    assert tuple(row) == ("annotated", "pending", "positive", "unannotated", "unannotated")


def test_age_status_ladder(spark):
    rows = spark.createDataFrame([(0,), (59,), (60,), (179,), (180,)], "age int")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    seen = F.timestamp_seconds(F.lit(1_700_000_000) - F.col("age"))
    got = [r[0] for r in rows.select(age_status(seen, F.lit("away"), now)).collect()]
    assert got == ["away", "away", "idle", "idle", "offline"]
    with pytest.raises(ValueError):
        Cadence(heartbeat_ms=60_000, idle_ms=60_000)
