"""One test per semantic trap, on tiny hand-made frames (FIXTURES.md part D)."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyhall.functions import exprs as X
from studyhall.functions.geo import haversine_km
from studyhall.functions.links import embed_url, file_id, is_valid_url, url_class, video_id
from studyhall.functions.tokens import access_code, qr_parts
from studyhall.operators.geojoin import within_radius_join
from studyhall.operators.overlap import overlap_join
from studyhall.operators.pages import page, pg_desc
from studyhall.operators.prefix import running_count, running_sum
from studyhall.operators.topn import first_per_group

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def ts(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_page_nulls_first_on_desc_and_stable_tiebreak(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 7)], "id long, v int")
    got = [r.id for r in page(df, [pg_desc("v")], limit=3).collect()]
    assert got == [1, 4, 2]


def test_pct_zero_denominator_and_half_up(spark):
    df = spark.createDataFrame([(1, 0), (1, 16), (1, 80), (1, 3), (29, 200)], "n long, d long")
    got = [r.p for r in df.select(X.pct("n", "d").alias("p")).collect()]
    assert got == [None, Decimal("6.3"), Decimal("1.3"), Decimal("33.3"), Decimal("14.5")]


def test_avg_1dp_half_up(spark):
    df = spark.createDataFrame([(9, 2), (1, 4), (0, 0)], "s long, c long")
    assert [r.a for r in df.select(X.avg_1dp("s", "c").alias("a")).collect()] == [
        Decimal("4.5"), Decimal("0.3"), None]


def test_first_failure_takes_first_in_order_and_ignores_null(spark):
    df = spark.createDataFrame([(True, True), (None, True), (False, False)], "a boolean, b boolean")
    got = [r.d for r in df.select(X.first_failure([("A", F.col("a")), ("B", F.col("b"))]).alias("d")).collect()]
    assert got == ["A", "B", "OK"]


def test_session_clock_status_edges(spark):
    start = ts(0)
    df = spark.createDataFrame([(start, 60, "scheduled"), (start, 60, "cancelled")],
                               "scheduled_at timestamp_ntz, duration_min int, status string")
    def status_at(m):
        return [r.s for r in df.select(X.session_clock_status(ts(m).isoformat(sep=" ")).alias("s")).collect()]
    assert status_at(-1) == ["scheduled", "cancelled"]
    assert status_at(0) == ["ongoing", "cancelled"]
    assert status_at(60) == ["completed", "cancelled"]


def test_array_text_quotes_like_postgres(spark):
    df = spark.createDataFrame([(["Grade 1", "x", "a,b", ""],)], "a array<string>")
    assert df.select(X.array_text("a").alias("t")).first().t == '{"Grade 1",x,"a,b",""}'


def test_has_value_with_null_element_is_null(spark):
    df = spark.createDataFrame([(["a", None],), ([],), (None,)], "a array<string>")
    got = [r.h for r in df.select(X.has_value("a", "b").alias("h")).collect()]
    assert got == [None, False, None]


def test_link_helpers(spark):
    urls = [("https://www.youtube.com/watch?v=abc&t=1", "video"), ("https://youtu.be/xyz", "video"),
            ("https://www.youtube.com/shorts/s1", "video"), ("https://vimeo.com/1", "video"),
            ("https://drive.google.com/file/d/F1/view", "pdf"), ("https://drive.google.com/open?id=F2&x=1", "pdf"),
            ("https://docs.google.com/document/d/F3/edit", "pdf"), ("https://x.org/a.pdf", "pdf"),
            ("https://x.org", "link"), ("notes-1", "other")]
    df = spark.createDataFrame(urls, "url string, type string")
    rows = df.select(url_class("url", "type").alias("c"), video_id("url").alias("v"), file_id("url").alias("f"),
                     is_valid_url("url").alias("ok"), embed_url(file_id("url")).alias("e")).collect()
    assert [r.c for r in rows] == ["youtube", "youtube", "youtube", "unknown_video", "google_drive", "google_drive",
                                   "google_drive", "direct_pdf", "external_link", "unknown"]
    assert [r.v for r in rows[:3]] == ["abc", "xyz", "s1"]
    assert [r.f for r in rows[4:7]] == ["F1", "F2", "F3"]
    assert rows[4].e == "https://drive.google.com/file/d/F1/preview"
    assert [r.ok for r in rows][-1] is False and rows[0].ok is True


def test_qr_parts_and_access_code(spark):
    df = spark.createDataFrame([("5_7_ab12cd34",), ("5-7-x",), ("a_b",)], "q string")
    rows = df.select(*[c.alias(n) for c, n in zip(qr_parts("q"), ["ok", "stu", "ses"])]).collect()
    assert [(r.ok, r.stu, r.ses) for r in rows] == [(True, "5", "7"), (False, None, None), (False, None, None)]
    code = spark.range(1).select(access_code(F.lit(42)).alias("c")).first().c
    assert len(code) == 8 and code == code.upper()


def test_overlap_is_half_open_and_finds_each_pair_once(spark):
    left = spark.createDataFrame([(1, 7, ts(0), ts(60)), (2, 7, ts(60), ts(90)), (3, 8, ts(0), ts(300))],
                                 "lid long, lk long, ls timestamp_ntz, le timestamp_ntz")
    right = spark.createDataFrame([(10, 7, ts(30), ts(60)), (11, 7, ts(-200), ts(500)), (12, 8, ts(300), ts(400))],
                                  "rid long, rk long, rs timestamp_ntz, re timestamp_ntz")
    got = sorted((r.lid, r.rid) for r in overlap_join(left, right, [("lk", "rk")], left_start="ls", left_end="le",
                                                       right_start="rs", right_end="re", bucket_minutes=30).collect())
    # (2,10) only touch at 60 -> no clash; (3,12) touch at 300 -> no clash; (x,11) spans many buckets, counted once
    assert got == [(1, 10), (1, 11), (2, 11)]


def test_overlap_plan_has_no_nested_loop(spark):
    left = spark.createDataFrame([(1, 7, ts(0), ts(60))], "lid long, lk long, ls timestamp_ntz, le timestamp_ntz")
    right = spark.createDataFrame([(10, 7, ts(30), ts(90))], "rid long, rk long, rs timestamp_ntz, re timestamp_ntz")
    plan = overlap_join(left, right, [("lk", "rk")], left_start="ls", left_end="le", right_start="rs",
                        right_end="re")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def by_order(df, col):
    return {r.o: (r.k, r[col]) for r in df.collect()}


def test_running_sum_equals_single_window_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else None if i % 7 == 0 else rnd.randint(1, 20), i, rnd.randint(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = running_sum(df, "k", ["o"], "v", "run", n_chunks=7)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(w))
    assert by_order(got, "run") == by_order(want, "run") and got.count() == 3000
    cnt = running_count(df, "k", ["o"], "rn", n_chunks=5)
    plain = running_sum(df, "k", ["o"], "v", "run")
    assert by_order(plain, "run") == by_order(want, "run")
    w2 = Window.partitionBy("k").orderBy("o")
    want2 = df.withColumn("rn", F.row_number().over(w2))
    assert by_order(cnt, "rn") == by_order(want2, "rn")


def test_radius_join_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(29.5, 30.5), rnd.uniform(30.5, 31.5)) for i in range(200)]
    plc = [(100 + j, rnd.uniform(29.5, 30.5), rnd.uniform(30.5, 31.5)) for j in range(60)]
    plc += [(999, 89.95, 10.0), (997, 10.0, -179.99), (996, 89.99, 180.0)]
    pts += [(998, 89.9, -170.0), (995, 10.0, 179.99), (994, 89.99, 0.0)]
    p = spark.createDataFrame(pts, "pid long, lat double, lng double")
    q = spark.createDataFrame(plc, "qid long, lat double, lng double")
    km = 12.0
    got = {(r.pid, r.qid) for r in within_radius_join(p, q, km).collect()}
    brute = (p.withColumnRenamed("lat", "a").withColumnRenamed("lng", "b").crossJoin(q)
             .filter(haversine_km("a", "b", "lat", "lng") <= km).collect())
    assert got == {(r.pid, r.qid) for r in brute}
    assert (995, 997) in got            # across the antimeridian (~2.2 km)
    assert (994, 996) in got            # across the pole (~2.2 km)
    assert (998, 999) not in got        # ~16.7 km apart
    # a tiny radius close to the pole: cap keys instead of a huge longitude expansion
    near = spark.createDataFrame([(1, 89.9995, 0.0), (2, 89.9995, 170.0), (3, 89.99, 0.0)], "qid long, lat double, lng double")
    me = spark.createDataFrame([(7, 89.9996, 90.0)], "pid long, lat double, lng double")
    got_cap = {(r.pid, r.qid) for r in within_radius_join(me, near, 0.1).collect()}
    brute_cap = {(r.pid, r.qid) for r in me.withColumnRenamed("lat", "a").withColumnRenamed("lng", "b").crossJoin(near)
                 .filter(haversine_km("a", "b", "lat", "lng") <= 0.1).collect()}
    assert got_cap == brute_cap == {(7, 1), (7, 2)}


def test_first_per_group_picks_min_order(spark):
    df = spark.createDataFrame([(1, ts(5), 3), (1, ts(5), 2), (1, ts(9), 1), (2, ts(1), 8)],
                               "k long, at timestamp_ntz, id long")
    got = sorted((r.k, r.id) for r in first_per_group(df, ["k"], ["at", "id"], []).collect())
    assert got == [(1, 2), (2, 8)]


def test_detail_pages_are_bounded_and_keep_one_element_of_nulls(spark):
    import json
    from studyhall.plans.discovery import detail_pages
    flat = spark.createDataFrame([(1, None, None)] + [(2, i, f"t{i}") for i in range(47)],
                                 "center_id long, teacher_id long, teacher_name string").repartition(3)
    rows = detail_pages(flat, ["center_id"], "teacher_id", {"id": "teacher_id", "name": "teacher_name"}, "teachers").collect()
    got = {(r.center_id, r.page): json.loads(r.teachers) for r in rows}
    assert got[1, 0] == [{"id": None, "name": None}]
    assert [len(got[2, p]) for p in range(3)] == [20, 20, 7]
    assert [x["id"] for p in range(3) for x in got[2, p]] == list(range(47))


def test_payloads_of_any_shape(spark):
    from studyhall.plans.admin import payload_summary
    rows = [("a", '{"k": 1}'), ("a", '{"k": "x", "z": [1]}'), ("a", '{"k'), ("a", None), ("a", "7"), ("b", None)]
    got = {r.source: r for r in payload_summary(spark.createDataFrame(rows, "source string, payload string")).collect()}
    assert (got["a"].n_rows, got["a"].missing, got["a"].malformed, got["a"].n_values, got["a"].sum_value) == (5, 1, 1, 1, 1)
    assert got["a"].payload_schema == "VARIANT" and got["b"].n_values == 0


def test_lambert_distance_close_to_spheroid_and_haversine(spark):
    from studyhall.functions.geo import distance_km
    # Cairo -> Alexandria: ellipsoidal distance about 178.6 km
    df = spark.createDataFrame([(30.0444, 31.2357, 31.2001, 29.9187), (10.0, 10.0, 10.0, 10.0)],
                               "a double, b double, c double, d double")
    rows = df.select(distance_km("a", "b", "c", "d", "lambert").alias("l"),
                     distance_km("a", "b", "c", "d").alias("h")).collect()
    assert abs(rows[0].l - 178.6) < 1.5 and abs(rows[0].l - rows[0].h) / rows[0].h < 0.006
    assert rows[1].l == 0.0 and rows[1].h == 0.0


def test_uuid_rule_only_for_text_keys(spark, frames):
    from studyhall.functions.exprs import is_uuid
    df = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("nope",), (None,)], "x string")
    assert [r.u for r in df.select(is_uuid("x").alias("u")).collect()] == [True, False, False]


def test_is_first_in_group_with_null_keys_and_a_condition(spark):
    from studyhall.operators.topn import is_first_in_group
    df = spark.createDataFrame([(1, 3, 30), (1, 1, 10), (1, 1, 5), (2, 7, 1), (None, 2, 2), (None, 1, 9), (3, None, 1), (3, 1, 1)],
                               "k long, o1 long, o2 long")
    got = {(r.k, r.o1, r.o2) for r in is_first_in_group(df, ["k"], ["o1", "o2"]).filter("_is_first").collect()}
    assert got == {(1, 1, 5), (2, 7, 1), (None, 1, 9), (3, None, 1)}
    some = is_first_in_group(df, ["k"], ["o1", "o2"], where=F.col("o2") > 5)
    assert some.count() == 8 and some.columns == ["k", "o1", "o2", "_is_first"]
    assert {(r.k, r.o1, r.o2) for r in some.filter("_is_first").collect()} == {(1, 1, 10), (None, 1, 9)}


def test_overlap_of_all_lengths_equals_brute_force(spark):
    rnd = random.Random(5)

    def rows(n, base):
        out = []
        for i in range(n):
            start = rnd.randint(-10**6, 10**6)
            out.append((base + i, rnd.choice([7, 8, None]), ts(start), ts(start + rnd.choice(
                [0, 1, 30, 90, 240, 241, 5000, 15360, 15361, 10**6, 10**7]))))
        return out
    a, b = rows(160, 0), rows(160, 1000) + [(2000, 7, ts(0), None)]
    left = spark.createDataFrame(a, "lid long, lk long, ls timestamp_ntz, le timestamp_ntz")
    right = spark.createDataFrame(b, "rid long, rk long, rs timestamp_ntz, re timestamp_ntz")
    got = [(r.lid, r.rid) for r in overlap_join(left, right, [("lk", "rk")], left_start="ls", left_end="le",
                                                right_start="rs", right_end="re").collect()]
    want = {(x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and y[3] is not None
            and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_radius_join_near_poles_and_antimeridian_equals_brute_force(spark):
    rnd = random.Random(11)

    def place():
        lat = rnd.choice([rnd.uniform(-90, 90), rnd.uniform(88, 90), rnd.uniform(-90, -89), rnd.uniform(69.5, 70.1), 90.0, -90.0])
        lng = rnd.choice([rnd.uniform(-180, 180), rnd.uniform(179, 180), rnd.uniform(-180, -179), 180.0, -180.0])
        return lat, lng
    p = spark.createDataFrame([(i, *place()) for i in range(250)] + [(9000, 69.8, -179.9999)], "pid long, lat double, lng double")
    q = spark.createDataFrame([(i, *place()) for i in range(250)] + [(9001, 69.8, 179.4)], "qid long, lat double, lng double")
    for km in (0.5, 25.0, 300.0, 2500.0):
        got = [(r.pid, r.qid) for r in within_radius_join(p, q, km).collect()]
        brute = {(r.pid, r.qid) for r in p.withColumnRenamed("lat", "a").withColumnRenamed("lng", "b").crossJoin(q)
                 .filter(haversine_km("a", "b", "lat", "lng") <= km).collect()}
        assert len(got) == len(set(got)) and set(got) == brute, km
        assert km != 25.0 or (9000, 9001) in brute


def test_dashboards_on_empty_tables_give_one_row_of_zeros(spark, frames):
    from studyhall.plans import admin
    from studyhall.sources.tables import SCHEMAS
    t = frames()
    for name in ("users", "centers", "sessions", "bookings", "rooms", "teachers", "wallet_transactions"):
        t[name] = spark.createDataFrame([], SCHEMAS[name])
    row = admin.platform_analytics(t).collect()
    assert len(row) == 1 and all(v == 0 for v in row[0].asDict().values())
    assert admin.platform_summary(t).first().total_revenue == 0
    assert admin.user_search_count(t, role="student").first().total == 0


def test_null_booleans_count_as_not_true(spark, frames):
    from studyhall.plans import admin, discovery
    from studyhall.sources.tables import SCHEMAS
    t = frames()
    cols = [f.name for f in SCHEMAS["centers"].fields]
    base = dict.fromkeys(cols)
    rows = [dict(base, id=1, owner_id=9, name="a", lat=30.0, lng=31.0, is_active=True),
            dict(base, id=2, owner_id=9, name="b", lat=30.0, lng=31.0, is_active=None)]
    t["centers"] = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMAS["centers"])
    assert admin.center_counts(t).first().asDict() == {"total_centers": 2, "active_centers": 1}
    got = discovery.nearby_centers(t, lat=30.0, lng=31.0, km=5).collect()
    assert [r.id for r in got] == [1]


def test_overlap_join_with_long_intervals(spark):
    from studyhall.operators import overlap as O
    day = 24 * 60
    left = spark.createDataFrame([(1, 7, ts(0), ts(60)), (2, 7, ts(-10 * day), ts(10 * day)), (3, 7, ts(5000), ts(5030))],
                                 "lid long, lk long, ls timestamp_ntz, le timestamp_ntz")
    right = spark.createDataFrame([(10, 7, ts(30), ts(90)), (11, 7, ts(-3 * day), ts(3 * day)), (12, 7, ts(5010), ts(5020)),
                                   (13, 8, ts(0), ts(60))],
                                  "rid long, rk long, rs timestamp_ntz, re timestamp_ntz")
    got = sorted((r.lid, r.rid) for r in O.overlap_join(left, right, [("lk", "rk")], left_start="ls", left_end="le",
                                                         right_start="rs", right_end="re").collect())
    brute = sorted((r.lid, r.rid) for r in left.crossJoin(right).filter(
        "lk = rk AND ls < re AND rs < le").collect())
    assert got == brute == [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 12)]


def test_booking_pages_shuffle_the_bookings_before_they_are_wide(tables):
    # The stored bookings are joined last, to sessions that have their teacher and centre; a teacher or centre is never looked up
    # for each booking.
    from studyhall.plans.center import student_bookings_summary
    from studyhall.plans.rooms import booking_history
    for frame in (booking_history(tables), student_bookings_summary(tables)):
        joins = [line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        assert "session_id" in joins[0], joins


def test_overlap_lists_only_roles_that_the_other_side_can_meet(spark):
    """Intervals of one level on both sides are listed in one role, not in two."""
    left = spark.createDataFrame([(1, 7, ts(0), ts(60)), (2, 7, ts(500), ts(530))],
                                 "lid long, lk long, ls timestamp_ntz, le timestamp_ntz")
    right = spark.createDataFrame([(10, 7, ts(30), ts(90))], "rid long, rk long, rs timestamp_ntz, re timestamp_ntz")
    pairs = overlap_join(left, right, [("lk", "rk")], left_start="ls", left_end="le", right_start="rs", right_end="re")
    assert [(r.lid, r.rid) for r in pairs.collect()] == [(1, 10)]
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "struct(role, l, level" in plan and "struct(role, r, level" not in plan
