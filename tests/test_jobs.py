"""Decision jobs on hand-made tables: in-batch competition, window edges, merges, deletes."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from studyhall.jobs import attendance, bookings, ledger, maintenance, rooms, schedule

AS_OF = "2024-01-01 08:00:00"
START = dt.datetime(2024, 1, 1, 10, 0, 0)


def at(minutes, seconds=0):
    return START + dt.timedelta(minutes=minutes, seconds=seconds)


SESSIONS = "id long, center_id long, teacher_id long, grade_level string, subject string, " \
           "scheduled_at timestamp_ntz, duration_min int, capacity int, seats_booked int, price decimal(10,2), " \
           "status string"
BOOKINGS = "id long, session_id long, student_id long, status string, qr_code string, amount_paid decimal(10,2), " \
           "booked_at timestamp_ntz, cancelled_at timestamp_ntz"
LEDGER = "id long, user_id long, amount decimal(10,2), type string, status string, reference_id long, " \
         "reference_type string, created_at timestamp_ntz"


def base_tables(spark, frames, sessions=None, books=None, led=None):
    t = frames()
    t["sessions"] = spark.createDataFrame(sessions or [
        (1, 1, 7, "Grade 1", "math", at(0), 60, 2, 0, Decimal("10.00"), "scheduled"),
        (2, 1, 7, "Grade 1", "math", at(-600), 60, 5, 0, Decimal("10.00"), "completed"),
    ], SESSIONS)
    t["bookings"] = spark.createDataFrame(books or [], BOOKINGS)
    t["wallet_transactions"] = spark.createDataFrame(led or [
        (1, 100, Decimal("15.00"), "deposit", "completed", None, None, at(-900)),
        (2, 101, Decimal("50.00"), "deposit", "completed", None, None, at(-900)),
        (3, 102, Decimal("50.00"), "deposit", "completed", None, None, at(-900)),
        (4, 102, Decimal("45.00"), "transfer", "completed", None, None, at(-900)),
    ], LEDGER)
    t["centers"] = spark.createDataFrame([(1, 9001)], "id long, owner_id long")
    t["users"] = spark.createDataFrame([(u, "student") for u in (100, 101, 102, 103)], "id long, role string")
    return t


def decide(df, key="request_id"):
    return {r[key]: r.decision for r in df.collect()}


def test_admit_two_requests_for_the_last_seat_and_one_purse(spark, frames):
    t = base_tables(spark, frames, books=[(50, 1, 103, "confirmed", "103_1_x", Decimal("10"), at(-900), None)])
    req = spark.createDataFrame([
        (1, 1, 100, at(-300)),   # first for the last free seat (capacity 2, one taken)
        (2, 1, 101, at(-200)),   # too late for a seat
        (3, 1, 100, at(-100)),   # duplicate of request 1: it finds the session full, which is checked first
        (4, 2, 101, at(-100)),   # completed session
        (5, 9, 101, at(-100)),   # unknown session
        (6, 1, 103, at(-100)),   # already booked, but full by then
    ], "request_id long, session_id long, student_id long, requested_at timestamp_ntz")
    got = decide(bookings.admit_bookings(t, req, as_of=AS_OF))
    assert got == {1: "OK", 2: "SESSION_FULL", 3: "SESSION_FULL", 4: "NOT_AVAILABLE", 5: "NOT_FOUND",
                   6: "SESSION_FULL"}
    spare = spark.createDataFrame([(6, 1, 103, at(-400)), (7, 1, 100, at(-300)), (8, 1, 100, at(-200))], req.schema)
    assert decide(bookings.admit_bookings(t, spare, as_of=AS_OF)) == {6: "ALREADY_BOOKED", 7: "OK", 8: "SESSION_FULL"}


def test_admit_running_balance_excludes_transfer(spark, frames):
    sessions = [(s, 1, 7, "Grade 1", "math", at(0), 60, 5, 0, Decimal("30.00"), "scheduled") for s in (1, 2, 3)]
    t = base_tables(spark, frames, sessions=sessions)
    req = spark.createDataFrame([(1, 1, 101, at(-3)), (2, 2, 101, at(-2)), (3, 3, 102, at(-1))],
                                "request_id long, session_id long, student_id long, requested_at timestamp_ntz")
    got = decide(bookings.admit_bookings(t, req, as_of=AS_OF))
    # 101 has 50: first 30 fits, second would need 60; 102 has 50 deposit (+45 transfer not spendable)
    assert got == {1: "OK", 2: "INSUFFICIENT_BALANCE", 3: "OK"}
    out = bookings.admission_outputs(t, bookings.admit_bookings(t, req, as_of=AS_OF), as_of=AS_OF)
    assert out["wallet_transactions"].count() == 4  # charge + owner transfer per OK


def test_scan_window_edges_and_second_scan(spark, frames):
    books = [(b, 1, 100 + b, "confirmed", f"{100 + b}_1_k{b}", Decimal("10"), at(-900), None) for b in range(1, 6)]
    books.append((6, 1, 106, "attended", "106_1_k6", Decimal("10"), at(-900), None))
    t = base_tables(spark, frames, books=books)
    t["users"] = spark.createDataFrame([(u,) for u in range(100, 110)], "id long")
    scans = spark.createDataFrame([
        (1, "101_1_k1", 1, at(-15)),          # exactly 15 min early: allowed
        (2, "102_1_k2", 1, at(-15, -1)),      # one second earlier: too early
        (3, "103_1_k3", 1, at(60)),           # exactly at the end: allowed
        (4, "104_1_k4", 1, at(60, 1)),        # one second after the end
        (5, "101_1_k1", 1, at(10)),           # second scan of booking 1
        (6, "105-1-k5", 1, at(0)),            # malformed
        (7, "105_1_k5", 2, at(0)),            # wrong centre
        (8, "106_1_k6", 1, at(0)),            # already attended
    ], "scan_id long, qr_code string, center_id long, scanned_at timestamp_ntz")
    got = decide(attendance.validate_scans(t, scans), "scan_id")
    assert got == {1: "OK", 2: "TOO_EARLY", 3: "OK", 4: "OUTSIDE_TIME_WINDOW", 5: "ALREADY_ATTENDED",
                   6: "BAD_FORMAT", 7: "FORBIDDEN", 8: "ALREADY_ATTENDED"}
    notes = attendance.scan_outputs(t, attendance.validate_scans(t, scans))["notifications"].collect()
    missed = [n.message for n in notes if n.type == "session_missed"]
    assert missed == ["You missed your session on 1/1/2024, 10:00:00 AM. Please contact the center for rescheduling."]


def test_cancel_booking_rules(spark, frames):
    books = [(1, 1, 100, "confirmed", "a", Decimal("0.00"), at(-900), None),
             (2, 1, 101, "attended", "b", Decimal("10.00"), at(-900), None),
             (3, 2, 102, "pending", "c", Decimal("10.00"), at(-900), None)]
    t = base_tables(spark, frames, books=books)
    req = spark.createDataFrame([(1, 1, 100, at(-5)), (2, 1, 100, at(-4)), (3, 2, 101, at(-3)), (4, 1, 999, at(-2)),
                                 (5, 3, 102, at(-1)), (6, 77, 100, at(-1))],
                                "request_id long, booking_id long, student_id long, requested_at timestamp_ntz")
    rows = {r.request_id: (r.decision, r.refund) for r in bookings.cancel_bookings(t, req, as_of=AS_OF).collect()}
    assert rows == {1: ("OK", Decimal("0.00")), 2: ("NOT_CANCELLABLE", None), 3: ("NOT_CANCELLABLE", None),
                    4: ("FORBIDDEN", None), 5: ("ALREADY_STARTED", None), 6: ("NOT_FOUND", None)}


def test_session_conflicts_touching_and_self(spark, frames):
    t = base_tables(spark, frames)
    cands = spark.createDataFrame([
        (1, None, 1, 7, "math", "Grade 1", at(60), 30),    # touches session 1's end: no clash
        (2, None, 1, 7, "math", "Grade 1", at(30), 30),    # teacher busy
        (3, 1, 1, 7, "math", "Grade 1", at(10), 30),       # update of session 1 itself
        (4, None, 1, 8, "math", "Grade 1", at(30), 30),    # other teacher, same centre + grade
    ], "candidate_id long, session_id long, center_id long, teacher_id long, subject string, grade_level string, "
       "scheduled_at timestamp_ntz, duration_min int")
    got = decide(schedule.session_conflicts(t, cands), "candidate_id")
    assert got == {1: "OK", 2: "TEACHER_BUSY", 3: "OK", 4: "GRADE_OVERLAP"}


def test_apply_patches_latest_wins_and_null_keeps(spark):
    table = spark.createDataFrame([(1, "a", True, at(0)), (2, "b", True, at(0))],
                                  "id long, name string, is_active boolean, updated_at timestamp_ntz")
    patches = spark.createDataFrame([(1, "x", None, at(5)), (1, None, False, at(9)), (3, "z", None, at(1))],
                                    "id long, name string, is_active boolean, patched_at timestamp_ntz")
    got = {r.id: (r.name, r.is_active, r.updated_at) for r in maintenance.apply_patches(table, patches).collect()}
    # each column takes its own latest non-NULL value, as when the patches are applied one by one
    assert got == {1: ("x", False, at(9)), 2: ("b", True, at(0))}
    over = {r.id: r.name for r in maintenance.apply_patches(table, patches, mode="overwrite").collect()}
    assert over == {1: None, 2: "b"}


def test_delete_restrict_cascade_and_set_null(spark, frames):
    t = frames()
    t["centers"] = spark.createDataFrame([(1, 9001), (2, 9002)], "id long, owner_id long")
    t["sessions"] = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 2, 7)], "id long, center_id long, teacher_id long")
    t["bookings"] = spark.createDataFrame([(10, 1, 100)], "id long, session_id long, student_id long")
    t["center_teachers"] = spark.createDataFrame([(1, 7), (2, 7)], "center_id long, teacher_id long")
    t["rooms"] = spark.createDataFrame([(5, 2, 7)], "id long, center_id long, teacher_id long")
    t["room_members"] = spark.createDataFrame([(50, 5, 100)], "id long, room_id long, student_id long")
    t["content_items"] = spark.createDataFrame([(60, 5, None)], "id long, room_id long, teacher_content_id long")
    # sessions: 1 has a booking (RESTRICT), 2 is free, 3 belongs to centre 2 but is asked by centre 1
    req = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 1)], "request_id long, id long, owner long")
    out = maintenance.delete_rows(t, "sessions", req, owner_col="center_id")
    assert decide(out["decisions"]) == {1: "BLOCKED", 2: "OK", 3: "NOT_FOUND"}
    assert sorted(r.id for r in out["sessions"].collect()) == [1, 3]
    # centres: 1 blocked through session 1's booking; 2 cascades to sessions, rooms, members, content, links
    creq = spark.createDataFrame([(7, 1), (8, 2)], "request_id long, id long")
    out = maintenance.delete_rows(t, "centers", creq)
    assert decide(out["decisions"]) == {7: "BLOCKED", 8: "OK"}
    assert sorted(r.id for r in out["centers"].collect()) == [1]
    assert sorted(r.id for r in out["sessions"].collect()) == [1]
    assert out["rooms"].count() == 0 and out["room_members"].count() == 0 and out["content_items"].count() == 0
    assert [(r.center_id, r.teacher_id) for r in out["center_teachers"].collect()] == [(1, 7)]


def test_review_per_booking_option(spark, frames):
    t = base_tables(spark, frames, books=[(1, 2, 100, "attended", "q1", Decimal("10"), at(-900), None),
                                          (2, 2, 100, "attended", "q2", Decimal("10"), at(-800), None)])
    t["teachers"] = spark.createDataFrame([(7,)], "id long")
    t["reviews"] = spark.createDataFrame([(1, 7, 100, 1)], "id long, teacher_id long, student_id long, booking_id long")
    req = spark.createDataFrame([(1, 100, 7, 5, at(0))],
                                "request_id long, student_id long, teacher_id long, rating int, requested_at timestamp_ntz")
    per_teacher = rooms.review_eligibility(t, req).first()
    per_booking = rooms.review_eligibility(t, req, per="booking").first()
    assert per_teacher.decision == "ALREADY_REVIEWED"
    assert (per_booking.decision, per_booking.booking_id) == ("OK", 2)


def test_registrations_duplicate_by_email_or_phone(spark, frames):
    t = frames()
    t["users"] = spark.createDataFrame([(1, "a@x", "111")], "id long, email string, phone string")
    cands = spark.createDataFrame([
        (10, "n", "a@x", "999", "student", None, None, None, None, None, None, None, None),
        (11, "n", "b@x", "111", "student", None, None, None, None, None, None, None, None),
        (12, "n", "c@x", "222", "teacher", "", "g1", None, None, None, None, None, None),
        (13, "n", "d@x", "333", "center_admin", None, None, "c", "addr", None, None, None, 30.0),
        (14, "n", "e@x", "444", "center_admin", None, None, "c", "addr", None, None, 29.0, 30.0),
    ], "candidate_id long, name string, email string, phone string, role string, subjects string, "
       "grade_levels string, center_name string, center_address string, lat double, lng double, "
       "center_lat double, center_lng double")
    out = rooms.validate_registrations(t, cands)
    assert decide(out["decisions"], "candidate_id") == {10: "USER_EXISTS", 11: "USER_EXISTS", 12: "OK",
                                                        13: "MISSING_CENTER_FIELDS", 14: "OK"}
    teacher = out["teachers"].first()
    assert (teacher.subjects, teacher.grade_levels) == ([], ["g1"])   # scalar inputs: '' dropped, value kept
    assert [(r.lat, r.lng) for r in out["centers"].collect()] == [(29.0, 30.0)]


def test_deposits_report_running_balance(spark, frames):
    t = base_tables(spark, frames)
    req = spark.createDataFrame([(1, 100, Decimal("5.00"), None, at(0)), (2, 100, Decimal("-1.00"), "card", at(1)),
                                 (3, 100, Decimal("7.00"), "card", at(2))],
                                "request_id long, user_id long, amount decimal(10,2), payment_method string, "
                                "requested_at timestamp_ntz")
    got = {r.request_id: (r.decision, r.new_balance, r.payment_method)
           for r in ledger.deposits_to_ledger(t, req).collect()}
    assert got == {1: ("OK", Decimal("20.00"), "manual"), 2: ("INVALID_AMOUNT", None, None),
                   3: ("OK", Decimal("27.00"), "card")}


def test_room_content_gated_for_one_student(spark, tables):
    import pytest as _pytest
    from studyhall.plans import rooms as R
    with _pytest.raises(ValueError):
        R.room_content_gated(tables)
    member = tables["room_members"].filter("is_active").first()
    got = R.room_content_gated(tables, room=member.room_id, student=member.student_id)
    view = R.room_content_by_tier(tables).filter(f"room_id = {member.room_id} AND access_tier = '{member.access_tier}'")
    room_active = tables["rooms"].filter(f"id = {member.room_id}").first().is_active
    assert got.count() == (view.count() if room_active else 0)
    assert sorted(r.url or "" for r in got.collect()) == sorted(r.url or "" for r in view.collect())


def test_scan_stream_marks_repeats_in_later_batches(spark, frames, tmp_path):
    from studyhall.streaming import streams as S
    books = [(1, 1, 101, "confirmed", "101_1_k1", Decimal("10"), at(-900), None)]
    t = base_tables(spark, frames, books=books)
    t["users"] = spark.createDataFrame([(101,)], "id long")
    schema = "scan_id long, qr_code string, center_id long, scanned_at timestamp_ntz"
    folder = str(tmp_path / "scans")
    spark.createDataFrame([(1, "101_1_k1", 1, at(0))], schema).write.parquet(folder)
    spark.createDataFrame([(2, "101_1_k1", 1, at(5)), (1, "101_1_k1", 1, at(0))], schema).write.mode(
        "append").parquet(folder)
    stream = S.file_stream(spark, folder, spark.createDataFrame([], schema).schema, max_files=1)
    got = {r.scan_id: r.decision for r in S.scan_stream_job(t, stream).collect()}
    # second file: scan 2 repeats an accepted booking, scan 1 is a re-delivery and is dropped
    assert got == {1: "OK", 2: "ALREADY_ATTENDED"}


def test_activity_windows_drop_rows_behind_the_watermark(spark, tmp_path):
    from studyhall.streaming import streams as S
    schema = "id long, user_id long, amount decimal(10,2), type string, status string, created_at timestamp_ntz"
    folder = str(tmp_path / "ledger")
    day = dt.datetime(2024, 1, 10, 12)
    late = day - dt.timedelta(days=9)      # older than the 2-day watermark once day 10 was seen
    # Spark drops late input by the watermark of the previous micro-batch, so the late row
    # comes two files after the one that moved the watermark.
    for rows in ([(1, 1, Decimal("1"), "deposit", "completed", day)],
                 [(3, 1, Decimal("1"), "deposit", "completed", day)],
                 [(2, 1, Decimal("1"), "deposit", "completed", late)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = S.file_stream(spark, folder, spark.createDataFrame([], schema).schema, max_files=1)
    got = {(r.window_start, r.type): r.rows for r in S.run_upsert(
        S.activity_windows(stream, window="1 day", watermark="2 days"),
        ["window_start", "window_end", "type"], "test-activity").collect()}
    assert got == {(dt.datetime(2024, 1, 10), "deposit"): 2}


def test_no_show_detector_emits_unmatched_bookings(spark, tmp_path):
    from studyhall.streaming import streams as S
    bschema = "booking_id long, session_start timestamp_ntz, session_end timestamp_ntz"
    sschema = "scan_booking_id long, scanned_at timestamp_ntz"
    bdir, sdir = str(tmp_path / "b"), str(tmp_path / "s")
    far = dt.datetime(2100, 1, 1)
    spark.createDataFrame([(1, at(0), at(60)), (2, at(0), at(60)), (3, at(0), at(60))], bschema).write.parquet(bdir)
    spark.createDataFrame([(-1, far, far)], bschema).write.mode("append").parquet(bdir)
    # booking 1 scanned in time, booking 2 scanned after the end (no-show), booking 3 never
    spark.createDataFrame([(1, at(-10)), (2, at(61))], sschema).write.parquet(sdir)
    spark.createDataFrame([(-1, far)], sschema).write.mode("append").parquet(sdir)
    b = S.file_stream(spark, bdir, spark.createDataFrame([], bschema).schema, max_files=1)
    s = S.file_stream(spark, sdir, spark.createDataFrame([], sschema).schema, max_files=1)
    out = str(tmp_path / "out")
    joined = S.no_show_detector(b, s)
    q = (joined.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(joined.schema).parquet(out).filter("booking_id >= 0").collect()
    assert sorted(r.booking_id for r in rows if r.scanned_at is None) == [2, 3]
    assert [r.booking_id for r in rows if r.scanned_at is not None] == [1]


def test_write_side_of_cancellations_and_guarded_session_patch(spark, frames):
    books = [(1, 1, 100, "confirmed", "a", Decimal("0.00"), at(-900), None),
             (2, 1, 101, "pending", "b", Decimal("10.00"), at(-900), None),
             (3, 1, 102, "cancelled", "c", Decimal("10.00"), at(-900), None)]
    t = base_tables(spark, frames, books=books)
    req = spark.createDataFrame([(1, 1, 1, at(-5))], "request_id long, session_id long, center_id long, "
                                                       "requested_at timestamp_ntz")
    d = bookings.cancel_sessions(t, req)
    assert [(r.decision, r.bookings_cancelled, r.refunds_processed) for r in d.collect()] == [("OK", 2, 1)]
    out = bookings.session_cancellation_outputs(t, d, as_of=AS_OF)
    assert sorted(r.id for r in out["booking_patches"].collect()) == [1, 2]
    assert [r.user_id for r in out["wallet_transactions"].collect()] == [101]
    assert sorted(r.user_id for r in out["notifications"].collect()) == [100, 101]
    patches = spark.createDataFrame([(1, 1, at(1)), (2, 1, at(1))], "id long, capacity int, patched_at timestamp_ntz")
    res = maintenance.apply_session_patches(t, patches)
    assert decide(res["decisions"], "id") == {1: "CAPACITY_BELOW_BOOKED", 2: "OK"}
    assert {r.id: r.capacity for r in res["sessions"].collect()} == {1: 2, 2: 1}


def test_scan_validation_with_text_keys(spark, frames):
    t = frames()
    t["sessions"] = spark.createDataFrame([("s-1", "c-1", at(0), 60)],
                                          "id string, center_id string, scheduled_at timestamp_ntz, duration_min int")
    t["bookings"] = spark.createDataFrame([("b-1", "s-1", "u-1", "confirmed", "u-1_s-1_ab12cd34")],
                                          "id string, session_id string, student_id string, status string, qr_code string")
    t["users"] = spark.createDataFrame([("u-1",)], "id string")
    scans = spark.createDataFrame([(1, "u-1_s-1_ab12cd34", "c-1", at(0)), (2, "u-1_s-9_ab12cd34", "c-1", at(0))],
                                  "scan_id long, qr_code string, center_id string, scanned_at timestamp_ntz")
    assert decide(attendance.validate_scans(t, scans), "scan_id") == {1: "OK", 2: "SESSION_NOT_FOUND"}


def test_check_constraints_finds_every_kind(spark, frames):
    t = frames()
    mk = spark.createDataFrame
    t["users"] = mk([(1, "a", "x@y", "1", "student"), (2, "b", "x@y", "2", "wizard"), (3, None, "z@y", "1", "teacher")],
                    "id long, name string, email string, phone string, role string")
    t["teachers"] = mk([(10, 3), (11, 99)], "id long, user_id long")
    t["centers"] = mk([(20, 1)], "id long, owner_id long")
    t["center_teachers"] = mk([(20, 10), (20, 10)], "center_id long, teacher_id long")
    t["sessions"] = mk([(30, 20, 10, 1, 2, 60, Decimal("1"), "scheduled", at(0)),
                        (31, 21, 10, 0, 0, 0, Decimal("-1"), "paused", None)],
                       "id long, center_id long, teacher_id long, capacity int, seats_booked int, duration_min int, "
                       "price decimal(10,2), status string, scheduled_at timestamp_ntz")
    t["bookings"] = mk([(40, 30, 1, "confirmed", "q"), (41, 30, 1, "lost", "q"), (42, 39, 1, "pending", None)],
                       "id long, session_id long, student_id long, status string, qr_code string")
    t["attendances"] = mk([(50, 40), (51, 40)], "id long, booking_id long")
    t["rooms"] = mk([(60, 20, 10, "AAAA"), (61, 20, 10, "AAAA")], "id long, center_id long, teacher_id long, access_code string")
    t["room_members"] = mk([(70, 60, 1, "gold")], "id long, room_id long, student_id long, access_tier string")
    t["content_items"] = mk([(80, 62, "video")], "id long, room_id long, type string")
    t["teacher_content"] = mk([(90, "x" * 300, "pdf")], "id long, title string, type string")
    t["reviews"] = mk([(100, 9, 40), (101, 3, 40)], "id long, rating int, booking_id long")
    t["wallet_transactions"] = mk([(110, 1, Decimal("0"), "deposit", "completed"), (111, 5, Decimal("3"), "gift", "done")],
                                  "id long, user_id long, amount decimal(10,2), type string, status string")
    t["notifications"] = mk([(120, 99, "poke", None, "m")], "id long, user_id long, type string, title string, message string")
    t["audit_logs"] = mk([(130, 98, "x" * 101, None)], "id long, admin_id long, action string, entity_type string")
    got = {(r.table_name, r.rule, r.row_key) for r in maintenance.check_constraints(t).collect()}
    want = {
        ("notifications", "enum(type)", "120"), ("notifications", "not_null(title)", "120"),
        ("notifications", "fk(user_id->users.id)", "120"), ("audit_logs", "check(length(action)<=100)", "130"),
        ("audit_logs", "not_null(entity_type)", "130"), ("audit_logs", "fk(admin_id->users.id)", "130"),
        ("sessions", "check(seats_booked<=capacity)", "30"), ("sessions", "check(capacity>0)", "31"),
        ("sessions", "check(duration_min>0)", "31"), ("sessions", "check(price>=0)", "31"),
        ("sessions", "enum(status)", "31"), ("sessions", "not_null(scheduled_at)", "31"),
        ("reviews", "check(rating between 1 and 5)", "100"), ("wallet_transactions", "check(amount>0)", "110"),
        ("wallet_transactions", "enum(type)", "111"), ("wallet_transactions", "enum(status)", "111"),
        ("teacher_content", "check(length(title)<=255)", "90"), ("users", "enum(role)", "2"),
        ("users", "not_null(name)", "3"), ("bookings", "enum(status)", "41"), ("bookings", "not_null(qr_code)", "42"),
        ("room_members", "enum(access_tier)", "70"),
        ("users", "unique(email)", "x@y"), ("users", "unique(phone)", "1"),
        ("center_teachers", "unique(center_id,teacher_id)", "20|10"), ("bookings", "unique(qr_code)", "q"),
        ("bookings", "unique(session_id,student_id)", "30|1"), ("attendances", "unique(booking_id)", "40"),
        ("rooms", "unique(access_code)", "AAAA"), ("reviews", "unique(booking_id)", "40"),
        ("teachers", "fk(user_id->users.id)", "11"), ("sessions", "fk(center_id->centers.id)", "31"),
        ("bookings", "fk(session_id->sessions.id)", "42"), ("content_items", "fk(room_id->rooms.id)", "80"),
        ("wallet_transactions", "fk(user_id->users.id)", "111"),
    }
    assert got == want


def test_running_balances_stream_over_several_batches_equals_batch(spark, tmp_path):
    from studyhall.plans.wallet import balances_by_user
    from studyhall.streaming import streams as S
    schema = "id long, user_id long, amount decimal(10,2), type string, status string, created_at timestamp_ntz"
    folder = str(tmp_path / "ledger")
    parts = [[(1, 1, Decimal("10"), "deposit", "completed", at(0)), (2, 2, Decimal("5"), "deposit", "completed", at(0))],
             [(3, 1, Decimal("4"), "booking_charge", "completed", at(1)), (4, 1, Decimal("7"), "transfer", "completed", at(1))],
             [(5, 2, Decimal("1"), "withdrawal", "pending", at(2)), (6, 3, Decimal("2"), "refund", "completed", at(2))]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = S.file_stream(spark, folder, spark.createDataFrame([], schema).schema, max_files=1)
    got = {r.user_id: r.balance for r in S.run_upsert(S.running_balances(stream), ["user_id"], "t-bal").collect()}
    batch = spark.read.parquet(folder)
    want = {r.user_id: r.balance for r in balances_by_user(batch).collect()}
    assert got == want == {1: Decimal("6.00"), 2: Decimal("5.00"), 3: Decimal("2.00")}


def test_patches_of_one_time_follow_the_request_id(spark):
    table = spark.createDataFrame([(1, "a", True, at(0))], "id long, name string, is_active boolean, updated_at timestamp_ntz")
    patches = spark.createDataFrame([(1, None, True, at(5), 1), (1, "z", False, at(5), 2), (1, "b", None, at(5), 3)],
                                    "id long, name string, is_active boolean, patched_at timestamp_ntz, request_id long")
    assert maintenance.apply_patches(table, patches).first()[1:3] == ("b", False)


def test_opposite_status_changes_of_one_user(spark, frames):
    t = frames()
    t["users"] = spark.createDataFrame([(1, "student", True, at(0)), (2, "student", False, at(0))],
                                       "id long, role string, is_active boolean, updated_at timestamp_ntz")
    req = spark.createDataFrame([(1, 9, 1, True, None), (2, 9, 1, False, None), (3, 9, 2, False, None), (4, 9, 2, True, None)],
                                "request_id long, admin_id long, user_id long, is_active boolean, reason string")
    out = ledger.user_status_changes(t, req)
    assert {r.id: r.is_active for r in out["users"].collect()} == {1: False, 2: True}


def test_registrations_settle_chains_within_the_batch(spark, frames):
    t = frames()
    t["users"] = spark.createDataFrame([], "id long, email string, phone string")
    rows = [(1, "e1", "p1"), (2, "e1", "p2"), (3, "e2", "p2"), (4, "e2", "p1"), (5, "e3", ""), (6, "e3", "p6"), (7, "e3", None),
            (8, "e6", "p6")]
    cands = spark.createDataFrame([(i, "n", e, p, "student") + (None,) * 8 for i, e, p in rows],
        "candidate_id long, name string, email string, phone string, role string, subjects string, "
        "grade_levels string, center_name string, center_address string, lat double, lng double, "
        "center_lat double, center_lng double")
    got = decide(rooms.validate_registrations(t, cands)["decisions"], "candidate_id")
    # 2 is refused for 1's e-mail, so 3 may have its phone; 4 meets 1 and 3; 5 lacks a phone
    assert got == {1: "OK", 2: "USER_EXISTS", 3: "OK", 4: "USER_EXISTS", 5: "MISSING_FIELDS", 6: "OK",
                   7: "USER_EXISTS", 8: "USER_EXISTS"}


def test_a_request_with_null_keys_keeps_its_decision(spark, tables):
    from studyhall.jobs import bookings, requests
    req = requests.booking_requests(tables)
    nulls = req.limit(3).withColumn("session_id", F.lit(None).cast("bigint")).withColumn(
        "request_id", F.col("request_id") + 10**15)
    all_ = req.unionByName(nulls)
    assert bookings.admit_bookings(tables, all_).count() == all_.count()


def test_every_code_occurs_in_the_registered_batches(spark, tables):
    """The request fixtures reach each decision of the settled jobs, OK included."""
    from studyhall.jobs import requests as q
    jobs = {
        "link": (maintenance.link_teachers(tables, q.link_requests(tables)),
                 {"OK", "CENTER_NOT_FOUND", "TEACHER_NOT_FOUND", "ALREADY_LINKED"}),
        "unlink": (maintenance.unlink_teachers(tables, q.unlink_requests(tables)),
                   {"OK", "CENTER_NOT_FOUND", "TEACHER_NOT_FOUND", "NOT_LINKED"}),
        "rooms": (rooms.validate_rooms(tables, q.room_candidates(tables)),
                  {"OK", "MISSING_FIELDS", "NAME_TAKEN", "NOT_LINKED", "NOT_TAUGHT"}),
        "attach": (rooms.attach_content(tables, q.attach_requests(tables)),
                   {"OK", "CONTENT_REQUIRED", "ROOM_NOT_FOUND", "CONTENT_NOT_AVAILABLE", "ALREADY_IN_ROOM"}),
        "registrations": (rooms.validate_registrations(tables, q.registration_candidates(tables))["decisions"],
                          {"OK", "USER_EXISTS", "MISSING_FIELDS", "MISSING_CENTER_FIELDS"}),
        "status": (ledger.user_status_changes(tables, q.status_change_requests(tables))["decisions"],
                   {"OK", "FIELD_REQUIRED", "NOT_FOUND", "FORBIDDEN"}),
    }
    for name, (decisions, codes) in jobs.items():
        assert {r[0] for r in decisions.select("decision").distinct().collect()} == codes, name


def test_no_settled_batch_accepts_one_key_twice(spark, tables):
    from studyhall.jobs import requests as q
    for d, keys in ((maintenance.link_teachers(tables, q.link_requests(tables)), ["center_id", "teacher_id"]),
                    (maintenance.unlink_teachers(tables, q.unlink_requests(tables)), ["center_id", "teacher_id"]),
                    (rooms.attach_content(tables, q.attach_requests(tables)), ["room_id", "content_id"]),
                    (rooms.validate_rooms(tables, q.room_candidates(tables)), ["center_id", "name"])):
        ok = d.filter("decision = 'OK'")
        assert ok.count() == ok.select(*keys).distinct().count()


def test_access_codes_skip_used_ones(spark):
    from studyhall.functions.tokens import access_code
    ids = spark.range(5).select(F.col("id").alias("k_id"))
    used = ids.select(access_code("k_id").alias("access_code")).unionByName(
        ids.filter("k_id = 2").select(access_code("k_id", 1).alias("access_code")))
    got = rooms._free_codes(ids, used)
    assert got.count() == 5 == got.select("access_code").distinct().count()
    assert got.join(used, "access_code").count() == 0
    two = ids.filter("k_id = 2").select(access_code("k_id", 2).alias("access_code")).first()[0]
    assert got.filter("k_id = 2").first().access_code == two


def test_scans_newest_first_all_get_a_decision(spark, frames):
    """Scans reported late (files newest first, weeks apart) are decided, re-delivered ones once."""
    from studyhall.streaming import streams as S
    t = frames()
    t["sessions"] = spark.createDataFrame([], SESSIONS)
    t["bookings"] = spark.createDataFrame([], BOOKINGS)
    t["users"] = spark.createDataFrame([], "id long")
    schema = "scan_id long, qr_code string, center_id long, scanned_at timestamp_ntz"
    folder = S.stream_folder(spark, "t-late-scans")
    for k in range(4):
        rows = [(k * 10 + i, f"1_2_{k}{i}", 1, at(-k * 50000 + i)) for i in range(10)] + [(0, "1_2_00", 1, at(0))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    got = S.scan_stream_job(t, S.file_stream(spark, folder, spark.createDataFrame([], schema).schema, max_files=1))
    assert sorted(r.scan_id for r in got.collect()) == list(range(40))


def test_registered_streams_take_several_micro_batches(spark, tables):
    from studyhall.streaming import streams as S
    cuts = S._time_cuts(tables["bookings"], "booked_at")
    assert len(cuts) >= 4


def _delete_one_by_one(tables, rules, requests):
    """Row-by-row deletes over {table: [dict]} with the schema's rules; requests (request_id, table, id)."""
    out = {}

    def tree(name, keys):
        gone, blocked = {(name, k) for k in keys}, False
        for child, col, rule in rules.get(name, []):
            hits = [r for r in tables.get(child, []) if r[col] in keys]
            if rule == "restrict" and hits:
                blocked = True
            elif rule == "cascade" and hits:
                if "id" in hits[0]:
                    more, b = tree(child, {r["id"] for r in hits})
                    gone, blocked = gone | more, blocked or b
                else:
                    gone |= {(child, col, r[col]) for r in hits}
        return gone, blocked
    for rid, table, key in sorted(requests):
        if not any(r["id"] == key for r in tables[table]):
            out[rid] = "NOT_FOUND"
            continue
        gone, blocked = tree(table, {key})
        out[rid] = "BLOCKED" if blocked else "OK"
        if not blocked:
            for name in tables:
                tables[name] = [r for r in tables[name] if not ("id" in r and (name, r["id"]) in gone)
                                and not any((name, c, v) in gone for c, v in r.items())]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_deletes_that_depend_on_earlier_ones(spark, frames, seed):
    import random
    rng = random.Random(seed)
    ids = lambda n: range(1, n + 1)
    schema = {
        "users": (["id"], [{"id": i} for i in ids(14)]),
        "teachers": (["id", "user_id"], [{"id": i, "user_id": rng.randint(1, 14)} for i in ids(8)]),
        "centers": (["id", "owner_id"], [{"id": i, "owner_id": rng.randint(1, 14)} for i in ids(7)]),
        "sessions": (["id", "center_id", "teacher_id"], [{"id": i, "center_id": rng.randint(1, 7), "teacher_id": rng.randint(1, 8)}
                                                        for i in ids(9)]),
        "bookings": (["id", "session_id", "student_id"], [{"id": 1, "session_id": 3, "student_id": 2}]),
    }
    for name, rules in maintenance.FK_RULES.items():
        for child, col, _ in rules:
            cols = schema.setdefault(child, (["id"] if child not in ("center_teachers",) else [], []))[0]
            if col not in cols:
                cols.append(col)
                for r in schema[child][1]:
                    r[col] = None
    t = frames()
    for name, (cols, rows) in schema.items():
        t[name] = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} long" for c in cols))
    req = [(i, rng.choice(["users", "teachers", "centers", "sessions"]), rng.randint(1, 15)) for i in range(60)]
    plain = {name: [dict(r) for r in rows] for name, (_, rows) in schema.items()}
    want = _delete_one_by_one(plain, maintenance.FK_RULES, req)
    out = maintenance.delete_rows(t, ["users", "teachers", "centers", "sessions"], spark.createDataFrame(
        req, "request_id long, table_name string, id long"))
    assert {"OK", "BLOCKED", "NOT_FOUND"} == set(want.values())
    assert decide(out["decisions"]) == want
    for name in ("users", "teachers", "centers", "sessions"):
        assert sorted(r.id for r in out[name].collect()) == sorted(r["id"] for r in plain[name]), name


def test_a_long_chain_of_registrations_takes_few_rounds(spark, monkeypatch):
    stores, real = [], rooms.stored
    monkeypatch.setattr(rooms, "stored", lambda df: stores.append(1) or real(df))
    n = 2000
    rows = [(i, f"e{i // 2}", f"p{(i + 1) // 2}") for i in range(n)]
    mail, tel = rooms._first_accepted(spark.createDataFrame(rows, "candidate_id long, email string, phone string"))
    assert sorted(r.m_id for r in mail.collect()) == list(range(0, n, 2))
    assert len(stores) < 25


@pytest.mark.parametrize("seed", [3])
def test_registrations_equal_one_by_one(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(i, f"e{rng.randrange(40)}", f"p{rng.randrange(40)}") for i in range(120)]
    rng.shuffle(rows)
    emails, phones, want = set(), set(), []
    for i, e, p in sorted(rows):
        if e not in emails and p not in phones:
            want.append(i)
            emails.add(e)
            phones.add(p)
    mail, _ = rooms._first_accepted(spark.createDataFrame(rows, "candidate_id long, email string, phone string"))
    assert sorted(r.m_id for r in mail.collect()) == want


def test_length_rules_hold_where_the_column_exists(spark, tables):
    class More:
        def __getitem__(self, name):
            df = tables[name]
            if name != "wallet_transactions":
                return df
            return df.withColumn("external_ref", F.when(F.col("id") == 5, F.repeat(F.lit("x"), 256)).otherwise(F.lit("ok")))
    bad = maintenance.check_constraints(More()).filter("rule like '%external_ref%'").collect()
    assert [(r.table_name, r.row_key) for r in bad] == [("wallet_transactions", "5")]


def scan_step_tables(spark, frames):
    t, start = frames(), dt.datetime(2024, 1, 1, 10, 0)
    t["users"] = spark.createDataFrame([(u,) for u in range(6)], "id long")
    t["sessions"] = spark.createDataFrame([(1, 5, start, 60), (2, 6, start, 60), (2, 6, start, 60)],
                                          "id long, center_id long, scheduled_at timestamp_ntz, duration_min int")
    t["bookings"] = spark.createDataFrame(
        [(0, 1, 0, "confirmed", "0_1_a"), (1, 1, 1, "attended", "1_1_a"), (2, 1, 2, "pending", "2_1_a"), (3, 1, 99, "confirmed", "99_1_a"),
         (4, 1, None, "confirmed", "x_1_a"), (5, 2, 5, None, "5_2_a"), (6, 7, 3, "confirmed", "3_1_a")],
        "id long, session_id long, student_id long, status string, qr_code string")
    scans = spark.createDataFrame(
        [(1, "0_1_a", 5, start), (2, "0_1_a", 5, start + dt.timedelta(minutes=1)), (3, "1_1_a", 5, start), (4, "2_1_a", 5, start),
         (5, "99_1_a", 5, start), (6, "x_1_a", 5, start), (7, "5_2_a", 6, start), (8, "3_1_a", 5, start), (9, "0_1_a", 6, start),
         (10, None, 5, start), (11, "a-b", 5, start), (12, "0_1_a", 5, start + dt.timedelta(hours=2))],
        "scan_id long, qr_code string, center_id long, scanned_at timestamp_ntz")
    return t, scans


def test_scans_are_validated_in_stored_steps(spark, frames):
    t, scans = scan_step_tables(spark, frames)
    out = attendance.validate_scans(t, scans)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 3   # accepted scans only
    got = sorted((r.scan_id, r.decision) for r in out.collect())
    # session 2 is there twice: each scan of it stands for each pair of its rows, one of them accepted
    assert got[:6] == [(1, "OK"), (2, "ALREADY_ATTENDED"), (3, "ALREADY_ATTENDED"), (4, "INVALID_STATUS"), (5, "BOOKING_NOT_FOUND"),
                       (6, "BOOKING_NOT_FOUND")]
    assert [x for x in got if x[0] == 7] == [(7, "OK")] * 4
    assert got[10:] == [(8, "BOOKING_NOT_FOUND"), (9, "FORBIDDEN"), (10, "QR_REQUIRED"), (11, "BAD_FORMAT"), (12, "OUTSIDE_TIME_WINDOW")]


def test_scans_of_bookings_attended_in_earlier_batches(spark, frames):
    t, scans = scan_step_tables(spark, frames)
    done = spark.createDataFrame([(0,), (0,), (2,)], "booking_id long")
    got = {r.scan_id: r.decision for r in attendance.validate_scans(t, scans, attended=done).collect()}
    assert {k: got[k] for k in (1, 2, 4, 9, 12)} == {1: "ALREADY_ATTENDED", 2: "ALREADY_ATTENDED", 4: "ALREADY_ATTENDED", 9: "FORBIDDEN",
                                                    12: "ALREADY_ATTENDED"}


def test_scan_notifications_come_from_stored_decisions(spark, frames):
    t, scans = scan_step_tables(spark, frames)
    t["centers"] = spark.createDataFrame([(5, 50), (6, 60)], "id long, owner_id long")
    notes = attendance.scan_outputs(t, attendance.validate_scans(t, scans))["notifications"]
    assert notes._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 3
    assert sorted(r.type for r in notes.collect()) == ["attendance_recorded"] * 5 + ["session_missed"]
