"""Check-in jobs over tables of scans / walk-ins (JOB-04, JOB-05).

The check-in window is inclusive at both ends: from start - 15 min to start + duration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import CHECKIN_EARLY_MIN
from studyhall.functions.exprs import first_failure, minutes, new_key, session_end, us_datetime
from studyhall.functions.tokens import qr_code, qr_parts
from studyhall.jobs.bookings import batch_bookings
from studyhall.operators.settle import Resource, settle_in_order
from studyhall.operators.topn import earliest_ok
from studyhall.session import stored

WALKIN_BOOKING_OFFSET = 3_000_000_000_000

# --- fixed values: notification texts of the check-in code ---
MISSED_TEXT = ("You missed your session on ", ". Please contact the center for rescheduling.")
RECORDED_TEXT = ("Your attendance for the session on ", " has been recorded successfully.")


def _window_checks(at: str) -> list:
    start = F.col("scheduled_at")
    return [
        ("TOO_EARLY", F.col(at) < start - minutes(CHECKIN_EARLY_MIN)),
        ("OUTSIDE_TIME_WINDOW", F.col(at) > session_end("scheduled_at", "duration_min")),
    ]


def scannable_bookings(t) -> DataFrame:
    """The bookings a scan can hit: of a known student and a known session, with the session's centre and times, and their
    status as ``b_refused``: 1 attended, 2 not confirmed, else NULL.

    The unknown students are looked up by their distinct ids, so that the bookings themselves, with their codes, are not dealt
    by student: few unknown ones are broadcast."""
    refused = F.when(F.col("status") == "attended", 1).when(F.col("status") != "confirmed", 2).cast("tinyint")
    b = t["bookings"].filter("student_id is not null").select(
        F.col("id").alias("booking_id"), F.col("qr_code").alias("b_qr"), F.col("student_id"), refused.alias("b_refused"),
        F.col("session_id").alias("b_sid"))
    users = t["users"].select(F.col("id").alias("u_id"))
    unknown = stored(b.select(F.col("student_id").alias("x_id")).distinct().join(users, F.col("x_id") == F.col("u_id"), "left_anti"))
    return (b.join(unknown, F.col("student_id") == F.col("x_id"), "left_anti")
            .join(t["sessions"].select(F.col("id").alias("bs_id"), F.col("center_id").alias("b_cid"), "scheduled_at",
                                       "duration_min"), F.col("b_sid") == F.col("bs_id")).drop("b_sid", "bs_id"))


def validate_scans(t, scans: DataFrame, *, bookings: DataFrame | None = None, attended: DataFrame | None = None) -> DataFrame:
    """JOB-04: per scan: QR_REQUIRED, BAD_FORMAT, SESSION_NOT_FOUND, FORBIDDEN (session of another
    centre), BOOKING_NOT_FOUND, FORBIDDEN (booking of another centre), ALREADY_ATTENDED,
    INVALID_STATUS (not confirmed), TOO_EARLY, OUTSIDE_TIME_WINDOW, else OK. A second OK scan of
    the same booking in the batch is ALREADY_ATTENDED.

    A caller with many batches passes ``scannable_bookings(t)`` as ``bookings`` and, as ``attended`` (booking_id), the bookings
    accepted by earlier batches. The scans are stored after their session is looked up, and the decisions before the batch's second
    scans are found, in which only accepted scans take part: each step's shuffle files are gone when the next one begins."""
    ok_fmt, _student_txt, session_txt = qr_parts("qr_code")
    sess = t["sessions"].select(F.col("id").alias("q_sid"), F.col("center_id").alias("q_cid"))
    # the key type is whatever the sessions table uses (UUID text or numbers): no key parsing
    sc = scans.withColumn("_fmt", ok_fmt).withColumn("_sid", session_txt.try_cast(sess.schema["q_sid"].dataType))
    bk = scannable_bookings(t) if bookings is None else bookings
    by_session = first_failure([
        ("QR_REQUIRED", F.col("qr_code").isNull() | (F.col("qr_code") == "")),
        ("BAD_FORMAT", ~F.col("_fmt")),
        ("SESSION_NOT_FOUND", F.col("q_sid").isNull()),
        ("FORBIDDEN", F.col("q_cid") != F.col("center_id")),
    ])
    sc = stored(sc.join(sess, sc._sid == sess.q_sid, "left").select(
        "scan_id", "qr_code", "center_id", "scanned_at", F.nullif(by_session, F.lit("OK")).alias("_refused")))
    by_booking = first_failure([
        ("BOOKING_NOT_FOUND", F.col("booking_id").isNull()),
        ("FORBIDDEN", F.col("b_cid") != F.col("center_id")),
        ("ALREADY_ATTENDED", F.col("b_refused") == 1),
        ("INVALID_STATUS", F.col("b_refused") == 2),
        *_window_checks("scanned_at"),
    ])
    d = stored(sc.join(bk, F.col("qr_code") == F.col("b_qr"), "left").select(
        "scan_id", "qr_code", "center_id", "scanned_at", "booking_id", "student_id", "scheduled_at",
        F.coalesce("_refused", by_booking).alias("decision")))
    # the decisions that depend on the scans before: codes after ALREADY_ATTENDED, all of known bookings
    open_ = F.col("decision").isin("OK") if attended is None else F.col("decision").isin(
        "OK", "INVALID_STATUS", "TOO_EARLY", "OUTSIDE_TIME_WINDOW")
    rest = d.filter(open_)
    if attended is not None:
        before = attended.select(F.col("booking_id").alias("_acc")).distinct()
        rest = rest.join(before, F.col("booking_id") == F.col("_acc"), "left").withColumn(
            "decision", F.when(F.col("_acc").isNotNull(), "ALREADY_ATTENDED").otherwise(F.col("decision"))).drop("_acc")
    rest = earliest_ok(rest, ["booking_id"], "ALREADY_ATTENDED", order=["scanned_at", "scan_id"])
    return d.filter(~open_).unionByName(rest)


def _notifications(decided: DataFrame, at: str) -> DataFrame:
    """One message per recorded attendance and per check-in after the session's end."""
    def told(text):
        return F.concat(F.lit(text[0]), us_datetime("scheduled_at"), F.lit(text[1]))
    ok = F.col("decision") == "OK"
    return decided.filter(F.col("decision").isin("OK", "OUTSIDE_TIME_WINDOW")).select(
        F.col("student_id").alias("user_id"), F.when(ok, "attendance_recorded").otherwise("session_missed").alias("type"),
        F.when(ok, told(RECORDED_TEXT)).otherwise(told(MISSED_TEXT)).alias("message"), F.col(at).alias("created_at"))


def _scanned_by(t, rows: DataFrame) -> DataFrame:
    """``rows`` plus scanned_by: the account of the centre that checked the student in (its owner)."""
    owner = t["centers"].select(F.col("id").alias("o_cid"), F.col("owner_id").alias("scanned_by"))
    return rows.join(owner, F.col("center_id") == F.col("o_cid"), "left").drop("o_cid")


def scan_outputs(t, decisions: DataFrame) -> dict[str, DataFrame]:
    """Rows produced by a scan batch: attendances, booking status patches, notifications."""
    ok = decisions.filter(F.col("decision") == "OK")
    notes = _notifications(decisions, "scanned_at")
    return {
        "attendances": _scanned_by(t, ok).select(F.col("booking_id").alias("id"), "booking_id", "scanned_at", "scanned_by"),
        "booking_patches": ok.select(F.col("booking_id").alias("id"), F.lit("attended").alias("status")),
        "notifications": notes,
    }


def walk_in_attendance(t, requests: DataFrame) -> DataFrame:
    """JOB-05: per walk-in (request_id, student_id, session_id, center_id, amount_paid, requested_at):
    MISSING_FIELDS, SESSION_NOT_FOUND, FORBIDDEN, TOO_EARLY, OUTSIDE_TIME_WINDOW, STUDENT_NOT_FOUND,
    ALREADY_BOOKED, FULL_OR_UNAVAILABLE (the seat trigger: not scheduled or no free seat), as if the walk-ins of
    a batch came one by one in the order (requested_at, request_id)."""
    s = t["sessions"].select(F.col("id").alias("s_id"), F.col("center_id").alias("s_cid"), "scheduled_at",
                             "duration_min", "capacity", F.col("status").alias("s_status"))
    users = t["users"].select(F.col("id").alias("u_id"))
    taken, booked = batch_bookings(t, requests)
    j = (requests.join(s, requests.session_id == s.s_id, "left")
         .join(users, requests.student_id == users.u_id, "left")
         .join(booked, (F.col("session_id") == F.col("e_sid")) & (F.col("student_id") == F.col("e_stu")), "left")
         .join(taken, F.col("session_id") == F.col("seat_sid"), "left"))
    seats = F.coalesce(F.col("seats_taken"), F.lit(0))
    decision = first_failure([
        ("MISSING_FIELDS", F.col("student_id").isNull() | F.col("session_id").isNull()),
        ("SESSION_NOT_FOUND", F.col("s_id").isNull()),
        ("FORBIDDEN", F.col("s_cid") != F.col("center_id")),
        *_window_checks("requested_at"),
        ("STUDENT_NOT_FOUND", F.col("u_id").isNull()),
        ("ALREADY_BOOKED", F.col("exists")),
        ("FULL_OR_UNAVAILABLE", (F.col("s_status") != "scheduled") | (seats >= F.col("capacity"))),
    ])
    d = j.select("request_id", "student_id", "session_id", "center_id", "amount_paid", "requested_at",
                 (F.col("capacity") - seats).alias("seats_left"), decision.alias("decision"))
    d = settle_in_order(d, ["requested_at", "request_id"], [
        Resource("once", ["session_id", "student_id"], F.lit(1), F.lit(1)),
        Resource("seats", ["session_id"], F.lit(1), F.col("seats_left"))], where=F.col("decision") == "OK")
    d = d.withColumn("decision", F.when((F.col("decision") != "OK") | F.col("accepted"), F.col("decision"))
                     .when(F.col("short_once"), "ALREADY_BOOKED").otherwise("FULL_OR_UNAVAILABLE"))
    return d.select(
        "request_id", "student_id", "session_id", "center_id", "amount_paid", "requested_at", "decision")


def walk_in_outputs(t, decisions: DataFrame) -> dict[str, DataFrame]:
    """Rows of a walk-in batch: booking (attended) + attendance; cash > 0 posts a student deposit
    and an owner transfer (C15: no matching charge); notifications as for scans."""
    when = t["sessions"].select(F.col("id").alias("n_sid"), "scheduled_at")
    notes = _notifications(decisions.join(when, F.col("session_id") == F.col("n_sid")), "requested_at")
    ok = decisions.filter(F.col("decision") == "OK")
    bid = new_key(ok, "request_id", WALKIN_BOOKING_OFFSET, "walk-in")
    owners = t["centers"].select(F.col("id").alias("c_id"), "owner_id")
    paid = ok.filter(F.col("amount_paid") > 0)
    ledger = (paid.select(F.col("student_id").alias("user_id"), F.col("amount_paid").alias("amount"),
                          F.lit("deposit").alias("type"), bid.alias("reference_id"))
              .unionByName(paid.join(owners, F.col("center_id") == F.col("c_id")).select(
                  F.col("owner_id").alias("user_id"), F.col("amount_paid").alias("amount"),
                  F.lit("transfer").alias("type"), bid.alias("reference_id"))))
    return {
        "bookings": ok.select(bid.alias("id"), "session_id", "student_id", F.lit("attended").alias("status"),
                              qr_code("student_id", "session_id", bid).alias("qr_code"),
                              F.coalesce(F.col("amount_paid"), F.lit(0)).alias("amount_paid"),
                              F.col("requested_at").alias("booked_at")),
        "attendances": _scanned_by(t, ok).select(bid.alias("id"), bid.alias("booking_id"),
                                                 F.col("requested_at").alias("scanned_at"), "scanned_by"),
        "notifications": notes,
        "wallet_transactions": ledger.withColumn("status", F.lit("completed")),
    }
