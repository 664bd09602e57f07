"""The rows that the batch jobs write, one registered key per output table, with their SQL.

Each entry runs a job on its registered request table and takes one of its output tables; the SQL
starts from the SQL of the job's decisions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from studyhall.constants import LEDGER_AS_OF, SESSION_AS_OF
from studyhall.jobs import attendance, bookings, ledger, maintenance, requests, rooms
from studyhall.oracle.sql_jobs import SQL

NOW = f"TIMESTAMP '{SESSION_AS_OF}'"
PAID_AT = f"TIMESTAMP '{LEDGER_AS_OF}'"


def _decided(key: str, code: str = "OK") -> str:
    return f"(SELECT * FROM ({SQL[key]}) WHERE decision = '{code}')"


def _said(prefix: str, at: str) -> str:
    """The two check-in messages of a decision row ``d`` of a session ``s``."""
    shown = "strftime(scheduled_at, '%-m/%-d/%Y, %-I:%M:%S %p')"
    recorded, missed = (f"'{a}' || {shown} || '{b}'" for a, b in (attendance.RECORDED_TEXT, attendance.MISSED_TEXT))
    return (f"student_id AS user_id, CASE WHEN decision = 'OK' THEN 'attendance_recorded' ELSE 'session_missed' END AS type, "
            f"CASE WHEN decision = 'OK' THEN {recorded} ELSE {missed} END AS message, {at} AS created_at")


def _owner(side: str) -> str:
    return f"(SELECT owner_id FROM centers WHERE centers.id = {side})"


def _admitted(t):
    return bookings.admission_outputs(t, bookings.admit_bookings(t, requests.booking_requests(t)))


def _cancelled(t):
    return bookings.cancellation_outputs(t, bookings.cancel_bookings(t, requests.cancel_requests(t)))


def _closed(t):
    return bookings.session_cancellation_outputs(t, bookings.cancel_sessions(t, requests.session_cancel_requests(t)))


def _scanned(t):
    return attendance.scan_outputs(t, attendance.validate_scans(t, requests.scan_requests(t)))


def _walked_in(t):
    return attendance.walk_in_outputs(t, attendance.walk_in_attendance(t, requests.walkin_requests(t)))


def _joined(t):
    return rooms.join_outputs(t, rooms.join_rooms(t, rooms.join_requests(t)))


def _upgraded(t):
    return rooms.upgrade_outputs(t, rooms.upgrade_room_access(t, rooms.upgrade_requests(t)))


LEDGER = ["user_id", "amount", "type", "status", "reference_id", "reference_type", "created_at"]


def _ledger_sql(rows: str, user: str, amount: str, kind: str, ref: str, ref_type: str) -> str:
    return (f"SELECT {user} AS user_id, {amount} AS amount, '{kind}' AS type, 'completed' AS status, {ref} AS reference_id, "
            f"'{ref_type}' AS reference_type, {NOW} AS created_at FROM {rows}")


_ADMITTED = f"(SELECT d.*, s.center_id FROM {_decided('admit_bookings')} d JOIN sessions s ON s.id = d.session_id)"
_CLOSED = (f"(SELECT b.* FROM bookings b JOIN {_decided('cancel_sessions')} d ON d.session_id = b.session_id "
           "WHERE b.status IN ('pending', 'confirmed'))")
_BID = f"request_id + {bookings.BOOKING_ID_OFFSET}"
_WID = f"request_id + {attendance.WALKIN_BOOKING_OFFSET}"
_REBUILT_TEACHERS = ["id", "rating", "total_reviews"]

ENTRIES = {
    "admitted_bookings": (
        lambda t: _admitted(t)["bookings"].drop("qr_code"),
        f"SELECT {_BID} AS id, session_id, student_id, 'confirmed' AS status, price AS amount_paid, {NOW} AS booked_at "
        f"FROM {_decided('admit_bookings')}"),
    "admitted_bookings_ledger": (
        lambda t: _admitted(t)["wallet_transactions"].select(*LEDGER),
        _ledger_sql(_ADMITTED, "student_id", "price", "booking_charge", _BID, "booking") + " UNION ALL "
        + _ledger_sql(_ADMITTED, _owner("center_id"), "price", "transfer", _BID, "booking")),
    "cancelled_bookings": (
        lambda t: _cancelled(t)["booking_patches"],
        f"SELECT booking_id AS id, 'cancelled' AS status, {NOW} AS cancelled_at, {NOW} AS patched_at "
        f"FROM {_decided('cancel_bookings')}"),
    "cancelled_bookings_ledger": (
        lambda t: _cancelled(t)["wallet_transactions"].select(*LEDGER),
        _ledger_sql(_decided("cancel_bookings"), "student_id", "refund", "refund", "booking_id", "booking")),
    "cancelled_sessions_bookings": (
        lambda t: _closed(t)["booking_patches"],
        f"SELECT id, 'cancelled' AS status, {NOW} AS cancelled_at, {NOW} AS patched_at FROM {_CLOSED}"),
    "cancelled_sessions_ledger": (
        lambda t: _closed(t)["wallet_transactions"].select(*LEDGER),
        _ledger_sql(_CLOSED + " WHERE amount_paid > 0", "student_id", "amount_paid", "refund", "id", "session_cancellation")),
    "cancelled_sessions_notifications": (
        lambda t: _closed(t)["notifications"],
        f"SELECT student_id AS user_id, 'session_cancelled' AS type, 'Session cancelled' AS title, "
        f"'Your session was cancelled and refunded.' AS message, {NOW} AS created_at FROM {_CLOSED}"),
    "scan_attendances": (
        lambda t: _scanned(t)["attendances"],
        f"SELECT booking_id AS id, booking_id, scanned_at, {_owner('center_id')} AS scanned_by FROM {_decided('validate_scans')} d"),
    "scan_notifications": (
        lambda t: _scanned(t)["notifications"],
        f"SELECT {_said('scan', 'scanned_at')} FROM ({SQL['validate_scans']}) WHERE decision IN ('OK', 'OUTSIDE_TIME_WINDOW')"),
    "walk_in_bookings": (
        lambda t: _walked_in(t)["bookings"].drop("qr_code"),
        f"SELECT {_WID} AS id, session_id, student_id, 'attended' AS status, COALESCE(amount_paid, 0) AS amount_paid, "
        f"requested_at AS booked_at FROM {_decided('walk_in_attendance')}"),
    "walk_in_attendances": (
        lambda t: _walked_in(t)["attendances"],
        f"SELECT {_WID} AS id, {_WID} AS booking_id, requested_at AS scanned_at, {_owner('center_id')} AS scanned_by "
        f"FROM {_decided('walk_in_attendance')} d"),
    "walk_in_ledger": (
        lambda t: _walked_in(t)["wallet_transactions"].select("user_id", "amount", "type", "reference_id", "status"),
        f"SELECT student_id AS user_id, amount_paid AS amount, 'deposit' AS type, {_WID} AS reference_id, 'completed' AS status "
        f"FROM {_decided('walk_in_attendance')} WHERE amount_paid > 0 UNION ALL SELECT {_owner('center_id')}, amount_paid, "
        f"'transfer', {_WID}, 'completed' FROM {_decided('walk_in_attendance')} d WHERE amount_paid > 0"),
    "walk_in_notifications": (
        lambda t: _walked_in(t)["notifications"],
        f"SELECT {_said('walk-in', 'requested_at')} FROM (SELECT d.*, s.scheduled_at FROM ({SQL['walk_in_attendance']}) d "
        "JOIN sessions s ON s.id = d.session_id) WHERE decision IN ('OK', 'OUTSIDE_TIME_WINDOW')"),
    "joined_room_members": (
        lambda t: _joined(t)["room_members_new"],
        f"SELECT room_id, student_id, 'free' AS access_tier, {NOW} AS joined_at, TRUE AS is_active "
        f"FROM {_decided('join_rooms', 'JOINED')}"),
    "rejoined_room_members": (
        lambda t: _joined(t)["room_members_patches"],
        f"SELECT room_id, student_id, TRUE AS is_active, {NOW} AS joined_at FROM {_decided('join_rooms', 'REJOINED')}"),
    "upgraded_members": (
        lambda t: _upgraded(t)["room_members_patches"],
        f"SELECT room_id, student_id, 'paid' AS access_tier FROM {_decided('upgrade_room_access')}"),
    "upgrade_ledger": (
        lambda t: _upgraded(t)["wallet_transactions"].select(*LEDGER),
        _ledger_sql(_decided("upgrade_room_access"), "student_id", "charged", "booking_charge", "room_id", "room_upgrade")),
    "new_reviews": (
        lambda t: rooms.review_outputs(rooms.review_eligibility(t, rooms.review_requests(t))),
        f"SELECT request_id AS id, teacher_id, student_id, booking_id, rating, CAST(NULL AS VARCHAR) AS comment, "
        f"TRUE AS is_visible, {NOW} AS created_at FROM {_decided('review_eligibility')}"),
    "deposit_rows": (
        lambda t: ledger.deposit_outputs(ledger.deposits_to_ledger(t, ledger.deposit_requests(t))).select(
            "id", "user_id", "amount", "type", "status", "description", "payment_method", "created_at", "completed_at"),
        f"SELECT request_id AS id, user_id, amount, 'deposit' AS type, 'completed' AS status, 'Wallet deposit' AS description, "
        f"payment_method, {PAID_AT} AS created_at, {PAID_AT} AS completed_at FROM {_decided('deposits_to_ledger')}"),
    "rebuilt_teacher_ratings": (
        lambda t: maintenance.rebuild_derived_columns(t)["teachers"].select(*_REBUILT_TEACHERS),
        f"SELECT t.id, d.rating, d.total_reviews FROM teachers t JOIN ({SQL['derived_teacher_ratings']}) d ON d.teacher_id = t.id"),
    "rebuilt_session_seats": (
        lambda t: maintenance.rebuild_derived_columns(t)["sessions"].select("id", F.col("seats_booked").cast("long").alias("seats_booked")),
        f"SELECT s.id, d.seats_booked FROM sessions s JOIN ({SQL['derived_session_seats']}) d ON d.session_id = s.id"),
    "rebuilt_room_counts": (
        lambda t: maintenance.rebuild_derived_columns(t)["rooms"].select(
            "id", F.col("member_count").cast("long").alias("member_count"), F.col("content_count").cast("long").alias("content_count")),
        f"SELECT r.id, d.member_count, d.content_count FROM rooms r JOIN ({SQL['derived_room_counts']}) d ON d.room_id = r.id"),
}
