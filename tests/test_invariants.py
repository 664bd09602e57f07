"""Invariants of SURVEY §5 on the registered instances (sf0.001)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as E
from conftest import SF_SMALL
from studyhall.jobs import bookings as B
from studyhall.jobs import requests as R
from studyhall.jobs import rooms as RM
from studyhall.jobs.ledger import deposit_requests
from studyhall.plans import wallet

DECISION_JOBS = {
    "admit_bookings": (R.booking_requests, "request_id"),
    "cancel_bookings": (R.cancel_requests, "request_id"),
    "cancel_sessions": (R.session_cancel_requests, "request_id"),
    "validate_scans": (R.scan_requests, "scan_id"),
    "walk_in_attendance": (R.walkin_requests, "request_id"),
    "session_conflicts": (R.session_candidates, "candidate_id"),
    "validate_sessions": (R.session_candidates, "candidate_id"),
    "join_rooms": (RM.join_requests, "request_id"),
    "upgrade_room_access": (RM.upgrade_requests, "request_id"),
    "review_eligibility": (RM.review_requests, "request_id"),
    "deposits_to_ledger": (deposit_requests, "request_id"),
}


def test_every_request_gets_exactly_one_decision(spark, tables):
    for key, (make, idc) in DECISION_JOBS.items():
        got = E.queries()[key](spark, SF_SMALL)
        req = make(tables)
        n_req = req.count()
        assert got.count() == n_req == req.select(idc).distinct().count(), key
        assert got.select(idc).distinct().count() == n_req, key
        assert got.filter(F.col("decision").isNull()).count() == 0, key


def test_seats_never_exceed_capacity_after_admission(spark, tables):
    d = B.admit_bookings(tables, R.booking_requests(tables))
    new = d.filter(F.col("decision") == "OK").groupBy("session_id").agg(F.count(F.lit(1)).alias("new"))
    seats, _ = B.batch_bookings(tables, R.booking_requests(tables))
    s = tables["sessions"].select(F.col("id").alias("session_id"), "capacity")
    j = (new.join(s, "session_id").join(seats, F.col("session_id") == F.col("seat_sid"), "left")
         .select((F.coalesce("seats_taken", F.lit(0)) + F.col("new") - F.col("capacity")).alias("over")))
    assert j.filter(F.col("over") > 0).count() == 0


def test_last_running_balance_is_the_balance(spark, tables):
    st = wallet.wallet_statement(tables)
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    last = st.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "balance_after")
    bal = wallet.wallet_balance(tables, include_users_without_rows=False)
    mism = last.join(bal, "user_id").filter(F.col("balance_after") != F.col("balance"))
    assert last.count() == bal.count() and mism.count() == 0
