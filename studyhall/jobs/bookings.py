"""Booking admission and cancellation decided for whole tables of requests (JOB-01 .. JOB-03).

Each job left-joins the facts every check needs onto the requests, then labels each request
with the first failing check in the reference's order (``first_failure``). Competition inside
one batch (two requests for the last seat, two bookings on one purse) is settled as if the requests came
one by one in the order ``(requested_at, request_id)`` (``operators.settle``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import SESSION_AS_OF
from studyhall.functions.exprs import first_failure, money, new_key, ts_lit
from studyhall.functions.tokens import qr_code
from studyhall.operators.settle import Resource, settle_in_order
from studyhall.operators.topn import is_first_in_group
from studyhall.plans.wallet import balances_by_user

BOOKING_ID_OFFSET = 2_000_000_000_000


def _in_batch(facts: DataFrame, requests: DataFrame, **columns: str) -> DataFrame:
    """The facts about the batch: rows whose columns (fact column=request column) occur together in ``requests``."""
    keys = requests.select(*[F.col(c).alias(f"_b_{c}") for c in columns.values()]).distinct()
    same = [F.col(f) == F.col(f"_b_{c}") for f, c in columns.items()]
    return facts.join(keys, reduce(lambda a, b: a & b, same), "left_semi")


def batch_bookings(t, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the bookings say about a batch: seats taken per session asked for (seat_sid, seats_taken: C2, non-cancelled bookings,
    never the stored counter), and the pairs asked for that are booked already, in any status (e_sid, e_stu, exists)."""
    facts = t["bookings"].select("session_id", "student_id", "status")
    taken = (_in_batch(facts.filter(F.col("status") != "cancelled"), requests, session_id="session_id")
             .groupBy(F.col("session_id").alias("seat_sid")).agg(F.count(F.lit(1)).alias("seats_taken")))
    booked = (_in_batch(facts, requests, session_id="session_id", student_id="student_id")
              .select(F.col("session_id").alias("e_sid"), F.col("student_id").alias("e_stu")).distinct()
              .withColumn("exists", F.lit(True)))
    return taken, booked


def admit_bookings(t, requests: DataFrame, *, as_of=SESSION_AS_OF) -> DataFrame:
    """JOB-01 decisions: request_id, session_id, student_id, price, decision, as if the requests of the batch came
    one by one in the order (requested_at, request_id).

    Order of the checks: NOT_FOUND, NOT_AVAILABLE (not scheduled), SESSION_FULL, ALREADY_STARTED, ALREADY_BOOKED (any
    status, or granted earlier in the batch), INSUFFICIENT_BALANCE (spendable balance less what earlier requests were
    charged). A refused request takes neither seat nor money. Prices are not negative (CHECK); a
    missing price costs nothing and a missing capacity is no limit, as in the reference's comparisons.
    """
    now = ts_lit(as_of)
    s = t["sessions"].select(F.col("id").alias("s_id"), "center_id", "price", "capacity",
                             F.col("status").alias("s_status"), "scheduled_at")
    taken, booked = batch_bookings(t, requests)
    ledger = _in_batch(t["wallet_transactions"], requests, user_id="student_id")
    bal = balances_by_user(ledger, "spendable").withColumnRenamed("user_id", "bal_uid")
    r = (requests.join(s, requests.session_id == s.s_id, "left")
         .join(taken, F.col("session_id") == F.col("seat_sid"), "left")
         .join(booked, (F.col("session_id") == F.col("e_sid")) & (F.col("student_id") == F.col("e_stu")), "left")
         .join(bal, F.col("student_id") == F.col("bal_uid"), "left"))
    seats = F.coalesce(F.col("seats_taken"), F.lit(0))
    static = first_failure([
        ("NOT_FOUND", F.col("s_id").isNull()),
        ("NOT_AVAILABLE", F.col("s_status") != "scheduled"),
        ("SESSION_FULL", seats >= F.col("capacity")),
        ("ALREADY_STARTED", F.col("scheduled_at") <= now),
    ])
    # Who has a booking already may have no further one; whether the session is full by their turn is checked first.
    r = r.select("request_id", "session_id", "student_id", "requested_at", "price",
                 (F.col("capacity") - seats).alias("seats_left"), F.when(F.col("exists"), 0).otherwise(1).alias("bookings_left"),
                 F.coalesce(F.col("balance"), F.lit(0)).alias("balance"), static.alias("static"))
    r = settle_in_order(r, ["requested_at", "request_id"], [
        Resource("seats", ["session_id"], F.lit(1), F.col("seats_left")),
        Resource("once", ["session_id", "student_id"], F.lit(1), F.col("bookings_left")),
        Resource("purse", ["student_id"], F.col("price"), F.col("balance"))], where=F.col("static") == "OK")
    decision = (F.when(F.col("static") != "OK", F.col("static")).when(F.col("accepted"), F.lit("OK"))
                .when(F.col("short_seats"), F.lit("SESSION_FULL")).when(F.col("short_once"), F.lit("ALREADY_BOOKED"))
                .otherwise(F.lit("INSUFFICIENT_BALANCE")))
    return r.select("request_id", "session_id", "student_id", "price", decision.alias("decision"))


def admission_outputs(t, decisions: DataFrame, *, as_of=SESSION_AS_OF) -> dict[str, DataFrame]:
    """New rows of an admission batch: bookings (confirmed), student charge, owner transfer."""
    ok = decisions.filter(F.col("decision") == "OK")
    owners = t["sessions"].select(F.col("id").alias("s_id"), "center_id").join(
        t["centers"].select(F.col("id").alias("c_id"), "owner_id"), F.col("center_id") == F.col("c_id"))
    bid = new_key(ok, "request_id", BOOKING_ID_OFFSET, "booking")
    bookings = ok.select(bid.alias("id"), "session_id", "student_id", F.lit("confirmed").alias("status"),
                         qr_code("student_id", "session_id", bid).alias("qr_code"),
                         F.col("price").alias("amount_paid"), ts_lit(as_of).alias("booked_at"))
    charge = ok.select(F.col("student_id").alias("user_id"), F.col("price").alias("amount"),
                       F.lit("booking_charge").alias("type"), bid.alias("reference_id"))
    transfer = ok.join(owners, F.col("session_id") == F.col("s_id")).select(
        F.col("owner_id").alias("user_id"), F.col("price").alias("amount"), F.lit("transfer").alias("type"),
        bid.alias("reference_id"))
    ledger = charge.unionByName(transfer).select(
        "user_id", "amount", "type", F.lit("completed").alias("status"), "reference_id",
        F.lit("booking").alias("reference_type"), ts_lit(as_of).alias("created_at"))
    return {"bookings": bookings, "wallet_transactions": ledger}


def cancel_bookings(t, requests: DataFrame, *, as_of=SESSION_AS_OF) -> DataFrame:
    """JOB-02 decisions: NOT_FOUND, FORBIDDEN (not the owner), NOT_CANCELLABLE (not pending or
    confirmed, or already cancelled by an earlier request of the batch), ALREADY_STARTED.
    ``refund`` is the booking's amount for OK (posted even when 0, as the reference does)."""
    b = t["bookings"].select(F.col("id").alias("b_id"), F.col("student_id").alias("owner"), "status", "amount_paid",
                             "session_id")
    s = t["sessions"].select(F.col("id").alias("s_id"), "scheduled_at")
    bs = b.join(s, b.session_id == s.s_id)
    r = requests.join(bs, requests.booking_id == bs.b_id, "left")
    static = first_failure([
        ("NOT_FOUND", F.col("b_id").isNull()),
        ("FORBIDDEN", F.col("owner") != F.col("student_id")),
        ("NOT_CANCELLABLE", ~F.col("status").isin("pending", "confirmed")),
        ("ALREADY_STARTED", F.col("scheduled_at") <= ts_lit(as_of)),
    ])
    r = r.select("request_id", "booking_id", "student_id", "requested_at", "amount_paid", static.alias("static"))
    # a second cancellation of one booking in the batch finds it cancelled already
    live = F.col("static") == "OK"
    r = is_first_in_group(r, ["booking_id"], ["requested_at", "request_id"], where=live)
    decision = F.when(~live, F.col("static")).when(F.col("_is_first"), "OK").otherwise("NOT_CANCELLABLE")
    out = r.select("request_id", "booking_id", "student_id", "amount_paid", decision.alias("decision"))
    return out.select("request_id", "booking_id", "student_id", "decision",
                      F.when(F.col("decision") == "OK", money(F.col("amount_paid"))).alias("refund"))


def cancel_sessions(t, requests: DataFrame) -> DataFrame:
    """JOB-03: NOT_FOUND (no such session at this centre), NOT_SCHEDULED (or cancelled earlier
    in the batch); OK cancels every pending/confirmed booking and refunds those with amount > 0.
    Per request: bookings cancelled, refunds processed and their total."""
    s = t["sessions"].select(F.col("id").alias("s_id"), F.col("center_id").alias("s_cid"), "status")
    r = requests.join(s, (requests.session_id == s.s_id) & (requests.center_id == s.s_cid), "left")
    static = first_failure([("NOT_FOUND", F.col("s_id").isNull()), ("NOT_SCHEDULED", F.col("status") != "scheduled")])
    r = r.select("request_id", "session_id", "center_id", "requested_at", static.alias("static"))
    live = F.col("static") == "OK"
    r = is_first_in_group(r, ["session_id"], ["requested_at", "request_id"], where=live)
    out = r.select("request_id", "session_id", "center_id", F.when(~live, F.col("static"))
                   .when(F.col("_is_first"), "OK").otherwise("NOT_SCHEDULED").alias("decision"))
    held = (t["bookings"].filter(F.col("status").isin("pending", "confirmed"))
            .groupBy(F.col("session_id").alias("h_sid")).agg(
                F.count(F.lit(1)).alias("n_held"), F.count_if(F.col("amount_paid") > 0).alias("n_refund"),
                F.sum(F.when(F.col("amount_paid") > 0, F.col("amount_paid"))).alias("refund_sum")))
    ok = F.col("decision") == "OK"
    return out.join(held, out.session_id == held.h_sid, "left").select(
        "request_id", "session_id", "center_id", "decision",
        F.when(ok, F.coalesce(F.col("n_held"), F.lit(0))).alias("bookings_cancelled"),
        F.when(ok, F.coalesce(F.col("n_refund"), F.lit(0))).alias("refunds_processed"),
        F.when(ok, money(F.coalesce(F.col("refund_sum"), F.lit(0)))).alias("refund_total"))


def cancellation_outputs(t, decisions: DataFrame, *, as_of=SESSION_AS_OF) -> dict[str, DataFrame]:
    """JOB-02 rows: booking patches (cancelled, cancelled_at) and one refund per OK request,
    posted even when the amount is 0 (C14); the owner's transfer is not reversed."""
    ok = decisions.filter(F.col("decision") == "OK")
    return {
        "booking_patches": ok.select(F.col("booking_id").alias("id"), F.lit("cancelled").alias("status"),
                                     ts_lit(as_of).alias("cancelled_at"), ts_lit(as_of).alias("patched_at")),
        "wallet_transactions": ok.select(
            F.col("student_id").alias("user_id"), F.col("refund").alias("amount"), F.lit("refund").alias("type"),
            F.lit("completed").alias("status"), F.col("booking_id").alias("reference_id"),
            F.lit("booking").alias("reference_type"), ts_lit(as_of).alias("created_at")),
    }


def session_cancellation_outputs(t, decisions: DataFrame, *, as_of=SESSION_AS_OF,
                                 notify: bool = True) -> dict[str, DataFrame]:
    """JOB-03 rows: the session patch, every pending/confirmed booking cancelled, a refund for
    each with amount > 0 (reference type ``session_cancellation``), and (contract option) one
    ``session_cancelled`` notification per affected student."""
    ok = decisions.filter(F.col("decision") == "OK").select(F.col("session_id").alias("ok_sid"))
    held = t["bookings"].filter(F.col("status").isin("pending", "confirmed")).join(
        ok, F.col("session_id") == F.col("ok_sid"), "left_semi")
    out = {
        "session_patches": ok.select(F.col("ok_sid").alias("id"), F.lit("cancelled").alias("status"),
                                     ts_lit(as_of).alias("patched_at")),
        "booking_patches": held.select("id", F.lit("cancelled").alias("status"), ts_lit(as_of).alias("cancelled_at"),
                                       ts_lit(as_of).alias("patched_at")),
        "wallet_transactions": held.filter(F.col("amount_paid") > 0).select(
            F.col("student_id").alias("user_id"), F.col("amount_paid").alias("amount"), F.lit("refund").alias("type"),
            F.lit("completed").alias("status"), F.col("id").alias("reference_id"),
            F.lit("session_cancellation").alias("reference_type"), ts_lit(as_of).alias("created_at")),
    }
    if notify:
        out["notifications"] = held.select(F.col("student_id").alias("user_id"),
                                           F.lit("session_cancelled").alias("type"),
                                           F.lit("Session cancelled").alias("title"),
                                           F.lit("Your session was cancelled and refunded.").alias("message"),
                                           ts_lit(as_of).alias("created_at"))
    return out
