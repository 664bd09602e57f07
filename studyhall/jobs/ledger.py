"""Ledger jobs: reconciliation per booking, deposits, user status changes (JOB-19, JOB-23, JOB-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import LEDGER_AS_OF
from studyhall.functions.exprs import first_failure, money, ts_lit
from studyhall.jobs.maintenance import apply_patches
from studyhall.operators.prefix import running_sum
from studyhall.plans.wallet import balances_by_user


def ledger_reconciliation(t) -> DataFrame:
    """JOB-19: per booking, what the ledger posted against it (completed rows with
    reference_type = 'booking') next to what the booking says.

    charged / refunded / transferred are sums per type; ``charge_mismatch`` when the charge
    differs from ``amount_paid``; ``transfer_not_reversed`` when a refund exists while the
    owner's transfer stands (C14); ``unknown_booking`` when the ledger names a missing booking.
    """
    led = t["wallet_transactions"].filter((F.col("reference_type") == "booking") & (F.col("status") == "completed"))
    ty = F.col("type")
    per = led.groupBy(F.col("reference_id").alias("l_bid")).agg(
        F.sum(F.when(ty == "booking_charge", F.col("amount"))).alias("_charged"),
        F.sum(F.when(ty == "refund", F.col("amount"))).alias("_refunded"),
        F.sum(F.when(ty == "transfer", F.col("amount"))).alias("_transferred"),
        F.sum(F.when(ty == "deposit", F.col("amount"))).alias("_deposited"))
    b = t["bookings"].select(F.col("id").alias("b_id"), "amount_paid", F.col("status").alias("booking_status"))
    j = b.join(per, b.b_id == per.l_bid, "full_outer")
    z = lambda c: money(F.coalesce(F.col(c), F.lit(0)))
    return j.select(
        F.coalesce(F.col("b_id"), F.col("l_bid")).alias("booking_id"), money(F.col("amount_paid")).alias("amount_paid"),
        "booking_status", z("_charged").alias("charged"), z("_refunded").alias("refunded"),
        z("_transferred").alias("transferred"), z("_deposited").alias("deposited"),
        money(F.coalesce(F.col("_charged"), F.lit(0)) - F.coalesce(F.col("_refunded"), F.lit(0))).alias("net_paid"),
        (F.col("b_id").isNotNull() & (F.coalesce(F.col("_charged"), F.lit(0)) != F.coalesce(F.col("amount_paid"),
                                                                                            F.lit(0))))
        .alias("charge_mismatch"),
        ((F.coalesce(F.col("_refunded"), F.lit(0)) > 0) & (F.coalesce(F.col("_transferred"), F.lit(0)) > 0))
        .alias("transfer_not_reversed"),
        F.col("b_id").isNull().alias("unknown_booking"))


def deposit_requests(t) -> DataFrame:
    """request_id, user_id, amount, payment_method, requested_at: one deposit per customer of
    its account balance (negative ones are refused), a second one of 10 for every 4th."""
    c = t.raw("customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    at = F.timestamp_add("MINUTE", -(k % 60), ts_lit(LEDGER_AS_OF))
    first = c.select((k * 2).alias("request_id"), k.alias("user_id"), F.col("c_acctbal").cast("decimal(10,2)")
                     .alias("amount"), F.when(k % 3 != 0, F.lit("card")).alias("payment_method"),
                     at.alias("requested_at"))
    second = c.filter(k % 4 == 0).select((k * 2 + 1).alias("request_id"), k.alias("user_id"),
                                         F.lit(10).cast("decimal(10,2)").alias("amount"),
                                         F.lit(None).cast("string").alias("payment_method"),
                                         F.timestamp_add("MINUTE", F.lit(1), at).alias("requested_at"))
    return first.unionByName(second)


def deposits_to_ledger(t, requests: DataFrame) -> DataFrame:
    """JOB-23: amount > 0 becomes a completed deposit (method defaults to 'manual'); every
    accepted deposit reports the user's spendable balance after it, in request order."""
    bal = balances_by_user(t["wallet_transactions"], "spendable").withColumnRenamed("user_id", "b_uid")
    r = requests.join(bal, requests.user_id == bal.b_uid, "left")
    r = r.withColumn("decision", first_failure([("INVALID_AMOUNT", F.col("amount").isNull() | (F.col("amount") <= 0))]))
    r = r.withColumn("_ok", F.col("decision") == "OK")
    r = running_sum(r, ["user_id", "_ok"], ["requested_at", "request_id"], "amount", "_deposited")
    balance = money(F.coalesce(F.col("balance"), F.lit(0)) + F.col("_deposited"))
    return r.select("request_id", "user_id", "amount", "decision", F.when(F.col("_ok"), balance).alias("new_balance"),
                    F.when(F.col("_ok"), F.coalesce(F.col("payment_method"), F.lit("manual"))).alias("payment_method"))


def deposit_outputs(decisions: DataFrame, *, as_of=LEDGER_AS_OF) -> DataFrame:
    """JOB-23 rows: one completed deposit per accepted request."""
    ok = decisions.filter(F.col("decision") == "OK")
    ref = F.col("payment_reference") if "payment_reference" in ok.columns else F.lit(None).cast("string")
    return ok.select(F.col("request_id").alias("id"), "user_id", "amount", F.lit("deposit").alias("type"),
                     F.lit("completed").alias("status"), F.lit("Wallet deposit").alias("description"),
                     "payment_method", ref.alias("external_ref"), ts_lit(as_of).alias("created_at"),
                     ts_lit(as_of).alias("completed_at"))


def user_status_changes(t, requests: DataFrame, *, as_of=LEDGER_AS_OF) -> dict[str, DataFrame]:
    """JOB-24: requests (request_id, admin_id, user_id, is_active, reason[, requested_at]):
    FIELD_REQUIRED (no is_active), NOT_FOUND, FORBIDDEN (super_admin target), else OK; OK patches the
    user (of several changes the latest by time, then request id, holds) and writes an audit row
    (activate_user / deactivate_user, details ``{"reason": ...}``)."""
    u = t["users"].select(F.col("id").alias("u_id"), "role")
    j = requests.join(u, requests.user_id == u.u_id, "left")
    d = j.select(*requests.columns, first_failure([
        ("FIELD_REQUIRED", F.col("is_active").isNull()), ("NOT_FOUND", F.col("u_id").isNull()),
        ("FORBIDDEN", F.col("role") == "super_admin")]).alias("decision"))
    ok = d.filter(F.col("decision") == "OK")
    at = F.coalesce(F.col("requested_at"), ts_lit(as_of)) if "requested_at" in requests.columns else ts_lit(as_of)
    patches = ok.select(F.col("user_id").alias("id"), "is_active", at.alias("patched_at"), "request_id")
    audit = ok.select(
        F.col("request_id").alias("id"), "admin_id",
        F.when(F.col("is_active"), "activate_user").otherwise("deactivate_user").alias("action"),
        F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"),
        F.to_json(F.struct(F.col("reason")), {"ignoreNullFields": "false"}).alias("details"),
        ts_lit(as_of).alias("created_at"))
    d = d.select("request_id", "admin_id", "user_id", "is_active", "reason", "decision")
    return {"decisions": d, "users": apply_patches(t["users"], patches, mode="overwrite"), "audit_logs": audit}
