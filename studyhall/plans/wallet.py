"""Wallet ledger reads (Q-22, Q-22b, Q-23, Q-50 wallet part)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyhall.constants import PAGE_ADMIN
from studyhall.functions.exprs import credit_types_for, money, optional_filters, signed_amount
from studyhall.operators.prefix import running_sum

HISTORY_COLS = ["id", "user_id", "amount", "type", "status", "reference_id", "reference_type", "description",
                "created_at", "completed_at"]


def balances_by_user(ledger: DataFrame, mode: str = "spendable") -> DataFrame:
    """AGG-07: signed completed sum per user (partial aggregation before the shuffle)."""
    return ledger.groupBy("user_id").agg(
        money(F.coalesce(F.sum(signed_amount(credit_types_for(mode))), F.lit(0))).alias("balance"))


def wallet_balance(t, *, user=None, mode: str = "spendable", include_users_without_rows: bool = True) -> DataFrame:
    """Q-22: balance per user; users without ledger rows get 0 (like ``COALESCE(SUM, 0)``)."""
    ledger = optional_filters(t["wallet_transactions"], {"user_id": user})
    bal = balances_by_user(ledger, mode)
    if not include_users_without_rows:
        return bal
    users = optional_filters(t["users"], {"id": user}).select(F.col("id").alias("user_id"))
    return users.join(bal, "user_id", "left").select(
        "user_id", money(F.coalesce(F.col("balance"), F.lit(0))).alias("balance"))


def wallet_statement(t, *, user=None, mode: str = "spendable") -> DataFrame:
    """Q-22b: every ledger row with the user's running balance after it, by (created_at, id)."""
    ledger = optional_filters(t["wallet_transactions"], {"user_id": user}).select(
        "id", "user_id", "type", "status", "amount", "created_at",
        signed_amount(credit_types_for(mode)).alias("signed_amount"))
    out = running_sum(ledger, "user_id", ["created_at", "id"], "signed_amount", "balance_after")
    return out.select("id", "user_id", "type", "status", "amount", "created_at",
                      money(F.col("signed_amount")).alias("signed_amount"),
                      money(F.col("balance_after")).alias("balance_after"))


def wallet_history(t, *, user=None, tx_type=None, limit=PAGE_ADMIN, offset=0) -> DataFrame:
    """Q-23: newest-first page of each user's ledger (whole table: the page of every user).

    ``row_number() <= k`` is planned as a WindowGroupLimit: each map task keeps only the top
    rows per user before the shuffle, so a user with a huge ledger ships at most k rows per task.
    """
    ledger = optional_filters(t["wallet_transactions"], {"user_id": user, "type": tx_type}).select(*HISTORY_COLS)
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").asc())
    ranked = ledger.withColumn("position", F.row_number().over(w))
    return ranked.filter((F.col("position") > offset) & (F.col("position") <= offset + limit)) \
        .withColumn("position", F.col("position").cast("bigint"))


def wallet_history_count(t, *, user=None, tx_type=None) -> DataFrame:
    """Q-23 total: ledger rows per user for the same filters."""
    ledger = optional_filters(t["wallet_transactions"], {"user_id": user, "type": tx_type})
    return ledger.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


def wallet_by_month(t) -> DataFrame:
    """Q-50: ledger volume per calendar month (UTC) and type."""
    return (t["wallet_transactions"]
            .groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month"), "type")
            .agg(F.count(F.lit(1)).alias("transactions"), money(F.sum("amount")).alias("amount")))
