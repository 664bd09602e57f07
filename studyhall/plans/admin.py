"""Platform administration reports (Q-01 .. Q-12, Q-44, Q-45, Q-53, Q-54)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import PAGE_ADMIN, ROLES, SESSION_AS_OF
from studyhall.functions.exprs import (
    between_times, ilike_any, money, optional_filters, pct, prune_months, since, ts_lit,
)
from studyhall.operators.pages import one_row, page, pg_desc
from studyhall.plans.wallet import wallet_balance

USER_COLS = ["id", "name", "email", "phone", "role", "avatar_url", "is_active", "created_at", "last_login_at"]


def _user_filter(t, role=None, active=None, term=None) -> DataFrame:
    return optional_filters(t["users"], {"role": role, "is_active": active},
                            [ilike_any(["name", "email", "phone"], term)])


def user_search(t, *, role=None, active=None, term=None, limit=PAGE_ADMIN, offset=0) -> DataFrame:
    """Q-01: newest-first page of users matching the optional filters."""
    return page(_user_filter(t, role, active, term).select(*USER_COLS), [pg_desc("created_at")], limit, offset)


def user_search_count(t, *, role=None, active=None, term=None) -> DataFrame:
    """Q-02: total for the same filters (one row, zero when nothing matches)."""
    return _user_filter(t, role, active, term).agg(F.count(F.lit(1)).alias("total"))


def users_by_role(t) -> DataFrame:
    """Q-03: users per role."""
    return t["users"].groupBy("role").agg(F.count(F.lit(1)).alias("users"))


def _role_counts(t) -> DataFrame:
    """AGG-11: one row, a count per role with 0 for an absent role, plus the total."""
    u = t["users"]
    return u.agg(F.count(F.lit(1)).alias("users_total"),
                 *[F.count_if(F.col("role") == r).alias(f"users_{r}") for r in ROLES])


def center_counts(t) -> DataFrame:
    """Q-04."""
    return t["centers"].agg(F.count(F.lit(1)).alias("total_centers"),
                            F.count_if(F.col("is_active")).alias("active_centers"))


def session_status_counts(t) -> DataFrame:
    """Q-05."""
    st = F.col("status")
    return t["sessions"].agg(F.count(F.lit(1)).alias("total_sessions"),
                             F.count_if(st == "scheduled").alias("scheduled"),
                             F.count_if(st == "completed").alias("completed"),
                             F.count_if(st == "cancelled").alias("cancelled"))


def booking_stats(t) -> DataFrame:
    """Q-06: revenue sums every booking, cancelled ones included (as the reference does)."""
    st = F.col("status")
    return t["bookings"].agg(F.count(F.lit(1)).alias("total_bookings"),
                             F.count_if(st == "confirmed").alias("confirmed"),
                             F.count_if(st == "attended").alias("attended"),
                             F.count_if(st == "cancelled").alias("cancelled"),
                             money(F.coalesce(F.sum("amount_paid"), F.lit(0))).alias("total_revenue"))


def room_stats(t) -> DataFrame:
    """Q-07: rooms and the stored member/content counters."""
    return t["rooms"].agg(F.count(F.lit(1)).alias("total_rooms"),
                          F.coalesce(F.sum("member_count"), F.lit(0)).cast("bigint").alias("total_memberships"),
                          F.coalesce(F.sum("content_count"), F.lit(0)).cast("bigint").alias("total_content"))


def recent_activity(t, *, as_of=SESSION_AS_OF, n_days=30) -> DataFrame:
    """Q-08: new users / sessions / bookings in the last ``n_days`` (three scalar subqueries)."""
    start = (dt.datetime.fromisoformat(str(as_of)) - dt.timedelta(days=n_days)).isoformat(sep=" ")

    def n_since(df, col):
        return prune_months(df, col, frm=start).filter(since(col, as_of, n_days)).agg(F.count(F.lit(1)))
    spark = t["users"].sparkSession
    return one_row(spark,
                   new_users=n_since(t["users"], "created_at"),
                   new_sessions=n_since(t["sessions"], "created_at"),
                   new_bookings=n_since(t["bookings"], "booked_at"))


def platform_analytics(t, *, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-09 flat: every dashboard number of Q-03 .. Q-08 in one row."""
    spark = t["users"].sparkSession
    parts = {}
    for frame in (_role_counts(t), center_counts(t), session_status_counts(t), booking_stats(t),
                  room_stats(t), recent_activity(t, as_of=as_of)):
        prefix = ""
        if "total_sessions" in frame.columns:
            prefix = "sessions_"
        elif "total_bookings" in frame.columns:
            prefix = "bookings_"
        for c in frame.columns:
            name = c if (c.startswith(("users_", "total_", "active_", "new_")) or not prefix) else prefix + c
            parts[name] = frame.select(c)
    return one_row(spark, **parts)


def platform_analytics_document(t, *, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-09 nested (flagship): the dashboard as one row of structs, like the reference's JSON."""
    flat = platform_analytics(t, as_of=as_of)
    c = F.col
    return flat.select(
        F.struct(F.struct(*[c(f"users_{r}").alias(r) for r in ROLES]).alias("by_role"),
                 c("users_total").alias("total")).alias("users"),
        F.struct(c("total_centers").alias("total"), c("active_centers").alias("active")).alias("centers"),
        F.struct(c("total_sessions").alias("total"), c("sessions_scheduled").alias("scheduled"),
                 c("sessions_completed").alias("completed"), c("sessions_cancelled").alias("cancelled"))
        .alias("sessions"),
        F.struct(c("total_bookings").alias("total"), c("bookings_confirmed").alias("confirmed"),
                 c("bookings_attended").alias("attended"), c("bookings_cancelled").alias("cancelled"),
                 c("total_revenue").alias("total_revenue")).alias("bookings"),
        F.struct(c("total_rooms").alias("total"), c("total_memberships").alias("total_memberships"),
                 c("total_content").alias("total_content")).alias("rooms"),
        F.struct(c("new_users"), c("new_sessions"), c("new_bookings")).alias("recent_30_days"),
    )


def audit_log_search(t, *, admin=None, action=None, entity_type=None, frm=None, to=None,
                     limit=PAGE_ADMIN, offset=0) -> DataFrame:
    """Q-10: audit rows joined with the acting admin, newest first."""
    logs = optional_filters(prune_months(t["audit_logs"], "created_at", frm, to),
                            {"admin_id": admin, "action": action, "entity_type": entity_type},
                            [between_times("created_at", frm, to)])
    admins = t["users"].select(F.col("id").alias("uid"), F.col("name").alias("admin_name"),
                               F.col("email").alias("admin_email"))
    joined = logs.join(admins, logs.admin_id == admins.uid).select(
        "id", "action", "entity_type", "entity_id", "details", "created_at", "admin_name", "admin_email")
    return page(joined, [pg_desc("created_at")], limit, offset)


def user_details(t, *, user=None) -> DataFrame:
    """Q-11: user with the block of its role: teacher profile, owned centre or booking stats.

    Whole-table form; ``user`` narrows it to the reference's single answer. Each block is
    built only for the role that has it, then attached by key (pre-aggregated, no fan-out).
    """
    users = optional_filters(t["users"], {"id": user}).select(*USER_COLS, "lat", "lng")
    tch = t["teachers"].select(F.col("user_id").alias("t_uid"), F.col("id").alias("teacher_id"),
                               F.col("bio").alias("teacher_bio"),
                               F.array_join("subjects", ", ").alias("teacher_subjects"),
                               F.array_join("grade_levels", ", ").alias("teacher_grade_levels"),
                               F.col("rating").alias("teacher_rating"),
                               F.col("total_reviews").alias("teacher_total_reviews"))
    ctr = t["centers"].select(F.col("owner_id").alias("c_uid"), F.col("id").alias("center_id"),
                              F.col("name").alias("center_name"), F.col("address").alias("center_address"),
                              F.col("is_active").alias("center_is_active"))
    stats = t["bookings"].groupBy(F.col("student_id").alias("b_uid")).agg(
        F.count(F.lit(1)).alias("total_bookings"), F.count_if(F.col("status") == "attended").alias("attended"))
    role = F.col("role")
    out = (users.join(tch, (users.id == tch.t_uid) & (role == "teacher"), "left")
           .join(ctr, (users.id == ctr.c_uid) & (role == "center_admin"), "left")
           .join(stats, (users.id == stats.b_uid) & (role == "student"), "left"))
    student = role == "student"
    return out.select(
        *USER_COLS, "lat", "lng", "teacher_id", "teacher_bio", "teacher_subjects", "teacher_grade_levels",
        "teacher_rating", "teacher_total_reviews", "center_id", "center_name", "center_address", "center_is_active",
        F.when(student, F.coalesce("total_bookings", F.lit(0))).alias("total_bookings"),
        F.when(student, F.coalesce("attended", F.lit(0))).alias("attended_bookings"),
    )


def student_attendance_stats(t, *, student=None) -> DataFrame:
    """Q-12: per student: totals by status and attendance rate (0 when there are no bookings)."""
    students = optional_filters(t["users"], {"id": student}, [F.col("role") == "student"]).select("id")
    st = F.col("status")
    agg = t["bookings"].groupBy(F.col("student_id").alias("sid")).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(st == "attended").alias("n_attended"),
        F.count_if(st == "pending").alias("n_pending"), F.count_if(st == "confirmed").alias("n_confirmed"),
        F.count_if(st == "cancelled").alias("n_cancelled"))
    j = students.join(agg, students.id == agg.sid, "left").select(
        F.col("id").alias("student_id"),
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(k) for k in
          ("total", "attended", "pending", "confirmed", "cancelled")])
    return j.select(
        "student_id",
        F.col("total").alias("total_bookings"), F.col("attended").alias("attended_sessions"),
        F.col("pending").alias("pending_bookings"), F.col("confirmed").alias("confirmed_bookings"),
        F.col("cancelled").alias("cancelled_bookings"),
        F.coalesce(pct("attended", "total"), F.lit(0).cast("decimal(10,1)")).alias("attendance_rate"))


def center_profile(t, *, center=None) -> DataFrame:
    """Q-44: centre with the owner's avatar and its coordinates."""
    c = optional_filters(t["centers"], {"id": center})
    u = t["users"].select(F.col("id").alias("uid"), "avatar_url")
    return c.join(u, c.owner_id == u.uid).select(
        "id", "name", "address", "description", "phone", "avatar_url", "lng", "lat", "created_at")


def user_profile(t, *, user=None) -> DataFrame:
    """Q-45: user with lat/lng or NULL."""
    return optional_filters(t["users"], {"id": user}).select(
        "id", "name", "email", "phone", "role", "avatar_url", "is_active", "created_at",
        F.when(F.col("lat").isNotNull(), F.col("lat")).alias("lat"),
        F.when(F.col("lat").isNotNull(), F.col("lng")).alias("lng"))


def user_profile_with_balance(t, *, user=None, mode="spendable") -> DataFrame:
    """Q-54 (contract): profile plus wallet balance (0 without ledger rows)."""
    prof = user_profile(t, user=user)
    bal = wallet_balance(t, mode=mode, include_users_without_rows=False).withColumnRenamed("user_id", "b_uid")
    return prof.join(bal, prof.id == bal.b_uid, "left").select(
        *prof.columns, money(F.coalesce(F.col("balance"), F.lit(0))).alias("balance"))


def platform_summary(t, *, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-53 (contract): totals and the users active on the day of ``as_of``."""
    spark = t["users"].sparkSession
    day = F.date_trunc("day", ts_lit(as_of)).cast("timestamp_ntz")
    return one_row(
        spark,
        total_users=t["users"].agg(F.count(F.lit(1))),
        total_centers=t["centers"].agg(F.count(F.lit(1))),
        total_teachers=t["teachers"].agg(F.count(F.lit(1))),
        total_sessions=t["sessions"].agg(F.count(F.lit(1))),
        total_bookings=t["bookings"].agg(F.count(F.lit(1))),
        total_revenue=t["bookings"].agg(money(F.coalesce(F.sum(F.when(
            F.col("status").isin("confirmed", "attended"), F.col("amount_paid"))), F.lit(0)))),
        active_today=t["users"].agg(F.count_if((F.col("last_login_at") >= day)
                                               & (F.col("last_login_at") <= ts_lit(as_of)))),
    )


def cut_payloads(t) -> DataFrame:
    """Payloads of the registered instance (source, payload): the ledger's metadata, every 97th cut short as by a broken client, and
    the audit log's details."""
    ledger = t["wallet_transactions"].select(F.lit("wallet_transactions").alias("source"), F.when(
        F.col("id") % 97 == 0, F.expr("left(metadata, length(metadata) - 1)")).otherwise(F.col("metadata")).alias("payload"))
    return ledger.unionByName(t["audit_logs"].select(F.lit("audit_logs").alias("source"), F.col("details").alias("payload")))


def payload_summary(payloads: DataFrame, path: str = "$.k") -> DataFrame:
    """SRC-05: free-form JSON payloads as VARIANT, per source: rows, missing and malformed ones, the schema all the others
    agree on, and the number, sum and range of the integer at ``path`` (values of other types do not count)."""
    v = payloads.select("source", "payload", F.try_parse_json("payload").alias("v"))
    value = F.try_variant_get("v", path, "bigint")
    return v.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("payload").isNull()).alias("missing"),
        F.count_if(F.col("payload").isNotNull() & F.col("v").isNull()).alias("malformed"),
        F.schema_of_variant_agg("v").alias("payload_schema"), F.count(value).alias("n_values"), F.sum(value).alias("sum_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"))
