"""Teacher dashboard (Q-30 .. Q-36)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import PAGE_ADMIN, PAGE_DISCOVERY, SESSION_AS_OF, SESSION_STATUSES
from studyhall.functions.exprs import (
    between_times, optional_filters, prune_months, teacher_list_status, ts_lit, virtual_status_filter,
)
from studyhall.operators.topn import top_k_per_group


def teacher_profile(t, *, teacher=None) -> DataFrame:
    """Q-30: profile with sessions per stored status (0 when absent) and active = scheduled + ongoing."""
    tch = optional_filters(t["teachers"], {"id": teacher})
    usr = t["users"].select(F.col("id").alias("u_id"), "name", "email", "phone", "avatar_url")
    st = F.col("status")
    counts = t["sessions"].groupBy(F.col("teacher_id").alias("s_tid")).agg(
        *[F.count_if(st == s).alias(f"sessions_{s}") for s in SESSION_STATUSES])
    j = tch.join(usr, tch.user_id == usr.u_id).join(counts, tch.id == counts.s_tid, "left")
    z = {s: F.coalesce(F.col(f"sessions_{s}"), F.lit(0)) for s in SESSION_STATUSES}
    return j.select(
        F.col("u_id").alias("id"), "name", "email", "phone", "avatar_url", F.col("id").alias("teacher_id"), "bio",
        F.array_join("subjects", ", ").alias("subjects"), F.array_join("grade_levels", ", ").alias("grade_levels"),
        "rating", "total_reviews", "total_sessions", "total_students", "is_verified", "created_at",
        *[z[s].alias(f"sessions_{s}") for s in SESSION_STATUSES],
        (z["scheduled"] + z["ongoing"]).alias("active_sessions"))


def teacher_stats(t, *, teacher=None, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-31: four per-teacher pre-aggregates joined to the teacher (no fan-out)."""
    now = ts_lit(as_of)
    tch = optional_filters(t["teachers"], {"id": teacher}).select("id", "rating", "total_reviews")
    st, at = F.col("status"), F.col("scheduled_at")
    s = t["sessions"].groupBy(F.col("teacher_id").alias("s_tid")).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if((st == "completed") | ((st == "scheduled") & (at < now))).alias("completed_sessions"),
        F.count_if((st == "scheduled") & (at > now)).alias("upcoming_sessions"),
        F.sum("seats_booked").alias("seats"))
    r = t["rooms"].filter(F.col("is_active")).groupBy(F.col("teacher_id").alias("r_tid")).agg(
        F.count(F.lit(1)).alias("rooms"))
    c = t["center_teachers"].filter(F.col("is_active")).groupBy(F.col("teacher_id").alias("c_tid")).agg(
        F.count(F.lit(1)).alias("centers"))
    j = (tch.join(s, tch.id == s.s_tid, "left").join(r, tch.id == r.r_tid, "left")
         .join(c, tch.id == c.c_tid, "left"))
    z = lambda name: F.coalesce(F.col(name), F.lit(0))
    return j.select(F.col("id").alias("teacher_id"), z("total_sessions").alias("total_sessions"),
                    z("completed_sessions").alias("completed_sessions"),
                    z("upcoming_sessions").alias("upcoming_sessions"),
                    z("seats").cast("bigint").alias("total_students_taught"), "rating", "total_reviews",
                    z("rooms").alias("total_rooms"), z("centers").alias("total_centers"))


def teacher_centers(t, *, teacher=None) -> DataFrame:
    """Q-32: the teacher's active links with distinct session and room counts at each centre."""
    ct = optional_filters(t["center_teachers"], {"teacher_id": teacher}, [F.col("is_active")])
    c = t["centers"].select(F.col("id").alias("c_id"), "name", "address", "phone", "logo_url", "rating", "is_active")
    s = t["sessions"].groupBy(F.col("center_id").alias("s_cid"), F.col("teacher_id").alias("s_tid")).agg(
        F.count(F.lit(1)).alias("my_sessions_count"))
    r = t["rooms"].groupBy(F.col("center_id").alias("r_cid"), F.col("teacher_id").alias("r_tid")).agg(
        F.count(F.lit(1)).alias("my_rooms_count"))
    j = (ct.drop("is_active").join(c, ct.center_id == c.c_id)
         .join(s, (F.col("center_id") == s.s_cid) & (F.col("teacher_id") == s.s_tid), "left")
         .join(r, (F.col("center_id") == r.r_cid) & (F.col("teacher_id") == r.r_tid), "left"))
    return j.select("teacher_id", F.col("center_id").alias("id"), "name", "address", "phone", "logo_url", "rating",
                    "is_active", "joined_at", F.coalesce(F.col("my_sessions_count"), F.lit(0)).alias("my_sessions_count"),
                    F.coalesce(F.col("my_rooms_count"), F.lit(0)).alias("my_rooms_count"))


def _session_booking_counts(t) -> DataFrame:
    """bookings per session: total, confirmed, attended (attendance is 0..1 per booking)."""
    att = t["attendances"].select(F.col("booking_id").alias("a_bid"), F.lit(1).alias("has_scan"))
    b = t["bookings"].select("id", "session_id", "status")
    return b.join(att, b.id == att.a_bid, "left").groupBy(F.col("session_id").alias("bc_sid")).agg(
        F.count(F.lit(1)).alias("total_bookings"), F.count_if(F.col("status") == "confirmed").alias("confirmed_bookings"),
        F.count(F.col("has_scan")).alias("total_attended"))


def _teacher_session_rows(t, teacher, status, center, frm, to, as_of) -> DataFrame:
    return optional_filters(prune_months(t["sessions"], "scheduled_at", frm, to),
                            {"teacher_id": teacher, "center_id": center},
                            [virtual_status_filter(status, as_of), between_times("scheduled_at", frm, to)])


def teacher_sessions(t, *, teacher=None, status=None, center=None, frm=None, to=None, as_of=SESSION_AS_OF,
                     limit=PAGE_DISCOVERY, offset=0) -> DataFrame:
    """Q-33: each teacher's page of sessions (newest first) with virtual status and booking counts."""
    s = _teacher_session_rows(t, teacher, status, center, frm, to, as_of)
    c = t["centers"].select(F.col("id").alias("c_id"), F.col("name").alias("center_name"))
    # the page first: names and counts are looked up for its rows only
    page_ = top_k_per_group(s, ["teacher_id"], [F.col("scheduled_at").desc_nulls_first(), F.col("id")], offset + limit)
    page_ = page_.filter(F.col("position") > offset)
    bc = _session_booking_counts(t)
    j = page_.join(c, page_.center_id == c.c_id).join(bc, page_.id == bc.bc_sid, "left")
    return j.select("id", "teacher_id", "subject", "grade_level", "title", "scheduled_at", "duration_min", "capacity",
                    "seats_booked", "price", teacher_list_status(as_of).alias("status"), "center_id", "center_name",
                    *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in
                      ("total_bookings", "confirmed_bookings", "total_attended")], "position")


def teacher_sessions_count(t, *, teacher=None, status=None, center=None, frm=None, to=None,
                           as_of=SESSION_AS_OF) -> DataFrame:
    """Q-33 total per teacher."""
    s = _teacher_session_rows(t, teacher, status, center, frm, to, as_of)
    return s.groupBy("teacher_id").agg(F.count(F.lit(1)).alias("total"))


def teacher_reviews(t, *, teacher=None, limit=PAGE_DISCOVERY, offset=0) -> DataFrame:
    """Q-34: visible reviews with student, session subject and centre; a page per teacher, newest first."""
    r = optional_filters(t["reviews"], {"teacher_id": teacher}, [F.col("is_visible")])
    # the page first: its rows alone are joined
    r = top_k_per_group(r, ["teacher_id"], [F.col("created_at").desc_nulls_first(), F.col("id")], offset + limit)
    r = r.filter(F.col("position") > offset)
    u = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("student_name"),
                          F.col("avatar_url").alias("student_avatar"))
    b = t["bookings"].select(F.col("id").alias("b_id"), F.col("session_id").alias("b_sid"))
    s = t["sessions"].select(F.col("id").alias("s_id"), "subject", "grade_level", F.col("center_id").alias("s_cid"))
    c = t["centers"].select(F.col("id").alias("c_id"), F.col("name").alias("center_name"))
    j = (r.join(u, r.student_id == u.u_id).join(b, r.booking_id == b.b_id).join(s, F.col("b_sid") == s.s_id)
         .join(c, F.col("s_cid") == c.c_id))
    return j.select("teacher_id", "id", "rating", "comment", "created_at", "student_name", "student_avatar", "subject",
                    "grade_level", "center_name", "position")


def teacher_reviews_count(t, *, teacher=None) -> DataFrame:
    """Q-34 total per teacher."""
    r = optional_filters(t["reviews"], {"teacher_id": teacher}, [F.col("is_visible")])
    return r.groupBy("teacher_id").agg(F.count(F.lit(1)).alias("total"))


def teacher_content_usage(t, *, teacher=None, center=None, limit=PAGE_ADMIN, offset=0) -> DataFrame:
    """Q-35: master content with the number of room items using it; page per (teacher, centre)."""
    tc = optional_filters(t["teacher_content"], {"teacher_id": teacher, "center_id": center})
    used = t["content_items"].filter(F.col("teacher_content_id").isNotNull()).groupBy(
        F.col("teacher_content_id").alias("u_tcid")).agg(F.count(F.lit(1)).alias("used_in_rooms_count"))
    j = tc.join(used, tc.id == used.u_tcid, "left")
    rows = j.select("teacher_id", "center_id", "id", "type", "title", "description", "url", "is_free", "is_active",
                    "sort_order", "created_at",
                    F.coalesce(F.col("used_in_rooms_count"), F.lit(0)).alias("used_in_rooms_count"))
    ranked = top_k_per_group(rows, ["teacher_id", "center_id"],
                             [F.col("sort_order").asc_nulls_last(), F.col("created_at").desc_nulls_first(),
                              F.col("id")], offset + limit)
    return ranked.filter(F.col("position") > offset)


def teacher_content_usage_count(t, *, teacher=None, center=None) -> DataFrame:
    """Q-35 total per (teacher, centre)."""
    tc = optional_filters(t["teacher_content"], {"teacher_id": teacher, "center_id": center})
    return tc.groupBy("teacher_id", "center_id").agg(F.count(F.lit(1)).alias("total"))


def center_teacher_content(t, *, teacher=None, center=None, content_type=None, is_free=None,
                           limit=PAGE_ADMIN, offset=0) -> DataFrame:
    """Q-36: active master content with its use count in the rooms of its own centre only."""
    tc = optional_filters(t["teacher_content"], {"teacher_id": teacher, "center_id": center, "type": content_type,
                                                 "is_free": is_free}, [F.col("is_active")])
    rooms = t["rooms"].select(F.col("id").alias("r_id"), F.col("center_id").alias("r_cid"))
    used = (t["content_items"].filter(F.col("teacher_content_id").isNotNull())
            .join(rooms, F.col("room_id") == F.col("r_id"))
            .groupBy(F.col("teacher_content_id").alias("u_tcid"), F.col("r_cid").alias("u_cid"))
            .agg(F.count(F.lit(1)).alias("already_used_count")))
    names = (t["teachers"].select(F.col("id").alias("t_id"), "user_id")
             .join(t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name")),
                   F.col("user_id") == F.col("u_id")))
    j = (tc.join(names, tc.teacher_id == names.t_id)
         .join(used, (tc.id == used.u_tcid) & (tc.center_id == used.u_cid), "left"))
    rows = j.select("teacher_id", "center_id", "id", "type", "title", "description", "url", "is_free", "sort_order",
                    "created_at", "teacher_name",
                    F.coalesce(F.col("already_used_count"), F.lit(0)).alias("already_used_count"))
    ranked = top_k_per_group(rows, ["teacher_id", "center_id"], [F.col("sort_order").asc_nulls_last(), F.col("id")],
                             offset + limit)
    return ranked.filter(F.col("position") > offset)
