"""Centre dashboard and analytics views (Q-37 .. Q-43, Q-47 .. Q-50)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import SESSION_AS_OF
from studyhall.functions.exprs import (
    between_times, money, optional_filters, pct, prune_months, session_clock_status, session_status_label, text_bool,
    ts_lit,
)


def _teacher_block(t) -> DataFrame:
    tch = t["teachers"].select(F.col("id").alias("t_id"), "user_id", "bio", "subjects", "grade_levels", "rating",
                               "total_reviews")
    usr = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"))
    return tch.join(usr, tch.user_id == usr.u_id).drop("user_id", "u_id")


def room_content_admin(t, *, room=None) -> DataFrame:
    """Q-37: every content item of a room, unredacted, in rank order (sort_order, created_at)."""
    return optional_filters(t["content_items"], {"room_id": room}).select(
        "room_id", "id", "type", "title", "description", "url", "is_free", "sort_order", "created_at")


def center_rooms(t, *, center=None, teacher=None, active: str | bool | None = None) -> DataFrame:
    """Q-38: rooms with teacher name and content / member counts.

    The reference counts DISTINCT ids over a join that multiplies items by members; counting
    each side per room first gives the same numbers without building that product.
    """
    act = text_bool(F.lit(active)) if isinstance(active, str) else (F.lit(active) if active is not None else None)
    r = optional_filters(t["rooms"], {"center_id": center, "teacher_id": teacher},
                         [None if act is None else (F.col("is_active") == act)])
    ci = t["content_items"].groupBy(F.col("room_id").alias("ci_room")).agg(F.count(F.lit(1)).alias("n_content"))
    rm = t["room_members"].groupBy(F.col("room_id").alias("rm_room")).agg(F.count(F.lit(1)).alias("n_members"))
    j = (r.join(_teacher_block(t).select("t_id", "teacher_name"), r.teacher_id == F.col("t_id"))
         .join(ci, r.id == ci.ci_room, "left").join(rm, r.id == rm.rm_room, "left"))
    return j.select("center_id", "id", "name", "description", "grade_level", "subject", "access_code", "is_active",
                    F.coalesce(F.col("n_content"), F.lit(0)).alias("content_count"), "created_at", "paid_price",
                    "teacher_id", "teacher_name", F.coalesce(F.col("n_members"), F.lit(0)).alias("member_count"))


def room_members_list(t, *, room=None) -> DataFrame:
    """Q-39: members of a room with the student's name, e-mail and avatar."""
    rm = optional_filters(t["room_members"], {"room_id": room})
    u = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("student_name"),
                          F.col("email").alias("student_email"), "avatar_url")
    return rm.join(u, rm.student_id == u.u_id).select("room_id", "id", "access_tier", "joined_at", "student_id",
                                                      "student_name", "student_email", "avatar_url")


def center_teacher_roster(t, *, center=None, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-40: every teacher linked to the centre (any link state) with sessions there and upcoming ones."""
    ct = optional_filters(t["center_teachers"], {"center_id": center}).select("center_id", "teacher_id")
    now = ts_lit(as_of)
    s = t["sessions"].groupBy(F.col("center_id").alias("s_cid"), F.col("teacher_id").alias("s_tid")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("scheduled_at") > now) & (F.col("status") != "cancelled")).alias("up"))
    j = (ct.join(_teacher_block(t), ct.teacher_id == F.col("t_id"))
         .join(s, (ct.center_id == s.s_cid) & (ct.teacher_id == s.s_tid), "left"))
    return j.select("center_id", F.col("teacher_id").alias("id"), F.col("teacher_name").alias("user_name"), "bio",
                    F.array_join("subjects", ", ").alias("subjects"),
                    F.array_join("grade_levels", ", ").alias("grade_levels"), "rating", "total_reviews",
                    F.coalesce(F.col("n"), F.lit(0)).alias("sessions_count"),
                    F.coalesce(F.col("up"), F.lit(0)).alias("upcoming_sessions"))


def center_session_board(t, *, center=None, as_of=SESSION_AS_OF, status=None, teacher=None, frm=None,
                         to=None) -> DataFrame:
    """Q-41: sessions with clock status and label, free slots (capacity - pending/confirmed), teacher block.

    The reference's correlated ``(SELECT COUNT(*) ... WHERE b.session_id = s.id)`` is a
    pre-aggregate joined back with a 0 default (JOIN-09). Contract options: ``status`` (the
    clock status), ``teacher``, ``frm`` / ``to`` on the start time (inclusive).
    """
    s = optional_filters(prune_months(t["sessions"], "scheduled_at", frm, to),
                         {"center_id": center, "teacher_id": teacher},
                         [between_times("scheduled_at", frm, to),
                          None if status is None else session_clock_status(as_of) == status])
    held = (t["bookings"].filter(F.col("status").isin("pending", "confirmed"))
            .groupBy(F.col("session_id").alias("h_sid")).agg(F.count(F.lit(1)).alias("held")))
    j = s.join(_teacher_block(t), s.teacher_id == F.col("t_id")).join(held, s.id == held.h_sid, "left")
    return j.select(
        "center_id", "id", "subject", "grade_level", "scheduled_at", "duration_min", "capacity", "notes",
        F.col("teacher_name").alias("teacher_name"), "price",
        session_clock_status(as_of).alias("status"), session_status_label(as_of).alias("status_label"),
        (F.col("capacity") - F.coalesce(F.col("held"), F.lit(0))).alias("available_slots"),
        F.col("teacher_id"), F.col("bio").alias("teacher_bio"),
        F.array_join("subjects", ", ").alias("teacher_subjects"),
        F.array_join("grade_levels", ", ").alias("teacher_grade_levels"), F.col("rating").alias("teacher_rating"),
        F.col("total_reviews").alias("teacher_total_reviews"))


def session_attendance(t, *, session=None) -> DataFrame:
    """Q-42: the roster of a session with each student's scan time (NULL when not scanned)."""
    b = optional_filters(t["bookings"], {"session_id": session})
    u = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("student_name"),
                          F.col("avatar_url").alias("student_avatar"))
    a = t["attendances"].select(F.col("booking_id").alias("a_bid"), "scanned_at")
    j = b.join(u, b.student_id == u.u_id).join(a, b.id == a.a_bid, "left")
    return j.select("session_id", F.col("id").alias("booking_id"), "student_id", "status", "student_name",
                    "student_avatar", "scanned_at")


def session_attendance_summary(t, *, session=None) -> DataFrame:
    """Q-43: booked, attended, no_show (counts ``confirmed``, as the reference does: C10), cancelled.

    Only bookings whose student exists count (the roster is an inner join with users).
    """
    b = optional_filters(t["bookings"], {"session_id": session})
    u = t["users"].select(F.col("id").alias("u_id"))
    st = F.col("status")
    return b.join(u, b.student_id == u.u_id, "left_semi").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_booked"), F.count_if(st == "attended").alias("attended"),
        F.count_if(st == "confirmed").alias("no_show"), F.count_if(st == "cancelled").alias("cancelled"))


def _center_metrics(t) -> DataFrame:
    """Per-centre metrics of the analytics view, each counted on its own side (no fan-out)."""
    ct = t["center_teachers"]
    teachers = ct.groupBy(F.col("center_id").alias("k")).agg(
        F.count_distinct(F.when(F.col("is_active"), F.col("teacher_id"))).alias("active_teachers"),
        F.count(F.lit(1)).alias("_links"))
    s = t["sessions"].select("id", "center_id", "status")
    sess = s.groupBy(F.col("center_id").alias("k")).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(F.col("status") == "completed").alias("completed_sessions"))
    att = t["attendances"].select(F.col("booking_id").alias("a_bid"), F.lit(1).alias("scan"))
    b = (t["bookings"].select("id", "session_id", "student_id", "status", "amount_paid")
         .join(s.select(F.col("id").alias("s_id"), F.col("center_id").alias("k")), F.col("session_id") == F.col("s_id"))
         .join(att, F.col("id") == F.col("a_bid"), "left"))
    # one pass over the bookings: aggregate per (centre, student) first, then per centre;
    # the number of (centre, student) groups is the distinct student count.
    per_student = b.groupBy("k", "student_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.col("scan")).alias("_scans"),
        F.count_if(F.col("status") != "cancelled").alias("_nc"),
        F.sum(F.when(F.col("status").isin("confirmed", "attended"), F.col("amount_paid"))).alias("_rev"))
    book = per_student.groupBy("k").agg(
        F.sum("_n").alias("total_bookings"), F.sum("_scans").alias("total_attendances"),
        F.sum("_nc").alias("_not_cancelled"), F.sum("_rev").alias("_revenue"),
        F.count(F.lit(1)).alias("unique_students"))
    c = t["centers"].select(F.col("id").alias("center_id"), F.col("name").alias("center_name"))
    j = c
    for part in (teachers, sess, book):
        j = j.join(part, j.center_id == part.k, "left").drop("k")
    return j


def _analytics_select(j: DataFrame, revenue) -> DataFrame:
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    return j.select(
        "center_id", "center_name", z("active_teachers").alias("active_teachers"),
        z("total_sessions").alias("total_sessions"), z("completed_sessions").alias("completed_sessions"),
        z("total_bookings").alias("total_bookings"), z("unique_students").alias("unique_students"),
        z("total_attendances").alias("total_attendances"),
        money(F.coalesce(revenue, F.lit(0))).alias("total_revenue"),
        F.coalesce(pct("coalesce(total_attendances, 0)", "coalesce(_not_cancelled, 0)"),
                   F.lit(0).cast("decimal(10,1)")).alias("attendance_rate"))


def center_analytics_exact(t) -> DataFrame:
    """Q-48: the analytics view's metrics with revenue counted once per booking."""
    return _analytics_select(_center_metrics(t), F.col("_revenue"))


def center_analytics(t) -> DataFrame:
    """Q-47: the view as declared (C5). Its left joins repeat every booking once per
    ``center_teachers`` row of the centre, which only changes the revenue sum: the literal
    value is the exact revenue times max(1, links). Computed that way, the product is never built.
    """
    j = _center_metrics(t)
    return _analytics_select(j, F.col("_revenue") * F.greatest(F.coalesce(F.col("_links"), F.lit(0)), F.lit(1)))


def student_bookings_summary(t, *, student=None) -> DataFrame:
    """Q-49 (view): booking + session + teacher + centre + attended flag."""
    b = optional_filters(t["bookings"], {"student_id": student})
    s = t["sessions"].select(F.col("id").alias("s_id"), "subject", "grade_level", F.col("title").alias("session_title"),
                             "scheduled_at", "duration_min", F.col("status").alias("session_status"),
                             F.col("teacher_id"), F.col("center_id").alias("s_cid"))
    tu = t["teachers"].select(F.col("id").alias("t_id"), "user_id", F.col("rating").alias("teacher_rating"))
    tb = tu.join(t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"),
                                   F.col("avatar_url").alias("teacher_avatar")), F.col("user_id") == F.col("u_id")).drop("user_id")
    c = t["centers"].select(F.col("id").alias("center_id"), F.col("name").alias("center_name"),
                            F.col("address").alias("center_address"), F.col("lat").alias("center_lat"),
                            F.col("lng").alias("center_lng"))
    a = t["attendances"].select(F.col("booking_id").alias("a_bid"), F.col("id").alias("a_id"), "scanned_at")
    # Sessions take their teacher and centre, bookings their scan, before the two meet: the wide rows are shuffled once.
    place = s.join(tb, F.col("teacher_id") == F.col("t_id")).join(c, F.col("s_cid") == c.center_id)
    j = b.join(a, b.id == a.a_bid, "left").join(place, F.col("session_id") == F.col("s_id"))
    return j.select(F.col("id").alias("booking_id"), "student_id", F.col("status").alias("booking_status"), "qr_code",
                    "amount_paid", "booked_at", F.col("session_id"), "subject", "grade_level", "session_title",
                    "scheduled_at", "duration_min", "session_status", "teacher_id", "teacher_name", "teacher_avatar",
                    "teacher_rating", "center_id", "center_name", "center_address", "center_lat", "center_lng",
                    F.col("a_id").isNotNull().alias("attended"), F.col("scanned_at").alias("attended_at"))


def sessions_by_month(t) -> DataFrame:
    """Q-50: sessions per calendar month of ``scheduled_at`` (UTC) and status."""
    return t["sessions"].groupBy(F.date_trunc("month", "scheduled_at").cast("timestamp_ntz").alias("month"),
                                 "status").agg(F.count(F.lit(1)).alias("sessions"),
                                               money(F.sum("price")).alias("list_value"))


def bookings_by_month(t) -> DataFrame:
    """Q-50: bookings per calendar month of ``booked_at`` and status."""
    return t["bookings"].groupBy(F.date_trunc("month", "booked_at").cast("timestamp_ntz").alias("month"),
                                 "status").agg(F.count(F.lit(1)).alias("bookings"),
                                               money(F.sum("amount_paid")).alias("amount"))
