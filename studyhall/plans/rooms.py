"""Bookings and content rooms seen by a student (Q-24 .. Q-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.functions.exprs import first_failure, optional_filters, redact_by_tier
from studyhall.functions.links import embed_url, file_id, is_valid_url, url_class, video_id


def _teacher_names(t) -> DataFrame:
    tch = t["teachers"].select(F.col("id").alias("t_id"), F.col("user_id").alias("t_uid"))
    usr = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"),
                            F.col("avatar_url").alias("teacher_avatar"))
    return tch.join(usr, tch.t_uid == usr.u_id).select("t_id", "teacher_name", "teacher_avatar")


def booking_history(t, *, student=None, status=None) -> DataFrame:
    """Q-24 (flat): bookings with session, centre and teacher; ``booking_history_documents`` nests the session."""
    b = optional_filters(t["bookings"], {"student_id": student, "status": status})
    s = t["sessions"].select(F.col("id").alias("s_id"), F.col("center_id").alias("s_cid"), "teacher_id",
                             "subject", "grade_level", "scheduled_at", "duration_min",
                             F.col("status").alias("session_status"))
    c = t["centers"].select(F.col("id").alias("c_id"), F.col("name").alias("center_name"))
    # Sessions, the fewer rows, take their centre and teacher first: bookings are shuffled once, by their session.
    place = s.join(c, F.col("s_cid") == c.c_id).join(_teacher_names(t), F.col("teacher_id") == F.col("t_id"))
    j = b.join(place, b.session_id == F.col("s_id"))
    return j.select("id", "student_id", "status", "qr_code", "amount_paid", "booked_at", "session_id", "teacher_id",
                    "teacher_name", "subject", "grade_level", "scheduled_at", "duration_min", "session_status",
                    "center_name")


def booking_history_documents(t, *, student=None) -> DataFrame:
    """Q-24 as the reference answers it (PRJ-05): each booking with its session as one JSON object."""
    h = booking_history(t, student=student)
    session = F.struct(F.col("session_id").alias("id"), "subject", "grade_level", "duration_min",
                       F.col("session_status").alias("status"))
    return h.select("id", "student_id", "status", "qr_code", "amount_paid", "booked_at", "scheduled_at", "teacher_name",
                    "center_name", F.to_json(session, {"ignoreNullFields": "false"}).alias("session"))


def room_counters(t) -> DataFrame:
    """Q-51: content items per room."""
    return t["content_items"].groupBy("room_id").agg(F.count(F.lit(1)).alias("content_count"))


def student_rooms(t, *, student=None) -> DataFrame:
    """Q-25: active memberships with room, teacher and content count (0 when the room has none)."""
    rm = optional_filters(t["room_members"], {"student_id": student}, [F.col("is_active")])
    r = t["rooms"].select(F.col("id").alias("r_id"), "name", "description", "subject", "grade_level",
                          F.col("is_active").alias("room_active"), "teacher_id")
    j = (rm.join(r, rm.room_id == r.r_id).join(_teacher_names(t), F.col("teacher_id") == F.col("t_id"))
         .join(room_counters(t).withColumnRenamed("room_id", "cc_room"), F.col("room_id") == F.col("cc_room"), "left"))
    return j.select("student_id", F.col("room_id").alias("id"), "name", "description", "subject", "grade_level",
                    F.col("room_active").alias("is_active"), "access_tier", "joined_at", "teacher_name",
                    "teacher_avatar", F.coalesce(F.col("content_count"), F.lit(0)).alias("content_count"))


def _gated_items(t) -> DataFrame:
    active = t["rooms"].filter(F.col("is_active")).select(F.col("id").alias("a_room"))
    return t["content_items"].join(active, F.col("room_id") == F.col("a_room"), "left_semi")


def _gated_cols():
    return ["room_id", F.col("id").alias("content_id"), "type", "title", "description", "is_free", "sort_order",
            "duration_seconds", "view_count", "created_at", redact_by_tier("url").alias("url"),
            redact_by_tier("thumbnail_url").alias("thumbnail_url")]


def room_content_by_tier(t) -> DataFrame:
    """Q-26, whole-table form: each item of an active room as seen by each access tier
    (url / thumbnail hidden from the free tier unless the item is free), in rank order.

    A member's view is the row of (room, member's tier): two rows per item, never one per
    member and item.
    """
    items = _gated_items(t).withColumn("access_tier", F.explode(F.array(F.lit("free"), F.lit("paid"))))
    return items.select("access_tier", *_gated_cols())


def room_content_gated(t, *, room=None, student=None) -> DataFrame:
    """Q-26 for one room and/or student: the items of active rooms the student is an active
    member of, redacted by the member's tier. Needs ``room`` or ``student``: the whole-table
    form is ``room_content_by_tier`` (members x items would grow with the square of a room)."""
    if room is None and student is None:
        raise ValueError("room_content_gated needs room or student; use room_content_by_tier for whole tables")
    rm = optional_filters(t["room_members"], {"room_id": room, "student_id": student}, [F.col("is_active")]).select(
        "student_id", F.col("room_id").alias("m_room"), "access_tier")
    ci = optional_filters(_gated_items(t), {"room_id": room})
    j = rm.join(ci, rm.m_room == ci.room_id)
    return j.select("student_id", *_gated_cols())


def room_info(t, *, room=None) -> DataFrame:
    """Q-27: room with teacher name and paid price."""
    r = optional_filters(t["rooms"], {"id": room})
    return r.join(_teacher_names(t), r.teacher_id == F.col("t_id")).select(
        F.col("id").alias("room_id"), "name", "description", "grade_level", "subject", "teacher_name", "paid_price")


def content_access_requests(t) -> DataFrame:
    """Requests (content_id, student_id) of the registered instance: every membership, in any state, asks
    for one item of its room (chosen by its id; an unknown item if the room has none), and every
    item is asked for by one other student. Requests grow with the members and the items."""
    nc = t.n_customer
    ci = t["content_items"].select(F.col("id").alias("content_id"), "room_id")
    # the items of room r are r, r + nc, r + 2 nc, ... in the derived tables
    per_room = ci.groupBy(F.col("room_id").alias("a_room")).agg(F.count(F.lit(1)).alias("_n"))
    rm = t["room_members"].join(per_room, F.col("room_id") == F.col("a_room"), "left")
    item = F.when(F.col("_n").isNull(), F.col("room_id") + UNKNOWN_CONTENT).otherwise(
        F.col("room_id") + F.col("student_id") % F.col("_n") * nc)
    members = rm.select(item.alias("content_id"), "student_id")
    outsider = ci.select("content_id", ((F.col("content_id") * 31 + 7) % nc).alias("student_id"))
    return members.unionByName(outsider)


UNKNOWN_CONTENT = 1_000_000_000_000


def content_access_decision(t, *, requests: DataFrame | None = None) -> DataFrame:
    """Q-28: per (content, student) request: NOT_FOUND -> NOT_A_MEMBER -> UPGRADE_REQUIRED -> NO_URL -> OK.

    The URL is the master copy's when the item has one, else its own; its class follows FN-23.
    """
    req = requests if requests is not None else content_access_requests(t)
    ci = t["content_items"].select(F.col("id").alias("ci_id"), "type", "is_free", "room_id",
                                   F.col("url").alias("own_url"), "teacher_content_id")
    tc = t["teacher_content"].select(F.col("id").alias("tc_id"), F.col("url").alias("master_url"))
    rm = t["room_members"].filter(F.col("is_active")).select(F.col("room_id").alias("m_room"),
                                                              F.col("student_id").alias("m_student"),
                                                              "access_tier", F.col("is_active").alias("member_active"))
    j = (req.join(ci, req.content_id == ci.ci_id, "left")
         .join(tc, F.col("teacher_content_id") == tc.tc_id, "left")
         .join(rm, (F.col("room_id") == rm.m_room) & (F.col("student_id") == rm.m_student), "left"))
    url = F.coalesce(F.col("master_url"), F.col("own_url"))
    decision = first_failure([
        ("NOT_FOUND", F.col("ci_id").isNull()),
        ("NOT_A_MEMBER", F.col("member_active").isNull() | ~F.col("member_active")),
        ("UPGRADE_REQUIRED", ~F.coalesce(F.col("is_free"), F.lit(False))
         & (F.coalesce(F.col("access_tier"), F.lit("")) != "paid")),
        ("NO_URL", url.isNull() | (url == "")),
    ])
    out = j.select("content_id", "student_id", "type", "is_free", "room_id", url.alias("url"), "access_tier",
                   decision.alias("decision"))
    return out.withColumn("url_type", F.when(F.col("decision") == "OK", url_class("url", "type")))


def content_link_resolution(t) -> DataFrame:
    """Q-29: per item: resolved URL, its class, video / file id, embed URL, well-formedness."""
    ci = t["content_items"].select("id", "type", F.col("url").alias("own_url"), "teacher_content_id")
    tc = t["teacher_content"].select(F.col("id").alias("tc_id"), F.col("url").alias("master_url"))
    j = ci.join(tc, ci.teacher_content_id == tc.tc_id, "left")
    url = F.coalesce(F.col("master_url"), F.col("own_url"))
    res = j.select(F.col("id").alias("content_id"), "type", url.alias("url"))
    cls = url_class("url", "type")
    return res.select(
        "content_id", "type", "url",
        F.when(F.col("url").isNotNull(), cls).alias("url_type"),
        video_id("url").alias("video_id"),
        file_id("url").alias("file_id"),
        F.when(F.col("url").isNotNull() & (cls == "google_drive"), embed_url(file_id("url"))).alias("embed_url"),
        is_valid_url("url").alias("url_well_formed"))
