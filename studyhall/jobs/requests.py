"""Request tables for the batch jobs, derived from the domain tables (FIXTURES.md, part C).

They grow with the data (one or more requests per order / booking / session) and include
the awkward cases on purpose: duplicates in one batch, unknown ids, wrong owners, edges of
the check-in window. The same formulas exist as DuckDB SQL in ``studyhall.oracle.sql_jobs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import SESSION_AS_OF
from studyhall.functions.exprs import ts_lit
from studyhall.sources.fixtures import plus_minutes

UNKNOWN_OFFSET = 1_000_000_000_000
REPEAT_OFFSET = 100_000_000_000_000  # added to a request id for its repeat in the batch


def booking_requests(t) -> DataFrame:
    """request_id, session_id, student_id, requested_at: one per order, plus duplicates,
    unknown sessions and a competing student."""
    nc = t.n_customer
    o = t.raw("orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    student = (c * 17 + k) % nc
    at = plus_minutes(ts_lit(SESSION_AS_OF), -(k % 50))
    base = o.select((k * 4).alias("request_id"), k.alias("session_id"), student.alias("student_id"),
                    at.alias("requested_at"))
    dup = o.filter(k % 7 == 0).select((k * 4 + 1).alias("request_id"), k.alias("session_id"),
                                      student.alias("student_id"), plus_minutes(at, 1).alias("requested_at"))
    unknown = o.filter(k % 11 == 0).select((k * 4 + 2).alias("request_id"), (k + UNKNOWN_OFFSET).alias("session_id"),
                                           student.alias("student_id"), at.alias("requested_at"))
    rival = o.filter(k % 5 == 0).select((k * 4 + 3).alias("request_id"), k.alias("session_id"),
                                        ((c * 31 + 7) % nc).alias("student_id"),
                                        plus_minutes(at, -1).alias("requested_at"))
    return base.unionByName(dup).unionByName(unknown).unionByName(rival)


def cancel_requests(t) -> DataFrame:
    """request_id, booking_id, student_id, requested_at: one per booking (some by the wrong
    student), duplicates, unknown bookings."""
    nc = t.n_customer
    b = t["bookings"].select("id", "student_id")
    k = F.col("id")
    who = F.when(k % 13 == 0, (F.col("student_id") + 1) % nc).otherwise(F.col("student_id"))
    at = plus_minutes(ts_lit(SESSION_AS_OF), -(k % 30))
    base = b.select((k * 4).alias("request_id"), k.alias("booking_id"), who.alias("student_id"),
                    at.alias("requested_at"))
    dup = b.filter(k % 17 == 0).select((k * 4 + 1).alias("request_id"), k.alias("booking_id"),
                                       F.col("student_id"), plus_minutes(at, 1).alias("requested_at"))
    unknown = b.filter(k % 19 == 0).select((k * 4 + 2).alias("request_id"), (k + UNKNOWN_OFFSET).alias("booking_id"),
                                           F.col("student_id"), at.alias("requested_at"))
    return base.unionByName(dup).unionByName(unknown)


def session_cancel_requests(t) -> DataFrame:
    """request_id, session_id, center_id, requested_at: every session by its centre (some by
    another centre), duplicates, unknown sessions."""
    ns = t.n_supplier
    s = t["sessions"].select("id", "center_id")
    k = F.col("id")
    ctr = F.when(k % 9 == 0, (F.col("center_id") + 1) % ns).otherwise(F.col("center_id"))
    at = plus_minutes(ts_lit(SESSION_AS_OF), -(k % 40))
    base = s.select((k * 4).alias("request_id"), k.alias("session_id"), ctr.alias("center_id"),
                    at.alias("requested_at"))
    dup = s.filter(k % 10 == 0).select((k * 4 + 1).alias("request_id"), k.alias("session_id"), ctr.alias("center_id"),
                                       plus_minutes(at, 1).alias("requested_at"))
    unknown = s.filter(k % 23 == 0).select((k * 4 + 2).alias("request_id"), (k + UNKNOWN_OFFSET).alias("session_id"),
                                           F.col("center_id"), at.alias("requested_at"))
    return base.unionByName(dup).unionByName(unknown)


def scan_requests(t) -> DataFrame:
    """scan_id, qr_code, center_id, scanned_at: one scan per booking at its session; every
    9th malformed, 7th early, 11th late, 29th exactly at start - 15 min, 31st exactly at the
    end, 23rd at the wrong centre; every 13th scanned twice."""
    ns = t.n_supplier
    b = t["bookings"].select("id", "session_id", "qr_code")
    s = t["sessions"].select(F.col("id").alias("sid"), "center_id", "scheduled_at", "duration_min")
    j = b.join(s, b.session_id == s.sid)
    k = F.col("id")
    start, dur = F.col("scheduled_at"), F.col("duration_min")
    at = (F.when(k % 7 == 0, plus_minutes(start, -30))
          .when(k % 11 == 0, plus_minutes(start, dur + 5))
          .when(k % 29 == 0, plus_minutes(start, -15))
          .when(k % 31 == 0, plus_minutes(start, dur))
          .otherwise(plus_minutes(start, k % 20 - 10)))
    qr = F.when(k % 9 == 0, F.regexp_replace(F.col("qr_code"), "_", "-")).otherwise(F.col("qr_code"))
    ctr = F.when(k % 23 == 0, (F.col("center_id") + 1) % ns).otherwise(F.col("center_id"))
    base = j.select((k * 2).alias("scan_id"), qr.alias("qr_code"), ctr.alias("center_id"), at.alias("scanned_at"))
    again = j.filter(k % 13 == 0).select((k * 2 + 1).alias("scan_id"), qr.alias("qr_code"), ctr.alias("center_id"),
                                         plus_minutes(at, 1).alias("scanned_at"))
    return base.unionByName(again)


def session_candidates(t) -> DataFrame:
    """candidate_id, session_id (update form: itself), center_id, teacher_id, subject,
    grade_level, scheduled_at, duration_min, capacity, price (some missing): every session shifted by -30..+30 min; every
    10th touches its own end exactly; every 2nd is an update of its source session; the
    subject is one the teacher teaches unless id % 3 = 0. Every 3rd has a rival later in the batch, 0..60 min after it."""
    s = t["sessions"].select("id", "center_id", "teacher_id", "subject", "grade_level", "scheduled_at",
                             "duration_min", "capacity", "price")
    tch = t["teachers"].select(F.col("id").alias("tid"), "subjects")
    j = s.join(tch, s.teacher_id == tch.tid, "left")
    k = F.col("id")
    at = F.when(k % 10 == 5, plus_minutes(F.col("scheduled_at"), F.col("duration_min"))).otherwise(
        plus_minutes(F.col("scheduled_at"), (k % 7 - 3) * 10))
    subject = F.when(k % 3 == 0, F.col("subject")).otherwise(F.element_at("subjects", (k % 2 + 1).cast("int")))
    base = j.select(k.alias("candidate_id"), F.when(k % 2 == 0, k).alias("session_id"), "center_id", "teacher_id",
                    subject.alias("subject"), "grade_level", at.alias("scheduled_at"), "duration_min",
                    F.when(k % 41 != 0, F.col("capacity")).alias("capacity"), F.when(k % 43 != 0, F.col("price")).alias("price"))
    rival = base.filter(F.col("candidate_id") % 3 == 1).select(
        (F.col("candidate_id") + REPEAT_OFFSET).alias("candidate_id"), F.lit(None).cast("bigint").alias("session_id"), "center_id",
        "teacher_id", "subject", "grade_level", plus_minutes(F.col("scheduled_at"), (F.col("candidate_id") % 5) * 15)
        .alias("scheduled_at"), "duration_min", "capacity", "price")
    return base.unionByName(rival)


def walkin_requests(t) -> DataFrame:
    """request_id, student_id, session_id, center_id, amount_paid, requested_at: one walk-in per
    session from 40 min before to 40 min after its start; unknown students / sessions, wrong
    centres, and a second walk-in of the same student for every 6th session."""
    nc, ns = t.n_customer, t.n_supplier
    s = t["sessions"].select("id", "teacher_id", "center_id", "scheduled_at")
    k = F.col("id")
    regular = (F.col("teacher_id") * 3 + k) % nc
    student = F.when(k % 43 == 0, F.lit(nc) + k).otherwise(regular)
    sess = F.when(k % 37 == 0, k + UNKNOWN_OFFSET).otherwise(k)
    ctr = F.when(k % 41 == 0, (F.col("center_id") + 1) % ns).otherwise(F.col("center_id"))
    amt = (k % 4 * 25).cast("decimal(10,2)")
    at = plus_minutes(F.col("scheduled_at"), (k % 9 - 4) * 10)
    base = s.select((k * 2).alias("request_id"), student.alias("student_id"), sess.alias("session_id"),
                    ctr.alias("center_id"), amt.alias("amount_paid"), at.alias("requested_at"))
    again = s.filter(k % 6 == 0).select((k * 2 + 1).alias("request_id"), regular.alias("student_id"),
                                        k.alias("session_id"), F.col("center_id"), amt.alias("amount_paid"),
                                        plus_minutes(at, 1).alias("requested_at"))
    return base.unionByName(again)


# ---------------------------------------------------------------- maintenance job inputs
def retire_requests(t) -> DataFrame:
    """request_id, content_id, teacher_id: every master content retired by its teacher; every
    7th names an unknown item, every 5th comes from another teacher."""
    tc = t["teacher_content"].select("id", "teacher_id")
    k = F.col("id")
    return tc.select(k.alias("request_id"), F.when(k % 7 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("content_id"),
                     F.when(k % 5 == 0, F.col("teacher_id") + 1).otherwise(F.col("teacher_id")).alias("teacher_id"))


def _again(requests: DataFrame, every: int, key: str = "request_id") -> DataFrame:
    """Plus a repeat of every n-th request under a later id, in the same batch."""
    repeat = requests.filter(F.col(key) % every == 0).withColumn(key, F.col(key) + F.lit(REPEAT_OFFSET))
    return requests.unionByName(repeat)


def link_requests(t) -> DataFrame:
    """request_id, center_id, teacher_id: each teacher asks to join centre id*3 % ns (every 17th an
    unknown centre), every 4th twice; every 13th teacher is unknown."""
    ns = t.n_supplier
    k = F.col("id")
    once = t["teachers"].select(
        k.alias("request_id"), F.when(k % 17 == 0, k + UNKNOWN_OFFSET).otherwise(k * 3 % ns).alias("center_id"),
        F.when(k % 13 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("teacher_id"))
    return _again(once, 4)


def unlink_requests(t) -> DataFrame:
    """request_id, center_id, teacher_id: every teacher asked off centre id*5 % ns or, for even ids, off
    one of theirs (id % ns), every 4th twice; unknown centres and teachers as in ``link_requests``."""
    ns = t.n_supplier
    k = F.col("id")
    once = t["teachers"].select(
        k.alias("request_id"), F.when(k % 17 == 0, k + UNKNOWN_OFFSET).when(k % 2 == 0, k % ns).otherwise(k * 5 % ns)
        .alias("center_id"), F.when(k % 13 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("teacher_id"))
    return _again(once, 4)


def publish_requests(t) -> DataFrame:
    """request_id, teacher_id, center_id, type, title, url: the master contents re-published;
    wrong centre for every 6th, bad type every 11th, a 300-character title every 13th."""
    ns = t.n_supplier
    tc = t["teacher_content"]
    k = F.col("id")
    return tc.select(k.alias("request_id"), "teacher_id",
                     F.when(k % 6 == 0, (F.col("center_id") + 1) % ns).otherwise(F.col("center_id")).alias("center_id"),
                     F.when(k % 11 == 0, F.lit("audio")).otherwise(F.col("type")).alias("type"),
                     F.when(k % 13 == 0, F.repeat(F.lit("t"), 300)).otherwise(F.col("title")).alias("title"), "url")


def room_candidates(t) -> DataFrame:
    """candidate_id, center_id, teacher_id, name, subject, grade_level: a second room per room;
    every 4th reuses the existing name, every 3rd asks for a subject the teacher does not teach, every
    19th has an empty name, every 23rd a teacher without link; every 5th is asked twice."""
    r = t["rooms"]
    k = F.col("id")
    once = r.select(k.alias("candidate_id"), "center_id",
                    F.when(k % 23 == 0, k + UNKNOWN_OFFSET).otherwise(F.col("teacher_id")).alias("teacher_id"),
                    F.when(k % 19 == 0, F.lit("")).when(k % 4 == 0, F.col("name"))
                    .otherwise(F.concat(F.lit("New "), F.col("name"))).alias("name"),
                    F.when(k % 3 == 0, F.lit("Art")).otherwise(F.col("subject")).alias("subject"), "grade_level")
    return _again(once, 5, "candidate_id")


def attach_requests(t) -> DataFrame:
    """request_id, center_id, room_id, content_id, is_free, sort_order: each master content
    attached to its teacher's room, for odd ids to another room of the centre (free for even ids, rank
    id % 10 for every 3rd); every 9th from the wrong centre, every 31st without content; every 3rd is
    asked twice."""
    ns = t.n_supplier
    tc = t["teacher_content"]
    k = F.col("id")
    own = F.col("teacher_id")
    other = F.when(own >= ns, own - ns).otherwise(own + ns)
    once = tc.select(k.alias("request_id"),
                     F.when(k % 9 == 0, (F.col("center_id") + 1) % ns).otherwise(F.col("center_id")).alias("center_id"),
                     F.when(k % 2 == 1, other).otherwise(own).alias("room_id"),
                     F.when(k % 31 != 0, k).alias("content_id"),
                     F.when(k % 2 == 0, F.lit(True)).alias("is_free"),
                     F.when(k % 3 == 0, (k % 10).cast("int")).alias("sort_order"))
    return _again(once, 3)


def reorder_requests(t) -> DataFrame:
    """room_id, items: one request per content item moving it to rank 100 - rank, plus an id
    that is not in the room (ignored)."""
    ci = t["content_items"]
    item = F.struct(F.col("id").alias("id"), (100 - F.col("sort_order")).alias("sort_order"))
    stray = F.struct((F.col("id") + UNKNOWN_OFFSET).alias("id"), F.lit(1).alias("sort_order"))
    return ci.select("room_id", F.array(item, stray).alias("items"))


def status_change_requests(t) -> DataFrame:
    """request_id, admin_id, user_id, is_active, reason: every user's activation flipped by an
    admin, and every super admin targeted too (refused); some name no user or no value."""
    u = t["users"].select("id", "is_active", "role")
    k = F.col("id")
    once = u.select(k.alias("request_id"), F.lit(3_000_000_000).alias("admin_id"),
                    F.when(k % 29 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("user_id"),
                    F.when(k % 37 != 0, ~F.col("is_active")).alias("is_active"),
                    F.when(F.col("is_active"), F.lit("policy")).alias("reason"))
    # every 8th is changed back by a later request of the batch
    return _again(once, 8).withColumn("is_active", F.when(F.col("request_id") % 8 != 0, F.col("is_active"))
                                      .otherwise(F.col("is_active") == (F.col("request_id") < REPEAT_OFFSET)))


def registration_candidates(t) -> DataFrame:
    """candidate_id, name, email, phone, role, subjects, grade_levels, center_name,
    center_address, lat, lng, center_lat, center_lng: one sign-up per customer; every 7th reuses
    the customer's e-mail, every 11th its phone, every 13th has none; some centre owners lack address or
    coordinates; every 6th signs up twice."""
    c = t.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    role = F.when(k % 3 == 0, "teacher").when(k % 3 == 1, "center_admin").otherwise("student")
    once = c.select(
        (k + F.lit(5_000_000_000)).alias("candidate_id"), F.col("c_name").alias("name"),
        F.when(k % 7 == 0, F.concat(F.lit("student."), k.cast("string"), F.lit("@mail.example")))
        .otherwise(F.concat(F.lit("new."), k.cast("string"), F.lit("@mail.example"))).alias("email"),
        F.when(k % 11 == 0, F.concat(F.lit("+20"), k.cast("string"))).when(k % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("+49"), k.cast("string"))).alias("phone"),
        role.alias("role"),
        F.array(F.col("c_mktsegment"), F.lit("")).alias("subjects"),
        F.array(F.lit("Grade 1"), F.lit(None).cast("string")).alias("grade_levels"),
        F.when(k % 2 == 0, F.concat(F.lit("Centre of "), F.col("c_name"))).alias("center_name"),
        F.when(k % 4 < 2, F.lit("Main street")).alias("center_address"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        F.when(k % 8 < 6, F.lit(22.0) + (k * 37 % 1000) / 100.0).alias("center_lat"),
        F.when(k % 8 < 6, F.lit(25.0) + (k * 91 % 1000) / 100.0).alias("center_lng"))
    return _again(once, 6, "candidate_id")


def session_delete_requests(t) -> DataFrame:
    """request_id, id, owner: every cancelled session deleted by its centre (every 7th asked by
    another centre)."""
    ns = t.n_supplier
    s = t["sessions"].filter(F.col("status") == "cancelled").select("id", "center_id")
    k = F.col("id")
    return s.select(k.alias("request_id"), k.alias("id"),
                    F.when(k % 7 == 0, (F.col("center_id") + 1) % ns).otherwise(F.col("center_id")).alias("owner"))


def room_delete_requests(t) -> DataFrame:
    """request_id, id, owner: every inactive room deleted by its centre."""
    r = t["rooms"].filter(~F.col("is_active")).select("id", "center_id")
    return r.select(F.col("id").alias("request_id"), "id", F.col("center_id").alias("owner"))


def content_update_requests(t) -> DataFrame:
    """Edits of master content by its teacher: new title for id % 3 = 0, a 300-character title
    for id % 3 = 2, a malformed url for id % 4 = 0; every 7th by another teacher, every 11th for
    an unknown item."""
    tc = t["teacher_content"].select("id", "teacher_id", "title")
    k = F.col("id")
    return tc.select(
        k.alias("request_id"), F.when(k % 11 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("content_id"),
        F.when(k % 7 == 0, F.col("teacher_id") + 1).otherwise(F.col("teacher_id")).alias("teacher_id"),
        F.when(k % 3 == 0, F.concat(F.lit("Updated "), F.col("title"))).when(k % 3 == 2, F.repeat(F.lit("x"), 300))
        .alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(k % 4 == 0, F.lit("bad url")).alias("url"),
        F.lit(None).cast("boolean").alias("is_free"), F.lit(None).cast("boolean").alias("is_active"),
        F.lit(None).cast("int").alias("sort_order"), ts_lit(SESSION_AS_OF).alias("requested_at"))
