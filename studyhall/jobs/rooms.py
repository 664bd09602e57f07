"""Room membership, upgrades, reviews, content attach/publish, room and registration checks
(JOB-08, JOB-09, JOB-13, JOB-16, JOB-20, JOB-21, JOB-25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import CONTENT_TYPES, SESSION_AS_OF
from studyhall.functions.exprs import first_failure, money, non_empty_array, ts_lit
from studyhall.functions.links import is_valid_url
from studyhall.functions.tokens import access_code
from studyhall.operators.settle import Resource, settle_in_order
from studyhall.operators.topn import earliest_ok, first_per_group
from studyhall.plans.wallet import balances_by_user
from studyhall.session import cut_lineage, stored

UNKNOWN_OFFSET = 1_000_000_000_000


# ------------------------------------------------------------------ JOB-08
def join_requests(t) -> DataFrame:
    """request_id, student_id, access_code, requested_at: every membership asks again (members /
    inactive members), each room gets a newcomer, every 11th room a bad code, every 5th a repeat."""
    nc = t.n_customer
    rm = t["room_members"].select("id", "room_id", "student_id")
    rooms = t["rooms"].select(F.col("id").alias("r_id"), "access_code")
    again = rm.join(rooms, rm.room_id == rooms.r_id).select(
        (F.col("id") * 4).alias("request_id"), "student_id", "access_code",
        F.timestamp_add("MINUTE", -(F.col("id") % 30), ts_lit(SESSION_AS_OF)).alias("requested_at"))
    k = F.col("r_id")
    newcomer = (k * 7 + 3) % nc
    at = F.timestamp_add("MINUTE", -(k % 45), ts_lit(SESSION_AS_OF))
    new = rooms.select((k * 4 + 1).alias("request_id"), newcomer.alias("student_id"), "access_code",
                       at.alias("requested_at"))
    bad = rooms.filter(k % 11 == 0).select((k * 4 + 2).alias("request_id"), newcomer.alias("student_id"),
                                           F.concat(F.lit("X"), F.col("access_code")).alias("access_code"),
                                           at.alias("requested_at"))
    rep = rooms.filter(k % 5 == 0).select((k * 4 + 3).alias("request_id"), newcomer.alias("student_id"),
                                          "access_code", F.timestamp_add("MINUTE", F.lit(1), at).alias("requested_at"))
    return again.unionByName(new).unionByName(bad).unionByName(rep)


def join_rooms(t, requests: DataFrame) -> DataFrame:
    """JOB-08: CODE_REQUIRED, INVALID_CODE, ROOM_INACTIVE, ALREADY_MEMBER (active), REJOINED
    (inactive member reactivated, real tier returned: C17), JOINED (free tier). A repeat of a
    join in the same batch is ALREADY_MEMBER."""
    rooms = t["rooms"].select(F.col("id").alias("room_id"), F.col("access_code").alias("r_code"),
                              F.col("is_active").alias("room_active"))
    rm = t["room_members"].select(F.col("room_id").alias("m_room"), F.col("student_id").alias("m_stu"),
                                  F.col("is_active").alias("m_active"), "access_tier")
    j = (requests.join(rooms, requests.access_code == rooms.r_code, "left")
         .join(rm, (F.col("room_id") == F.col("m_room")) & (F.col("student_id") == F.col("m_stu")), "left"))
    decision = first_failure([
        ("CODE_REQUIRED", F.col("access_code").isNull() | (F.col("access_code") == "")),
        ("INVALID_CODE", F.col("room_id").isNull()),
        ("ROOM_INACTIVE", ~F.col("room_active")),
        ("ALREADY_MEMBER", F.col("m_active")),
    ])
    d = j.select("request_id", "student_id", "access_code", "requested_at", "room_id", "m_room", "access_tier",
                 decision.alias("decision"))
    d = earliest_ok(d, ["room_id", "student_id"], "ALREADY_MEMBER")  # room known only after the code lookup
    ok = F.col("decision") == "OK"
    rejoin = ok & F.col("m_room").isNotNull()
    return d.select("request_id", "student_id", "room_id",
                    F.when(rejoin, "REJOINED").when(ok, "JOINED").otherwise(F.col("decision")).alias("decision"),
                    F.when(rejoin, F.col("access_tier")).when(ok, F.lit("free")).alias("access_tier"))


# ------------------------------------------------------------------ JOB-09
def upgrade_requests(t) -> DataFrame:
    """request_id, student_id, room_id, requested_at: every 2nd membership asks for the paid
    tier; each room also gets a request from a non-member."""
    nc = t.n_customer
    rm = t["room_members"].select("id", "room_id", "student_id")
    k = F.col("id")
    members = rm.filter(k % 2 == 0).select((k * 2).alias("request_id"), "student_id", "room_id",
                                           F.timestamp_add("MINUTE", -(k % 50), ts_lit(SESSION_AS_OF))
                                           .alias("requested_at"))
    r = t["rooms"].select("id")
    outsiders = r.select((k * 2 + 1).alias("request_id"), ((k * 11 + 5) % nc).alias("student_id"), k.alias("room_id"),
                         F.timestamp_add("MINUTE", -(k % 20), ts_lit(SESSION_AS_OF)).alias("requested_at"))
    return members.unionByName(outsiders)


def upgrade_room_access(t, requests: DataFrame) -> DataFrame:
    """JOB-09, as if the requests came one by one in the order (requested_at, request_id): NOT_A_MEMBER (no active
    membership), ALREADY_PAID (or upgraded earlier in the batch), INVALID_PRICE (missing or <= 0),
    INSUFFICIENT_BALANCE (spendable balance less the upgrades granted before), else OK (charge = room price).
    A refused request takes nothing."""
    rm = t["room_members"].filter(F.col("is_active")).select(F.col("room_id").alias("m_room"),
                                                              F.col("student_id").alias("m_stu"), "access_tier")
    rooms = t["rooms"].select(F.col("id").alias("r_id"), "paid_price")
    bal = balances_by_user(t["wallet_transactions"], "spendable").withColumnRenamed("user_id", "b_uid")
    j = (requests.join(rm, (requests.room_id == rm.m_room) & (requests.student_id == rm.m_stu), "left")
         .join(rooms, F.col("room_id") == F.col("r_id"), "left")
         .join(bal, F.col("student_id") == F.col("b_uid"), "left"))
    static = first_failure([
        ("NOT_A_MEMBER", F.col("m_room").isNull()),
        ("ALREADY_PAID", F.col("access_tier") == "paid"),
        ("INVALID_PRICE", F.col("paid_price").isNull() | (F.col("paid_price") <= 0)),
    ])
    d = j.select("request_id", "student_id", "room_id", "requested_at", "paid_price",
                 F.coalesce(F.col("balance"), F.lit(0)).alias("balance"), static.alias("decision"))
    d = settle_in_order(d, ["requested_at", "request_id"], [
        Resource("once", ["room_id", "student_id"], F.lit(1), F.lit(1)),
        Resource("purse", ["student_id"], F.col("paid_price"), F.col("balance"))], where=F.col("decision") == "OK")
    out = d.withColumn("decision", F.when((F.col("decision") != "OK") | F.col("accepted"), F.col("decision"))
                       .when(F.col("short_once"), F.lit("ALREADY_PAID")).otherwise(F.lit("INSUFFICIENT_BALANCE")))
    return out.select("request_id", "student_id", "room_id", "decision",
                      F.when(F.col("decision") == "OK", money(F.col("paid_price"))).alias("charged"))


# ------------------------------------------------------------------ JOB-16
def review_requests(t) -> DataFrame:
    """request_id, student_id, teacher_id, rating, requested_at: one per booking about the
    session's teacher, ratings 0..6, every 29th about an unknown teacher."""
    b = t["bookings"].select("id", "student_id", "session_id")
    s = t["sessions"].select(F.col("id").alias("s_id"), "teacher_id", "scheduled_at")
    k = F.col("id")
    return b.join(s, b.session_id == s.s_id).select(
        k.alias("request_id"), "student_id",
        F.when(k % 29 == 0, F.col("teacher_id") + F.lit(UNKNOWN_OFFSET)).otherwise(F.col("teacher_id"))
        .alias("teacher_id"),
        (k % 7).cast("int").alias("rating"),
        F.timestamp_add("DAY", F.lit(2), F.col("scheduled_at")).alias("requested_at"))


def review_eligibility(t, requests: DataFrame, *, per: str = "teacher") -> DataFrame:
    """JOB-16: MISSING_FIELDS, INVALID_RATING (1..5), TEACHER_NOT_FOUND, NOT_ATTENDED (no attended
    booking with the teacher), ALREADY_REVIEWED, else OK with the booking it is for: the
    earliest attended one by (booked_at, id) (C16). ``per='booking'`` allows one review per
    attended booking instead of one per teacher."""
    tch = t["teachers"].select(F.col("id").alias("t_id"))
    att = (t["bookings"].filter(F.col("status") == "attended").select("id", "student_id", "session_id", "booked_at")
           .join(t["sessions"].select(F.col("id").alias("s_id"), "teacher_id"), F.col("session_id") == F.col("s_id")))
    reviewed_b = t["reviews"].select(F.col("booking_id").alias("rb"))
    if per == "booking":
        any_att = att.groupBy("student_id", "teacher_id").agg(F.lit(True).alias("attended"))
        open_b = att.join(reviewed_b, att.id == reviewed_b.rb, "left_anti")
        pick = first_per_group(open_b, ["student_id", "teacher_id"], ["booked_at", "id"], [], prefix="p_")
        facts = any_att.join(pick, ["student_id", "teacher_id"], "left").withColumn(
            "reviewed", F.col("p_id").isNull())
    elif per == "teacher":
        pick = first_per_group(att, ["student_id", "teacher_id"], ["booked_at", "id"], [], prefix="p_")
        done = t["reviews"].select("student_id", "teacher_id").distinct().withColumn("reviewed", F.lit(True))
        facts = pick.withColumn("attended", F.lit(True)).join(done, ["student_id", "teacher_id"], "left")
    else:
        raise ValueError(per)
    facts = facts.select(F.col("student_id").alias("f_stu"), F.col("teacher_id").alias("f_tid"), "attended",
                         "reviewed", F.col("p_id").alias("booking_id"))
    j = (requests.join(tch, requests.teacher_id == tch.t_id, "left")
         .join(facts, (F.col("student_id") == F.col("f_stu")) & (F.col("teacher_id") == F.col("f_tid")), "left"))
    decision = first_failure([
        ("MISSING_FIELDS", F.col("teacher_id").isNull() | F.col("rating").isNull() | (F.col("rating") == 0)),
        ("INVALID_RATING", (F.col("rating") < 1) | (F.col("rating") > 5)),
        ("TEACHER_NOT_FOUND", F.col("t_id").isNull()),
        ("NOT_ATTENDED", F.col("attended").isNull()),
        ("ALREADY_REVIEWED", F.col("reviewed")),
    ])
    d = j.select("request_id", "student_id", "teacher_id", "rating", "requested_at", "booking_id",
                 decision.alias("decision"))
    d = earliest_ok(d, ["student_id", "teacher_id"], "ALREADY_REVIEWED")
    return d.select("request_id", "student_id", "teacher_id", "rating", "decision",
                    F.when(F.col("decision") == "OK", F.col("booking_id")).alias("booking_id"))


# ------------------------------------------------------------------ JOB-13
def attach_content(t, requests: DataFrame) -> DataFrame:
    """JOB-13: requests (request_id, center_id, room_id, content_id, is_free?, sort_order?):
    CONTENT_REQUIRED, ROOM_NOT_FOUND (not a room of this centre), CONTENT_NOT_AVAILABLE (not an
    active master content of this centre whose teacher is actively linked to it), ALREADY_IN_ROOM (or
    attached by an earlier request of the batch), else OK with the copy: the master's type, title, description and url; ``is_free`` from the
    request or the master; ``sort_order`` from the request or 0."""
    rooms = t["rooms"].select(F.col("id").alias("r_id"), F.col("center_id").alias("r_cid"))
    links = t["center_teachers"].filter(F.col("is_active")).select(F.col("center_id").alias("l_cid"),
                                                                   F.col("teacher_id").alias("l_tid")).distinct()
    tc = (t["teacher_content"].filter(F.col("is_active"))
          .join(links, (F.col("center_id") == F.col("l_cid")) & (F.col("teacher_id") == F.col("l_tid")), "left_semi")
          .select(F.col("id").alias("tc_id"), F.col("center_id").alias("tc_cid"), "type",
                  F.col("title").alias("tc_title"), F.col("description").alias("tc_description"), "url",
                  F.col("is_free").alias("tc_free")))
    have = t["content_items"].filter(F.col("teacher_content_id").isNotNull()).select(
        F.col("room_id").alias("h_room"), F.col("teacher_content_id").alias("h_tc")).distinct() \
        .withColumn("attached", F.lit(True))
    j = (requests.join(rooms, (requests.room_id == rooms.r_id) & (requests.center_id == rooms.r_cid), "left")
         .join(tc, (F.col("content_id") == F.col("tc_id")) & (F.col("center_id") == F.col("tc_cid")), "left")
         .join(have, (F.col("room_id") == F.col("h_room")) & (F.col("content_id") == F.col("h_tc")), "left"))
    decision = first_failure([
        ("CONTENT_REQUIRED", F.col("content_id").isNull()), ("ROOM_NOT_FOUND", F.col("r_id").isNull()),
        ("CONTENT_NOT_AVAILABLE", F.col("tc_id").isNull()), ("ALREADY_IN_ROOM", F.col("attached"))])
    d = j.select("request_id", "room_id", "content_id", decision.alias("decision"), "type",
                 F.col("tc_title").alias("title"), F.col("tc_description").alias("description"), "url",
                 F.coalesce(F.col("is_free"), F.col("tc_free")).alias("is_free"),
                 F.coalesce(F.col("sort_order"), F.lit(0)).alias("sort_order"))
    return earliest_ok(d, ["room_id", "content_id"], "ALREADY_IN_ROOM", order=["request_id"])


# ------------------------------------------------------------------ JOB-20
def validate_rooms(t, candidates: DataFrame) -> DataFrame:
    """JOB-20: candidates (candidate_id, center_id, teacher_id, name, subject, grade_level):
    MISSING_FIELDS (NULL or empty), NAME_TAKEN (same name in the centre, or in an earlier OK
    candidate), NOT_LINKED (no association row with the
    centre), NOT_TAUGHT (grade or subject not among the teacher's), else OK with an access code.

    The code is FN-20 of the candidate id, salted further until no room and no other accepted
    candidate has it (deterministic, unlike a random retry).
    """
    taken = t["rooms"].select(F.col("center_id").alias("n_cid"), F.col("name").alias("n_name")).distinct() \
        .withColumn("taken", F.lit(True))
    links = t["center_teachers"].select(F.col("center_id").alias("l_cid"), F.col("teacher_id").alias("l_tid")) \
        .distinct().withColumn("linked", F.lit(True))
    tch = t["teachers"].select(F.col("id").alias("t_id"), "subjects", "grade_levels")
    j = (candidates.join(taken, (candidates.center_id == taken.n_cid) & (candidates.name == taken.n_name), "left")
         .join(links, (F.col("center_id") == F.col("l_cid")) & (F.col("teacher_id") == F.col("l_tid")), "left")
         .join(tch, F.col("teacher_id") == F.col("t_id"), "left"))
    decision = first_failure([
        ("MISSING_FIELDS", F.col("teacher_id").isNull()
         | reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == "" for c in ("name", "subject", "grade_level")])),
        ("NAME_TAKEN", F.col("taken")), ("NOT_LINKED", F.col("linked").isNull()),
        ("NOT_TAUGHT", ~F.array_contains("grade_levels", F.col("grade_level"))
         | ~F.array_contains("subjects", F.col("subject")))])
    d = j.select("candidate_id", "center_id", "teacher_id", "name", decision.alias("decision"))
    # The first OK candidate takes the name; later complete ones of that name find it taken.
    first = (d.filter(F.col("decision") == "OK").groupBy(F.col("center_id").alias("f_cid"), F.col("name").alias("f_name"))
             .agg(F.min("candidate_id").alias("f_id")))
    d = d.join(first, (F.col("center_id") == F.col("f_cid")) & (F.col("name") == F.col("f_name")), "left")
    late = F.coalesce((F.col("decision") != "MISSING_FIELDS") & (F.col("candidate_id") > F.col("f_id")), F.lit(False))
    d = d.withColumn("decision", F.when(late, "NAME_TAKEN").otherwise(F.col("decision"))).drop("f_cid", "f_name", "f_id")
    codes = _free_codes(d.filter(F.col("decision") == "OK").select(F.col("candidate_id").alias("k_id")),
                        t["rooms"].select("access_code"))
    return d.join(codes, F.col("candidate_id") == F.col("k_id"), "left").select(
        "candidate_id", "center_id", "teacher_id", "name", "decision", "access_code")


def _free_codes(ids: DataFrame, used: DataFrame) -> DataFrame:
    """(k_id, access_code): FN-20 of each id with the smallest salt whose code no room and no other id
    has: a code goes to its smallest taker, the others try the next salt until none is left."""
    left, out, salt = cut_lineage(ids), None, 0
    while True:
        tried = left.withColumn("access_code", access_code("k_id", salt)).join(
            used.filter(F.col("access_code").isNotNull()).select("access_code").distinct(), "access_code", "left_anti")
        won = cut_lineage(tried.groupBy("access_code").agg(F.min("k_id").alias("k_id")).select("k_id", "access_code"))
        out = won if out is None else out.unionByName(won)
        used = used.unionByName(won.select("access_code"))
        left = cut_lineage(left.join(won.select("k_id"), "k_id", "left_anti"))
        if left.isEmpty():
            return out
        salt += 1


# ------------------------------------------------------------------ JOB-21
def _array_input(df: DataFrame, col: str):
    """FN-26: an array input is kept as given; a scalar one becomes a one-element array, or an
    empty one when the value is NULL or ''."""
    from pyspark.sql import types as T

    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col)
    return non_empty_array(F.array(F.col(col)))


def _waits_for(live: DataFrame, col: str) -> DataFrame:
    """``live`` with ``_<col>``: the one earlier candidate with the same ``col``, NULL for the first; ``_<col>_more``: there are
    several. Two minimums per value, whatever the number of candidates that share it."""
    first = live.groupBy(F.col(col).alias("_v")).agg(F.min("candidate_id").alias("_first"))
    j = live.join(first, F.col(col) == F.col("_v")).drop("_v")
    second = j.filter(F.col("candidate_id") > F.col("_first")).groupBy(F.col(col).alias("_v")).agg(
        F.min("candidate_id").alias("_second"))
    j = j.join(second, F.col(col) == F.col("_v"), "left")
    return j.select(*live.columns, F.when(F.col("candidate_id") > F.col("_first"), F.col("_first")).alias(f"_{col}"),
                    F.coalesce(F.col("candidate_id") > F.col("_second"), F.lit(False)).alias(f"_{col}_more"))


def _by_parity(nodes: DataFrame) -> DataFrame:
    """(candidate_id, end, odd) for nodes (candidate_id, to): the end of each one's chain of ``to`` and whether the chain is of
    odd length, by pointer jumping: every round doubles the steps, so a chain of n takes log2(n) rounds."""
    hops = stored(nodes.select("candidate_id", F.col("to").alias("end"), F.lit(True).alias("odd")))
    while True:
        on = hops.select(F.col("candidate_id").alias("_at"), F.col("end").alias("_end"), F.col("odd").alias("_odd"))
        j = hops.join(on, F.col("end") == F.col("_at"), "left")
        if j.filter("_at is not null").isEmpty():
            return hops
        hops = stored(j.select("candidate_id", F.coalesce("_end", "end").alias("end"),
                               (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd")))


def _first_accepted(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates a one-by-one run accepts, as (a_email, m_id) and (a_phone, p_id).

    Who shares neither e-mail nor phone with an earlier one is accepted. Who has exactly one such earlier candidate is
    accepted if that one is not: such chains are followed by pointer jumping and settled at once by their parity. The others
    wait for the next round, in which all who share something with an accepted one are gone.
    """
    live, accepted = stored(live), None
    while True:
        j = stored(_waits_for(_waits_for(live, "email"), "phone"))
        to = F.coalesce("_email", "_phone")
        several = (F.col("_email_more") | F.col("_phone_more") | F.coalesce(F.col("_email") != F.col("_phone"), F.lit(False)))
        free = j.filter("_email is null and _phone is null").select(F.col("candidate_id").alias("f_id"))
        ends = _by_parity(j.filter(~several & to.isNotNull()).select("candidate_id", to.alias("to")))
        even = ends.filter(~F.col("odd")).join(free, F.col("end") == F.col("f_id"), "left_semi").select(F.col("candidate_id").alias("f_id"))
        won = stored(live.join(free.unionByName(even), F.col("candidate_id") == F.col("f_id"), "left_semi"))
        accepted = won if accepted is None else accepted.unionByName(won)
        live = stored(live.join(won.select("email"), "email", "left_anti").join(won.select("phone"), "phone", "left_anti"))
        if live.isEmpty():
            return (accepted.select(F.col("email").alias("a_email"), F.col("candidate_id").alias("m_id")),
                    accepted.select(F.col("phone").alias("a_phone"), F.col("candidate_id").alias("p_id")))


def validate_registrations(t, candidates: DataFrame) -> dict[str, DataFrame]:
    """JOB-21: candidates (candidate_id, name, email, phone, role, subjects, grade_levels, lat,
    lng, center_name, center_address, center_lat, center_lng): USER_EXISTS (e-mail or phone
    already used, or by an earlier accepted candidate: equi-joins, not an OR join), MISSING_FIELDS
    (NOT NULL columns; empty text counts as missing),
    MISSING_CENTER_FIELDS (centre owners need centre name, address and coordinates), else OK;
    OK rows split into users / teachers / centers."""
    u = t["users"]
    by_email = candidates.join(u.select(F.col("email").alias("_e")), candidates.email == F.col("_e"), "left_semi")
    by_phone = candidates.join(u.select(F.col("phone").alias("_p")), candidates.phone == F.col("_p"), "left_semi")
    dup = by_email.select("candidate_id").unionByName(by_phone.select("candidate_id")).distinct() \
        .withColumn("dup", F.lit(True))
    j = candidates.join(dup, "candidate_id", "left")
    blank = lambda *cols: reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == "" for c in cols])
    decision = first_failure([
        ("USER_EXISTS", F.col("dup")),
        ("MISSING_FIELDS", blank("name", "email", "phone", "role")),
        ("MISSING_CENTER_FIELDS", (F.col("role") == "center_admin")
         & (blank("center_name", "center_address") | F.col("center_lat").isNull() | F.col("center_lng").isNull())),
    ])
    d = cut_lineage(j.withColumn("decision", decision))
    mail, phone = _first_accepted(d.filter(F.col("decision") == "OK").select("candidate_id", "email", "phone"))
    d = d.join(mail, F.col("email") == F.col("a_email"), "left").join(phone, F.col("phone") == F.col("a_phone"), "left")
    late = F.coalesce(F.col("candidate_id") > F.col("m_id"), F.lit(False)) \
        | F.coalesce(F.col("candidate_id") > F.col("p_id"), F.lit(False))
    d = d.withColumn("decision", F.when(late, "USER_EXISTS").otherwise(F.col("decision")))
    ok = d.filter(F.col("decision") == "OK")
    return {
        "decisions": d.select("candidate_id", "email", "decision"),
        "users": ok.select(F.col("candidate_id").alias("id"), "name", "email", "phone", "role",
                           F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("lat")).alias("lat"),
                           F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("lng")).alias("lng")),
        "teachers": ok.filter(F.col("role") == "teacher").select(
            F.col("candidate_id").alias("user_id"), _array_input(ok, "subjects").alias("subjects"),
            _array_input(ok, "grade_levels").alias("grade_levels")),
        "centers": ok.filter(F.col("role") == "center_admin").select(
            F.col("candidate_id").alias("owner_id"), F.col("center_name").alias("name"),
            F.col("center_address").alias("address"), F.col("center_lat").alias("lat"),
            F.col("center_lng").alias("lng")),
    }


# ------------------------------------------------------------------ JOB-25
def publish_teacher_content(t, requests: DataFrame) -> DataFrame:
    """JOB-25: requests (request_id, teacher_id, center_id, type, title, url): CENTER_REQUIRED,
    MISSING_FIELDS, INVALID_TYPE, TITLE_TOO_LONG (> 255), INVALID_URL, NOT_YOUR_CENTER, else OK."""
    links = t["center_teachers"].filter(F.col("is_active")).select(F.col("center_id").alias("l_cid"),
                                                                   F.col("teacher_id").alias("l_tid"),
                                                                   F.lit(True).alias("linked"))
    j = requests.join(links, (requests.center_id == links.l_cid) & (requests.teacher_id == links.l_tid), "left")
    decision = first_failure([
        ("CENTER_REQUIRED", F.col("center_id").isNull()),
        ("MISSING_FIELDS", F.col("type").isNull() | F.col("title").isNull() | F.col("url").isNull()
         | (F.col("title") == "") | (F.col("url") == "")),
        ("INVALID_TYPE", ~F.col("type").isin(*CONTENT_TYPES)),
        ("TITLE_TOO_LONG", F.length("title") > 255),
        ("INVALID_URL", ~is_valid_url("url")),
        ("NOT_YOUR_CENTER", F.col("linked").isNull()),
    ])
    return j.select("request_id", "teacher_id", "center_id", decision.alias("decision"))


# ------------------------------------------------------------------ write side
def join_outputs(t, decisions: DataFrame, *, as_of=SESSION_AS_OF) -> dict[str, DataFrame]:
    """JOB-08 rows: new free memberships (JOINED) and reactivations (REJOINED, joined_at reset)."""
    joined = decisions.filter(F.col("decision") == "JOINED").select(
        "room_id", "student_id", F.lit("free").alias("access_tier"), ts_lit(as_of).alias("joined_at"),
        F.lit(True).alias("is_active"))
    rejoined = decisions.filter(F.col("decision") == "REJOINED").select(
        "room_id", "student_id", F.lit(True).alias("is_active"), ts_lit(as_of).alias("joined_at"))
    return {"room_members_new": joined, "room_members_patches": rejoined}


def upgrade_outputs(t, decisions: DataFrame, *, as_of=SESSION_AS_OF) -> dict[str, DataFrame]:
    """JOB-09 rows: membership tier set to paid and one charge (reference type room_upgrade)."""
    ok = decisions.filter(F.col("decision") == "OK")
    return {
        "room_members_patches": ok.select("room_id", "student_id", F.lit("paid").alias("access_tier")),
        "wallet_transactions": ok.select(
            F.col("student_id").alias("user_id"), F.col("charged").alias("amount"),
            F.lit("booking_charge").alias("type"), F.lit("completed").alias("status"),
            F.col("room_id").alias("reference_id"), F.lit("room_upgrade").alias("reference_type"),
            ts_lit(as_of).alias("created_at")),
    }


def review_outputs(decisions: DataFrame, *, as_of=SESSION_AS_OF, comments: DataFrame | None = None) -> DataFrame:
    """JOB-16 rows: one review per OK request, for the booking it was matched to."""
    ok = decisions.filter(F.col("decision") == "OK")
    if comments is not None:
        ok = ok.join(comments, "request_id", "left")
    else:
        ok = ok.withColumn("comment", F.lit(None).cast("string"))
    return ok.select(F.col("request_id").alias("id"), "teacher_id", "student_id", "booking_id", "rating", "comment",
                     F.lit(True).alias("is_visible"), ts_lit(as_of).alias("created_at"))
