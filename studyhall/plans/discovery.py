"""Directory and discovery (Q-13 .. Q-21, Q-46, Q-52): distance, arrays, next session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import NEARBY_KM, PAGE_DISCOVERY, SEARCH_CAP, SEARCH_KM, SESSION_AS_OF
from studyhall.functions.exprs import (
    array_text_ilike, has_value, ilike_any, optional_filters, prune_months, ts_lit,
)
from studyhall.functions.geo import geodesic_km, haversine_km, within_km
from studyhall.operators.geojoin import within_radius_join
from studyhall.operators.nearest import nearest_places
from studyhall.operators.prefix import running_count
from studyhall.operators.pages import page, page_of, pg_asc
from studyhall.operators.topn import first_per_group

CENTER_COLS = ["id", "name", "address", "description", "phone", "logo_url", "is_active"]


def _dist(lat, lng) -> F.Column:
    # rounded to 6 decimals: the engines agree on it and a tie then breaks on the id
    return F.round(haversine_km("lat", "lng", lat, lng), 6)


def _check_point(lat: float, lng: float) -> None:
    """FN-17 for the query point (a parameter): finite, latitude in [-90, 90], longitude in [-180, 180]."""
    if lat is None or lng is None or lat != lat or lng != lng or not (-90 <= lat <= 90) or not (-180 <= lng <= 180):
        raise ValueError("valid latitude and longitude are required")


def _nearby(t, lat, lng, km) -> DataFrame:
    _check_point(lat, lng)
    c = t["centers"].filter(F.col("is_active") & within_km("lat", "lng", lat, lng, km))
    return c.select(*CENTER_COLS, _dist(lat, lng).alias("distance_km"))


def nearby_centers(t, *, lat: float, lng: float, km: float = NEARBY_KM, page_no: int = 1,
                   limit: int = PAGE_DISCOVERY) -> DataFrame:
    """Q-13: active centres within ``km`` of the point, nearest first, one page."""
    return page(_nearby(t, lat, lng, km), [pg_asc("distance_km")], limit, page_of(page_no, limit))


def nearby_centers_geodesic(t, *, lat: float, lng: float, km: float = NEARBY_KM) -> DataFrame:
    """Q-13 with the reference's own distance, the geodesic on the ellipsoid: all active centres within ``km``."""
    _check_point(lat, lng)
    c = t["centers"].filter(F.col("is_active") & within_km("lat", "lng", lat, lng, km, "geodesic"))
    return c.select(*CENTER_COLS, F.round(geodesic_km("lat", "lng", lat, lng), 6).alias("distance_km"))


def nearby_centers_count(t, *, lat: float, lng: float, km: float = NEARBY_KM) -> DataFrame:
    """Q-13 total."""
    return _nearby(t, lat, lng, km).agg(F.count(F.lit(1)).alias("total"))


def student_nearby_centers(t, *, km: float = NEARBY_KM) -> DataFrame:
    """JOIN-08, whole-table form of Q-13: every located active student with each active centre in range."""
    students = t["users"].filter((F.col("role") == "student") & F.col("is_active")).select(
        F.col("id").alias("student_id"), "lat", "lng")
    centers = t["centers"].filter(F.col("is_active")).select(
        F.col("id").alias("center_id"), F.col("name").alias("center_name"), "lat", "lng")
    pairs = within_radius_join(students, centers, km)
    return pairs.select("student_id", "center_id", "center_name",
                        F.round("distance_km", 6).alias("distance_km"))


def student_center_pages(t, *, km: float = NEARBY_KM, limit: int = 20) -> DataFrame:
    """Q-13 for every student: the first page of active centres in range, nearest first."""
    students = t["users"].filter((F.col("role") == "student") & F.col("is_active")).select(
        F.col("id").alias("point_id"), "lat", "lng")
    centers = t["centers"].filter(F.col("is_active"))
    near = nearest_places(students, centers.select(F.col("id").alias("place_id"), "lat", "lng"), limit, km)
    names = centers.select(F.col("id").alias("center_id"), F.col("name").alias("center_name"))
    return near.select(F.col("point_id").alias("student_id"), "position", F.col("place_id").alias("center_id"), "distance_km").join(
        names, "center_id").select("student_id", "position", "center_id", "center_name", "distance_km")


def _teacher_center_rows(t) -> DataFrame:
    """teacher x active link x active centre (JOIN-01), shared by Q-14, Q-15, Q-46."""
    tch = t["teachers"]
    usr = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"), "avatar_url",
                            F.col("is_active").alias("u_active"))
    ct = t["center_teachers"].filter(F.col("is_active")).select(F.col("teacher_id").alias("ct_tid"),
                                                                F.col("center_id").alias("ct_cid"))
    ctr = t["centers"].filter(F.col("is_active")).select(
        F.col("id").alias("center_id"), F.col("name").alias("center_name"),
        F.col("address").alias("center_address"), F.col("lat").alias("center_lat"),
        F.col("lng").alias("center_lng"), F.col("phone").alias("center_phone"),
        F.col("logo_url").alias("center_logo_url"), F.col("rating").alias("center_rating"),
        F.col("description").alias("center_description"))
    return (tch.join(usr, tch.user_id == usr.u_id)
            .join(ct, tch.id == ct.ct_tid)
            .join(ctr, ct.ct_cid == ctr.center_id))


def nearby_teachers(t, *, lat: float, lng: float, km: float = NEARBY_KM, subject=None, grade=None,
                    page_no: int = 1, limit: int = PAGE_DISCOVERY) -> DataFrame:
    """Q-14: teacher x centre rows within the radius (subject/grade exact array match)."""
    _check_point(lat, lng)
    rows = _teacher_center_rows(t).filter(within_km("center_lat", "center_lng", lat, lng, km))
    rows = optional_filters(rows, extra=[has_value("subjects", subject), has_value("grade_levels", grade)])
    out = rows.select(
        F.col("id").alias("teacher_id"), "teacher_name", "avatar_url",
        F.array_join("subjects", ", ").alias("subjects"), F.array_join("grade_levels", ", ").alias("grade_levels"),
        "rating", "total_reviews", "center_id", "center_name", "center_address",
        F.round(haversine_km("center_lat", "center_lng", lat, lng), 6).alias("distance_km"))
    return page(out, [pg_asc("distance_km"), F.col("center_id")], limit, page_of(page_no, limit), "teacher_id")


def search_centers(t, *, lat: float, lng: float, name: str = "", address: str = "", grade=None,
                   subject=None, distinct: bool = False) -> DataFrame:
    """Q-15: centres within 50 km matching name/address/grade/subject text; top 100 by distance.

    Literal form (C6): one row per matching active teacher of the centre; ``distinct=True``
    gives one row per centre.
    """
    _check_point(lat, lng)
    rows = _teacher_center_rows(t).filter(within_km("center_lat", "center_lng", lat, lng, SEARCH_KM))
    rows = optional_filters(rows, extra=[
        ilike_any(["center_name"], name.strip() if name else ""),
        ilike_any(["center_address"], address.strip() if address else ""),
        array_text_ilike("grade_levels", grade), array_text_ilike("subjects", subject)])
    out = rows.select(
        F.col("center_id").alias("id"), F.col("center_name").alias("name"),
        F.col("center_address").alias("address"), F.col("center_description").alias("description"),
        F.col("center_phone").alias("phone"), F.col("center_logo_url").alias("logo_url"),
        F.lit(True).alias("is_active"), F.col("id").alias("_tid"),
        F.round(haversine_km("center_lat", "center_lng", lat, lng), 6).alias("distance_km"))
    if distinct:
        out = out.drop("_tid").dropDuplicates(["id"])
        return page(out, [pg_asc("distance_km")], SEARCH_CAP, 0, "id")
    ranked = page(out, [pg_asc("distance_km"), F.col("id")], SEARCH_CAP, 0, "_tid")
    return ranked.select("id", "name", "address", "description", "phone", "logo_url", "is_active", "distance_km")


def search_teachers(t, *, name=None, subject=None, grade=None) -> DataFrame:
    """Q-16: teacher directory with optional name / subject / grade filters."""
    tch = t["teachers"]
    usr = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"), "avatar_url")
    rows = tch.join(usr, tch.user_id == usr.u_id)
    rows = optional_filters(rows, extra=[ilike_any(["teacher_name"], name), has_value("subjects", subject),
                                         has_value("grade_levels", grade)])
    return rows.select(F.col("id").alias("teacher_id"), "teacher_name", "avatar_url",
                       F.array_join("subjects", ", ").alias("subjects"),
                       F.array_join("grade_levels", ", ").alias("grade_levels"), "rating", "total_reviews")


def _center_teachers(t, center) -> DataFrame:
    c = optional_filters(t["centers"], {"id": center}, [F.col("is_active")]).select(
        F.col("id").alias("center_id"), F.col("name").alias("center_name"),
        F.col("address").alias("center_address"), F.col("description").alias("center_description"),
        F.col("phone").alias("center_phone"), F.col("logo_url").alias("center_logo_url"))
    ct = t["center_teachers"].filter(F.col("is_active")).select(F.col("center_id").alias("ct_cid"),
                                                                F.col("teacher_id").alias("ct_tid"))
    tch = t["teachers"].select(F.col("id").alias("teacher_id"), "user_id", "subjects", "grade_levels", "rating",
                               "total_reviews")
    usr = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"), "avatar_url")
    return (c.join(ct, c.center_id == ct.ct_cid, "left")
            .join(tch, F.col("ct_tid") == tch.teacher_id, "left")
            .join(usr, F.col("user_id") == usr.u_id, "left"))


def center_details(t, *, center=None) -> DataFrame:
    """Q-17 (flat): each active centre with each of its active teachers, one row per pair.

    A centre without an active teacher keeps one row with NULL teacher columns (the
    reference's one all-NULL array element). ``center_detail_pages`` nests it.
    """
    return _center_teachers(t, center).select(
        "center_id", "center_name", "center_address", "center_description", "center_phone",
        "center_logo_url", "teacher_id", "teacher_name", "avatar_url", F.array_join("subjects", ", ").alias("subjects"),
        F.array_join("grade_levels", ", ").alias("grade_levels"), "rating", "total_reviews")


def teacher_details(t, *, teacher=None) -> DataFrame:
    """Q-18 (flat): each teacher with each active link to an active centre (NULLs when none)."""
    tch = optional_filters(t["teachers"], {"id": teacher})
    usr = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"), "avatar_url")
    ct = t["center_teachers"].filter(F.col("is_active")).select(F.col("teacher_id").alias("ct_tid"),
                                                                F.col("center_id").alias("ct_cid"))
    ctr = t["centers"].filter(F.col("is_active")).select(
        F.col("id").alias("center_id"), F.col("name").alias("center_name"), F.col("address").alias("center_address"),
        F.col("description").alias("center_description"), F.col("phone").alias("center_phone"),
        F.col("logo_url").alias("center_logo_url"))
    # ON-clause semantics: an inactive centre nulls the centre columns, the link row stays.
    rows = (tch.join(usr, tch.user_id == usr.u_id)
            .join(ct, tch.id == ct.ct_tid, "left")
            .join(ctr, F.col("ct_cid") == ctr.center_id, "left"))
    return rows.select(F.col("id").alias("teacher_id"), "teacher_name", "avatar_url",
                       F.array_join("subjects", ", ").alias("subjects"),
                       F.array_join("grade_levels", ", ").alias("grade_levels"), "rating", "total_reviews", "bio",
                       "center_id", "center_name", "center_address", "center_description", "center_phone",
                       "center_logo_url")


def detail_pages(flat: DataFrame, keys: list[str], order: str, items: dict[str, str], name: str,
                 page_size: int = 20) -> DataFrame:
    """AGG-10 (``json_agg``) in numbered pages: ``keys``, page (from 0) and ``name``, the JSON array of the page's ``items`` (field:
    column) in the order of ``order``. A document of a whole group would hold a hot centre in one row; rows are numbered
    without gathering a group, so a page never has more than ``page_size`` items. An entity without items keeps
    one page with one element of NULLs, as the left join of the reference gives."""
    numbered = running_count(flat, [keys[0]], [F.asc_nulls_first(order)], "_at").withColumn(
        "page", F.floor((F.col("_at") - 1) / page_size))
    item = F.struct("_at", F.struct(*[F.col(c).alias(f) for f, c in items.items()]).alias("item"))
    paged = numbered.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return paged.select(*keys, "page", F.to_json(F.transform("_items", lambda x: x["item"]), {"ignoreNullFields": "false"}).alias(name))


def center_detail_pages(t, *, center=None) -> DataFrame:
    """Q-17 as the reference answers it: each active centre with its teachers nested, in pages."""
    flat = _center_teachers(t, center)
    keys = ["center_id", "center_name", "center_address", "center_description", "center_phone", "center_logo_url"]
    fields = ["teacher_id", "teacher_name", "avatar_url", "subjects", "grade_levels", "rating", "total_reviews"]
    return detail_pages(flat, keys, "teacher_id", {f: f for f in fields}, "teachers")


def teacher_detail_pages(t, *, teacher=None) -> DataFrame:
    """Q-18 as the reference answers it: each teacher with the active centres nested, in pages."""
    flat = teacher_details(t, teacher=teacher)
    keys = ["teacher_id", "teacher_name", "avatar_url", "subjects", "grade_levels", "rating", "total_reviews", "bio"]
    fields = ["center_id", "center_name", "center_address", "center_description", "center_phone", "center_logo_url"]
    return detail_pages(flat, keys, "center_id", {f: f for f in fields}, "centers")


def all_subjects(t) -> DataFrame:
    """Q-19: distinct subjects over all teachers (explode drops empty/NULL arrays)."""
    return t["teachers"].select(F.explode("subjects").alias("subject")).distinct()


def teacher_reviews_public(t, *, teacher=None) -> DataFrame:
    """Q-20: reviews with the reviewer, hidden ones included (C11), newest first."""
    r = optional_filters(t["reviews"], {"teacher_id": teacher})
    u = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("reviewer_name"),
                          F.col("avatar_url").alias("reviewer_avatar"))
    return r.join(u, r.student_id == u.u_id).select(
        "teacher_id", F.col("id").alias("review_id"), "rating", "comment", "created_at", "reviewer_name",
        "reviewer_avatar")


def center_upcoming_sessions(t, *, center=None, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-21: future, not completed sessions of active centres (cancelled ones stay)."""
    s = optional_filters(prune_months(t["sessions"], "scheduled_at", frm=as_of), {"center_id": center},
                         [F.col("status") != "completed", F.col("scheduled_at") > ts_lit(as_of)])
    active = t["centers"].filter(F.col("is_active")).select(F.col("id").alias("center_id"))
    s = s.join(active, "center_id", "left_semi")
    tch = t["teachers"].select(F.col("id").alias("t_id"), "user_id")
    u = t["users"].select(F.col("id").alias("u_id"), F.col("name").alias("teacher_name"),
                          F.col("avatar_url").alias("teacher_avatar"))
    return (s.join(tch, s.teacher_id == tch.t_id).join(u, F.col("user_id") == u.u_id)
            .select("center_id", F.col("id").alias("session_id"), "subject", "grade_level", "scheduled_at",
                    "duration_min", "status", "capacity", "teacher_id", "teacher_name", "teacher_avatar"))


def _discovery_rows(t, as_of) -> DataFrame:
    """Q-46 rows with array columns (formatted as text by the public functions)."""
    rows = _teacher_center_rows(t).filter(F.col("u_active"))
    bookable = prune_months(t["sessions"], "scheduled_at", frm=as_of).filter(
        (F.col("status") == "scheduled") & (F.col("scheduled_at") > ts_lit(as_of))
        & (F.col("seats_booked") < F.col("capacity")))
    nxt = first_per_group(bookable, ["teacher_id", "center_id"], ["scheduled_at", "id"],
                          ["price", "subject", "grade_level", "title", "duration_min", "capacity", "seats_booked"],
                          prefix="s_")
    nxt = nxt.withColumnRenamed("teacher_id", "n_tid").withColumnRenamed("center_id", "n_cid")
    return rows.join(nxt, (rows.id == nxt.n_tid) & (rows.center_id == nxt.n_cid), "left")


def _discovery_select(j: DataFrame) -> DataFrame:
    return j.select(
        F.col("id").alias("teacher_id"), F.col("user_id"), "teacher_name", "avatar_url", "bio",
        F.array_join("subjects", ", ").alias("subjects"), F.array_join("grade_levels", ", ").alias("grade_levels"),
        "rating", "total_reviews", "total_sessions", F.col("is_verified").alias("teacher_verified"),
        "center_id", "center_name", "center_address", "center_lat", "center_lng", "center_phone", "center_logo_url",
        "center_rating", F.col("s_id").alias("session_id"), F.col("s_scheduled_at").alias("next_session"),
        F.col("s_price").alias("session_price"), F.col("s_subject").alias("session_subject"),
        F.col("s_grade_level").alias("session_grade_level"), F.col("s_title").alias("session_title"),
        F.col("s_duration_min").alias("duration_min"),
        (F.col("s_capacity") - F.col("s_seats_booked")).alias("available_seats"))


def teacher_discovery(t, *, as_of=SESSION_AS_OF) -> DataFrame:
    """Q-46 (view): active teacher x active link x active centre, with the next bookable session.

    The lateral ``ORDER BY scheduled_at LIMIT 1`` is a ``min(struct)`` aggregate per
    (teacher, centre) over the bookable sessions (id breaks ties), then a left join.
    """
    return _discovery_select(_discovery_rows(t, as_of))


def teacher_discovery_nearby(t, *, lat: float, lng: float, km: float = NEARBY_KM, subject=None, grade=None,
                             as_of=SESSION_AS_OF) -> DataFrame:
    """Q-52 (contract): Q-46 within the radius, with distance (exact subject/grade match on the arrays)."""
    _check_point(lat, lng)
    rows = _discovery_rows(t, as_of).filter(within_km("center_lat", "center_lng", lat, lng, km))
    rows = optional_filters(rows, extra=[has_value("subjects", subject), has_value("grade_levels", grade)])
    return _discovery_select(rows).withColumn(
        "distance_km", F.round(haversine_km("center_lat", "center_lng", lat, lng), 6))
