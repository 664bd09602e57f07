"""Table maintenance: constraint checks, derived counters, patches, deletes (JOB-10 .. JOB-18, JOB-22).

Counters that the reference keeps with triggers (and double-bumps, C2-C4) are recomputed
from the facts here, never incremented.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import SESSION_AS_OF
from studyhall.jobs import rules
from studyhall.operators.topn import earliest_ok
from studyhall.functions.exprs import avg_1dp, first_failure, ts_lit
from studyhall.session import cut_lineage, stored

# Output of the constraint job: one row per violation.
VIOLATION_COLS = ["table_name", "rule", "row_key", "detail"]



def _out(df: DataFrame, table, rule, key, detail) -> DataFrame:
    return df.select(F.lit(table).alias("table_name") if isinstance(table, str) else table.alias("table_name"),
                     rule.alias("rule"), key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def _row_rules(t, table: str, checks: list[tuple[str, object, object]]) -> DataFrame:
    """All row-level rules of one table in one scan: rows that break any rule are exploded into
    one violation per broken rule (CHECK, enum, NOT NULL)."""
    df = t[table]
    conds = [F.coalesce(c, F.lit(False)) for _, c, _ in checks]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"),
                                                  (F.lit(None) if d is None else F.col(d)).cast("string").alias("d")))
                              for (r, _, d), c in zip(checks, conds)]), lambda x: x.isNotNull())
    bad = df.filter(reduce(lambda a, b: a | b, conds)).select(_row_key(table).alias("_k"), F.explode(hits).alias("_v"))
    return _out(bad, table, F.col("_v.rule"), F.col("_k"), F.col("_v.d"))


def _unique_rules(t, spec: dict[str, list[list[str]]]) -> DataFrame:
    """All UNIQUE rules of all tables in two steps.

    1. one aggregation over (rule number, 64-bit hash of the typed key columns) finds the
       candidate groups (no key text is built for the vast majority of rows);
    2. only tables with candidates are read again, and only rows of candidate groups get their
       exact key text and are counted again, so a hash collision between different keys never
       reports a duplicate.
    """
    pairs = [(table, cols) for table, keys in spec.items() for cols in keys if set(cols) <= set(t[table].columns)]
    hashed, exact = [], []
    for i, (table, cols) in enumerate(pairs):
        nn = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        rows = t[table].filter(nn)
        hashed.append(rows.select(F.lit(i).alias("_r"), F.xxhash64(*[F.col(c) for c in cols]).alias("_h")))
        exact.append((i, table, cols, rows))
    cand = cut_lineage(reduce(lambda a, b: a.unionByName(b), hashed).groupBy("_r", "_h").agg(F.count(F.lit(1)).alias("_n"))
                       .filter(F.col("_n") > 1).select("_r", "_h"))
    # which rules have candidates at all (at most one small int per rule reaches the driver):
    # tables without any are not read a second time
    with_cand = {r._r for r in cand.select("_r").distinct().collect()}
    again = [rows.select(F.lit(i).alias("_r"), F.lit(table).alias("_table"), F.lit(f"unique({','.join(cols)})").alias("rule"),
                         F.xxhash64(*[F.col(c) for c in cols]).alias("_h"),
                         F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("k"))
             for i, table, cols, rows in exact if i in with_cand]
    if not again:
        empty = t["users"].sparkSession.createDataFrame([], "_table string, rule string, k string, n bigint")
        return _out(empty, F.col("_table"), F.col("rule"), F.col("k"), F.col("n"))
    hits = reduce(lambda a, b: a.unionByName(b), again).join(cand, ["_r", "_h"], "left_semi")
    dup = hits.groupBy("_table", "rule", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _out(dup, F.col("_table"), F.col("rule"), F.col("k"), F.col("n"))


def _row_key(table: str):
    cols = rules.ROW_KEYS.get(table)
    return F.col("id").cast("string") if cols is None else F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _foreign_keys(t, spec: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """All foreign keys: the distinct references of each (child, column) first, one anti join of those
    against the parents' ids, and only the few missing values are looked up in the child rows again."""
    pairs = [(parent, child, col) for parent, children in spec.items() for child, col in children
             if col in t[child].columns]
    refs = reduce(lambda a, b: a.unionByName(b), [
        t[child].filter(F.col(col).isNotNull()).select(
            F.lit(child).alias("_table"), F.lit(f"fk({col}->{parent}.id)").alias("_rule"),
            F.lit(parent).alias("_parent"), F.col(col).alias("_ref")) for parent, child, col in pairs]).distinct()
    ids = reduce(lambda a, b: a.unionByName(b), [
        t[parent].select(F.lit(parent).alias("_p"), F.col("id").alias("_pk")) for parent in spec])
    miss = cut_lineage(refs.join(ids, (refs._parent == ids._p) & (refs._ref == ids._pk), "left_anti"))
    # which rules have misses at all (one short row per rule reaches the driver): the others read nothing more
    broken = {(r._table, r._rule) for r in miss.select("_table", "_rule").distinct().collect()}
    if not broken:
        return _out(miss.limit(0), F.col("_table"), F.col("_rule"), F.col("_ref"), F.col("_ref"))
    # One scan per child that has any, its references to the parents at fault listed with their rules; one join for all.
    listed = []
    for child in dict.fromkeys(c for c, _ in broken):
        mine = [(f"fk({col}->{parent}.id)", col) for parent, c, col in pairs if c == child]
        held = F.explode(F.array(*[F.struct(F.lit(rule).alias("_rule"), F.col(col).alias("_ref"))
                                   for rule, col in mine if (child, rule) in broken])).alias("_x")
        listed.append(t[child].select(F.lit(child).alias("_table"), _row_key(child).alias("_k"), held).select(
            "_table", "_k", "_x._rule", "_x._ref"))
    rows = reduce(lambda a, b: a.unionByName(b), listed).join(miss.select("_table", "_rule", "_ref"), ["_table", "_rule", "_ref"])
    return _out(rows, F.col("_table"), F.col("_rule"), F.col("_k"), F.col("_ref"))


def _uuid_rules(t) -> list[DataFrame]:
    """FN-31: where keys are text (UUIDs, as in the reference schema), every id must be one.
    Numeric keys need no such rule."""
    from pyspark.sql import types as T

    from studyhall.functions.exprs import is_uuid
    out = []
    for table in ("users", "centers", "teachers", "sessions", "bookings", "rooms", "wallet_transactions"):
        if isinstance(t[table].schema["id"].dataType, T.StringType):
            out.append(_row_rules(t, table, [("uuid(id)", F.col("id").isNotNull() & ~is_uuid("id"), "id")]))
    return out


def check_constraints(t) -> DataFrame:
    """JOB-17: one row per violated declared rule (CHECK, enum, NOT NULL, length, UNIQUE, FK) of
    ``jobs.rules``. Row rules: one scan per table; all UNIQUE rules: one aggregation; all foreign keys:
    one anti join of distinct references.
    """
    c = F.col
    checks = {
        "sessions": [("check(seats_booked<=capacity)", c("seats_booked") > c("capacity"), None),
                     ("check(capacity>0)", c("capacity") <= 0, None), ("check(duration_min>0)", c("duration_min") <= 0, None),
                     ("check(price>=0)", c("price") < 0, None)],
        "reviews": [("check(rating between 1 and 5)", ~c("rating").between(1, 5), None)],
        "wallet_transactions": [("check(amount>0)", c("amount") <= 0, None)],
    }
    parts = [*_uuid_rules(t)]
    for table in sorted({*checks, *rules.NOT_NULL, *rules.MAX_LENGTH, *rules.ENUMS}):
        has = set(t[table].columns)
        own = checks.get(table, [])
        own += [(f"enum({col})", c(col).isNotNull() & ~c(col).isin(*allowed), col)
                for col, allowed in rules.ENUMS.get(table, {}).items() if col in has]
        own += [(f"not_null({col})", c(col).isNull(), None) for col in rules.NOT_NULL.get(table, []) if col in has]
        own += [(f"check(length({col})<={n})", F.length(col) > n, None)
                for col, n in rules.MAX_LENGTH.get(table, {}).items() if col in has]
        parts.append(_row_rules(t, table, own))
    parts.append(_unique_rules(t, rules.UNIQUE))
    parts.append(_foreign_keys(t, rules.FOREIGN_KEYS))
    return reduce(lambda a, b: a.unionByName(b), parts)


def constraint_summary(t) -> DataFrame:
    """JOB-17 summary: violations per (table, rule)."""
    return check_constraints(t).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("violations"))


# ------------------------------------------------------------------ JOB-18
def teacher_ratings(t) -> DataFrame:
    """Teacher rating = round(avg(visible ratings), 1) or 0, review count, session count."""
    r = t["reviews"].filter(F.col("is_visible")).groupBy(F.col("teacher_id").alias("r_tid")).agg(
        F.sum("rating").alias("_s"), F.count(F.lit(1)).alias("_n"))
    s = t["sessions"].groupBy(F.col("teacher_id").alias("s_tid")).agg(F.count(F.lit(1)).alias("_sessions"))
    j = t["teachers"].select("id").join(r, F.col("id") == F.col("r_tid"), "left").join(
        s, F.col("id") == F.col("s_tid"), "left")
    return j.select(F.col("id").alias("teacher_id"),
                    F.coalesce(avg_1dp("_s", "_n"), F.lit(0).cast("decimal(10,1)")).alias("rating"),
                    F.coalesce(F.col("_n"), F.lit(0)).alias("total_reviews"),
                    F.coalesce(F.col("_sessions"), F.lit(0)).alias("total_sessions"))


def session_seats(t) -> DataFrame:
    """seats_booked = non-cancelled bookings (C2), next to the stored value."""
    b = (t["bookings"].filter(F.col("status") != "cancelled").groupBy(F.col("session_id").alias("b_sid"))
         .agg(F.count(F.lit(1)).alias("_n")))
    s = t["sessions"].select("id", "capacity", F.col("seats_booked").alias("stored_seats_booked"))
    return s.join(b, s.id == b.b_sid, "left").select(
        F.col("id").alias("session_id"), "capacity", "stored_seats_booked",
        F.coalesce(F.col("_n"), F.lit(0)).alias("seats_booked"))


def room_counts(t) -> DataFrame:
    """member_count / content_count from the rows (C3)."""
    m = t["room_members"].groupBy(F.col("room_id").alias("m_rid")).agg(F.count(F.lit(1)).alias("_m"))
    c = t["content_items"].groupBy(F.col("room_id").alias("c_rid")).agg(F.count(F.lit(1)).alias("_c"))
    r = t["rooms"].select("id")
    j = r.join(m, r.id == m.m_rid, "left").join(c, F.col("id") == F.col("c_rid"), "left")
    return j.select(F.col("id").alias("room_id"), F.coalesce(F.col("_m"), F.lit(0)).alias("member_count"),
                    F.coalesce(F.col("_c"), F.lit(0)).alias("content_count"))


def rebuild_derived_columns(t) -> dict[str, DataFrame]:
    """JOB-18: new snapshots of the counter-bearing tables with recomputed counters."""
    tr = teacher_ratings(t)
    teachers = (t["teachers"].drop("rating", "total_reviews", "total_sessions")
                .join(tr.withColumnRenamed("teacher_id", "id"), "id"))
    seats = session_seats(t).select(F.col("session_id").alias("id"), "seats_booked")
    sessions = t["sessions"].drop("seats_booked").join(seats, "id")
    rc = room_counts(t).withColumnRenamed("room_id", "id")
    rooms = t["rooms"].drop("member_count", "content_count").join(rc, "id")
    return {"teachers": teachers, "sessions": sessions, "rooms": rooms}


# ------------------------------------------------------------------ JOB-10
def apply_patches(table: DataFrame, patches: DataFrame, *, key: str = "id", stamp_col: str | None = "updated_at",
                  patched_at: str = "patched_at", order_id: str = "request_id", mode: str = "coalesce") -> DataFrame:
    """JOB-10: merge a batch of patches into a snapshot by join (no in-place UPDATE).

    The result is that of applying the patches one by one, ordered by (``patched_at``, ``order_id`` if
    the patches have it). ``coalesce``: a NULL in a patch keeps the value before it
    (``COALESCE($n, col)``), so each column takes its own latest non-NULL value; ``overwrite``: the last
    patch replaces all patched columns. The stamp column takes the last ``patched_at``.
    """
    by = [c for c in (patched_at, order_id) if c in patches.columns]
    cols = [c for c in patches.columns if c not in (key, *by) and c in table.columns]
    # max_by aggregates: combined map-side, safe for a key with very many patches
    order = F.struct(*by)
    if mode == "coalesce":
        aggs = [F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(f"_p_{c}")
                for c in cols]
    else:
        aggs = [F.max(F.struct(order.alias("o"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])).alias("_p")]
    latest = patches.groupBy(F.col(key).alias("_pk")).agg(F.max(patched_at).alias("_at"), *aggs)
    j = table.join(latest, F.col(key) == F.col("_pk"), "left")
    hit = F.col("_at").isNotNull()
    out = []
    for c in table.columns:
        if c in cols:
            new = F.coalesce(F.col(f"_p_{c}.v"), F.col(c)) if mode == "coalesce" else \
                F.when(hit, F.col(f"_p.v{cols.index(c)}")).otherwise(F.col(c))
            out.append(new.alias(c))
        elif stamp_col is not None and c == stamp_col:
            out.append(F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def room_patches(t) -> DataFrame:
    """Patches for rooms: one per room (name, is_active or neither), a later one of ``is_active`` alone
    for every 5th, and two at one time that differ for every 15th."""
    r = t["rooms"].select("id")
    k = F.col("id")
    none = F.lit(None).cast("string")
    at = ts_lit(SESSION_AS_OF)
    first = r.select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("Renamed "), k.cast("string"))).alias("name"),
                     F.when(k % 3 == 0, F.lit(False)).alias("is_active"), at.alias("patched_at"), k.alias("request_id"))
    second = r.filter(k % 5 == 0).select(
        k.alias("id"), none.alias("name"), F.lit(True).alias("is_active"),
        F.timestamp_add("MINUTE", F.lit(5), at).alias("patched_at"), (k + 1_000_000_000).alias("request_id"))
    third = r.filter(k % 15 == 0).select(
        k.alias("id"), F.concat(F.lit("Again "), k.cast("string")).alias("name"), F.lit(False).alias("is_active"),
        F.timestamp_add("MINUTE", F.lit(5), at).alias("patched_at"), (k + 2_000_000_000).alias("request_id"))
    return first.unionByName(second).unionByName(third)


def apply_session_patches(t, patches: DataFrame, *, mode: str = "coalesce") -> dict[str, DataFrame]:
    """JOB-10 on sessions with the contract's guard: a patch that would set ``capacity`` below
    the seats already taken (non-cancelled bookings) is refused (CAPACITY_BELOW_BOOKED); the
    others are merged. Returns the decisions and the new sessions snapshot."""
    seats = (t["bookings"].filter(F.col("status") != "cancelled").groupBy(F.col("session_id").alias("g_sid"))
             .agg(F.count(F.lit(1)).alias("_taken")))
    p = patches.join(seats, patches.id == seats.g_sid, "left")
    bad = F.col("capacity").isNotNull() & (F.col("capacity") < F.coalesce(F.col("_taken"), F.lit(0)))
    d = p.withColumn("decision", F.when(bad, "CAPACITY_BELOW_BOOKED").otherwise("OK"))
    ok = d.filter(F.col("decision") == "OK").select(*patches.columns)
    snap = apply_patches(t["sessions"], ok, mode=mode)
    return {"decisions": d.select("id", "patched_at", "decision"), "sessions": snap}


# ------------------------------------------------------------------ JOB-11 / 12 / 14 / 15 / 22
def propagate_content_updates(t, changed: DataFrame) -> DataFrame:
    """JOB-11: copy title/description/url of changed master content into every room item using it."""
    ch = changed.select(F.col("id").alias("tc_id"), F.col("title").alias("_t"), F.col("description").alias("_d"),
                        F.col("url").alias("_u"))
    ci = t["content_items"]
    j = ci.join(ch, ci.teacher_content_id == ch.tc_id, "left")
    hit = F.col("tc_id").isNotNull()
    return j.select(*[F.when(hit, F.col({"title": "_t", "description": "_d", "url": "_u"}[c])).otherwise(F.col(c))
                      .alias(c) if c in ("title", "description", "url") else F.col(c) for c in ci.columns])


def update_teacher_content(t, requests: DataFrame, *, as_of=SESSION_AS_OF) -> dict[str, DataFrame]:
    """JOB-10 + JOB-11 for master content: requests (request_id, content_id, teacher_id, title,
    description, url, is_free, is_active, sort_order, requested_at): NOT_FOUND, NOT_YOUR_CONTENT,
    TITLE_TOO_LONG, INVALID_URL, else OK. Accepted patches are merged with COALESCE (latest per
    item wins) and every room copy takes the master's new title, description and url."""
    from studyhall.functions.links import is_valid_url

    tc = t["teacher_content"].select(F.col("id").alias("_tc"), F.col("teacher_id").alias("_owner"))
    j = requests.join(tc, requests.content_id == tc._tc, "left")
    d = j.withColumn("decision", first_failure([
        ("NOT_FOUND", F.col("_tc").isNull()), ("NOT_YOUR_CONTENT", F.col("_owner") != F.col("teacher_id")),
        ("TITLE_TOO_LONG", F.col("title").isNotNull() & (F.length("title") > 255)),
        ("INVALID_URL", F.col("url").isNotNull() & ~is_valid_url("url"))])).drop("_tc", "_owner")
    cols = ["title", "description", "url", "is_free", "is_active", "sort_order"]
    ok = d.filter(F.col("decision") == "OK").select(
        F.col("content_id").alias("id"), *cols,
        F.coalesce(F.col("requested_at"), ts_lit(as_of)).alias("patched_at"), "request_id")
    masters = apply_patches(t["teacher_content"], ok)
    changed = masters.join(ok.select(F.col("id").alias("_chg")).distinct(), F.col("id") == F.col("_chg"),
                           "left_semi")
    return {"decisions": d.select("request_id", "content_id", "teacher_id", "decision"),
            "teacher_content": masters, "content_items": propagate_content_updates(t, changed)}


def retire_content(t, requests: DataFrame) -> DataFrame:
    """JOB-12: per requested master content: DEACTIVATED when room items use it, DELETED when not,
    NOT_FOUND when it does not exist (or belongs to another teacher)."""
    used = t["content_items"].filter(F.col("teacher_content_id").isNotNull()).groupBy(
        F.col("teacher_content_id").alias("u_id")).agg(F.count(F.lit(1)).alias("uses"))
    tc = t["teacher_content"].select(F.col("id").alias("tc_id"), F.col("teacher_id").alias("owner"))
    j = requests.join(tc, requests.content_id == tc.tc_id, "left").join(used, F.col("content_id") == F.col("u_id"),
                                                                         "left")
    return j.select("request_id", "content_id", "teacher_id",
                    F.when(F.col("tc_id").isNull() | (F.col("owner") != F.col("teacher_id")), "NOT_FOUND")
                    .when(F.coalesce(F.col("uses"), F.lit(0)) > 0, "DEACTIVATED").otherwise("DELETED")
                    .alias("decision"), F.coalesce(F.col("uses"), F.lit(0)).alias("uses"))


def reorder_content(t, requests: DataFrame) -> DataFrame:
    """JOB-14: requests ([requested_at, request_id,] room_id[, center_id], items: array<struct<id, sort_order>>) set new
    ranks; ids outside the room are ignored, and with ``center_id`` a request for a room of
    another centre is ignored (NOT_FOUND). Returns the new content_items snapshot."""
    if "center_id" in requests.columns:
        own = t["rooms"].select(F.col("id").alias("_rid"), F.col("center_id").alias("_rc"))
        requests = requests.join(own, (requests.room_id == own._rid) & (requests.center_id == own._rc), "left_semi")
    order = [c for c in ("requested_at", "request_id") if c in requests.columns]
    ranks = (requests.select("room_id", *order, F.posexplode("items").alias("_pos", "_item"))
             .select(F.col("room_id").alias("r_room"), F.col("_item.id").alias("r_id"),
                     F.col("_item.sort_order").alias("r_rank"), *order, "_pos"))
    # requests in order of (time, id); in one request the last mention of an id wins
    ranks = ranks.groupBy("r_room", "r_id").agg(F.max(F.struct(*order, "_pos", "r_rank")).alias("_b")).select(
        "r_room", "r_id", F.col("_b.r_rank").alias("r_rank"))
    ci = t["content_items"]
    j = ci.join(ranks, (ci.id == ranks.r_id) & (ci.room_id == ranks.r_room), "left")
    return j.select(*[F.coalesce(F.col("r_rank").cast("int"), F.col(c)).alias(c) if c == "sort_order" else F.col(c)
                      for c in ci.columns])


def _link_facts(t, requests: DataFrame) -> DataFrame:
    ctr = t["centers"].select(F.col("id").alias("c_id"))
    tch = t["teachers"].select(F.col("id").alias("t_id"))
    ct = t["center_teachers"].select(F.col("center_id").alias("l_cid"), F.col("teacher_id").alias("l_tid")) \
        .distinct()
    return (requests.join(ctr, requests.center_id == ctr.c_id, "left")
            .join(tch, F.col("teacher_id") == F.col("t_id"), "left")
            .join(ct, (F.col("center_id") == F.col("l_cid")) & (F.col("teacher_id") == F.col("l_tid")), "left"))


def link_teachers(t, requests: DataFrame) -> DataFrame:
    """JOB-15 link: CENTER_NOT_FOUND, TEACHER_NOT_FOUND, ALREADY_LINKED (any association row,
    active or not, or an earlier request of the batch), else OK (a new active link)."""
    j = _link_facts(t, requests)
    d = j.select("request_id", "center_id", "teacher_id", first_failure([
        ("CENTER_NOT_FOUND", F.col("c_id").isNull()), ("TEACHER_NOT_FOUND", F.col("t_id").isNull()),
        ("ALREADY_LINKED", F.col("l_cid").isNotNull())]).alias("decision"))
    return earliest_ok(d, ["center_id", "teacher_id"], "ALREADY_LINKED", order=["request_id"])


def unlink_teachers(t, requests: DataFrame) -> DataFrame:
    """JOB-15 unlink: CENTER_NOT_FOUND, TEACHER_NOT_FOUND, NOT_LINKED (no association row, or
    an earlier request of the batch removed it), else OK (the association row is deleted)."""
    j = _link_facts(t, requests)
    d = j.select("request_id", "center_id", "teacher_id", first_failure([
        ("CENTER_NOT_FOUND", F.col("c_id").isNull()), ("TEACHER_NOT_FOUND", F.col("t_id").isNull()),
        ("NOT_LINKED", F.col("l_cid").isNull())]).alias("decision"))
    return earliest_ok(d, ["center_id", "teacher_id"], "NOT_LINKED", order=["request_id"])


# The delete rule of every foreign key of the reference schema (parent table ->
# child table, column, rule). NO ACTION is enforced like RESTRICT. content_items.teacher_content_id
# is not declared there (C8); the code only deletes unused master content, so it restricts.
FK_RULES: dict[str, list[tuple[str, str, str]]] = {
    "users": [("centers", "owner_id", "restrict"), ("teachers", "user_id", "cascade"),
              ("bookings", "student_id", "restrict"), ("attendances", "scanned_by", "restrict"),
              ("room_members", "student_id", "cascade"), ("wallet_transactions", "user_id", "restrict"),
              ("reviews", "student_id", "cascade"), ("notifications", "user_id", "cascade"),
              ("audit_logs", "admin_id", "set_null")],
    "centers": [("center_teachers", "center_id", "cascade"), ("sessions", "center_id", "cascade"),
                ("rooms", "center_id", "cascade")],
    "teachers": [("center_teachers", "teacher_id", "cascade"), ("sessions", "teacher_id", "restrict"),
                 ("rooms", "teacher_id", "cascade"), ("reviews", "teacher_id", "cascade")],
    "sessions": [("bookings", "session_id", "restrict")],
    "bookings": [("attendances", "booking_id", "restrict"), ("reviews", "booking_id", "restrict")],
    "rooms": [("room_members", "room_id", "cascade"), ("content_items", "room_id", "cascade")],
    "teacher_content": [("content_items", "teacher_content_id", "restrict")],
}


def _cascade(t, roots: list[tuple[str, DataFrame]]) -> tuple[list, list, list]:
    """What deleting rows takes along, from (table, frame) of the rows asked for: lists of (table, frame) of rows removed,
    (table, column, frame) of references cleared or rows removed by reference, and (table, frame) of rows that forbid
    it. Frames: _root (which row was asked for), _key.
    Level by level along the schema's rules; the FK graph is acyclic; each level is stored once and read by all users."""
    removed, cleared, forbid, level = list(roots), [], [], list(roots)
    while level:
        nxt = []
        for parent, keys in level:
            for child, col, rule in FK_RULES.get(parent, []):
                by_id = "id" in t[child].columns
                refs = t[child].select(F.col("id" if by_id else col).alias("_ck"), F.col(col).alias("_ref"))
                hits = refs.join(keys, refs._ref == keys._key).select("_root", F.col("_ck").alias("_key")).distinct()
                if rule == "restrict":
                    forbid.append((child, hits))
                elif rule == "set_null":
                    cleared.append((child, col, hits))
                elif by_id:
                    hits = stored(hits)
                    removed.append((child, hits))
                    nxt.append((child, hits))
                else:  # a leaf without an id: its rows go by the reference itself
                    cleared.append((child, f"_delete_by:{col}", hits))
        level = nxt
    return removed, cleared, forbid


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def delete_rows(t, table: str | list[str], requests: DataFrame, *, owner_col: str | None = None) -> dict[str, DataFrame]:
    """JOB-22: owner-scoped deletes, as if the requests came one by one in the order of request_id.

    ``requests``: request_id, id[, owner] of one ``table``, or of several with the column ``table_name``. NOT_FOUND when the row does not
    exist, belongs to another owner or was removed by an earlier accepted request; BLOCKED when a row in the request's
    cascade tree still has a RESTRICT dependant (the database would reject the whole statement); otherwise OK, and the row,
    its CASCADE dependants (transitively) are removed and SET NULL references cleared. Returns the decisions and a new
    snapshot of every table the accepted deletes touch.

    The trees are found once. A dependant that an earlier accepted request removes blocks no more: requests that depend on
    others are settled in rounds, each deciding those whose earlier removers are all decided (at least the first one
    left); requests without such dependants, the usual case, are all decided in the first round.
    """
    tables = [table] if isinstance(table, str) else list(table)
    if isinstance(table, str):
        requests = requests.withColumn("table_name", F.lit(table))
    parts = []
    for name in tables:
        base = t[name].select(F.col("id").alias("_id"), *([F.col(owner_col).alias("_owner")] if owner_col else []))
        mine = requests.filter(F.col("table_name") == name)
        cond = mine.id == base._id
        if owner_col:
            cond = cond & (mine.owner == base._owner)
        parts.append(mine.join(base, cond, "left").select("request_id", "table_name", "id", F.col("_id").isNotNull().alias("_found")))
    found = stored(_union(parts).withColumn("_root", F.concat_ws(":", "table_name", F.col("id").cast("string"))))

    roots = [(name, stored(found.filter(F.col("_found") & (F.col("table_name") == name)).select(
        "_root", F.col("id").alias("_key")).distinct())) for name in tables]
    removed, cleared, forbid = _cascade(t, roots)
    asked = found.filter("_found").select("request_id", "_root")
    # What must be gone before a request passes, and who (of the same batch, earlier) removes it; likewise its own row.
    tagged = [f.select("_root", F.lit(name).alias("_table"), F.col("_key").cast("string").alias("_row")) for name, f in removed]
    gone_by = stored(_union(tagged)).join(asked.select("_root", F.col("request_id").alias("by")), "_root").drop("_root")
    in_way = [f.select("_root", F.lit(name).alias("_table"), F.col("_key").cast("string").alias("_row"),
                       F.lit(False).alias("own")) for name, f in forbid]
    in_way += [f.select("_root", F.lit(name).alias("_table"), F.col("_key").cast("string").alias("_row"),
                        F.lit(True).alias("own")) for name, f in roots]
    needs = asked.join(_union(in_way), "_root").join(gone_by, ["_table", "_row"], "left").select(
        "request_id", "_table", "_row", "own", F.when(F.col("by") < F.col("request_id"), F.col("by")).alias("by"))
    # A row nobody earlier removes is one entry with ``by`` NULL.
    needs = stored(needs.distinct())
    state = stored(asked.select("request_id", F.lit("WAITS").alias("decision")))
    while True:
        by = state.select(F.col("request_id").alias("by"), F.col("decision").alias("_by"))
        left = needs.join(state.filter("decision = 'WAITS'").select("request_id"), "request_id", "left_semi")
        rows = left.join(by, "by", "left").groupBy("request_id", "_table", "_row", "own").agg(
            F.max(F.coalesce(F.col("_by") == "OK", F.lit(False))).alias("gone"),
            F.max(F.coalesce(F.col("_by") == "WAITS", F.lit(False))).alias("open"))
        own, dep = F.col("own"), ~F.col("own")
        told = rows.groupBy("request_id").agg(
            F.max(own & F.col("gone")).alias("lost"), F.max(F.col("open") & ~F.col("gone")).alias("open"),
            F.max(own & F.col("open") & ~F.col("gone")).alias("own_open"),
            F.max(dep & ~F.col("gone") & ~F.col("open")).alias("blocked"))
        now = (F.when(F.col("lost"), "NOT_FOUND").when(F.col("own_open"), "WAITS").when(F.col("blocked"), "BLOCKED")
               .when(F.col("open"), "WAITS").otherwise("OK"))
        told = told.select("request_id", now.alias("_now"))
        state = stored(state.join(told, "request_id", "left").select(
            "request_id", F.coalesce("_now", "decision").alias("decision")))
        if state.filter("decision = 'WAITS'").isEmpty():
            break
    decisions = found.join(state, "request_id", "left").select(
        "request_id", "id", F.coalesce("decision", F.lit("NOT_FOUND")).alias("decision"))
    ok_roots = stored(found.join(state.filter("decision = 'OK'"), "request_id", "left_semi").select(
        F.col("_root").alias("_ok")).distinct())

    def accepted(frames: list[DataFrame]) -> DataFrame:
        return _union(frames).join(ok_roots, F.col("_root") == F.col("_ok"), "left_semi").select("_key").distinct()

    out = {"decisions": decisions}
    for name in dict.fromkeys(n for n, _ in removed):
        gone = accepted([f for n, f in removed if n == name])
        out[name] = t[name].join(gone, t[name].id == gone._key, "left_anti")
    for name, col, frame in cleared:
        snap = out.get(name, t[name])
        gone = accepted([frame])
        if col.startswith("_delete_by:"):
            snap = snap.join(gone, snap[col.split(":", 1)[1]] == gone._key, "left_anti")
        else:
            hit = gone.withColumn("_hit", F.lit(True))
            j = snap.join(hit, snap["id"] == hit._key, "left")
            snap = j.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).cast(
                snap.schema[c].dataType).alias(c) if c == col else F.col(c) for c in snap.columns])
        out[name] = snap
    return out
