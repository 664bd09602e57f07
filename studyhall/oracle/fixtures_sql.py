"""DuckDB SQL deriving the domain tables from the driver views (same formulas as
``studyhall.sources.fixtures``). ``with_fixtures(body)`` prefixes a query with them."""

from __future__ import annotations

from studyhall.constants import (
    ADMIN_USER_OFFSET, OWNER_USER_OFFSET, SESSION_AS_OF, TEACHER_USER_OFFSET,
)

AS_OF = f"TIMESTAMP '{SESSION_AS_OF}'"


def _url(k: str) -> str:
    s = f"CAST({k} AS VARCHAR)"
    return f"""CASE {k} % 8
        WHEN 0 THEN 'https://www.youtube.com/watch?v=yt' || {s} || '&t=10'
        WHEN 1 THEN 'https://youtu.be/yb' || {s}
        WHEN 2 THEN 'https://www.youtube.com/shorts/ys' || {s}
        WHEN 3 THEN 'https://drive.google.com/file/d/fd' || {s} || '/view'
        WHEN 4 THEN 'https://drive.google.com/open?id=fo' || {s} || '&usp=sharing'
        WHEN 5 THEN 'https://docs.google.com/document/d/dd' || {s} || '/edit'
        WHEN 6 THEN 'https://files.example.com/notes/' || {s} || '.pdf'
        ELSE 'notes-' || {s} END"""


def _user_part(src: str, key: str, name: str, role: str, offset: int, located: bool) -> str:
    uid = f"({key} + {offset})"
    lat = f"CASE WHEN {key} % 4 <> 0 THEN 22.0 + ({key} * 53 % 1000) / 100.0 END" if located else "NULL"
    lng = f"CASE WHEN {key} % 4 <> 0 THEN 25.0 + ({key} * 29 % 1000) / 100.0 END" if located else "NULL"
    created = f"({AS_OF} - to_days(CAST({key} % 90 AS INTEGER)))"
    return f"""SELECT {uid} AS id, {name} AS name,
        '{role}.' || CAST({uid} AS VARCHAR) || '@mail.example' AS email,
        CASE WHEN {uid} % 5 <> 0 THEN '+20' || CAST({uid} AS VARCHAR) END AS phone,
        '{role}' AS role,
        CAST({lat} AS DOUBLE) AS lat, CAST({lng} AS DOUBLE) AS lng,
        CASE WHEN {key} % 3 <> 0 THEN 'https://img.example.com/a/' || CAST({uid} AS VARCHAR) || '.jpg' END AS avatar_url,
        {key} % 10 <> 0 AS is_active,
        {key} % 2 = 0 AS is_verified,
        CASE WHEN {key} % 7 <> 0 THEN {created} + to_hours(CAST({key} % 48 AS INTEGER)) END AS last_login_at,
        {created} AS created_at,
        {created} AS updated_at
      FROM {src}"""


FIXTURE_CTES = {
    "_n": """SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM supplier) AS ns,
                (SELECT count(*) FROM pages) AS ng, (SELECT count(*) FROM orders) AS no,
                (SELECT count(*) FROM nation) AS nn""",
    "users": " UNION ALL ".join([
        _user_part("customer", "c_custkey", "c_name", "student", 0, True),
        _user_part("part", "p_partkey", "p_name", "teacher", TEACHER_USER_OFFSET, False),
        _user_part("supplier", "s_suppkey", "s_name", "center_admin", OWNER_USER_OFFSET, False),
        _user_part("(SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation)",
                   "n_nationkey", "n_name", "super_admin", ADMIN_USER_OFFSET, False),
    ]),
    "teachers": f"""SELECT p_partkey AS id, p_partkey + {TEACHER_USER_OFFSET} AS user_id, p_name AS bio,
        [p_type, p_brand] AS subjects,
        ['Grade ' || CAST(1 + p_size % 12 AS VARCHAR), 'Grade ' || CAST(1 + p_partkey % 12 AS VARCHAR)] AS grade_levels,
        CAST(CAST(1 + p_partkey % 4 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS DECIMAL(2,1)) AS rating,
        CAST(p_partkey % 25 AS INTEGER) AS total_reviews,
        CAST(p_partkey % 40 AS INTEGER) AS total_sessions,
        CAST(p_partkey % 60 AS INTEGER) AS total_students,
        p_partkey % 3 <> 0 AS is_verified,
        {AS_OF} - to_days(CAST(p_partkey % 365 AS INTEGER)) AS created_at
      FROM part""",
    "centers": f"""SELECT s_suppkey AS id, s_suppkey + {OWNER_USER_OFFSET} AS owner_id, s_name AS name,
        'Street ' || CAST(s_suppkey % 97 AS VARCHAR) || ', District ' || CAST(s_nationkey AS VARCHAR) AS address,
        22.0 + (s_suppkey * 37 % 1000) / 100.0 AS lat,
        25.0 + (s_suppkey * 91 % 1000) / 100.0 AS lng,
        CASE WHEN s_suppkey % 4 <> 0 THEN 'Centre ' || CAST(s_suppkey AS VARCHAR) END AS description,
        '+203' || CAST(s_suppkey AS VARCHAR) AS phone,
        CASE WHEN s_suppkey % 3 <> 0 THEN 'https://img.example.com/c/' || CAST(s_suppkey AS VARCHAR) || '.png' END AS logo_url,
        CAST(CAST(2 + s_suppkey % 3 AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR) AS DECIMAL(2,1)) AS rating,
        CAST(s_suppkey % 50 AS INTEGER) AS total_reviews,
        s_suppkey % 8 <> 0 AS is_active,
        {AS_OF} - to_days(CAST(s_suppkey % 700 AS INTEGER)) AS created_at
      FROM supplier""",
    "sessions": """SELECT o_orderkey AS id,
        (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % (SELECT ns FROM _n) AS center_id,
        o_custkey AS teacher_id,
        o_orderpriority AS subject,
        'Grade ' || CAST(1 + o_custkey % 12 AS VARCHAR) AS grade_level,
        o_orderpriority || ' #' || CAST(o_orderkey AS VARCHAR) AS title,
        o_orderdate + to_hours(CAST(8 + o_orderkey % 12 AS INTEGER)) AS scheduled_at,
        CAST(30 * (1 + o_orderkey % 4) AS INTEGER) AS duration_min,
        CAST(1 + o_orderkey % 6 AS INTEGER) AS capacity,
        CAST(o_orderkey % 4 AS INTEGER) AS seats_booked,
        CAST(o_orderkey % 40 * 5 AS DECIMAL(10,2)) AS price,
        CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'scheduled'
             WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'ongoing' END AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN 'bring notebook' END AS notes,
        o_orderdate + to_hours(CAST(8 + o_orderkey % 12 AS INTEGER)) - to_days(CAST(7 + o_orderkey % 20 AS INTEGER)) AS created_at,
        o_orderdate + to_hours(CAST(8 + o_orderkey % 12 AS INTEGER)) - to_days(CAST(7 + o_orderkey % 20 AS INTEGER)) AS updated_at
      FROM orders""",
    "_li": """SELECT l_orderkey, l_linenumber, min(l_shipdate) AS booked_at,
        l_orderkey * 10 + l_linenumber AS bid,
        (l_orderkey * 7 + l_linenumber * 13) % (SELECT nc FROM _n) AS student,
        CASE WHEN (l_orderkey + l_linenumber) % 10 <= 1 THEN 'cancelled'
             WHEN (l_orderkey + l_linenumber) % 10 = 2 THEN 'pending'
             WHEN (l_orderkey + l_linenumber) % 10 <= 5 THEN 'confirmed'
             WHEN (l_orderkey + l_linenumber) % 10 <= 8 THEN 'attended'
             ELSE 'no_show' END AS st
      FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "bookings": """SELECT bid AS id, l_orderkey AS session_id, student AS student_id, st AS status,
        CAST(student AS VARCHAR) || '_' || CAST(l_orderkey AS VARCHAR) || '_' || substr(sha256(CAST(bid AS VARCHAR)), 1, 8) AS qr_code,
        CAST(l_orderkey % 40 * 5 AS DECIMAL(10,2)) AS amount_paid,
        booked_at,
        CASE WHEN st = 'cancelled' THEN booked_at + INTERVAL 1 DAY END AS cancelled_at,
        booked_at AS updated_at
      FROM _li""",
    "attendances": f"""SELECT b.id AS id, b.id AS booking_id,
        s.scheduled_at + to_minutes(CAST(b.id % 30 - 10 AS INTEGER)) AS scanned_at,
        s.center_id + {OWNER_USER_OFFSET} AS scanned_by
      FROM bookings b JOIN sessions s ON b.session_id = s.id WHERE b.status = 'attended'""",
    "center_teachers": """SELECT center_id, teacher_id, teacher_id % 7 <> 0 AS is_active,
        min(scheduled_at) AS joined_at,
        CASE WHEN NOT (teacher_id % 7 <> 0) THEN min(scheduled_at) + INTERVAL 365 DAY END AS left_at
      FROM sessions GROUP BY center_id, teacher_id""",
    "reviews": """SELECT b.id AS id, s.teacher_id, b.student_id, b.id AS booking_id,
        CAST(1 + b.id % 5 AS INTEGER) AS rating,
        CASE WHEN b.id % 4 <> 0 THEN 'Review ' || CAST(b.id AS VARCHAR) END AS comment,
        b.id % 11 <> 0 AS is_visible,
        s.scheduled_at + INTERVAL 1 DAY AS created_at
      FROM bookings b JOIN sessions s ON b.session_id = s.id
      WHERE b.status = 'attended' AND b.id % 3 = 0""",
    "rooms": f"""SELECT p_partkey AS id, p_partkey % (SELECT ns FROM _n) AS center_id, p_partkey AS teacher_id,
        'Room ' || CAST(p_partkey AS VARCHAR) AS name,
        CASE WHEN p_partkey % 2 = 0 THEN 'Study room of ' || p_name END AS description,
        upper(substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8)) AS access_code,
        p_type AS subject,
        'Grade ' || CAST(1 + p_size % 12 AS VARCHAR) AS grade_level,
        CAST(p_size * 10 AS DECIMAL(10,2)) AS paid_price,
        p_partkey % 6 <> 0 AS is_active,
        CAST(p_size % 7 AS INTEGER) AS member_count,
        CAST(p_partkey % 5 AS INTEGER) AS content_count,
        {AS_OF} - to_days(CAST(p_partkey % 200 AS INTEGER)) AS created_at,
        {AS_OF} - to_days(CAST(p_partkey % 100 AS INTEGER)) AS updated_at
      FROM part WHERE p_partkey < (SELECT nc FROM _n)""",
    "room_members": """SELECT min(b.id) AS id, s.teacher_id AS room_id, b.student_id,
        CASE WHEN min(b.id) % 3 = 0 THEN 'paid' ELSE 'free' END AS access_tier,
        min(b.booked_at) AS joined_at,
        CAST(NULL AS TIMESTAMP) AS expires_at,
        min(b.id) % 9 <> 0 AS is_active
      FROM bookings b JOIN sessions s ON b.session_id = s.id
      GROUP BY s.teacher_id, b.student_id""",
    "teacher_content": f"""SELECT page_id AS id, page_id % (SELECT nc FROM _n) AS teacher_id,
        page_id % (SELECT nc FROM _n) % (SELECT ns FROM _n) AS center_id,
        CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'pdf' ELSE 'link' END AS type,
        'Lesson ' || CAST(page_id AS VARCHAR) AS title,
        CASE WHEN page_id % 4 <> 0 THEN 'About lesson ' || CAST(page_id AS VARCHAR) END AS description,
        {_url('page_id')} AS url,
        page_id % 2 = 0 AS is_free,
        page_id % 5 <> 0 AS is_active,
        CAST(page_id % 20 AS INTEGER) AS sort_order,
        {AS_OF} - to_days(CAST(page_id % 100 AS INTEGER)) AS created_at,
        {AS_OF} - to_days(CAST(page_id % 100 AS INTEGER)) + to_days(CAST(page_id % 10 AS INTEGER)) AS updated_at
      FROM pages""",
    "content_items": f"""SELECT doc_id AS id, doc_id % (SELECT nc FROM _n) AS room_id,
        CASE WHEN doc_id % 5 <> 0 THEN doc_id % (SELECT ng FROM _n) END AS teacher_content_id,
        CASE doc_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'pdf' ELSE 'link' END AS type,
        'Item ' || CAST(doc_id AS VARCHAR) AS title,
        CASE WHEN doc_id % 2 = 0 THEN 'Notes for item ' || CAST(doc_id AS VARCHAR) END AS description,
        CASE WHEN doc_id % 7 <> 0 THEN {_url('doc_id')} END AS url,
        CASE WHEN doc_id % 2 <> 0 THEN 'https://img.example.com/t/' || CAST(doc_id AS VARCHAR) || '.jpg' END AS thumbnail_url,
        doc_id % 4 = 0 AS is_free,
        CAST(doc_id % 50 AS INTEGER) AS sort_order,
        CAST(n_chars AS INTEGER) AS duration_seconds,
        CAST(doc_id % 100 AS INTEGER) AS view_count,
        doc_id % 13 <> 0 AS is_active,
        {AS_OF} - to_days(CAST(doc_id % 100 AS INTEGER)) AS created_at
      FROM documents""",
    "wallet_transactions": """SELECT event_id AS id, user_id, CAST(value AS DECIMAL(10,2)) AS amount,
        CASE event_type WHEN 'signup' THEN 'deposit' WHEN 'click' THEN 'refund'
             WHEN 'purchase' THEN 'booking_charge' WHEN 'error' THEN 'withdrawal'
             WHEN 'view' THEN 'transfer' END AS type,
        CASE WHEN event_id % 10 = 0 THEN 'pending' WHEN event_id % 10 = 1 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN event_type IN ('purchase', 'click', 'view') THEN (event_id * 7 % (SELECT no FROM _n)) * 10 + 1 END AS reference_id,
        CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'booking' END AS reference_type,
        CASE WHEN event_type = 'signup' THEN 'manual' ELSE 'wallet' END AS payment_method,
        CASE event_type WHEN 'signup' THEN 'deposit' WHEN 'click' THEN 'refund'
             WHEN 'purchase' THEN 'booking_charge' WHEN 'error' THEN 'withdrawal'
             WHEN 'view' THEN 'transfer' END || ' ' || CAST(event_id AS VARCHAR) AS description,
        props AS metadata,
        ts AS created_at,
        CASE WHEN event_id % 10 NOT IN (0, 1) THEN ts + INTERVAL 1 MINUTE END AS completed_at
      FROM events""",
    "audit_logs": f"""SELECT event_id AS id, event_id % (SELECT nn FROM _n) + {ADMIN_USER_OFFSET} AS admin_id,
        CASE event_type WHEN 'signup' THEN 'activate_user' WHEN 'error' THEN 'deactivate_user'
             WHEN 'click' THEN 'update_center' WHEN 'purchase' THEN 'delete_session' ELSE 'update_settings' END AS action,
        CASE WHEN event_type IN ('signup', 'error') THEN 'user' WHEN event_type = 'click' THEN 'center'
             WHEN event_type = 'purchase' THEN 'session' ELSE 'settings' END AS entity_type,
        user_id AS entity_id,
        props AS details,
        '10.0.' || CAST(event_id % 256 AS VARCHAR) || '.' || CAST(event_id % 100 AS VARCHAR) AS ip_address,
        ts AS created_at
      FROM events WHERE event_id % 4 = 0""",
}




# ---------------------------------------------------------------- request tables (FIXTURES.md, part C)
_AT = AS_OF
FIXTURE_CTES.update({
    "booking_requests": f"""
        SELECT o_orderkey * 4 AS request_id, o_orderkey AS session_id,
               (o_custkey * 17 + o_orderkey) % (SELECT nc FROM _n) AS student_id,
               {_AT} - to_minutes(CAST(o_orderkey % 50 AS INTEGER)) AS requested_at FROM orders
        UNION ALL
        SELECT o_orderkey * 4 + 1, o_orderkey, (o_custkey * 17 + o_orderkey) % (SELECT nc FROM _n),
               {_AT} - to_minutes(CAST(o_orderkey % 50 AS INTEGER)) + INTERVAL 1 MINUTE FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL
        SELECT o_orderkey * 4 + 2, o_orderkey + 1000000000000, (o_custkey * 17 + o_orderkey) % (SELECT nc FROM _n),
               {_AT} - to_minutes(CAST(o_orderkey % 50 AS INTEGER)) FROM orders WHERE o_orderkey % 11 = 0
        UNION ALL
        SELECT o_orderkey * 4 + 3, o_orderkey, (o_custkey * 31 + 7) % (SELECT nc FROM _n),
               {_AT} - to_minutes(CAST(o_orderkey % 50 AS INTEGER)) - INTERVAL 1 MINUTE FROM orders WHERE o_orderkey % 5 = 0""",
    "cancel_requests": f"""
        SELECT id * 4 AS request_id, id AS booking_id,
               CASE WHEN id % 13 = 0 THEN (student_id + 1) % (SELECT nc FROM _n) ELSE student_id END AS student_id,
               {_AT} - to_minutes(CAST(id % 30 AS INTEGER)) AS requested_at FROM bookings
        UNION ALL
        SELECT id * 4 + 1, id, student_id, {_AT} - to_minutes(CAST(id % 30 AS INTEGER)) + INTERVAL 1 MINUTE
        FROM bookings WHERE id % 17 = 0
        UNION ALL
        SELECT id * 4 + 2, id + 1000000000000, student_id, {_AT} - to_minutes(CAST(id % 30 AS INTEGER))
        FROM bookings WHERE id % 19 = 0""",
    "session_cancel_requests": f"""
        SELECT id * 4 AS request_id, id AS session_id,
               CASE WHEN id % 9 = 0 THEN (center_id + 1) % (SELECT ns FROM _n) ELSE center_id END AS center_id,
               {_AT} - to_minutes(CAST(id % 40 AS INTEGER)) AS requested_at FROM sessions
        UNION ALL
        SELECT id * 4 + 1, id, CASE WHEN id % 9 = 0 THEN (center_id + 1) % (SELECT ns FROM _n) ELSE center_id END,
               {_AT} - to_minutes(CAST(id % 40 AS INTEGER)) + INTERVAL 1 MINUTE FROM sessions WHERE id % 10 = 0
        UNION ALL
        SELECT id * 4 + 2, id + 1000000000000, center_id, {_AT} - to_minutes(CAST(id % 40 AS INTEGER))
        FROM sessions WHERE id % 23 = 0""",
    "_scan_base": """
        SELECT b.id, CASE WHEN b.id % 9 = 0 THEN replace(b.qr_code, '_', '-') ELSE b.qr_code END AS qr_code,
               CASE WHEN b.id % 23 = 0 THEN (s.center_id + 1) % (SELECT ns FROM _n) ELSE s.center_id END AS center_id,
               CASE WHEN b.id % 7 = 0 THEN s.scheduled_at - INTERVAL 30 MINUTE
                    WHEN b.id % 11 = 0 THEN s.scheduled_at + to_minutes(s.duration_min + 5)
                    WHEN b.id % 29 = 0 THEN s.scheduled_at - INTERVAL 15 MINUTE
                    WHEN b.id % 31 = 0 THEN s.scheduled_at + to_minutes(s.duration_min)
                    ELSE s.scheduled_at + to_minutes(CAST(b.id % 20 - 10 AS INTEGER)) END AS scanned_at
        FROM bookings b JOIN sessions s ON b.session_id = s.id""",
    "scan_requests": """
        SELECT id * 2 AS scan_id, qr_code, center_id, scanned_at FROM _scan_base
        UNION ALL
        SELECT id * 2 + 1, qr_code, center_id, scanned_at + INTERVAL 1 MINUTE FROM _scan_base WHERE id % 13 = 0""",
    "walkin_requests": """
        SELECT id * 2 AS request_id,
               CASE WHEN id % 43 = 0 THEN (SELECT nc FROM _n) + id ELSE (teacher_id * 3 + id) % (SELECT nc FROM _n) END
                   AS student_id,
               CASE WHEN id % 37 = 0 THEN id + 1000000000000 ELSE id END AS session_id,
               CASE WHEN id % 41 = 0 THEN (center_id + 1) % (SELECT ns FROM _n) ELSE center_id END AS center_id,
               CAST(id % 4 * 25 AS DECIMAL(10,2)) AS amount_paid,
               scheduled_at + to_minutes(CAST((id % 9 - 4) * 10 AS INTEGER)) AS requested_at
        FROM sessions
        UNION ALL
        SELECT id * 2 + 1, (teacher_id * 3 + id) % (SELECT nc FROM _n), id, center_id,
               CAST(id % 4 * 25 AS DECIMAL(10,2)), scheduled_at + to_minutes(CAST((id % 9 - 4) * 10 AS INTEGER))
                   + INTERVAL 1 MINUTE
        FROM sessions WHERE id % 6 = 0""",
    "session_candidates": """
        WITH base AS (
        SELECT s.id AS candidate_id, CASE WHEN s.id % 2 = 0 THEN s.id END AS session_id, s.center_id, s.teacher_id,
               CASE WHEN s.id % 3 = 0 THEN s.subject ELSE t.subjects[CAST(s.id % 2 + 1 AS INTEGER)] END AS subject,
               s.grade_level,
               CASE WHEN s.id % 10 = 5 THEN s.scheduled_at + to_minutes(s.duration_min)
                    ELSE s.scheduled_at + to_minutes(CAST((s.id % 7 - 3) * 10 AS INTEGER)) END AS scheduled_at,
               s.duration_min, CASE WHEN s.id % 41 <> 0 THEN s.capacity END AS capacity,
               CASE WHEN s.id % 43 <> 0 THEN s.price END AS price
        FROM sessions s LEFT JOIN teachers t ON s.teacher_id = t.id)
        SELECT * FROM base
        UNION ALL
        SELECT candidate_id + 100000000000000, NULL, center_id, teacher_id, subject, grade_level,
               scheduled_at + to_minutes(CAST(candidate_id % 5 * 15 AS INTEGER)), duration_min, capacity, price
        FROM base WHERE candidate_id % 3 = 1""",
})


def with_fixtures(body: str) -> str:
    """``WITH <all domain tables>[, <body's own CTEs>] <body>``; DuckDB only evaluates the CTEs
    the body uses. A body that starts with ``WITH`` has its CTEs appended after the fixtures."""
    ctes = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in FIXTURE_CTES.items())
    b = body.lstrip()
    if b[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{b[15:]}"
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"


FIXTURE_CTES.update({
    "join_requests": f"""
        SELECT rm.id * 4 AS request_id, rm.student_id, r.access_code,
               {_AT} - to_minutes(CAST(rm.id % 30 AS INTEGER)) AS requested_at
        FROM room_members rm JOIN rooms r ON rm.room_id = r.id
        UNION ALL
        SELECT id * 4 + 1, (id * 7 + 3) % (SELECT nc FROM _n), access_code,
               {_AT} - to_minutes(CAST(id % 45 AS INTEGER)) FROM rooms
        UNION ALL
        SELECT id * 4 + 2, (id * 7 + 3) % (SELECT nc FROM _n), 'X' || access_code,
               {_AT} - to_minutes(CAST(id % 45 AS INTEGER)) FROM rooms WHERE id % 11 = 0
        UNION ALL
        SELECT id * 4 + 3, (id * 7 + 3) % (SELECT nc FROM _n), access_code,
               {_AT} - to_minutes(CAST(id % 45 AS INTEGER)) + INTERVAL 1 MINUTE FROM rooms WHERE id % 5 = 0""",
    "upgrade_requests": f"""
        SELECT id * 2 AS request_id, student_id, room_id,
               {_AT} - to_minutes(CAST(id % 50 AS INTEGER)) AS requested_at FROM room_members WHERE id % 2 = 0
        UNION ALL
        SELECT id * 2 + 1, (id * 11 + 5) % (SELECT nc FROM _n), id,
               {_AT} - to_minutes(CAST(id % 20 AS INTEGER)) FROM rooms""",
    "review_requests": """
        SELECT b.id AS request_id, b.student_id,
               CASE WHEN b.id % 29 = 0 THEN s.teacher_id + 1000000000000 ELSE s.teacher_id END AS teacher_id,
               CAST(b.id % 7 AS INTEGER) AS rating, s.scheduled_at + INTERVAL 2 DAY AS requested_at
        FROM bookings b JOIN sessions s ON b.session_id = s.id""",
    "deposit_requests": """
        SELECT c_custkey * 2 AS request_id, c_custkey AS user_id, CAST(c_acctbal AS DECIMAL(10,2)) AS amount,
               CASE WHEN c_custkey % 3 <> 0 THEN 'card' END AS payment_method,
               TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST(c_custkey % 60 AS INTEGER)) AS requested_at
        FROM customer
        UNION ALL
        SELECT c_custkey * 2 + 1, c_custkey, CAST(10 AS DECIMAL(10,2)), CAST(NULL AS VARCHAR),
               TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST(c_custkey % 60 AS INTEGER)) + INTERVAL 1 MINUTE
        FROM customer WHERE c_custkey % 4 = 0""",
})


FIXTURE_CTES.update({
    "room_patches": f"""
        SELECT id, CASE WHEN id % 2 = 0 THEN 'Renamed ' || CAST(id AS VARCHAR) END AS name,
               CASE WHEN id % 3 = 0 THEN FALSE END AS is_active, {_AT} AS patched_at, id AS request_id FROM rooms
        UNION ALL
        SELECT id, CAST(NULL AS VARCHAR), TRUE, {_AT} + INTERVAL 5 MINUTE, id + 1000000000 FROM rooms WHERE id % 5 = 0
        UNION ALL
        SELECT id, 'Again ' || CAST(id AS VARCHAR), FALSE, {_AT} + INTERVAL 5 MINUTE, id + 2000000000 FROM rooms
        WHERE id % 15 = 0""",
    "retire_requests": """SELECT id AS request_id,
            CASE WHEN id % 7 = 0 THEN id + 1000000000000 ELSE id END AS content_id,
            CASE WHEN id % 5 = 0 THEN teacher_id + 1 ELSE teacher_id END AS teacher_id FROM teacher_content""",
    "link_requests": """WITH o AS (SELECT id AS request_id,
            CASE WHEN id % 17 = 0 THEN id + 1000000000000 ELSE id * 3 % (SELECT ns FROM _n) END AS center_id,
            CASE WHEN id % 13 = 0 THEN id + 1000000000000 ELSE id END AS teacher_id FROM teachers)
        SELECT request_id, center_id, teacher_id FROM o UNION ALL SELECT request_id + 100000000000000, center_id, teacher_id FROM o WHERE request_id % 4 = 0""",
    "unlink_requests": """WITH o AS (SELECT id AS request_id,
            CASE WHEN id % 17 = 0 THEN id + 1000000000000 WHEN id % 2 = 0 THEN id % (SELECT ns FROM _n)
                 ELSE id * 5 % (SELECT ns FROM _n) END AS center_id,
            CASE WHEN id % 13 = 0 THEN id + 1000000000000 ELSE id END AS teacher_id FROM teachers)
        SELECT request_id, center_id, teacher_id FROM o UNION ALL SELECT request_id + 100000000000000, center_id, teacher_id FROM o WHERE request_id % 4 = 0""",
    "publish_requests": """SELECT id AS request_id, teacher_id,
            CASE WHEN id % 6 = 0 THEN (center_id + 1) % (SELECT ns FROM _n) ELSE center_id END AS center_id,
            CASE WHEN id % 11 = 0 THEN 'audio' ELSE type END AS type,
            CASE WHEN id % 13 = 0 THEN repeat('t', 300) ELSE title END AS title, url FROM teacher_content""",
    "room_candidates": """WITH o AS (SELECT id AS candidate_id, center_id,
            CASE WHEN id % 23 = 0 THEN id + 1000000000000 ELSE teacher_id END AS teacher_id,
            CASE WHEN id % 19 = 0 THEN '' WHEN id % 4 = 0 THEN name ELSE 'New ' || name END AS name,
            CASE WHEN id % 3 = 0 THEN 'Art' ELSE subject END AS subject, grade_level FROM rooms)
        SELECT candidate_id, center_id, teacher_id, name, subject, grade_level FROM o UNION ALL SELECT candidate_id + 100000000000000, center_id, teacher_id, name, subject, grade_level FROM o WHERE candidate_id % 5 = 0""",
    "attach_requests": """WITH o AS (SELECT id AS request_id,
            CASE WHEN id % 9 = 0 THEN (center_id + 1) % (SELECT ns FROM _n) ELSE center_id END AS center_id,
            CASE WHEN id % 2 = 0 THEN teacher_id WHEN teacher_id >= (SELECT ns FROM _n)
                 THEN teacher_id - (SELECT ns FROM _n) ELSE teacher_id + (SELECT ns FROM _n) END AS room_id,
            CASE WHEN id % 31 <> 0 THEN id END AS content_id,
            CASE WHEN id % 2 = 0 THEN TRUE END AS is_free,
            CASE WHEN id % 3 = 0 THEN CAST(id % 10 AS INTEGER) END AS sort_order FROM teacher_content)
        SELECT request_id, center_id, room_id, content_id, is_free, sort_order FROM o UNION ALL SELECT request_id + 100000000000000, center_id, room_id, content_id, is_free, sort_order FROM o WHERE request_id % 3 = 0""",
    "status_change_requests": """WITH o AS (SELECT id AS request_id, 3000000000 AS admin_id,
            CASE WHEN id % 29 = 0 THEN id + 1000000000000 ELSE id END AS user_id,
            CASE WHEN id % 37 <> 0 THEN NOT is_active END AS is_active,
            CASE WHEN is_active THEN 'policy' END AS reason FROM users)
        SELECT request_id, admin_id, user_id, is_active, reason FROM o
        UNION ALL SELECT request_id + 100000000000000, admin_id, user_id, NOT is_active, reason FROM o
        WHERE request_id % 8 = 0""",
})


FIXTURE_CTES.update({
    "registration_candidates": """WITH o AS (SELECT c_custkey + 5000000000 AS candidate_id, c_name AS name,
            CASE WHEN c_custkey % 7 = 0 THEN 'student.' || CAST(c_custkey AS VARCHAR) || '@mail.example'
                 ELSE 'new.' || CAST(c_custkey AS VARCHAR) || '@mail.example' END AS email,
            CASE WHEN c_custkey % 11 = 0 THEN '+20' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 13 = 0 THEN ''
                 ELSE '+49' || CAST(c_custkey AS VARCHAR) END AS phone,
            CASE WHEN c_custkey % 3 = 0 THEN 'teacher' WHEN c_custkey % 3 = 1 THEN 'center_admin' ELSE 'student' END
                AS role,
            CASE WHEN c_custkey % 2 = 0 THEN 'Centre of ' || c_name END AS center_name,
            CASE WHEN c_custkey % 4 < 2 THEN 'Main street' END AS center_address,
            CASE WHEN c_custkey % 8 < 6 THEN 22.0 + (c_custkey * 37 % 1000) / 100.0 END AS center_lat,
            CASE WHEN c_custkey % 8 < 6 THEN 25.0 + (c_custkey * 91 % 1000) / 100.0 END AS center_lng
        FROM customer)
        SELECT * FROM o UNION ALL SELECT * REPLACE (candidate_id + 100000000000000 AS candidate_id) FROM o
        WHERE candidate_id % 6 = 0""",
})


FIXTURE_CTES.update({
    "session_delete_requests": """SELECT id AS request_id, id,
            CASE WHEN id % 7 = 0 THEN (center_id + 1) % (SELECT ns FROM _n) ELSE center_id END AS owner
        FROM sessions WHERE status = 'cancelled'""",
    "room_delete_requests": "SELECT id AS request_id, id, center_id AS owner FROM rooms WHERE NOT is_active",
})


FIXTURE_CTES.update({
    "content_update_requests": f"""SELECT id AS request_id,
            CASE WHEN id % 11 = 0 THEN id + 1000000000000 ELSE id END AS content_id,
            CASE WHEN id % 7 = 0 THEN teacher_id + 1 ELSE teacher_id END AS teacher_id,
            CASE WHEN id % 3 = 0 THEN 'Updated ' || title WHEN id % 3 = 2 THEN repeat('x', 300) END AS title,
            CAST(NULL AS VARCHAR) AS description,
            CASE WHEN id % 4 = 0 THEN 'bad url' END AS url,
            {AS_OF} AS requested_at
        FROM teacher_content""",
})
