"""Oracle SQL (DuckDB) for admin and wallet reports; bodies go after ``with_fixtures``."""

from __future__ import annotations

from studyhall.constants import SESSION_AS_OF

AS_OF = f"TIMESTAMP '{SESSION_AS_OF}'"


def pct_sql(n: str, d: str) -> str:
    return (f"CASE WHEN {d} = 0 THEN NULL ELSE CAST(CAST(({n} * 2000 + {d}) // ({d} * 2) AS DECIMAL(18,0)) * 0.1 "
            f"AS DECIMAL(10,1)) END")


def avg_sql(s: str, c: str) -> str:
    return (f"CASE WHEN {c} = 0 THEN NULL ELSE CAST(CAST(({s} * 20 + {c}) // ({c} * 2) AS DECIMAL(18,0)) * 0.1 "
            f"AS DECIMAL(10,1)) END")


def signed_sql(credit=("deposit", "refund")) -> str:
    cr = ", ".join(f"'{c}'" for c in credit)
    return (f"CASE WHEN status = 'completed' AND type IN ({cr}) THEN amount "
            f"WHEN status = 'completed' AND type IN ('withdrawal', 'booking_charge') THEN -amount ELSE 0 END")


ROLE_COUNTS = """count(*) AS users_total,
    count(*) FILTER (WHERE role = 'student') AS users_student,
    count(*) FILTER (WHERE role = 'teacher') AS users_teacher,
    count(*) FILTER (WHERE role = 'center_admin') AS users_center_admin,
    count(*) FILTER (WHERE role = 'super_admin') AS users_super_admin"""

SQL = {
    "user_search": """SELECT id, name, email, phone, role, avatar_url, is_active, created_at, last_login_at
        FROM users WHERE role = 'student' AND is_active = TRUE
          AND (name ILIKE '%00001%' OR email ILIKE '%00001%' OR phone ILIKE '%00001%')
        ORDER BY created_at DESC NULLS FIRST, id LIMIT 50 OFFSET 0""",
    "user_search_count": """SELECT count(*) AS total FROM users WHERE role = 'student' AND is_active = TRUE
          AND (name ILIKE '%00001%' OR email ILIKE '%00001%' OR phone ILIKE '%00001%')""",
    "users_by_role": "SELECT role, count(*) AS users FROM users GROUP BY role",
    "center_counts": """SELECT count(*) AS total_centers, count(*) FILTER (WHERE is_active) AS active_centers
        FROM centers""",
    "session_status_counts": """SELECT count(*) AS total_sessions,
        count(*) FILTER (WHERE status = 'scheduled') AS scheduled,
        count(*) FILTER (WHERE status = 'completed') AS completed,
        count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM sessions""",
    "booking_stats": """SELECT count(*) AS total_bookings,
        count(*) FILTER (WHERE status = 'confirmed') AS confirmed,
        count(*) FILTER (WHERE status = 'attended') AS attended,
        count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
        CAST(COALESCE(SUM(amount_paid), 0) AS DECIMAL(18,2)) AS total_revenue FROM bookings""",
    "room_stats": """SELECT count(*) AS total_rooms,
        CAST(COALESCE(SUM(member_count), 0) AS BIGINT) AS total_memberships,
        CAST(COALESCE(SUM(content_count), 0) AS BIGINT) AS total_content FROM rooms""",
    "recent_activity": f"""SELECT
        (SELECT count(*) FROM users WHERE created_at >= {AS_OF} - INTERVAL 30 DAY) AS new_users,
        (SELECT count(*) FROM sessions WHERE created_at >= {AS_OF} - INTERVAL 30 DAY) AS new_sessions,
        (SELECT count(*) FROM bookings WHERE booked_at >= {AS_OF} - INTERVAL 30 DAY) AS new_bookings""",
    "platform_analytics": f"""SELECT u.*, c.*, s.*, b.*, r.*, a.* FROM
        (SELECT {ROLE_COUNTS} FROM users) u,
        (SELECT count(*) AS total_centers, count(*) FILTER (WHERE is_active) AS active_centers FROM centers) c,
        (SELECT count(*) AS total_sessions, count(*) FILTER (WHERE status = 'scheduled') AS sessions_scheduled,
                count(*) FILTER (WHERE status = 'completed') AS sessions_completed,
                count(*) FILTER (WHERE status = 'cancelled') AS sessions_cancelled FROM sessions) s,
        (SELECT count(*) AS total_bookings, count(*) FILTER (WHERE status = 'confirmed') AS bookings_confirmed,
                count(*) FILTER (WHERE status = 'attended') AS bookings_attended,
                count(*) FILTER (WHERE status = 'cancelled') AS bookings_cancelled,
                CAST(COALESCE(SUM(amount_paid), 0) AS DECIMAL(18,2)) AS total_revenue FROM bookings) b,
        (SELECT count(*) AS total_rooms, CAST(COALESCE(SUM(member_count), 0) AS BIGINT) AS total_memberships,
                CAST(COALESCE(SUM(content_count), 0) AS BIGINT) AS total_content FROM rooms) r,
        (SELECT (SELECT count(*) FROM users WHERE created_at >= {AS_OF} - INTERVAL 30 DAY) AS new_users,
                (SELECT count(*) FROM sessions WHERE created_at >= {AS_OF} - INTERVAL 30 DAY) AS new_sessions,
                (SELECT count(*) FROM bookings WHERE booked_at >= {AS_OF} - INTERVAL 30 DAY) AS new_bookings) a""",
    "audit_log_search": """SELECT al.id, al.action, al.entity_type, al.entity_id, al.details, al.created_at,
            u.name AS admin_name, u.email AS admin_email
        FROM audit_logs al JOIN users u ON u.id = al.admin_id
        WHERE al.action = 'deactivate_user'
        ORDER BY al.created_at DESC NULLS FIRST, al.id LIMIT 50 OFFSET 0""",
    "user_details": """SELECT u.id, u.name, u.email, u.phone, u.role, u.avatar_url, u.is_active, u.created_at,
            u.last_login_at, u.lat, u.lng,
            t.id AS teacher_id, t.bio AS teacher_bio, array_to_string(t.subjects, ', ') AS teacher_subjects,
            array_to_string(t.grade_levels, ', ') AS teacher_grade_levels, t.rating AS teacher_rating,
            t.total_reviews AS teacher_total_reviews,
            c.id AS center_id, c.name AS center_name, c.address AS center_address, c.is_active AS center_is_active,
            CASE WHEN u.role = 'student' THEN COALESCE(b.total_bookings, 0) END AS total_bookings,
            CASE WHEN u.role = 'student' THEN COALESCE(b.attended, 0) END AS attended_bookings
        FROM users u
        LEFT JOIN teachers t ON t.user_id = u.id AND u.role = 'teacher'
        LEFT JOIN centers c ON c.owner_id = u.id AND u.role = 'center_admin'
        LEFT JOIN (SELECT student_id, count(*) AS total_bookings,
                          count(*) FILTER (WHERE status = 'attended') AS attended
                   FROM bookings GROUP BY student_id) b ON b.student_id = u.id AND u.role = 'student'""",
    "student_attendance_stats": f"""SELECT u.id AS student_id,
            COALESCE(b.n_total, 0) AS total_bookings, COALESCE(b.n_attended, 0) AS attended_sessions,
            COALESCE(b.n_pending, 0) AS pending_bookings, COALESCE(b.n_confirmed, 0) AS confirmed_bookings,
            COALESCE(b.n_cancelled, 0) AS cancelled_bookings,
            COALESCE({pct_sql('COALESCE(b.n_attended, 0)', 'COALESCE(b.n_total, 0)')}, CAST(0 AS DECIMAL(10,1)))
                AS attendance_rate
        FROM users u LEFT JOIN (
            SELECT student_id, count(*) AS n_total,
                   count(*) FILTER (WHERE status = 'attended') AS n_attended,
                   count(*) FILTER (WHERE status = 'pending') AS n_pending,
                   count(*) FILTER (WHERE status = 'confirmed') AS n_confirmed,
                   count(*) FILTER (WHERE status = 'cancelled') AS n_cancelled
            FROM bookings GROUP BY student_id) b ON b.student_id = u.id
        WHERE u.role = 'student'""",
    "center_profile": """SELECT c.id, c.name, c.address, c.description, c.phone, u.avatar_url, c.lng, c.lat,
            c.created_at
        FROM centers c JOIN users u ON c.owner_id = u.id""",
    "user_profile": """SELECT id, name, email, phone, role, avatar_url, is_active, created_at,
            CASE WHEN lat IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lng END AS lng
        FROM users""",
    "user_profile_with_balance": f"""SELECT p.*, CAST(COALESCE(b.balance, 0) AS DECIMAL(18,2)) AS balance
        FROM (SELECT id, name, email, phone, role, avatar_url, is_active, created_at,
                     CASE WHEN lat IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lng END AS lng
              FROM users) p
        LEFT JOIN (SELECT user_id, CAST(COALESCE(SUM({signed_sql()}), 0) AS DECIMAL(18,2)) AS balance
                   FROM wallet_transactions GROUP BY user_id) b ON b.user_id = p.id""",
    "platform_summary": f"""SELECT
        (SELECT count(*) FROM users) AS total_users,
        (SELECT count(*) FROM centers) AS total_centers,
        (SELECT count(*) FROM teachers) AS total_teachers,
        (SELECT count(*) FROM sessions) AS total_sessions,
        (SELECT count(*) FROM bookings) AS total_bookings,
        (SELECT CAST(COALESCE(SUM(amount_paid) FILTER (WHERE status IN ('confirmed', 'attended')), 0)
                AS DECIMAL(18,2)) FROM bookings) AS total_revenue,
        (SELECT count(*) FILTER (WHERE last_login_at >= date_trunc('day', {AS_OF})
                AND last_login_at <= {AS_OF}) FROM users) AS active_today""",
    # ---------------------------------------------------------------- wallet
    "wallet_balance": f"""SELECT u.id AS user_id, CAST(COALESCE(b.balance, 0) AS DECIMAL(18,2)) AS balance
        FROM users u LEFT JOIN (SELECT user_id, SUM({signed_sql()}) AS balance FROM wallet_transactions
                                GROUP BY user_id) b ON b.user_id = u.id""",
    "wallet_balance_display": f"""SELECT user_id,
            CAST(COALESCE(SUM({signed_sql(('deposit', 'refund', 'transfer'))}), 0) AS DECIMAL(18,2)) AS balance
        FROM wallet_transactions GROUP BY user_id""",
    "wallet_statement": f"""SELECT id, user_id, type, status, amount, created_at,
            CAST({signed_sql()} AS DECIMAL(18,2)) AS signed_amount,
            CAST(SUM({signed_sql()}) OVER (PARTITION BY user_id ORDER BY created_at, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance_after
        FROM wallet_transactions""",
    "wallet_history": """SELECT * FROM (
            SELECT id, user_id, amount, type, status, reference_id, reference_type, description, created_at,
                   completed_at,
                   row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id) AS position
            FROM wallet_transactions) WHERE position > 0 AND position <= 50""",
    "wallet_history_count": "SELECT user_id, count(*) AS total FROM wallet_transactions GROUP BY user_id",
    "wallet_by_month": """SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS month, type, count(*) AS transactions,
            CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
        FROM wallet_transactions GROUP BY 1, 2""",
}


SQL["platform_analytics_json"] = f"""SELECT CAST(to_json({{
        'users': {{'by_role': {{'student': users_student, 'teacher': users_teacher,
                               'center_admin': users_center_admin, 'super_admin': users_super_admin}},
                   'total': users_total}},
        'centers': {{'total': total_centers, 'active': active_centers}},
        'sessions': {{'total': total_sessions, 'scheduled': sessions_scheduled, 'completed': sessions_completed,
                      'cancelled': sessions_cancelled}},
        'bookings': {{'total': total_bookings, 'confirmed': bookings_confirmed, 'attended': bookings_attended,
                      'cancelled': bookings_cancelled, 'total_revenue': total_revenue}},
        'rooms': {{'total': total_rooms, 'total_memberships': total_memberships, 'total_content': total_content}},
        'recent_30_days': {{'new_users': new_users, 'new_sessions': new_sessions, 'new_bookings': new_bookings}}
    }}) AS VARCHAR) AS document
    FROM ({SQL["platform_analytics"]}) flat"""

SQL["wallet_balance_function"] = f"""SELECT user_id, CAST(COALESCE(SUM({signed_sql()}), 0) AS DECIMAL(20,2)) AS balance
    FROM wallet_transactions GROUP BY user_id"""


SQL["payload_summary"] = """WITH p AS (
        SELECT 'wallet_transactions' AS source,
               CASE WHEN id % 97 = 0 THEN left(metadata, length(metadata) - 1) ELSE metadata END AS payload FROM wallet_transactions
        UNION ALL SELECT 'audit_logs', details FROM audit_logs),
      v AS (SELECT source, payload, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p),
      k AS (SELECT *, CASE WHEN json_type(j, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(j, '$.k') AS BIGINT) END AS value
            FROM v)
    SELECT source, count(*) AS n_rows, count(*) - count(payload) AS missing, count(payload) - count(j) AS malformed,
           CASE WHEN count(j) > 0 THEN 'OBJECT<k: BIGINT>' ELSE 'VOID' END AS payload_schema, count(value) AS n_values,
           CAST(sum(value) AS BIGINT) AS sum_value, min(value) AS min_value, max(value) AS max_value
    FROM k GROUP BY source"""
