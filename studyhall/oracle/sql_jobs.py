"""Oracle SQL (DuckDB) for the batch jobs, with plain window functions for the in-batch rules."""

from __future__ import annotations

from studyhall.constants import SESSION_AS_OF
from studyhall.jobs import rules
from studyhall.oracle.sql_admin import signed_sql

AS_OF = f"TIMESTAMP '{SESSION_AS_OF}'"

SEATS = ("(SELECT session_id, count(*) AS seats_taken FROM bookings WHERE status <> 'cancelled' "
         "GROUP BY session_id)")
BOOKED = "(SELECT DISTINCT session_id, student_id, TRUE AS e FROM bookings)"

PAIRS = """SELECT c.candidate_id, s.id AS session_id, s.scheduled_at AS session_start, 'TEACHER_BUSY' AS kind
    FROM session_candidates c JOIN sessions s ON s.teacher_id = c.teacher_id
     AND s.scheduled_at < c.scheduled_at + to_minutes(c.duration_min)
     AND c.scheduled_at < s.scheduled_at + to_minutes(s.duration_min)
    WHERE c.session_id IS NULL OR c.session_id <> s.id
    UNION ALL
    SELECT c.candidate_id, s.id, s.scheduled_at, 'GRADE_OVERLAP'
    FROM session_candidates c JOIN sessions s ON s.center_id = c.center_id AND s.grade_level = c.grade_level
     AND s.scheduled_at < c.scheduled_at + to_minutes(c.duration_min)
     AND c.scheduled_at < s.scheduled_at + to_minutes(s.duration_min)
    WHERE c.session_id IS NULL OR c.session_id <> s.id"""

CONFLICT_CTES = f"""p AS ({PAIRS}),
    f AS (SELECT candidate_id, kind, session_id FROM (
            SELECT *, row_number() OVER (PARTITION BY candidate_id, kind ORDER BY session_start, session_id) AS rn
            FROM p) WHERE rn = 1)"""

CONFLICT_SELECT = """SELECT c.candidate_id,
           CASE WHEN b.session_id IS NOT NULL THEN 'TEACHER_BUSY' WHEN g.session_id IS NOT NULL THEN 'GRADE_OVERLAP'
                ELSE 'OK' END AS decision,
           COALESCE(b.session_id, g.session_id) AS conflict_session_id
    FROM session_candidates c
    LEFT JOIN f b ON b.candidate_id = c.candidate_id AND b.kind = 'TEACHER_BUSY'
    LEFT JOIN f g ON g.candidate_id = c.candidate_id AND g.kind = 'GRADE_OVERLAP'"""

CONFLICTS = f"WITH {CONFLICT_CTES}\n{CONFLICT_SELECT}"


def _validate_sessions_sql(options: str = "") -> str:
    """Candidates one after the other: those that passed all checks so far are refused if an accepted one before them is in
    the way, which is whoever of their earlier clashes is not on the list of the refused."""
    return f"""WITH RECURSIVE {CONFLICT_CTES}, k AS ({CONFLICT_SELECT}),
      d AS MATERIALIZED (SELECT c.*,
               CASE WHEN COALESCE(c.subject, '') = '' OR COALESCE(c.grade_level, '') = '' OR c.scheduled_at IS NULL
                         OR COALESCE(c.duration_min, 0) <= 0 OR COALESCE(c.capacity, 0) <= 0 OR COALESCE(c.price, 0) <= 0
                        THEN 'MISSING_FIELDS'
                    WHEN ce.id IS NULL THEN 'CENTER_NOT_FOUND'
                    WHEN t.id IS NULL THEN 'TEACHER_NOT_FOUND'
                    WHEN NOT list_contains(t.grade_levels, c.grade_level) THEN 'GRADE_NOT_TAUGHT'
                    WHEN NOT list_contains(t.subjects, c.subject) THEN 'SUBJECT_NOT_TAUGHT'
                    {options}
                    ELSE k.decision END AS decision, k.conflict_session_id
            FROM session_candidates c LEFT JOIN teachers t ON t.id = c.teacher_id
            LEFT JOIN centers ce ON ce.id = c.center_id
            LEFT JOIN (SELECT * FROM center_teachers WHERE is_active) l
                 ON l.center_id = c.center_id AND l.teacher_id = c.teacher_id
            LEFT JOIN k ON k.candidate_id = c.candidate_id),
      live AS MATERIALIZED (SELECT *, scheduled_at + to_minutes(duration_min) AS ends_at FROM d WHERE decision = 'OK'),
      pr AS MATERIALIZED (
        SELECT y.candidate_id AS j, x.candidate_id AS i, x.scheduled_at, 'TEACHER_BUSY' AS kind FROM live x
        JOIN live y ON x.teacher_id = y.teacher_id AND x.candidate_id < y.candidate_id
         AND x.scheduled_at < y.ends_at AND y.scheduled_at < x.ends_at AND NOT COALESCE(x.session_id = y.session_id, FALSE)
        UNION ALL
        SELECT y.candidate_id, x.candidate_id, x.scheduled_at, 'GRADE_OVERLAP' FROM live x
        JOIN live y ON x.center_id = y.center_id AND x.grade_level = y.grade_level AND x.candidate_id < y.candidate_id
         AND x.scheduled_at < y.ends_at AND y.scheduled_at < x.ends_at AND NOT COALESCE(x.session_id = y.session_id, FALSE)),
      turn AS MATERIALIZED (SELECT j, list(i) AS before, row_number() OVER (ORDER BY j) AS rn FROM pr GROUP BY j),
      one_by_one AS (
        SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS refused
        UNION ALL
        SELECT q.rn, CASE WHEN len(list_filter(q.before, lambda x: NOT list_contains(o.refused, x))) > 0
                          THEN list_append(o.refused, q.j) ELSE o.refused END
        FROM one_by_one o JOIN turn q ON q.rn = o.rn + 1),
      refused AS (SELECT unnest(refused) AS j FROM (SELECT refused FROM one_by_one ORDER BY rn DESC LIMIT 1)),
      why AS (SELECT pr.j, pr.kind, pr.i FROM pr JOIN refused r ON r.j = pr.j
              WHERE pr.i NOT IN (SELECT j FROM refused)
              QUALIFY row_number() OVER (PARTITION BY pr.j ORDER BY pr.kind DESC, pr.scheduled_at, pr.i) = 1)
    SELECT d.candidate_id, COALESCE(w.kind, d.decision) AS decision,
           CASE WHEN d.decision IN ('TEACHER_BUSY', 'GRADE_OVERLAP') THEN conflict_session_id END AS conflict_session_id,
           w.i AS conflict_candidate_id
    FROM d LEFT JOIN why w ON w.j = d.candidate_id"""

SQL = {
    # One request after the other: each step sees the list of the bookings granted so far.
    "admit_bookings": f"""WITH RECURSIVE r AS (
        SELECT q.request_id, q.session_id, q.student_id, q.requested_at, s.price,
               s.capacity - COALESCE(st.seats_taken, 0) AS seats_left, COALESCE(bal.balance, 0) AS balance,
               CASE WHEN s.id IS NULL THEN 'NOT_FOUND' WHEN s.status <> 'scheduled' THEN 'NOT_AVAILABLE'
                    WHEN COALESCE(st.seats_taken, 0) >= s.capacity THEN 'SESSION_FULL'
                    WHEN s.scheduled_at <= {AS_OF} THEN 'ALREADY_STARTED' ELSE 'OK' END AS static,
               ex.e IS NOT NULL AS booked
        FROM booking_requests q LEFT JOIN sessions s ON s.id = q.session_id
        LEFT JOIN {SEATS} st ON st.session_id = q.session_id
        LEFT JOIN {BOOKED} ex ON ex.session_id = q.session_id AND ex.student_id = q.student_id
        LEFT JOIN (SELECT user_id, SUM({signed_sql()}) AS balance FROM wallet_transactions GROUP BY user_id) bal
               ON bal.user_id = q.student_id),
      live AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY requested_at, request_id) AS i FROM r WHERE static = 'OK'),
      one_by_one AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s BIGINT, u BIGINT, p DECIMAL(18,2))[]) AS granted,
               CAST('' AS VARCHAR) AS decision
        UNION ALL
        SELECT i, CASE WHEN d = 'OK' THEN list_append(granted, {{'s': session_id, 'u': student_id,
                                                                'p': CAST(price AS DECIMAL(18,2))}}) ELSE granted END, d
        FROM (SELECT l.i, l.session_id, l.student_id, l.price, o.granted,
                     CASE WHEN len(list_filter(o.granted, lambda x: x.s = l.session_id)) >= l.seats_left THEN 'SESSION_FULL'
                          WHEN l.booked OR len(list_filter(o.granted, lambda x: x.s = l.session_id AND x.u = l.student_id)) > 0
                               THEN 'ALREADY_BOOKED'
                          WHEN l.balance - COALESCE(list_sum(list_transform(list_filter(o.granted,
                               lambda x: x.u = l.student_id), lambda x: x.p)), 0) < l.price THEN 'INSUFFICIENT_BALANCE'
                          ELSE 'OK' END AS d
              FROM one_by_one o JOIN live l ON l.i = o.i + 1))
    SELECT request_id, session_id, student_id, price, static AS decision FROM r WHERE static <> 'OK'
    UNION ALL
    SELECT l.request_id, l.session_id, l.student_id, l.price, o.decision FROM live l JOIN one_by_one o ON o.i = l.i""",
    "cancel_bookings": f"""WITH r AS (
        SELECT q.request_id, q.booking_id, q.student_id, q.requested_at,
               CASE WHEN bs.id IS NULL THEN 'NOT_FOUND' WHEN bs.owner <> q.student_id THEN 'FORBIDDEN'
                    WHEN bs.status NOT IN ('pending', 'confirmed') THEN 'NOT_CANCELLABLE'
                    WHEN bs.scheduled_at <= {AS_OF} THEN 'ALREADY_STARTED' ELSE 'OK' END AS static
        FROM cancel_requests q LEFT JOIN (SELECT b.id, b.student_id AS owner, b.status, s.scheduled_at
                                          FROM bookings b JOIN sessions s ON s.id = b.session_id) bs
             ON bs.id = q.booking_id),
      d AS (SELECT request_id, booking_id, student_id, static AS decision FROM r WHERE static <> 'OK'
            UNION ALL
            SELECT request_id, booking_id, student_id,
                   CASE WHEN row_number() OVER (PARTITION BY booking_id ORDER BY requested_at, request_id) = 1
                        THEN 'OK' ELSE 'NOT_CANCELLABLE' END FROM r WHERE static = 'OK')
    SELECT d.request_id, d.booking_id, d.student_id, d.decision,
           CASE WHEN d.decision = 'OK' THEN CAST(b.amount_paid AS DECIMAL(18,2)) END AS refund
    FROM d LEFT JOIN bookings b ON b.id = d.booking_id""",
    "cancel_sessions": """WITH r AS (
        SELECT q.request_id, q.session_id, q.center_id, q.requested_at,
               CASE WHEN s.id IS NULL THEN 'NOT_FOUND' WHEN s.status <> 'scheduled' THEN 'NOT_SCHEDULED'
                    ELSE 'OK' END AS static
        FROM session_cancel_requests q LEFT JOIN sessions s ON s.id = q.session_id AND s.center_id = q.center_id),
      d AS (SELECT request_id, session_id, center_id, static AS decision FROM r WHERE static <> 'OK'
            UNION ALL
            SELECT request_id, session_id, center_id,
                   CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY requested_at, request_id) = 1
                        THEN 'OK' ELSE 'NOT_SCHEDULED' END FROM r WHERE static = 'OK'),
      h AS (SELECT session_id, count(*) AS n_held, count(*) FILTER (WHERE amount_paid > 0) AS n_refund,
                   SUM(amount_paid) FILTER (WHERE amount_paid > 0) AS refund_sum
            FROM bookings WHERE status IN ('pending', 'confirmed') GROUP BY session_id)
    SELECT d.request_id, d.session_id, d.center_id, d.decision,
           CASE WHEN d.decision = 'OK' THEN COALESCE(h.n_held, 0) END AS bookings_cancelled,
           CASE WHEN d.decision = 'OK' THEN COALESCE(h.n_refund, 0) END AS refunds_processed,
           CASE WHEN d.decision = 'OK' THEN CAST(COALESCE(h.refund_sum, 0) AS DECIMAL(18,2)) END AS refund_total
    FROM d LEFT JOIN h ON h.session_id = d.session_id""",
    "validate_scans": """WITH sc AS (
        SELECT *, len(string_split(qr_code, '_')) = 3 AS fmt,
               CASE WHEN len(string_split(qr_code, '_')) = 3 THEN TRY_CAST(string_split(qr_code, '_')[2] AS BIGINT) END
                   AS sid
        FROM scan_requests),
      bk AS (SELECT b.id AS booking_id, b.qr_code AS b_qr, b.student_id, b.status AS b_status, s.center_id AS b_cid,
                    s.scheduled_at, s.duration_min
             FROM bookings b JOIN sessions s ON s.id = b.session_id WHERE b.student_id IN (SELECT id FROM users)),
      j AS (SELECT sc.scan_id, sc.qr_code, sc.center_id, sc.scanned_at, bk.booking_id, bk.student_id, bk.scheduled_at,
               CASE WHEN sc.qr_code IS NULL OR sc.qr_code = '' THEN 'QR_REQUIRED' WHEN NOT sc.fmt THEN 'BAD_FORMAT'
                    WHEN s.id IS NULL THEN 'SESSION_NOT_FOUND' WHEN s.center_id <> sc.center_id THEN 'FORBIDDEN'
                    WHEN bk.booking_id IS NULL THEN 'BOOKING_NOT_FOUND' WHEN bk.b_cid <> sc.center_id THEN 'FORBIDDEN'
                    WHEN bk.b_status = 'attended' THEN 'ALREADY_ATTENDED'
                    WHEN bk.b_status <> 'confirmed' THEN 'INVALID_STATUS'
                    WHEN sc.scanned_at < bk.scheduled_at - INTERVAL 15 MINUTE THEN 'TOO_EARLY'
                    WHEN sc.scanned_at > bk.scheduled_at + to_minutes(bk.duration_min) THEN 'OUTSIDE_TIME_WINDOW'
                    ELSE 'OK' END AS decision
            FROM sc LEFT JOIN sessions s ON s.id = sc.sid LEFT JOIN bk ON bk.b_qr = sc.qr_code)
    SELECT scan_id, qr_code, center_id, scanned_at, booking_id, student_id, scheduled_at, decision
    FROM j WHERE decision <> 'OK'
    UNION ALL
    SELECT scan_id, qr_code, center_id, scanned_at, booking_id, student_id, scheduled_at,
           CASE WHEN row_number() OVER (PARTITION BY booking_id ORDER BY scanned_at, scan_id) = 1 THEN 'OK'
                ELSE 'ALREADY_ATTENDED' END
    FROM j WHERE decision = 'OK'""",
    "walk_in_attendance": f"""WITH r AS (
        SELECT q.request_id, q.student_id, q.session_id, q.center_id, q.amount_paid, q.requested_at, s.capacity,
               COALESCE(st.seats_taken, 0) AS seats,
               CASE WHEN q.student_id IS NULL OR q.session_id IS NULL THEN 'MISSING_FIELDS'
                    WHEN s.id IS NULL THEN 'SESSION_NOT_FOUND' WHEN s.center_id <> q.center_id THEN 'FORBIDDEN'
                    WHEN q.requested_at < s.scheduled_at - INTERVAL 15 MINUTE THEN 'TOO_EARLY'
                    WHEN q.requested_at > s.scheduled_at + to_minutes(s.duration_min) THEN 'OUTSIDE_TIME_WINDOW'
                    WHEN u.id IS NULL THEN 'STUDENT_NOT_FOUND' WHEN ex.e IS NOT NULL THEN 'ALREADY_BOOKED'
                    WHEN s.status <> 'scheduled' OR COALESCE(st.seats_taken, 0) >= s.capacity
                        THEN 'FULL_OR_UNAVAILABLE'
                    ELSE 'OK' END AS decision
        FROM walkin_requests q LEFT JOIN sessions s ON s.id = q.session_id
        LEFT JOIN users u ON u.id = q.student_id
        LEFT JOIN {BOOKED} ex ON ex.session_id = q.session_id AND ex.student_id = q.student_id
        LEFT JOIN {SEATS} st ON st.session_id = q.session_id),
      live AS (SELECT *, row_number() OVER (PARTITION BY session_id, student_id ORDER BY requested_at, request_id)
                   AS rn FROM r WHERE decision = 'OK'),
      comp AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY requested_at, request_id) AS seat_rank
               FROM live WHERE rn = 1)
    SELECT request_id, student_id, session_id, center_id, amount_paid, requested_at, decision FROM r
    WHERE decision <> 'OK'
    UNION ALL SELECT request_id, student_id, session_id, center_id, amount_paid, requested_at,
        CASE WHEN seat_rank <= capacity - seats THEN 'OK' ELSE 'FULL_OR_UNAVAILABLE' END FROM comp
    -- a repeat finds the first one booked, or the session still full
    UNION ALL SELECT l.request_id, l.student_id, l.session_id, l.center_id, l.amount_paid, l.requested_at,
        CASE WHEN c.seat_rank <= c.capacity - c.seats THEN 'ALREADY_BOOKED' ELSE 'FULL_OR_UNAVAILABLE' END
    FROM live l JOIN comp c ON c.session_id = l.session_id AND c.student_id = l.student_id WHERE l.rn > 1""",
    "session_overlap_pairs": PAIRS,
    "session_conflicts": CONFLICTS,
    "validate_sessions": _validate_sessions_sql(),
    "validate_sessions_strict": _validate_sessions_sql(f"""WHEN l.center_id IS NULL THEN 'NOT_LINKED'
                    WHEN c.scheduled_at <= {AS_OF} THEN 'IN_THE_PAST'"""),
}


BALANCES = f"(SELECT user_id, SUM({signed_sql()}) AS balance FROM wallet_transactions GROUP BY user_id)"

SQL.update({
    "join_rooms": """WITH j AS (
        SELECT q.request_id, q.student_id, q.requested_at, r.id AS room_id, m.room_id AS m_room, m.access_tier,
               CASE WHEN q.access_code IS NULL OR q.access_code = '' THEN 'CODE_REQUIRED'
                    WHEN r.id IS NULL THEN 'INVALID_CODE' WHEN NOT r.is_active THEN 'ROOM_INACTIVE'
                    WHEN m.is_active THEN 'ALREADY_MEMBER' ELSE 'OK' END AS decision
        FROM join_requests q LEFT JOIN rooms r ON r.access_code = q.access_code
        LEFT JOIN room_members m ON m.room_id = r.id AND m.student_id = q.student_id),
      d AS (SELECT request_id, student_id, room_id, m_room, access_tier, decision FROM j WHERE decision <> 'OK'
            UNION ALL
            SELECT request_id, student_id, room_id, m_room, access_tier,
                   CASE WHEN row_number() OVER (PARTITION BY room_id, student_id ORDER BY requested_at, request_id) = 1
                        THEN 'OK' ELSE 'ALREADY_MEMBER' END FROM j WHERE decision = 'OK')
    SELECT request_id, student_id, room_id,
           CASE WHEN decision = 'OK' AND m_room IS NOT NULL THEN 'REJOINED' WHEN decision = 'OK' THEN 'JOINED'
                ELSE decision END AS decision,
           CASE WHEN decision = 'OK' AND m_room IS NOT NULL THEN access_tier WHEN decision = 'OK' THEN 'free' END
               AS access_tier
    FROM d""",
    # Upgrades compete for their student's money only: all students' next requests are decided in one step.
    "upgrade_room_access": f"""WITH RECURSIVE j AS (
        SELECT q.request_id, q.student_id, q.room_id, q.requested_at, r.paid_price, COALESCE(bal.balance, 0) AS balance,
               CASE WHEN m.room_id IS NULL THEN 'NOT_A_MEMBER' WHEN m.access_tier = 'paid' THEN 'ALREADY_PAID'
                    WHEN r.paid_price IS NULL OR r.paid_price <= 0 THEN 'INVALID_PRICE' ELSE 'OK' END AS decision
        FROM upgrade_requests q
        LEFT JOIN (SELECT * FROM room_members WHERE is_active) m ON m.room_id = q.room_id AND m.student_id = q.student_id
        LEFT JOIN rooms r ON r.id = q.room_id
        LEFT JOIN {BALANCES} bal ON bal.user_id = q.student_id),
      live AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY requested_at, request_id) AS i
                            FROM j WHERE decision = 'OK'),
      one_by_one AS (
        SELECT DISTINCT student_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS paid, CAST(0 AS DECIMAL(18,2)) AS spent,
               CAST('' AS VARCHAR) AS code FROM live
        UNION ALL
        SELECT student_id, i, CASE WHEN c = 'OK' THEN list_append(paid, room_id) ELSE paid END,
               CAST(CASE WHEN c = 'OK' THEN spent + paid_price ELSE spent END AS DECIMAL(18,2)), c
        FROM (SELECT l.student_id, l.i, l.room_id, l.paid_price, o.paid, o.spent,
                     CASE WHEN list_contains(o.paid, l.room_id) THEN 'ALREADY_PAID'
                          WHEN l.balance - o.spent < l.paid_price THEN 'INSUFFICIENT_BALANCE' ELSE 'OK' END AS c
              FROM one_by_one o JOIN live l ON l.student_id = o.student_id AND l.i = o.i + 1))
    SELECT request_id, student_id, room_id, decision, CAST(NULL AS DECIMAL(18,2)) AS charged FROM j
    WHERE decision <> 'OK'
    UNION ALL
    SELECT l.request_id, l.student_id, l.room_id, o.code, CASE WHEN o.code = 'OK' THEN CAST(l.paid_price AS DECIMAL(18,2)) END
    FROM live l JOIN one_by_one o ON o.student_id = l.student_id AND o.i = l.i""",
    "review_eligibility": """WITH att AS (
        SELECT b.id, b.student_id, s.teacher_id, b.booked_at FROM bookings b JOIN sessions s ON s.id = b.session_id
        WHERE b.status = 'attended'),
      pick AS (SELECT student_id, teacher_id, id AS booking_id FROM (
               SELECT *, row_number() OVER (PARTITION BY student_id, teacher_id ORDER BY booked_at, id) AS rn
               FROM att) WHERE rn = 1),
      done AS (SELECT DISTINCT student_id, teacher_id FROM reviews),
      j AS (SELECT q.request_id, q.student_id, q.teacher_id, q.rating, q.requested_at, p.booking_id,
               CASE WHEN q.teacher_id IS NULL OR q.rating IS NULL OR q.rating = 0 THEN 'MISSING_FIELDS'
                    WHEN q.rating < 1 OR q.rating > 5 THEN 'INVALID_RATING'
                    WHEN t.id IS NULL THEN 'TEACHER_NOT_FOUND' WHEN p.booking_id IS NULL THEN 'NOT_ATTENDED'
                    WHEN dn.student_id IS NOT NULL THEN 'ALREADY_REVIEWED' ELSE 'OK' END AS decision
            FROM review_requests q LEFT JOIN teachers t ON t.id = q.teacher_id
            LEFT JOIN pick p ON p.student_id = q.student_id AND p.teacher_id = q.teacher_id
            LEFT JOIN done dn ON dn.student_id = q.student_id AND dn.teacher_id = q.teacher_id),
      o AS (SELECT *, row_number() OVER (PARTITION BY student_id, teacher_id ORDER BY requested_at, request_id) AS rn
            FROM j WHERE decision = 'OK')
    SELECT request_id, student_id, teacher_id, rating, decision, CAST(NULL AS BIGINT) AS booking_id FROM j
    WHERE decision <> 'OK'
    UNION ALL SELECT request_id, student_id, teacher_id, rating,
        CASE WHEN rn = 1 THEN 'OK' ELSE 'ALREADY_REVIEWED' END, CASE WHEN rn = 1 THEN booking_id END FROM o""",
    "derived_teacher_ratings": """SELECT t.id AS teacher_id,
            COALESCE(CASE WHEN r.n = 0 THEN NULL ELSE CAST(CAST((r.s * 20 + r.n) // (r.n * 2) AS DECIMAL(18,0)) * 0.1
                     AS DECIMAL(10,1)) END, CAST(0 AS DECIMAL(10,1))) AS rating,
            COALESCE(r.n, 0) AS total_reviews, COALESCE(s.n, 0) AS total_sessions
        FROM teachers t
        LEFT JOIN (SELECT teacher_id, SUM(rating) AS s, count(*) AS n FROM reviews WHERE is_visible
                   GROUP BY teacher_id) r ON r.teacher_id = t.id
        LEFT JOIN (SELECT teacher_id, count(*) AS n FROM sessions GROUP BY teacher_id) s ON s.teacher_id = t.id""",
    "derived_session_seats": """SELECT s.id AS session_id, s.capacity, s.seats_booked AS stored_seats_booked,
            COALESCE(b.n, 0) AS seats_booked
        FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM bookings WHERE status <> 'cancelled'
                                   GROUP BY session_id) b ON b.session_id = s.id""",
    "derived_room_counts": """SELECT r.id AS room_id, COALESCE(m.n, 0) AS member_count, COALESCE(c.n, 0) AS content_count
        FROM rooms r
        LEFT JOIN (SELECT room_id, count(*) AS n FROM room_members GROUP BY room_id) m ON m.room_id = r.id
        LEFT JOIN (SELECT room_id, count(*) AS n FROM content_items GROUP BY room_id) c ON c.room_id = r.id""",
    "ledger_reconciliation": """SELECT COALESCE(b.id, l.ref) AS booking_id, CAST(b.amount_paid AS DECIMAL(18,2)) AS amount_paid,
            b.status AS booking_status,
            CAST(COALESCE(l.charged, 0) AS DECIMAL(18,2)) AS charged,
            CAST(COALESCE(l.refunded, 0) AS DECIMAL(18,2)) AS refunded,
            CAST(COALESCE(l.transferred, 0) AS DECIMAL(18,2)) AS transferred,
            CAST(COALESCE(l.deposited, 0) AS DECIMAL(18,2)) AS deposited,
            CAST(COALESCE(l.charged, 0) - COALESCE(l.refunded, 0) AS DECIMAL(18,2)) AS net_paid,
            b.id IS NOT NULL AND COALESCE(l.charged, 0) <> COALESCE(b.amount_paid, 0) AS charge_mismatch,
            COALESCE(l.refunded, 0) > 0 AND COALESCE(l.transferred, 0) > 0 AS transfer_not_reversed,
            b.id IS NULL AS unknown_booking
        FROM bookings b FULL OUTER JOIN (
            SELECT reference_id AS ref,
                   SUM(amount) FILTER (WHERE type = 'booking_charge') AS charged,
                   SUM(amount) FILTER (WHERE type = 'refund') AS refunded,
                   SUM(amount) FILTER (WHERE type = 'transfer') AS transferred,
                   SUM(amount) FILTER (WHERE type = 'deposit') AS deposited
            FROM wallet_transactions WHERE reference_type = 'booking' AND status = 'completed'
            GROUP BY reference_id) l ON l.ref = b.id""",
    "deposits_to_ledger": f"""WITH r AS (
        SELECT q.*, COALESCE(bal.balance, 0) AS balance,
               CASE WHEN q.amount IS NULL OR q.amount <= 0 THEN 'INVALID_AMOUNT' ELSE 'OK' END AS decision
        FROM deposit_requests q LEFT JOIN {BALANCES} bal ON bal.user_id = q.user_id)
    SELECT request_id, user_id, amount, decision,
           CAST(balance + SUM(amount) OVER (PARTITION BY user_id ORDER BY requested_at, request_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2))
               AS new_balance,
           COALESCE(payment_method, 'manual') AS payment_method
    FROM r WHERE decision = 'OK'
    UNION ALL
    SELECT request_id, user_id, amount, decision, CAST(NULL AS DECIMAL(18,2)), CAST(NULL AS VARCHAR)
    FROM r WHERE decision <> 'OK'""",
})


def _check_constraints_sql() -> str:
    def q(vals):
        return ", ".join(f"'{v}'" for v in vals)

    def row(table, rule, key, detail, frm, where):
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST({key} AS VARCHAR) AS row_key, "
                f"CAST({detail} AS VARCHAR) AS detail FROM {frm} WHERE {where}")

    p = [
        row("sessions", "check(seats_booked<=capacity)", "id", "NULL", "sessions", "seats_booked > capacity"),
        row("sessions", "check(capacity>0)", "id", "NULL", "sessions", "capacity <= 0"),
        row("sessions", "check(duration_min>0)", "id", "NULL", "sessions", "duration_min <= 0"),
        row("sessions", "check(price>=0)", "id", "NULL", "sessions", "price < 0"),
        row("reviews", "check(rating between 1 and 5)", "id", "NULL", "reviews", "NOT (rating BETWEEN 1 AND 5)"),
        row("wallet_transactions", "check(amount>0)", "id", "NULL", "wallet_transactions", "amount <= 0"),
    ]
    def named(table, prefix=""):
        cols = rules.ROW_KEYS.get(table)
        return f"{prefix}id" if cols is None else "concat_ws('|', " + ", ".join(f"{prefix}{c}" for c in cols) + ")"

    for table, enums in rules.ENUMS.items():
        p += [row(table, f"enum({col})", named(table), col, table, f"{col} NOT IN ({q(vals)})") for col, vals in enums.items()]
    for table, cols in rules.NOT_NULL.items():
        p += [row(table, f"not_null({col})", named(table), "NULL", table, f"{col} IS NULL") for col in cols]
    for table, lengths in rules.MAX_LENGTH.items():
        p += [row(table, f"check(length({col})<={n})", named(table), "NULL", table, f"length({col}) > {n}")
              for col, n in lengths.items() if (table, col) not in rules.NOT_DERIVED]
    for table, keys in rules.UNIQUE.items():
        for cols in keys:
            cl = ", ".join(cols)
            key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
            nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            frm = f"(SELECT {cl}, count(*) AS n FROM {table} WHERE {nn} GROUP BY {cl} HAVING count(*) > 1) d"
            p.append(row(table, f"unique({','.join(cols)})", key, "n", frm, "TRUE"))
    for parent, children in rules.FOREIGN_KEYS.items():
        p += [row(table, f"fk({col}->{parent}.id)", named(table, "c."), f"c.{col}", f"{table} c",
                  f"c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} x WHERE x.id = c.{col})")
              for table, col in children]
    # notifications is empty in the derived tables and has no SQL form
    return "\nUNION ALL\n".join(x for x in p if not x.startswith("SELECT 'notifications'"))


SQL["check_constraints"] = _check_constraints_sql()
SQL["constraint_summary"] = (f"SELECT table_name, rule, count(*) AS violations FROM ({SQL['check_constraints']}) v "
                             f"GROUP BY table_name, rule")


SQL.update({
    "stream_running_balances": f"""SELECT user_id, CAST(SUM({signed_sql()}) AS DECIMAL(18,2)) AS balance
        FROM wallet_transactions GROUP BY user_id""",
    "stream_teacher_ratings": """SELECT teacher_id,
            CAST(CAST((SUM(rating) * 20 + count(*)) // (count(*) * 2) AS DECIMAL(18,0)) * 0.1 AS DECIMAL(10,1)) AS rating,
            count(*) AS total_reviews
        FROM reviews WHERE is_visible GROUP BY teacher_id""",
    "stream_seat_counter": """SELECT session_id,
            GREATEST(count(*) - count(*) FILTER (WHERE status = 'cancelled'), 0) AS seats_booked
        FROM bookings GROUP BY session_id""",
    "stream_activity_daily": """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS window_start,
            CAST(date_trunc('day', created_at) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, type,
            count(*) AS rows, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
        FROM wallet_transactions GROUP BY 1, 2, 3""",
    "stream_activity_30d": """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) - to_days(CAST(r.k AS INTEGER))
                AS window_start,
            CAST(date_trunc('day', created_at) AS TIMESTAMP) - to_days(CAST(r.k AS INTEGER)) + INTERVAL 30 DAY
                AS window_end,
            type, count(*) AS rows, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
        FROM wallet_transactions JOIN range(30) AS r(k) ON TRUE GROUP BY 1, 2, 3""",
    "stream_no_show": """SELECT b.id AS booking_id, s.scheduled_at AS session_start
        FROM bookings b JOIN sessions s ON s.id = b.session_id
        WHERE b.status = 'confirmed' AND NOT EXISTS (
            SELECT 1 FROM scan_requests sr JOIN bookings b2 ON b2.qr_code = sr.qr_code
            WHERE b2.id = b.id AND sr.scanned_at >= s.scheduled_at - INTERVAL 15 MINUTE
              AND sr.scanned_at <= s.scheduled_at + INTERVAL 1 DAY
              AND sr.scanned_at <= s.scheduled_at + to_minutes(s.duration_min))""",
})
SQL["stream_scans"] = SQL["validate_scans"]


SQL.update({
    # Patches applied one after the other: a recursive fold over each room's patches in order.
    "apply_room_patches": """SELECT * FROM (WITH RECURSIVE q AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY patched_at, request_id) AS step FROM room_patches),
          f AS (SELECT id, name, is_active, updated_at, CAST(0 AS BIGINT) AS step FROM rooms
                UNION ALL
                SELECT f.id, COALESCE(q.name, f.name), COALESCE(q.is_active, f.is_active), q.patched_at, q.step
                FROM f JOIN q ON q.id = f.id AND q.step = f.step + 1),
          l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC) AS rn FROM f) WHERE rn = 1)
        SELECT r.id, r.center_id, r.teacher_id, l.name, r.description, r.access_code, r.subject, r.grade_level,
               r.paid_price, l.is_active, r.member_count, r.content_count, r.created_at, l.updated_at
        FROM rooms r JOIN l ON l.id = r.id)""",
    "propagate_content_updates": """SELECT ci.id, ci.room_id, ci.teacher_content_id,
            CASE WHEN tc.id IS NOT NULL THEN 'Updated ' || tc.title ELSE ci.title END AS title,
            CASE WHEN tc.id IS NOT NULL THEN tc.description ELSE ci.description END AS description,
            CASE WHEN tc.id IS NOT NULL THEN tc.url ELSE ci.url END AS url
        FROM content_items ci LEFT JOIN (SELECT * FROM teacher_content WHERE id % 3 = 0) tc
             ON tc.id = ci.teacher_content_id""",
    "retire_content": """SELECT q.request_id, q.content_id, q.teacher_id,
            CASE WHEN tc.id IS NULL OR tc.teacher_id <> q.teacher_id THEN 'NOT_FOUND'
                 WHEN COALESCE(u.uses, 0) > 0 THEN 'DEACTIVATED' ELSE 'DELETED' END AS decision,
            COALESCE(u.uses, 0) AS uses
        FROM retire_requests q LEFT JOIN teacher_content tc ON tc.id = q.content_id
        LEFT JOIN (SELECT teacher_content_id, count(*) AS uses FROM content_items
                   WHERE teacher_content_id IS NOT NULL GROUP BY teacher_content_id) u
             ON u.teacher_content_id = q.content_id""",
    "link_teachers": """WITH d AS (SELECT q.request_id, q.center_id, q.teacher_id,
            CASE WHEN c.id IS NULL THEN 'CENTER_NOT_FOUND' WHEN t.id IS NULL THEN 'TEACHER_NOT_FOUND'
                 WHEN EXISTS (SELECT 1 FROM center_teachers ct WHERE ct.center_id = q.center_id
                              AND ct.teacher_id = q.teacher_id) THEN 'ALREADY_LINKED' ELSE 'OK' END AS decision
            FROM link_requests q LEFT JOIN centers c ON c.id = q.center_id LEFT JOIN teachers t ON t.id = q.teacher_id)
        SELECT request_id, center_id, teacher_id,
               CASE WHEN decision = 'OK' AND EXISTS (SELECT 1 FROM d e WHERE e.decision = 'OK' AND e.center_id = d.center_id
                         AND e.teacher_id = d.teacher_id AND e.request_id < d.request_id) THEN 'ALREADY_LINKED'
                    ELSE decision END AS decision FROM d""",

    "unlink_teachers": """WITH d AS (SELECT q.request_id, q.center_id, q.teacher_id,
            CASE WHEN c.id IS NULL THEN 'CENTER_NOT_FOUND' WHEN t.id IS NULL THEN 'TEACHER_NOT_FOUND'
                 WHEN NOT EXISTS (SELECT 1 FROM center_teachers ct WHERE ct.center_id = q.center_id
                                  AND ct.teacher_id = q.teacher_id) THEN 'NOT_LINKED' ELSE 'OK' END AS decision
            FROM unlink_requests q LEFT JOIN centers c ON c.id = q.center_id LEFT JOIN teachers t ON t.id = q.teacher_id)
        SELECT request_id, center_id, teacher_id,
               CASE WHEN decision = 'OK' AND EXISTS (SELECT 1 FROM d e WHERE e.decision = 'OK' AND e.center_id = d.center_id
                         AND e.teacher_id = d.teacher_id AND e.request_id < d.request_id) THEN 'NOT_LINKED'
                    ELSE decision END AS decision FROM d""",

    "publish_teacher_content": """SELECT q.request_id, q.teacher_id, q.center_id,
            CASE WHEN q.center_id IS NULL THEN 'CENTER_REQUIRED'
                 WHEN q.type IS NULL OR q.title IS NULL OR q.url IS NULL OR q.title = '' OR q.url = ''
                     THEN 'MISSING_FIELDS'
                 WHEN q.type NOT IN ('video', 'pdf', 'link') THEN 'INVALID_TYPE'
                 WHEN length(q.title) > 255 THEN 'TITLE_TOO_LONG'
                 WHEN NOT COALESCE(regexp_matches(q.url, '^[A-Za-z][A-Za-z0-9+.\\-]*:'), FALSE) THEN 'INVALID_URL'
                 WHEN l.center_id IS NULL THEN 'NOT_YOUR_CENTER' ELSE 'OK' END AS decision
        FROM publish_requests q LEFT JOIN (SELECT * FROM center_teachers WHERE is_active) l
             ON l.center_id = q.center_id AND l.teacher_id = q.teacher_id""",
    "validate_rooms": """WITH d AS (
        SELECT q.candidate_id, q.center_id, q.teacher_id, q.name,
               CASE WHEN COALESCE(q.name, '') = '' OR q.teacher_id IS NULL OR COALESCE(q.subject, '') = ''
                         OR COALESCE(q.grade_level, '') = '' THEN 'MISSING_FIELDS'
                    WHEN EXISTS (SELECT 1 FROM rooms r WHERE r.center_id = q.center_id AND r.name = q.name)
                        THEN 'NAME_TAKEN'
                    WHEN NOT EXISTS (SELECT 1 FROM center_teachers ct WHERE ct.center_id = q.center_id
                                     AND ct.teacher_id = q.teacher_id) THEN 'NOT_LINKED'
                    WHEN NOT list_contains(t.grade_levels, q.grade_level) OR NOT list_contains(t.subjects, q.subject)
                        THEN 'NOT_TAUGHT'
                    ELSE 'OK' END AS decision
        FROM room_candidates q LEFT JOIN teachers t ON t.id = q.teacher_id),
      e AS (SELECT d.* REPLACE (CASE WHEN decision <> 'MISSING_FIELDS' AND EXISTS (
                SELECT 1 FROM d o WHERE o.decision = 'OK' AND o.center_id = d.center_id AND o.name = d.name
                  AND o.candidate_id < d.candidate_id) THEN 'NAME_TAKEN' ELSE decision END AS decision) FROM d),
      c0 AS (SELECT candidate_id, upper(substr(sha256(CAST(candidate_id AS VARCHAR)), 1, 8)) AS code FROM e
             WHERE decision = 'OK'),
      w0 AS (SELECT min(candidate_id) AS candidate_id, code FROM c0 WHERE code NOT IN (SELECT access_code FROM rooms)
             GROUP BY code),
      c1 AS (SELECT candidate_id, upper(substr(sha256(CAST(candidate_id AS VARCHAR) || '#1'), 1, 8)) AS code FROM c0
             WHERE candidate_id NOT IN (SELECT candidate_id FROM w0))
    SELECT e.candidate_id, e.center_id, e.teacher_id, e.name, e.decision, COALESCE(w0.code, c1.code) AS access_code
    FROM e LEFT JOIN w0 USING (candidate_id) LEFT JOIN c1 USING (candidate_id)""",
    "attach_content": """WITH d AS (SELECT q.request_id, q.room_id, q.content_id,
            CASE WHEN q.content_id IS NULL THEN 'CONTENT_REQUIRED' WHEN r.id IS NULL THEN 'ROOM_NOT_FOUND'
                 WHEN tc.id IS NULL THEN 'CONTENT_NOT_AVAILABLE' WHEN h.room_id IS NOT NULL THEN 'ALREADY_IN_ROOM'
                 ELSE 'OK' END AS decision,
            tc.type, tc.title, tc.description, tc.url, COALESCE(q.is_free, tc.is_free) AS is_free,
            COALESCE(q.sort_order, 0) AS sort_order
        FROM attach_requests q
        LEFT JOIN rooms r ON r.id = q.room_id AND r.center_id = q.center_id
        LEFT JOIN (SELECT tc.* FROM teacher_content tc
                   WHERE tc.is_active AND EXISTS (SELECT 1 FROM center_teachers ct WHERE ct.is_active
                                                  AND ct.teacher_id = tc.teacher_id AND ct.center_id = tc.center_id)) tc
             ON tc.id = q.content_id AND tc.center_id = q.center_id
        LEFT JOIN (SELECT DISTINCT room_id, teacher_content_id FROM content_items WHERE teacher_content_id IS NOT NULL) h
             ON h.room_id = q.room_id AND h.teacher_content_id = q.content_id)
        SELECT d.* REPLACE (CASE WHEN decision = 'OK' AND EXISTS (
            SELECT 1 FROM d o WHERE o.decision = 'OK' AND o.room_id = d.room_id AND o.content_id = d.content_id
              AND o.request_id < d.request_id) THEN 'ALREADY_IN_ROOM' ELSE decision END AS decision) FROM d""",
    "reorder_content": """SELECT ci.id, ci.room_id, COALESCE(CAST(r.rank AS INTEGER), ci.sort_order) AS sort_order
        FROM content_items ci LEFT JOIN (SELECT room_id, id, 100 - sort_order AS rank FROM content_items) r
             ON r.id = ci.id AND r.room_id = ci.room_id""",
    "delete_cancelled_sessions": """SELECT q.request_id, q.id,
            CASE WHEN s.id IS NULL THEN 'NOT_FOUND'
                 WHEN EXISTS (SELECT 1 FROM bookings b WHERE b.session_id = q.id) THEN 'BLOCKED' ELSE 'OK' END
                AS decision
        FROM session_delete_requests q LEFT JOIN sessions s ON s.id = q.id AND s.center_id = q.owner""",
    "delete_inactive_rooms": """SELECT q.request_id, q.id, CASE WHEN r.id IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS decision
        FROM room_delete_requests q LEFT JOIN rooms r ON r.id = q.id AND r.center_id = q.owner""",
    "delete_inactive_rooms_content": """SELECT id, room_id FROM content_items
        WHERE room_id NOT IN (SELECT id FROM rooms WHERE NOT is_active)""",
    "user_status_changes": """SELECT q.request_id, q.admin_id, q.user_id, q.is_active, q.reason,
            CASE WHEN q.is_active IS NULL THEN 'FIELD_REQUIRED' WHEN u.id IS NULL THEN 'NOT_FOUND'
                 WHEN u.role = 'super_admin' THEN 'FORBIDDEN' ELSE 'OK' END AS decision
        FROM status_change_requests q LEFT JOIN users u ON u.id = q.user_id""",
})


# The repeats of the batch share e-mail and phone with one earlier candidate, so "an earlier OK one with
# the same e-mail or phone" is the whole rule here; chains through refused ones are unit-tested.
SQL["validate_registrations"] = """WITH d AS (SELECT q.candidate_id, q.email, q.phone,
        CASE WHEN q.email IN (SELECT email FROM users WHERE email IS NOT NULL)
                  OR q.phone IN (SELECT phone FROM users WHERE phone IS NOT NULL) THEN 'USER_EXISTS'
             WHEN COALESCE(q.name, '') = '' OR COALESCE(q.email, '') = '' OR COALESCE(q.phone, '') = ''
                  OR COALESCE(q.role, '') = '' THEN 'MISSING_FIELDS'
             WHEN q.role = 'center_admin' AND (COALESCE(q.center_name, '') = '' OR COALESCE(q.center_address, '') = ''
                  OR q.center_lat IS NULL OR q.center_lng IS NULL) THEN 'MISSING_CENTER_FIELDS'
             ELSE 'OK' END AS decision
    FROM registration_candidates q)
    SELECT candidate_id, email, CASE WHEN EXISTS (
            SELECT 1 FROM d o WHERE o.decision = 'OK' AND o.candidate_id < d.candidate_id AND o.email = d.email)
        OR EXISTS (SELECT 1 FROM d o WHERE o.decision = 'OK' AND o.candidate_id < d.candidate_id AND o.phone = d.phone)
        THEN 'USER_EXISTS' ELSE decision END AS decision FROM d"""


SQL.update({
    "review_eligibility_per_booking": """WITH att AS (
        SELECT b.id, b.student_id, s.teacher_id, b.booked_at FROM bookings b JOIN sessions s ON s.id = b.session_id
        WHERE b.status = 'attended'),
      any_att AS (SELECT DISTINCT student_id, teacher_id FROM att),
      pick AS (SELECT student_id, teacher_id, id AS booking_id FROM (
               SELECT *, row_number() OVER (PARTITION BY student_id, teacher_id ORDER BY booked_at, id) AS rn
               FROM att WHERE id NOT IN (SELECT booking_id FROM reviews WHERE booking_id IS NOT NULL)) WHERE rn = 1),
      j AS (SELECT q.request_id, q.student_id, q.teacher_id, q.rating, q.requested_at, p.booking_id,
               CASE WHEN q.teacher_id IS NULL OR q.rating IS NULL OR q.rating = 0 THEN 'MISSING_FIELDS'
                    WHEN q.rating < 1 OR q.rating > 5 THEN 'INVALID_RATING'
                    WHEN t.id IS NULL THEN 'TEACHER_NOT_FOUND' WHEN a.student_id IS NULL THEN 'NOT_ATTENDED'
                    WHEN p.booking_id IS NULL THEN 'ALREADY_REVIEWED' ELSE 'OK' END AS decision
            FROM review_requests q LEFT JOIN teachers t ON t.id = q.teacher_id
            LEFT JOIN any_att a ON a.student_id = q.student_id AND a.teacher_id = q.teacher_id
            LEFT JOIN pick p ON p.student_id = q.student_id AND p.teacher_id = q.teacher_id),
      o AS (SELECT *, row_number() OVER (PARTITION BY student_id, teacher_id ORDER BY requested_at, request_id) AS rn
            FROM j WHERE decision = 'OK')
    SELECT request_id, student_id, teacher_id, rating, decision, CAST(NULL AS BIGINT) AS booking_id FROM j
    WHERE decision <> 'OK'
    UNION ALL SELECT request_id, student_id, teacher_id, rating,
        CASE WHEN rn = 1 THEN 'OK' ELSE 'ALREADY_REVIEWED' END, CASE WHEN rn = 1 THEN booking_id END FROM o""",
})


CONTENT_UPDATE = """WITH d AS (
        SELECT q.request_id, q.content_id, q.teacher_id, q.title, q.description, q.url,
               CASE WHEN tc.id IS NULL THEN 'NOT_FOUND' WHEN tc.teacher_id <> q.teacher_id THEN 'NOT_YOUR_CONTENT'
                    WHEN q.title IS NOT NULL AND length(q.title) > 255 THEN 'TITLE_TOO_LONG'
                    WHEN q.url IS NOT NULL AND NOT COALESCE(regexp_matches(q.url, '^[A-Za-z][A-Za-z0-9+.\\-]*:'), FALSE)
                        THEN 'INVALID_URL'
                    ELSE 'OK' END AS decision
        FROM content_update_requests q LEFT JOIN teacher_content tc ON tc.id = q.content_id),
      m AS (SELECT tc.id, COALESCE(d.title, tc.title) AS title, COALESCE(d.description, tc.description) AS description,
                   COALESCE(d.url, tc.url) AS url
            FROM teacher_content tc JOIN d ON d.content_id = tc.id AND d.decision = 'OK')"""

SQL["update_teacher_content"] = CONTENT_UPDATE + """
    SELECT request_id, content_id, teacher_id, decision FROM d"""
SQL["update_teacher_content_items"] = CONTENT_UPDATE + """
    SELECT ci.id, ci.room_id, ci.teacher_content_id,
           CASE WHEN m.id IS NOT NULL THEN m.title ELSE ci.title END AS title,
           CASE WHEN m.id IS NOT NULL THEN m.description ELSE ci.description END AS description,
           CASE WHEN m.id IS NOT NULL THEN m.url ELSE ci.url END AS url
    FROM content_items ci LEFT JOIN m ON m.id = ci.teacher_content_id"""
