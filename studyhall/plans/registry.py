"""Named queries: key -> (spark callable over the domain tables, oracle SQL body or None).

The parameters chosen here are the registered instance of each operator; every one of them
reads whole tables (no id subsets, no row caps beyond a page or top-k that is the feature).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyhall.oracle.fixtures_sql import with_fixtures
from studyhall.session import ensure_checkpoint_dir
from studyhall.sources.fixtures import StoredFixtures
from studyhall.sources.tables import to_json_documents

_FIXTURES: dict = {}


def tables(spark: SparkSession, sf_dir: str) -> StoredFixtures:
    """Domain tables for one driver directory, derived once per session and stored as parquet
    below the shared checkpoint folder (read back by every query)."""
    key = (id(spark), sf_dir)
    fx = _FIXTURES.get(key)
    if fx is None or fx.spark is not spark:
        tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/domain-{tag}-{id(spark):x}"
        fx = _FIXTURES[key] = StoredFixtures(spark, sf_dir, root)
    return fx


def _entries() -> dict[str, tuple[Callable, str | None]]:
    from studyhall.jobs import attendance as jatt
    from studyhall.jobs import bookings as jbook
    from studyhall.jobs import ledger as jled
    from studyhall.jobs import maintenance as jmaint
    from studyhall.jobs import rooms as jrooms
    from studyhall.jobs import requests as jreq
    from studyhall.jobs import schedule as jsched
    from studyhall.oracle import sql_admin, sql_dash, sql_discovery, sql_jobs
    from studyhall.streaming import streams
    from studyhall.plans import admin, center, discovery, outputs, rooms, teacher, views, wallet

    A = sql_admin.SQL
    e = {
        "user_search": (lambda t: admin.user_search(t, role="student", active=True, term="00001"),
                        A["user_search"]),
        "user_search_count": (lambda t: admin.user_search_count(t, role="student", active=True, term="00001"),
                              A["user_search_count"]),
        "users_by_role": (admin.users_by_role, A["users_by_role"]),
        "center_counts": (admin.center_counts, A["center_counts"]),
        "session_status_counts": (admin.session_status_counts, A["session_status_counts"]),
        "booking_stats": (admin.booking_stats, A["booking_stats"]),
        "room_stats": (admin.room_stats, A["room_stats"]),
        "recent_activity": (admin.recent_activity, A["recent_activity"]),
        "platform_analytics": (admin.platform_analytics, A["platform_analytics"]),
        "platform_analytics_json": (lambda t: to_json_documents(admin.platform_analytics_document(t)),
                                    A["platform_analytics_json"]),
        "audit_log_search": (lambda t: admin.audit_log_search(t, action="deactivate_user"), A["audit_log_search"]),
        "user_details": (admin.user_details, A["user_details"]),
        "student_attendance_stats": (admin.student_attendance_stats, A["student_attendance_stats"]),
        "center_profile": (admin.center_profile, A["center_profile"]),
        "user_profile": (admin.user_profile, A["user_profile"]),
        "user_profile_with_balance": (admin.user_profile_with_balance, A["user_profile_with_balance"]),
        "platform_summary": (admin.platform_summary, A["platform_summary"]),
        "wallet_balance": (wallet.wallet_balance, A["wallet_balance"]),
        "wallet_balance_display": (lambda t: wallet.wallet_balance(t, mode="display",
                                                                   include_users_without_rows=False),
                                   A["wallet_balance_display"]),
        "wallet_statement": (wallet.wallet_statement, A["wallet_statement"]),
        "wallet_history": (wallet.wallet_history, A["wallet_history"]),
        "wallet_history_count": (wallet.wallet_history_count, A["wallet_history_count"]),
        "wallet_by_month": (wallet.wallet_by_month, A["wallet_by_month"]),
    }
    D = sql_discovery.SQL
    plat, plng = sql_discovery.POINT
    clat, clng = sql_discovery.CENTRE_POINT
    e.update({
        "nearby_centers": (lambda t: discovery.nearby_centers(t, lat=plat, lng=plng, km=250.0), D["nearby_centers"]),
        "nearby_centers_count": (lambda t: discovery.nearby_centers_count(t, lat=plat, lng=plng, km=250.0),
                                 D["nearby_centers_count"]),
        "student_nearby_centers": (lambda t: discovery.student_nearby_centers(t, km=25.0),
                                   D["student_nearby_centers"]),
        "nearby_centers_geodesic": (lambda t: discovery.nearby_centers_geodesic(t, lat=plat, lng=plng, km=250.0),
                                    D["nearby_centers_geodesic"]),
        "center_detail_pages": (discovery.center_detail_pages, D["center_detail_pages"]),
        "teacher_detail_pages": (discovery.teacher_detail_pages, D["teacher_detail_pages"]),
        "payload_summary": (lambda t: admin.payload_summary(admin.cut_payloads(t)), A["payload_summary"]),
        "student_center_pages": (lambda t: discovery.student_center_pages(t, km=250.0), D["student_center_pages"]),
        "nearby_teachers": (lambda t: discovery.nearby_teachers(t, lat=plat, lng=plng, km=100.0),
                            D["nearby_teachers"]),
        "search_centers": (lambda t: discovery.search_centers(t, lat=clat, lng=clng, grade="Grade 1"),
                           D["search_centers"]),
        "search_teachers": (lambda t: discovery.search_teachers(t, grade="Grade 7"), D["search_teachers"]),
        "center_details": (discovery.center_details, D["center_details"]),
        "teacher_details": (discovery.teacher_details, D["teacher_details"]),
        "all_subjects": (discovery.all_subjects, D["all_subjects"]),
        "teacher_reviews_public": (discovery.teacher_reviews_public, D["teacher_reviews_public"]),
        "center_upcoming_sessions": (discovery.center_upcoming_sessions, D["center_upcoming_sessions"]),
        "teacher_discovery": (discovery.teacher_discovery, D["teacher_discovery"]),
        "teacher_discovery_nearby": (lambda t: discovery.teacher_discovery_nearby(t, lat=clat, lng=clng, km=100.0),
                                     D["teacher_discovery_nearby"]),
    })
    S = sql_dash.SQL
    e.update({
        "booking_history": (rooms.booking_history, S["booking_history"]),
        "room_counters": (rooms.room_counters, S["room_counters"]),
        "student_rooms": (rooms.student_rooms, S["student_rooms"]),
        "booking_history_documents": (rooms.booking_history_documents, S["booking_history_documents"]),
        "member_room_content": (views.member_room_content, S["member_room_content"]),
        "room_content_by_tier": (rooms.room_content_by_tier, S["room_content_by_tier"]),
        "room_info": (rooms.room_info, S["room_info"]),
        "content_access_decision": (rooms.content_access_decision, S["content_access_decision"]),
        "content_link_resolution": (rooms.content_link_resolution, S["content_link_resolution"]),
        "teacher_profile": (teacher.teacher_profile, S["teacher_profile"]),
        "teacher_stats": (teacher.teacher_stats, S["teacher_stats"]),
        "teacher_centers": (teacher.teacher_centers, S["teacher_centers"]),
        "teacher_sessions": (teacher.teacher_sessions, S["teacher_sessions"]),
        "teacher_sessions_count": (teacher.teacher_sessions_count, S["teacher_sessions_count"]),
        "teacher_sessions_ended": (lambda t: teacher.teacher_sessions_count(t, status="ended"),
                                   S["teacher_sessions_ended"]),
        "teacher_reviews": (teacher.teacher_reviews, S["teacher_reviews"]),
        "teacher_reviews_count": (teacher.teacher_reviews_count, S["teacher_reviews_count"]),
        "teacher_content_usage": (teacher.teacher_content_usage, S["teacher_content_usage"]),
        "teacher_content_usage_count": (teacher.teacher_content_usage_count, S["teacher_content_usage_count"]),
        "center_teacher_content": (teacher.center_teacher_content, S["center_teacher_content"]),
        "room_content_admin": (center.room_content_admin, S["room_content_admin"]),
        "center_rooms": (center.center_rooms, S["center_rooms"]),
        "room_members_list": (center.room_members_list, S["room_members_list"]),
        "center_teacher_roster": (center.center_teacher_roster, S["center_teacher_roster"]),
        "center_session_board": (center.center_session_board, S["center_session_board"]),
        "center_session_board_filtered": (lambda t: center.center_session_board(
            t, status="scheduled", frm="1998-01-01 00:00:00", to="1998-12-31 23:59:59"),
            S["center_session_board_filtered"]),
        "session_attendance": (center.session_attendance, S["session_attendance"]),
        "session_attendance_summary": (center.session_attendance_summary, S["session_attendance_summary"]),
        "center_analytics": (center.center_analytics, S["center_analytics"]),
        "center_analytics_exact": (center.center_analytics_exact, S["center_analytics_exact"]),
        "center_analytics_view": (views.center_analytics_view, S["center_analytics"]),
        "wallet_balance_function": (views.wallet_balance_function, A["wallet_balance_function"]),
        "student_bookings_summary": (center.student_bookings_summary, S["student_bookings_summary"]),
        "sessions_by_month": (center.sessions_by_month, S["sessions_by_month"]),
        "bookings_by_month": (center.bookings_by_month, S["bookings_by_month"]),
    })
    J = sql_jobs.SQL
    e.update({
        "admit_bookings": (lambda t: jbook.admit_bookings(t, jreq.booking_requests(t)), J["admit_bookings"]),
        "cancel_bookings": (lambda t: jbook.cancel_bookings(t, jreq.cancel_requests(t)), J["cancel_bookings"]),
        "cancel_sessions": (lambda t: jbook.cancel_sessions(t, jreq.session_cancel_requests(t)),
                            J["cancel_sessions"]),
        "validate_scans": (lambda t: jatt.validate_scans(t, jreq.scan_requests(t)), J["validate_scans"]),
        "walk_in_attendance": (lambda t: jatt.walk_in_attendance(t, jreq.walkin_requests(t)),
                               J["walk_in_attendance"]),
        "session_overlap_pairs": (lambda t: jsched.session_overlap_pairs(t, jreq.session_candidates(t)),
                                  J["session_overlap_pairs"]),
        "session_conflicts": (lambda t: jsched.session_conflicts(t, jreq.session_candidates(t)),
                              J["session_conflicts"]),
        "validate_sessions": (lambda t: jsched.validate_sessions(t, jreq.session_candidates(t)),
                              J["validate_sessions"]),
        "validate_sessions_strict": (lambda t: jsched.validate_sessions(
            t, jreq.session_candidates(t), require_link=True, require_future=True), J["validate_sessions_strict"]),
    })
    e.update({
        "join_rooms": (lambda t: jrooms.join_rooms(t, jrooms.join_requests(t)), J["join_rooms"]),
        "upgrade_room_access": (lambda t: jrooms.upgrade_room_access(t, jrooms.upgrade_requests(t)),
                                J["upgrade_room_access"]),
        "review_eligibility": (lambda t: jrooms.review_eligibility(t, jrooms.review_requests(t)),
                               J["review_eligibility"]),
        "review_eligibility_per_booking": (lambda t: jrooms.review_eligibility(
            t, jrooms.review_requests(t), per="booking"), J["review_eligibility_per_booking"]),
        "check_constraints": (jmaint.check_constraints, J["check_constraints"]),
        "constraint_summary": (jmaint.constraint_summary, J["constraint_summary"]),
        "derived_teacher_ratings": (jmaint.teacher_ratings, J["derived_teacher_ratings"]),
        "derived_session_seats": (jmaint.session_seats, J["derived_session_seats"]),
        "derived_room_counts": (jmaint.room_counts, J["derived_room_counts"]),
        "ledger_reconciliation": (jled.ledger_reconciliation, J["ledger_reconciliation"]),
        "deposits_to_ledger": (lambda t: jled.deposits_to_ledger(t, jled.deposit_requests(t)),
                               J["deposits_to_ledger"]),
    })
    e.update({
        "apply_room_patches": (lambda t: jmaint.apply_patches(t["rooms"], jmaint.room_patches(t)),
                               J["apply_room_patches"]),
        "propagate_content_updates": (lambda t: jmaint.propagate_content_updates(
            t, t["teacher_content"].filter(F.col("id") % 3 == 0).withColumn(
                "title", F.concat(F.lit("Updated "), F.col("title")))).select(
            "id", "room_id", "teacher_content_id", "title", "description", "url"), J["propagate_content_updates"]),
        "update_teacher_content": (lambda t: jmaint.update_teacher_content(
            t, jreq.content_update_requests(t))["decisions"], J["update_teacher_content"]),
        "update_teacher_content_items": (lambda t: jmaint.update_teacher_content(
            t, jreq.content_update_requests(t))["content_items"].select(
            "id", "room_id", "teacher_content_id", "title", "description", "url"), J["update_teacher_content_items"]),
        "retire_content": (lambda t: jmaint.retire_content(t, jreq.retire_requests(t)), J["retire_content"]),
        "link_teachers": (lambda t: jmaint.link_teachers(t, jreq.link_requests(t)), J["link_teachers"]),
        "unlink_teachers": (lambda t: jmaint.unlink_teachers(t, jreq.unlink_requests(t)), J["unlink_teachers"]),
        "publish_teacher_content": (lambda t: jrooms.publish_teacher_content(t, jreq.publish_requests(t)),
                                    J["publish_teacher_content"]),
        "validate_rooms": (lambda t: jrooms.validate_rooms(t, jreq.room_candidates(t)), J["validate_rooms"]),
        "attach_content": (lambda t: jrooms.attach_content(t, jreq.attach_requests(t)), J["attach_content"]),
        "reorder_content": (lambda t: jmaint.reorder_content(t, jreq.reorder_requests(t)).select(
            "id", "room_id", "sort_order"), J["reorder_content"]),
        "delete_cancelled_sessions": (lambda t: jmaint.delete_rows(
            t, "sessions", jreq.session_delete_requests(t), owner_col="center_id")["decisions"],
            J["delete_cancelled_sessions"]),
        "delete_inactive_rooms": (lambda t: jmaint.delete_rows(
            t, "rooms", jreq.room_delete_requests(t), owner_col="center_id")["decisions"],
            J["delete_inactive_rooms"]),
        "delete_inactive_rooms_content": (lambda t: jmaint.delete_rows(
            t, "rooms", jreq.room_delete_requests(t), owner_col="center_id")["content_items"].select("id", "room_id"),
            J["delete_inactive_rooms_content"]),
        "validate_registrations": (lambda t: jrooms.validate_registrations(
            t, jreq.registration_candidates(t))["decisions"], J["validate_registrations"]),
        "user_status_changes": (lambda t: jled.user_status_changes(t, jreq.status_change_requests(t))["decisions"],
                                J["user_status_changes"]),
    })
    e.update({
        "stream_running_balances": (lambda t: streams.stream_running_balances(t.spark, t.sf_dir, t.n_orders),
                                    J["stream_running_balances"]),
        "stream_teacher_ratings": (streams.stream_rating, J["stream_teacher_ratings"]),
        "stream_seat_counter": (streams.stream_seat_counter, J["stream_seat_counter"]),
        "stream_activity_daily": (lambda t: streams.stream_activity(t.spark, t.sf_dir, t.n_orders, "1 day", None),
                                  J["stream_activity_daily"]),
        "stream_activity_30d": (lambda t: streams.stream_activity(t.spark, t.sf_dir, t.n_orders, "30 days",
                                                                  "1 day"), J["stream_activity_30d"]),
        "stream_no_show": (streams.stream_no_show, J["stream_no_show"]),
        "stream_scans": (streams.stream_scans, J["stream_scans"]),
    })
    e.update(outputs.ENTRIES)
    return e


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, fn=fn: fn(tables(spark, sf_dir))) for k, (fn, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_fixtures(sql) for k, (_, sql) in _entries().items() if sql is not None}
