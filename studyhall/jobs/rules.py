"""The declared rules of the tables (JOB-17), as data: the constraint job and its SQL read them from here.

Fixed values: what the schema declares.
"""

from __future__ import annotations

from studyhall.constants import (
    ACCESS_TIERS, BOOKING_STATUSES, CONTENT_TYPES, NOTIFICATION_TYPES, ROLES, SESSION_STATUSES, TX_STATUSES, TX_TYPES,
)

NOT_NULL: dict[str, list[str]] = {
    "users": ["name", "email", "phone", "role"],
    "centers": ["owner_id", "name", "address", "lat", "lng"],
    "teachers": ["user_id"],
    "center_teachers": ["center_id", "teacher_id"],
    "sessions": ["center_id", "teacher_id", "subject", "grade_level", "scheduled_at", "duration_min", "capacity",
                 "seats_booked", "price"],
    "bookings": ["session_id", "student_id", "qr_code", "amount_paid"],
    "attendances": ["booking_id", "scanned_by"],
    "rooms": ["center_id", "teacher_id", "name", "grade_level", "subject", "access_code"],
    "room_members": ["room_id", "student_id", "access_tier"],
    "content_items": ["room_id", "type", "title", "url"],
    "wallet_transactions": ["user_id", "amount", "type"],
    "reviews": ["teacher_id", "student_id", "booking_id", "rating"],
    "notifications": ["user_id", "type", "title", "message"],
    "audit_logs": ["action", "entity_type"],
}

MAX_LENGTH: dict[str, dict[str, int]] = {
    "users": {"name": 150, "email": 255, "phone": 20},
    "centers": {"name": 200, "phone": 20},
    "sessions": {"subject": 100, "grade_level": 50, "title": 255},
    "rooms": {"name": 200, "grade_level": 50, "subject": 100, "access_code": 20},
    "teacher_content": {"title": 255},
    "content_items": {"title": 255},
    "wallet_transactions": {"reference_type": 50, "payment_method": 50, "external_ref": 255},
    "notifications": {"title": 255},
    "audit_logs": {"action": 100, "entity_type": 50},
}

# Columns of the schema that the derived tables do not have (a rule holds where its column exists).
NOT_DERIVED = {("wallet_transactions", "external_ref")}

ENUMS: dict[str, dict[str, tuple]] = {
    "users": {"role": ROLES},
    "sessions": {"status": SESSION_STATUSES},
    "bookings": {"status": BOOKING_STATUSES},
    "wallet_transactions": {"type": TX_TYPES, "status": TX_STATUSES},
    "room_members": {"access_tier": ACCESS_TIERS},
    "content_items": {"type": CONTENT_TYPES},
    "teacher_content": {"type": CONTENT_TYPES},
    "notifications": {"type": NOTIFICATION_TYPES},
}

UNIQUE: dict[str, list[list[str]]] = {
    "users": [["email"], ["phone"]],
    "teachers": [["user_id"]],
    "center_teachers": [["center_id", "teacher_id"]],
    "bookings": [["qr_code"], ["session_id", "student_id"]],
    "attendances": [["booking_id"]],
    "rooms": [["access_code"]],
    "room_members": [["room_id", "student_id"]],
    "reviews": [["booking_id"], ["teacher_id", "student_id", "booking_id"]],
}

# parent -> (child, column)
FOREIGN_KEYS: dict[str, list[tuple[str, str]]] = {
    "users": [("centers", "owner_id"), ("teachers", "user_id"), ("bookings", "student_id"), ("attendances", "scanned_by"),
              ("room_members", "student_id"), ("wallet_transactions", "user_id"), ("reviews", "student_id"),
              ("notifications", "user_id"), ("audit_logs", "admin_id")],
    "centers": [("center_teachers", "center_id"), ("sessions", "center_id"), ("rooms", "center_id")],
    "teachers": [("center_teachers", "teacher_id"), ("sessions", "teacher_id"), ("rooms", "teacher_id"),
                 ("reviews", "teacher_id")],
    "sessions": [("bookings", "session_id")],
    "bookings": [("attendances", "booking_id"), ("reviews", "booking_id")],
    "rooms": [("room_members", "room_id"), ("content_items", "room_id")],
}

# Tables without an id of their own: the columns that name a row.
ROW_KEYS: dict[str, list[str]] = {"center_teachers": ["center_id", "teacher_id"]}
