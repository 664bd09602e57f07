"""Fixed values of the domain (enum members, defaults, clocks, id offsets).

Fixed values that must equal the reference's for right results, stated together as text:
  user roles:            student, teacher, center_admin, super_admin
  session statuses:      scheduled, ongoing, completed, cancelled
  booking statuses:      pending, confirmed, attended, cancelled, no_show
  wallet tx types:       deposit, withdrawal, booking_charge, refund, transfer
  wallet tx statuses:    pending, completed, failed, cancelled
  room access tiers:     free, paid
  content types:         video, pdf, link
  notification types:    booking_confirmed, booking_cancelled, session_reminder, session_cancelled,
                         payment_received, refund_processed, review_received, room_access_granted,
                         plus session_missed and attendance_recorded (written by the check-in code)
  page sizes:            50 (admin lists, wallet, content of a teacher), 20 (discovery, teacher lists)
  radius defaults:       10 km (nearby), 50 km and 100 rows (centre search)
  check-in window:       15 minutes before start until start + duration
  balance credit types:  deposit, refund (+ transfer in the display read); debits: withdrawal, booking_charge
"""

from __future__ import annotations

# --- fixed values (see module docstring) ---
ROLES = ("student", "teacher", "center_admin", "super_admin")
SESSION_STATUSES = ("scheduled", "ongoing", "completed", "cancelled")
BOOKING_STATUSES = ("pending", "confirmed", "attended", "cancelled", "no_show")
TX_TYPES = ("deposit", "withdrawal", "booking_charge", "refund", "transfer")
TX_STATUSES = ("pending", "completed", "failed", "cancelled")
ACCESS_TIERS = ("free", "paid")
CONTENT_TYPES = ("video", "pdf", "link")
NOTIFICATION_TYPES = (
    "booking_confirmed", "booking_cancelled", "session_reminder", "session_cancelled",
    "payment_received", "refund_processed", "review_received", "room_access_granted",
    "session_missed", "attendance_recorded",
)
PAGE_ADMIN = 50
PAGE_DISCOVERY = 20
NEARBY_KM = 10.0
SEARCH_KM = 50.0
SEARCH_CAP = 100
CHECKIN_EARLY_MIN = 15

# Wallet balance presets.
CREDIT_SPENDABLE = ("deposit", "refund")
CREDIT_DISPLAY = ("deposit", "refund", "transfer")
DEBIT_TYPES = ("withdrawal", "booking_charge")

# --- clocks of the test data (every operator takes ``as_of`` explicitly) ---
SESSION_AS_OF = "1998-07-01 12:00:00"
LEDGER_AS_OF = "2024-01-31 00:00:00"

# --- id spaces of the derived users table ---
TEACHER_USER_OFFSET = 1_000_000_000
OWNER_USER_OFFSET = 2_000_000_000
ADMIN_USER_OFFSET = 3_000_000_000

EARTH_RADIUS_KM = 6371.0088
