"""Check-in tokens and access codes (FN-18 .. FN-20), deterministic instead of random."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyhall.functions.exprs import as_col


def qr_parts(qr: Column | str) -> tuple[Column, Column, Column]:
    """FN-18: ``student_session_suffix`` -> (well_formed, student_id text, session_id text)."""
    parts = F.split(as_col(qr), "_")
    ok = F.coalesce(F.size(parts) == 3, F.lit(False))
    return ok, F.when(ok, parts.getItem(0)), F.when(ok, parts.getItem(1))


def qr_code(student_id: Column | str, session_id: Column | str, key: Column | str) -> Column:
    """FN-19: token ``student_session_<8 hex>``; the suffix is a hash of ``key``."""
    return F.concat_ws("_", as_col(student_id).cast("string"), as_col(session_id).cast("string"),
                       F.substring(F.sha2(as_col(key).cast("string"), 256), 1, 8))


def access_code(room_id: Column | str, salt: Column | int = 0) -> Column:
    """FN-20: 8 upper-case hex characters; the salt is raised to resolve a clash."""
    s = salt if isinstance(salt, Column) else F.lit(salt)
    base = F.when(s == 0, as_col(room_id).cast("string")).otherwise(
        F.concat_ws("#", as_col(room_id).cast("string"), s.cast("string")))
    return F.upper(F.substring(F.sha2(base, 256), 1, 8))
