"""Column builders for filters, projections and small scalar rules.

Everything here returns a ``Column`` made of built-in Spark expressions, so it stays inside
whole-stage codegen and can be pushed into scans where Spark allows it.

The plainest items of the inventory need no helper and are written inline in the plans:
PRJ-01 (projection with aliases: ``select(col.alias(...))``), PRJ-02 (differences, casts,
division: column arithmetic and ``cast``), FLT-01 (equality / boolean filters, also through
``optional_filters``), FLT-06 (IN-lists: ``isin`` / ``~isin``), FLT-11 (NULL tests: ``isNull`` /
``isNotNull``, NULL-safe branches with ``coalesce``).
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyhall.constants import CREDIT_DISPLAY, CREDIT_SPENDABLE, DEBIT_TYPES


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(text) -> Column:
    """Zone-less timestamp literal; accepts text or an existing Column."""
    return text if isinstance(text, Column) else F.lit(str(text)).cast("timestamp_ntz")


def minutes(c: Column | str | int) -> Column:
    """n minutes as a day-time interval (FN-11)."""
    n = F.lit(c) if isinstance(c, int) else as_col(c)
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


# ----------------------------------------------------------------- filters
def optional_filters(df: DataFrame, preds: Mapping[str, object] | None = None,
                     extra: Iterable[Column | None] = ()) -> DataFrame:
    """FLT-02: equality predicate per argument that is not None, AND-ed; plus extra columns."""
    conds = [F.col(c) == v for c, v in (preds or {}).items() if v is not None]
    conds += [c for c in extra if c is not None]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def ilike_any(cols: Iterable[Column | str], term: str | None) -> Column | None:
    """FLT-03: case-insensitive substring on any of the columns; ``%``/``_`` stay wildcards."""
    if term is None or term == "":
        return None
    pattern = f"%{term}%"
    return reduce(lambda a, b: a | b, [as_col(c).ilike(pattern) for c in cols])


def has_value(arr: Column | str, value: str | None) -> Column | None:
    """FLT-04: ``value = ANY(arr)``."""
    return None if value is None else F.array_contains(as_col(arr), value)


def array_text(arr: Column | str) -> Column:
    """PostgreSQL's text form of a text[]: ``{a,"b c"}`` (elements with blanks/commas/quotes quoted)."""
    quoted = F.transform(
        as_col(arr),
        lambda x: F.when(x.isNull(), F.lit("NULL"))
        .when(x.rlike(r'[\s,{}"\\]') | (x == ""), F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r'\\$1'),
                                                            F.lit('"')))
        .otherwise(x),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def array_text_ilike(arr: Column | str, term: str | None) -> Column | None:
    """FLT-05: ``arr::text ILIKE '%term%'``."""
    if term is None:
        return None
    return array_text(arr).ilike(f"%{term}%")


def between_times(c: Column | str, frm=None, to=None) -> Column | None:
    """FLT-07: inclusive range; either end optional."""
    c = as_col(c)
    parts = []
    if frm is not None:
        parts.append(c >= ts_lit(frm))
    if to is not None:
        parts.append(c <= ts_lit(to))
    return reduce(lambda a, b: a & b, parts) if parts else None


def prune_months(df: DataFrame, col: str, frm=None, to=None) -> DataFrame:
    """Add the month-partition predicate that matches a time filter on ``col`` (inclusive
    bounds), when ``df`` has the ``<col>_month`` partition column; otherwise return ``df``.

    Spark prunes partition folders on it before reading; the exact time filter still applies.
    """
    mc = f"{col}_month"
    if mc not in df.columns or (frm is None and to is None):
        return df
    cond = None
    if frm is not None:
        cond = F.col(mc) >= F.date_format(ts_lit(frm), "yyyy-MM")
    if to is not None:
        c2 = F.col(mc) <= F.date_format(ts_lit(to), "yyyy-MM")
        cond = c2 if cond is None else cond & c2
    return df.filter(cond)


def since(c: Column | str, as_of, n_days: int) -> Column:
    """FLT-08: ``c >= as_of - n days``."""
    return as_col(c) >= ts_lit(as_of) - days(n_days)


# --------------------------------------------------------------- statuses
def session_end(start: Column | str = "scheduled_at", duration: Column | str = "duration_min") -> Column:
    return as_col(start) + minutes(duration)


def session_clock_status(as_of, status="status", start="scheduled_at", duration="duration_min",
                         past_label: str = "completed") -> Column:
    """PRJ-03: cancelled, then ended (>= start + duration), then ongoing (>= start), else scheduled.

    ``past_label`` is ``completed`` on the centre board and ``ended`` in the teacher list.
    """
    now = ts_lit(as_of)
    return (F.when(as_col(status) == "cancelled", F.lit("cancelled"))
            .when(now >= session_end(start, duration), F.lit(past_label))
            .when(now >= as_col(start), F.lit("ongoing"))
            .otherwise(F.lit("scheduled")))


def session_status_label(as_of, status="status", start="scheduled_at", duration="duration_min") -> Column:
    """PRJ-03 label of the centre board: cancelled, ended, is started now, scheduled."""
    return (F.when(as_col(status) == "cancelled", F.lit("cancelled"))
            .when(ts_lit(as_of) >= session_end(start, duration), F.lit("ended"))
            .when(ts_lit(as_of) >= as_col(start), F.lit("is started now"))
            .otherwise(F.lit("scheduled")))


def teacher_list_status(as_of, status="status", start="scheduled_at") -> Column:
    """Teacher session list: a stored ``scheduled`` session that started before ``as_of`` shows ``ended``."""
    return F.when((as_col(status) == "scheduled") & (as_col(start) < ts_lit(as_of)), F.lit("ended")).otherwise(
        as_col(status))


def virtual_status_filter(status: str | None, as_of, col_status="status", start="scheduled_at") -> Column | None:
    """FLT-09: ``ended`` / ``scheduled`` are computed from the clock; other values are stored."""
    if status is None:
        return None
    now = ts_lit(as_of)
    st = as_col(col_status)
    if status == "ended":
        return (st == "scheduled") & (as_col(start) < now)
    if status == "scheduled":
        return (st == "scheduled") & (as_col(start) >= now)
    return st == status


# ----------------------------------------------------------- projections
def redact_by_tier(value: Column | str, is_free: Column | str = "is_free", tier: Column | str = "access_tier") -> Column:
    """PRJ-04: value visible when the item is free or the member paid; NULL otherwise."""
    return F.when(as_col(is_free) | (as_col(tier) == "paid"), as_col(value))


# ----------------------------------------------------------------- money
def signed_amount(credit_types=CREDIT_SPENDABLE, debit_types=DEBIT_TYPES,
                  type_col="type", status_col="status", amount_col="amount") -> Column:
    """AGG-07 summand: +amount for completed credits, -amount for completed debits, else 0."""
    done = as_col(status_col) == "completed"
    amt = as_col(amount_col)
    return (F.when(done & as_col(type_col).isin(*credit_types), amt)
            .when(done & as_col(type_col).isin(*debit_types), -amt)
            .otherwise(F.lit(0)))


def credit_types_for(mode: str) -> tuple:
    """C1: ``spendable`` (deposit, refund) or ``display`` (+ transfer)."""
    if mode == "spendable":
        return CREDIT_SPENDABLE
    if mode == "display":
        return CREDIT_DISPLAY
    raise ValueError(f"unknown balance mode {mode!r}")


def money(c: Column) -> Column:
    """Money output type shared with the oracle."""
    return c.cast("decimal(18,2)")


def pct(num: str, den: str) -> Column:
    """AGG-08: ``round(num / nullif(den, 0) * 100, 1)`` HALF_UP, exact at any size.

    Done in integers: tenths = (2000*num + den) div (2*den). ``num``/``den`` name count columns.
    """
    return F.expr(f"CASE WHEN {den} = 0 THEN NULL ELSE CAST(CAST(({num} * 2000 + {den}) div ({den} * 2) "
                  f"AS DECIMAL(18,0)) * 0.1 AS DECIMAL(10,1)) END")


def avg_1dp(total: str, count: str) -> Column:
    """AGG-09: ``round(avg(x), 1)`` HALF_UP from an integer sum and count (NULL when count is 0)."""
    return F.expr(f"CASE WHEN {count} = 0 THEN NULL ELSE CAST(CAST(({total} * 20 + {count}) div ({count} * 2) "
                  f"AS DECIMAL(18,0)) * 0.1 AS DECIMAL(10,1)) END")


# ------------------------------------------------------------- text / misc
def text_bool(c: Column | str) -> Column:
    """FN-27: 'true'/'false' text to boolean, anything else NULL."""
    c = as_col(c)
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))


def non_empty_array(c: Column | str) -> Column:
    """FN-26: scalar-or-array to array without NULL/empty entries."""
    c = as_col(c)
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def deterministic_id(*parts: Column | str) -> Column:
    """FN-34: retry-safe key from the natural key (instead of a random UUID)."""
    return F.sha2(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]), 256)


def new_key(df: DataFrame, source: str, offset: int, namespace: str) -> Column:
    """Key of a row created from request ``source``: ``offset + request id`` when keys are
    numbers, else a hash of (namespace, request id) — retry-safe either way (FN-34)."""
    from pyspark.sql import types as T

    if isinstance(df.schema[source].dataType, T.IntegralType):
        return F.col(source) + F.lit(offset)
    return deterministic_id(F.lit(namespace), F.col(source))


UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_uuid(c: Column | str) -> Column:
    """FN-31: text is a UUID (8-4-4-4-12 hex digits)."""
    return F.coalesce(as_col(c).rlike(UUID_PATTERN), F.lit(False))


def us_datetime(c: Column | str) -> Column:
    """FN-33: 'M/d/yyyy, h:mm:ss a' as in the check-in messages."""
    return F.date_format(as_col(c), "M/d/yyyy, h:mm:ss a")


def first_failure(checks: list[tuple[str, Column]], ok: str = "OK") -> Column:
    """First failing check in the given order wins; ``ok`` when none fails.

    ``checks`` holds ``(code, failed_condition)``; a NULL condition counts as not failed.
    """
    expr = None
    for code, failed in checks:
        expr = F.when(F.coalesce(failed, F.lit(False)), F.lit(code)) if expr is None else \
            expr.when(F.coalesce(failed, F.lit(False)), F.lit(code))
    return F.lit(ok) if expr is None else expr.otherwise(F.lit(ok))
