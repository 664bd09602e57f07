"""Schedule validation for tables of candidate sessions (JOB-06, JOB-07).

Overlap is half-open ``[start, start + duration)``: touching sessions do not clash; cancelled
sessions still block (the reference has no status filter). The update form (candidate with a
``session_id``) never clashes with the session it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyhall.constants import SESSION_AS_OF
from studyhall.functions.exprs import first_failure, session_end, ts_lit
from studyhall.operators.overlap import bucket_lists, levels_of, overlap_join
from studyhall.operators.sweep import earliest_overlap
from studyhall.session import stored

KINDS = ("TEACHER_BUSY", "GRADE_OVERLAP")
BUCKET_MINUTES = 240


def _existing(t) -> DataFrame:
    return t["sessions"].select(
        F.col("id").alias("x_id"), F.col("teacher_id").alias("x_tid"), F.col("center_id").alias("x_cid"),
        F.col("grade_level").alias("x_grade"), F.col("scheduled_at").alias("x_start"),
        session_end().alias("x_end"))


def _by_resource(df: DataFrame, teacher: str, center: str, grade: str, prefix: str) -> DataFrame:
    """Each row under its two keys: the teacher (TEACHER_BUSY) and the centre's grade (GRADE_OVERLAP)."""
    keys = F.array(
        F.struct(F.lit("TEACHER_BUSY").alias("kind"), F.col(teacher).cast("string").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("GRADE_OVERLAP").alias("kind"), F.col(center).cast("string").alias("a"),
                 F.col(grade).cast("string").alias("b")))
    keep = [c for c in df.columns if c not in (teacher, center, grade)]
    out = df.select(*keep, F.explode(keys).alias("_key")).filter("_key.a is not null and _key.b is not null")
    return out.select(*keep, *[F.col(f"_key.{c}").alias(f"{prefix}{c}") for c in ("kind", "a", "b")])


def session_overlap_pairs(t, candidates: DataFrame, bucket_minutes: int = 240) -> DataFrame:
    """JOB-06 pairs: candidate_id, session_id of the clash, kind (TEACHER_BUSY / GRADE_OVERLAP), found
    by one overlap join over rows listed under both keys."""
    cand = candidates.select("candidate_id", F.col("session_id").alias("c_self"), "teacher_id", "center_id",
                             "grade_level", F.col("scheduled_at").alias("c_start"),
                             session_end("scheduled_at", "duration_min").alias("c_end"))
    pairs = overlap_join(_by_resource(cand, "teacher_id", "center_id", "grade_level", "c_"),
                         _by_resource(_existing(t), "x_tid", "x_cid", "x_grade", "x_"),
                         [("c_kind", "x_kind"), ("c_a", "x_a"), ("c_b", "x_b")], left_start="c_start",
                         left_end="c_end", right_start="x_start", right_end="x_end", bucket_minutes=bucket_minutes)
    pairs = pairs.filter(F.col("c_self").isNull() | (F.col("c_self") != F.col("x_id")))
    return pairs.select("candidate_id", F.col("x_id").alias("session_id"), F.col("x_start").alias("session_start"),
                        F.col("c_kind").alias("kind"))


def _clashes(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per candidate the earliest overlapping interval of each kind: k_id, TEACHER_BUSY, GRADE_OVERLAP as
    struct(start, ident) or NULL. Both frames: teacher_id, center_id, grade_level, start, end; ident or candidate_id and own."""
    keys = ["kind", "a", "b"]
    found = earliest_overlap(_by_resource(asked, "teacher_id", "center_id", "grade_level", ""),
                             _by_resource(intervals, "teacher_id", "center_id", "grade_level", ""), keys,
                             start="start", end="end", ident="ident", own="own")
    return found.groupBy(F.col("candidate_id").alias("k_id")).agg(*[
        F.min(F.when(F.col("kind") == kind, F.col("hit"))).alias(kind) for kind in KINDS])


def _asked(candidates: DataFrame) -> DataFrame:
    return candidates.select("candidate_id", F.col("session_id").alias("own"), "teacher_id", "center_id", "grade_level",
                             F.col("scheduled_at").alias("start"), session_end("scheduled_at", "duration_min").alias("end"))


def session_conflicts(t, candidates: DataFrame) -> DataFrame:
    """JOB-06 decisions: per candidate TEACHER_BUSY, else GRADE_OVERLAP, else OK, with the earliest clashing session of the
    reported kind, found by sweeps that never build the pairs (``operators.sweep``)."""
    stored = t["sessions"].select(F.col("id").alias("ident"), "teacher_id", "center_id", "grade_level",
                                  F.col("scheduled_at").alias("start"), session_end().alias("end"))
    clash = _clashes(_asked(candidates), stored)
    c = candidates.select("candidate_id").join(clash, F.col("candidate_id") == F.col("k_id"), "left")
    decision = first_failure([(kind, F.col(kind).isNotNull()) for kind in KINDS])
    return c.select("candidate_id", decision.alias("decision"),
                    F.coalesce(*[F.col(f"{kind}.ident") for kind in KINDS]).alias("conflict_session_id"))


def first_come(live: DataFrame) -> DataFrame:
    """Settle candidates (candidate_id, own, teacher_id, center_id, grade_level, start, end) against each other, first come
    first served by candidate_id: ``accepted`` per candidate_id. Candidates clash if they overlap for one teacher or for one
    centre and grade; two updates of one session (equal ``own``) do not clash.

    Rounds over the undecided: candidates list themselves in time buckets (``operators.overlap``), one aggregate
    finds the earliest of each bucket, and who is the earliest in all its buckets is accepted, since nobody undecided
    before it can overlap it. Accepted ones do not overlap each other, so a join by buckets with those that they refuse
    stays linear. Candidates that share no bucket with others are all accepted in the first round; a run of candidates
    that wait for each other in turn takes a round for each link.
    """
    undecided = stored(live)
    accepted = None
    while True:
        rows = _by_resource(undecided, "teacher_id", "center_id", "grade_level", "").filter(F.col("start") < F.col("end"))
        # A level that no undecided interval has owns no bucket: nobody visits it.
        levels = levels_of(undecided.filter(F.col("start") < F.col("end")), "start", "end", BUCKET_MINUTES * 60)
        listed = rows.select("candidate_id", "kind", "a", "b", F.explode(
            bucket_lists("start", "end", BUCKET_MINUTES * 60, own="own", above="above", above_at=levels)).alias("e"))
        listed = listed.select("candidate_id", "kind", "a", "b", "e.role", "e.level", "e.bucket")
        place = ["kind", "a", "b", "level", "bucket"]
        owners = listed.filter("role = 'own'").groupBy(*place).agg(F.min("candidate_id").alias("first_owner"))
        # A visitor (a shorter interval) matters only where a longer one is listed.
        met = listed.join(owners, place)
        firsts = met.groupBy(*place).agg(F.min("candidate_id").alias("first_any"))
        met = met.join(firsts, place)
        waits = met.groupBy("candidate_id").agg(F.max(
            F.when(F.col("role") == "own", F.col("first_any") < F.col("candidate_id"))
            .otherwise(F.col("first_owner") < F.col("candidate_id"))).alias("waits"))
        state = stored(undecided.join(waits, "candidate_id", "left").withColumn(
            "waits", F.coalesce("waits", F.lit(False))))
        sure = state.filter(~F.col("waits")).drop("waits")
        accepted = sure if accepted is None else accepted.unionByName(sure)
        rest = state.filter("waits").drop("waits")
        if rest.isEmpty():
            return accepted.select("candidate_id")
        gone = overlapping_candidates(rest, sure).select("candidate_id").distinct()
        undecided = stored(rest.join(gone, "candidate_id", "left_anti"))
        if undecided.isEmpty():
            return accepted.select("candidate_id")


def overlapping_candidates(asked: DataFrame, others: DataFrame) -> DataFrame:
    """(candidate_id, kind, other_id, other_start): candidates and the ``others`` they clash with, for others that do
    not overlap each other."""
    left = _by_resource(asked, "teacher_id", "center_id", "grade_level", "")
    right = _by_resource(others, "teacher_id", "center_id", "grade_level", "")
    right = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
    pairs = overlap_join(left, right, [(k, f"o_{k}") for k in ("kind", "a", "b")], left_start="start", left_end="end",
                         right_start="o_start", right_end="o_end", bucket_minutes=BUCKET_MINUTES)
    apart = ~F.coalesce(F.col("own") == F.col("o_own"), F.lit(False)) & (F.col("candidate_id") != F.col("o_candidate_id"))
    return pairs.filter(apart).select("candidate_id", "kind", F.col("o_candidate_id").alias("other_id"),
                                      F.col("o_start").alias("other_start"))


def validate_sessions(t, candidates: DataFrame, *, require_link: bool = False, require_future: bool = False,
                      as_of=SESSION_AS_OF) -> DataFrame:
    """JOB-07, as if the candidates came one by one in the order of candidate_id: MISSING_FIELDS (empty texts, and
    duration, capacity or price of zero or less included), CENTER_NOT_FOUND (no such centre, or, where candidates have an
    ``admin_id``, not its owner), TEACHER_NOT_FOUND, GRADE_NOT_TAUGHT, SUBJECT_NOT_TAUGHT, then the contract options
    NOT_LINKED / IN_THE_PAST, then TEACHER_BUSY, GRADE_OVERLAP (JOB-06) against the stored sessions, then the same
    against candidates that were accepted before, else OK.

    ``conflict_session_id`` names the stored session, ``conflict_candidate_id`` the accepted candidate in the way. A stored session
    keeps its time for the whole batch, also where an accepted candidate moves it; two updates of one session do not clash.
    """
    tch = t["teachers"].select(F.col("id").alias("t_id"), "subjects", "grade_levels")
    ctr = t["centers"].select(F.col("id").alias("c_id"), "owner_id")
    links = (t["center_teachers"].filter(F.col("is_active"))
             .select(F.col("center_id").alias("l_cid"), F.col("teacher_id").alias("l_tid"), F.lit(True).alias("linked")))
    clash = session_conflicts(t, candidates).select(F.col("candidate_id").alias("k_cid"),
                                                    F.col("decision").alias("clash"), "conflict_session_id")
    j = (candidates.join(tch, candidates.teacher_id == tch.t_id, "left")
         .join(ctr, F.col("center_id") == F.col("c_id"), "left")
         .join(links, (F.col("center_id") == F.col("l_cid")) & (F.col("teacher_id") == F.col("l_tid")), "left")
         .join(clash, F.col("candidate_id") == F.col("k_cid"), "left"))

    def empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    def nothing(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) <= 0
    no_center = F.col("c_id").isNull()
    if "admin_id" in candidates.columns:
        no_center = no_center | ~F.col("owner_id").eqNullSafe(F.col("admin_id"))
    checks = [
        ("MISSING_FIELDS", empty("subject") | empty("grade_level") | F.col("scheduled_at").isNull()
         | nothing("duration_min") | nothing("capacity") | nothing("price")),
        ("CENTER_NOT_FOUND", no_center),
        ("TEACHER_NOT_FOUND", F.col("t_id").isNull()),
        ("GRADE_NOT_TAUGHT", ~F.array_contains("grade_levels", F.col("grade_level"))),
        ("SUBJECT_NOT_TAUGHT", ~F.array_contains("subjects", F.col("subject"))),
    ]
    if require_link:
        checks.append(("NOT_LINKED", F.col("linked").isNull()))
    if require_future:
        checks.append(("IN_THE_PAST", F.col("scheduled_at") <= ts_lit(as_of)))
    checks += [(kind, F.col("clash") == kind) for kind in KINDS]
    d = stored(j.select(*candidates.columns, first_failure(checks).alias("decision"), "conflict_session_id"))
    live = _asked(d.filter(F.col("decision") == "OK"))
    accepted = first_come(live)
    refused = live.join(accepted, "candidate_id", "left_anti")
    before = overlapping_candidates(refused, live.join(accepted, "candidate_id", "left_semi")).filter(
        "other_id < candidate_id").groupBy(F.col("candidate_id").alias("r_id")).agg(*[
            F.min(F.when(F.col("kind") == kind, F.struct("other_start", "other_id"))).alias(kind) for kind in KINDS])
    out = d.join(before, F.col("candidate_id") == F.col("r_id"), "left")
    decision = F.when(F.col("decision") != "OK", F.col("decision")).otherwise(
        first_failure([(kind, F.col(kind).isNotNull()) for kind in KINDS]))
    return out.select("candidate_id", decision.alias("decision"),
                      F.when(F.col("decision").isin(*KINDS), F.col("conflict_session_id")).alias("conflict_session_id"),
                      F.coalesce(*[F.col(f"{kind}.other_id") for kind in KINDS]).alias("conflict_candidate_id"))
