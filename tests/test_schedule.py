"""Schedule jobs: sweeps equal to brute force, batches of candidates settled first come first served."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from studyhall.jobs import schedule
from studyhall.operators import sweep

T0 = dt.datetime(1998, 7, 1, 8, 0)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


@pytest.mark.parametrize("seed", [1, 2])
def test_earliest_overlap_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    stored = [(rng.choice(["a", "a", "b", None]), s, s + rng.choice([0, 1, 3, 5, 40]), i)
              for i, s in enumerate(rng.randrange(120) for _ in range(150))]
    asked = [(rng.choice(["a", "a", "b", "c", None]), s, s + rng.choice([0, 1, 2, 7, 25]), rng.choice([None, rng.randrange(150)]), i)
             for i, s in enumerate(rng.randrange(125) for _ in range(250))]
    asked += [(k, s, e, i, 1000 + i) for k, s, e, i in stored]
    got = sweep.earliest_overlap(spark.createDataFrame(asked, "k string, s int, e int, own int, q int"),
                                 spark.createDataFrame(stored, "k string, s int, e int, id int"), ["k"],
                                 start="s", end="e", ident="id", own="own").collect()
    want = {}
    for k, s, e, own, q in asked:
        hits = [(s2, i) for k2, s2, e2, i in stored
                if k2 == k and k is not None and i != own and s < e and s2 < e2 and s2 < e and s < e2]
        want[q] = min(hits) if hits else None
    assert {r.q: (tuple(r.hit) if r.hit else None) for r in got} == want


def frame_of(spark, frames, sessions, candidates):
    t = frames()
    t["sessions"] = spark.createDataFrame(sessions, "id long, teacher_id long, center_id long, grade_level string, "
                                                    "scheduled_at timestamp_ntz, duration_min int")
    t["teachers"] = spark.createDataFrame([(i, ["math"], ["g1", "g2"]) for i in range(4)],
                                          "id long, subjects array<string>, grade_levels array<string>")
    t["centers"] = spark.createDataFrame([(i, 100 + i) for i in range(3)], "id long, owner_id long")
    t["center_teachers"] = spark.createDataFrame([], "center_id long, teacher_id long, is_active boolean")
    c = spark.createDataFrame(candidates, "candidate_id long, session_id long, center_id long, teacher_id long, subject string, "
                                          "grade_level string, scheduled_at timestamp_ntz, duration_min int, capacity int, "
                                          "price double")
    return t, c


@pytest.mark.parametrize("seed", [3])
def test_batch_of_candidates_equals_one_by_one(spark, frames, seed):
    rng = random.Random(seed)
    sessions = [(i, rng.randrange(4), rng.randrange(3), rng.choice(["g1", "g2"]), minutes(rng.randrange(3000)), 45)
                for i in range(15)]
    cands = [(i, rng.choice([None, None, rng.randrange(15)]), rng.randrange(3), rng.randrange(4), "math",
              rng.choice(["g1", "g2"]), minutes(rng.randrange(2500)), rng.choice([20, 45, 60, 700]), 5, 10.0)
             for i in range(90)]
    cands += [(200 + i, None, 0, 0, "math", "g1", minutes(4000), 30, 5, 10.0) for i in range(30)]
    t, c = frame_of(spark, frames, sessions, cands)
    taken, want = [], {}
    for cid, sid, cen, tea, _, g, at, dur, _, _ in cands:
        end = at + dt.timedelta(minutes=dur)

        def clash(rows, same):
            return min(((s, i) for i, own, t2, c2, g2, s, d in rows if same(t2, c2, g2) and not (own is not None and own == sid)
                        and s < end and at < s + dt.timedelta(minutes=d)), default=None)
        kinds = (("TEACHER_BUSY", lambda t2, c2, g2: t2 == tea), ("GRADE_OVERLAP", lambda t2, c2, g2: (c2, g2) == (cen, g)))
        old = [(i, i, t2, c2, g2, s, d) for i, t2, c2, g2, s, d in sessions]
        hit = next(((k, x[1], None) for k, f in kinds if (x := clash(old, f))), None)
        hit = hit or next(((k, None, x[1]) for k, f in kinds if (x := clash(taken, f))), None)
        want[cid] = hit or ("OK", None, None)
        if not hit:
            taken.append((cid, sid, tea, cen, g, at, dur))
    got = {r.candidate_id: (r.decision, r.conflict_session_id, r.conflict_candidate_id)
           for r in schedule.validate_sessions(t, c).collect()}
    assert got == want


def test_required_fields_and_centers(spark, frames):
    good = (None, 1, 1, "math", "g1", T0, 60, 5, 10.0)
    names = ["session_id", "center_id", "teacher_id", "subject", "grade_level", "scheduled_at", "duration_min", "capacity", "price"]
    bad = [("subject", "", "MISSING_FIELDS"), ("grade_level", "", "MISSING_FIELDS"), ("scheduled_at", None, "MISSING_FIELDS"),
           ("duration_min", 0, "MISSING_FIELDS"), ("capacity", 0, "MISSING_FIELDS"), ("price", 0.0, "MISSING_FIELDS"),
           ("price", None, "MISSING_FIELDS"), ("center_id", 77, "CENTER_NOT_FOUND"), ("teacher_id", 77, "TEACHER_NOT_FOUND"),
           ("grade_level", "g9", "GRADE_NOT_TAUGHT"), ("subject", "art", "SUBJECT_NOT_TAUGHT")]
    rows, want = [], {}
    for i, (name, value, code) in enumerate(bad):
        rows.append((i, *[value if n == name else v for n, v in zip(names, good)]))
        want[i] = code
    rows += [(50, *good), (51, *good)]
    want |= {50: "OK", 51: "TEACHER_BUSY"}
    t, c = frame_of(spark, frames, [], rows)
    assert {r.candidate_id: r.decision for r in schedule.validate_sessions(t, c).collect()} == want
    owned = c.filter("candidate_id >= 50").withColumn("admin_id", F.when(F.col("candidate_id") == 50, 5).otherwise(101))
    assert {r.candidate_id: r.decision for r in schedule.validate_sessions(t, owned).collect()} == {
        50: "CENTER_NOT_FOUND", 51: "OK"}
