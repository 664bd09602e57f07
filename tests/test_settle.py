"""Batches settled in order: equal to handling the requests one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from studyhall.jobs import bookings, rooms
from studyhall.operators.settle import Resource, settle_in_order

T0 = dt.datetime(1998, 7, 1, 12, 0)
SOON = dt.datetime(1998, 7, 9, 12, 0)


def one_by_one(requests, seats, purse, booked=()):
    seats, purse, have, out = dict(seats), dict(purse), set(booked), {}
    for at, rid, s, u, price in sorted(requests):
        if seats[s] < 1:
            out[rid] = "SESSION_FULL"
        elif (s, u) in have:
            out[rid] = "ALREADY_BOOKED"
        elif purse[u] < price:
            out[rid] = "INSUFFICIENT_BALANCE"
        else:
            seats[s] -= 1
            purse[u] -= price
            have.add((s, u))
            out[rid] = "OK"
    return out


def marketplace(spark, frames, requests, seats, purse, prices, booked=()):
    t = frames()
    t["sessions"] = spark.createDataFrame(
        [(s, 1, prices[s], seats[s], "scheduled", SOON) for s in seats],
        "id long, center_id long, price decimal(10,2), capacity int, status string, scheduled_at timestamp_ntz")
    t["bookings"] = spark.createDataFrame([(i, s, u, "cancelled") for i, (s, u) in enumerate(booked)],
                                          "id long, session_id long, student_id long, status string")
    t["wallet_transactions"] = spark.createDataFrame(
        [(u, "deposit", "completed", b) for u, b in purse.items()],
        "user_id long, type string, status string, amount decimal(12,2)")
    q = spark.createDataFrame([(r, s, u, at) for at, r, s, u, _ in requests],
                              "request_id long, session_id long, student_id long, requested_at timestamp_ntz")
    return t, q


def decided(t, q):
    return {r.request_id: r.decision for r in bookings.admit_bookings(t, q, as_of="1998-07-01 12:00:00").collect()}


def test_refused_requests_take_nothing(spark, frames):
    from decimal import Decimal as D
    prices = {1: D(150), 2: D(50), 3: D(10)}
    seats, purse = {1: 5, 2: 5, 3: 1}, {1: D(100), 2: D(0), 3: D(100)}
    req = [(T0, 1, 1, 1, D(150)), (T0 + dt.timedelta(minutes=1), 2, 2, 1, D(50)),
           (T0, 3, 3, 2, D(10)), (T0 + dt.timedelta(minutes=1), 4, 3, 3, D(10)), (T0 + dt.timedelta(minutes=2), 5, 3, 3, D(10)),
           (T0 + dt.timedelta(minutes=3), 6, 2, 1, D(50))]
    got = decided(*marketplace(spark, frames, req, seats, purse, prices))
    assert got == {1: "INSUFFICIENT_BALANCE", 2: "OK", 3: "INSUFFICIENT_BALANCE", 4: "OK", 5: "SESSION_FULL",
                   6: "ALREADY_BOOKED"}


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_equals_one_by_one(spark, frames, seed):
    from decimal import Decimal as D
    rng = random.Random(seed)
    n_s, n_u = 25, 40
    prices = {s: D(rng.choice([0, 5, 20, 35, 60])) for s in range(n_s)}
    seats = {s: rng.randint(1, 9) for s in range(n_s)}
    purse = {u: D(rng.choice([0, 30, 80, 200])) for u in range(n_u)}
    req = []
    for i in range(200):
        s, u = min(rng.randrange(n_s), rng.randrange(n_s)), min(rng.randrange(n_u), rng.randrange(n_u))
        req.append((T0 + dt.timedelta(minutes=rng.randrange(40)), i, s, u, prices[s]))
    booked = {(rng.randrange(n_s), rng.randrange(n_u)) for _ in range(60)}
    assert decided(*marketplace(spark, frames, req, seats, purse, prices, booked)) == one_by_one(req, seats, purse, booked)


def test_one_crowded_session_takes_few_rounds(spark, frames, monkeypatch):
    from decimal import Decimal as D
    from studyhall.operators import settle
    cuts = []
    real = settle.stored
    monkeypatch.setattr(settle, "stored", lambda df: cuts.append(1) or real(df))
    seats, purse, prices = {1: 300}, {u: D(u % 3 * 10) for u in range(1500)}, {1: D(10)}
    req = [(T0 + dt.timedelta(seconds=u), u, 1, u, D(10)) for u in range(1500)]
    assert decided(*marketplace(spark, frames, req, seats, purse, prices)) == one_by_one(req, seats, purse)
    assert len(cuts) <= 6


@pytest.mark.parametrize("seed", [4])
def test_upgrades_equal_one_by_one(spark, frames, seed):
    rng = random.Random(seed)
    n_r, n_u = 8, 10
    prices = {r: rng.choice([10, 25, 40, 90]) for r in range(n_r)}
    purse = {u: rng.choice([0, 60, 150]) for u in range(n_u)}
    t = frames()
    t["rooms"] = spark.createDataFrame([(r, float(p)) for r, p in prices.items()], "id long, p double").select(
        "id", F.col("p").cast("decimal(10,2)").alias("paid_price"))
    t["room_members"] = spark.createDataFrame([(r, u, True, "free") for r in range(n_r) for u in range(n_u)],
                                              "room_id long, student_id long, is_active boolean, access_tier string")
    t["wallet_transactions"] = spark.createDataFrame([(u, "deposit", "completed", float(b)) for u, b in purse.items()],
                                                     "user_id long, type string, status string, a double").select(
        "user_id", "type", "status", F.col("a").cast("decimal(12,2)").alias("amount"))
    req = [(i, rng.randrange(n_u), rng.randrange(n_r), T0 + dt.timedelta(minutes=rng.randrange(30))) for i in range(60)]
    q = spark.createDataFrame(req, "request_id long, student_id long, room_id long, requested_at timestamp_ntz")
    left, paid, want = dict(purse), set(), {}
    for i, u, r, _ in sorted(req, key=lambda x: (x[3], x[0])):
        want[i] = "ALREADY_PAID" if (r, u) in paid else "INSUFFICIENT_BALANCE" if left[u] < prices[r] else "OK"
        if want[i] == "OK":
            left[u] -= prices[r]
            paid.add((r, u))
    assert {r.request_id: r.decision for r in rooms.upgrade_room_access(t, q).collect()} == want


def test_settling_with_missing_keys_limits_and_weights(spark):
    rows = [(1, None, 2, 1), (2, None, 2, 1), (3, None, 2, 1), (4, "a", None, 9), (5, "b", 1, None), (6, "b", 1, 1), (6, "b", 1, 1)]
    df = spark.createDataFrame(rows, "id int, k string, lim int, w int")
    got = settle_in_order(df, ["id"], [Resource("x", ["k"], F.col("w"), F.col("lim"))], where=F.lit(True))
    assert sorted((r.id, r.accepted, r.short_x) for r in got.collect()) == [
        (1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, True, False), (6, False, True),
        (6, True, False)]
    assert settle_in_order(df.limit(0), ["id"], [Resource("x", ["k"], F.col("w"), F.col("lim"))], where=F.lit(True)).count() == 0


@pytest.mark.parametrize("fold_rows", [100_000, 12])
def test_groups_that_share_nothing_are_settled_in_one_pass(spark, monkeypatch, fold_rows):
    from studyhall.operators import settle
    monkeypatch.setattr(settle, "FOLD_ROWS", fold_rows)
    rounds = []
    real = settle.running
    monkeypatch.setattr(settle, "running", lambda *a, **k: rounds.append(1) or real(*a, **k))
    rng = random.Random(3)
    # twelve purses, one without a name, in which prices of all sizes wait for each other; some requests come twice
    rows = [(i, None if u == 3 else u, rng.randrange(9), rng.choice([1, 2, 3, 5, 8, 13, 21, None]), 40 + (u or 0))
            for i, u in enumerate(min(rng.randrange(12), rng.randrange(12)) for _ in range(150))]
    df = spark.createDataFrame(rows, "id int, u int, room int, w int, lim int")
    got = settle_in_order(df, ["id"], [Resource("once", ["room", "u"], F.lit(1), F.lit(1)), Resource("purse", ["u"], F.col("w"), F.col("lim"))],
                          where=F.col("id") % 10 != 0)
    left, have, want = {}, set(), []
    for i, u, room, w, lim in rows:
        if i % 10 == 0:
            want.append((i, False, False, False))
            continue
        once, short = (u, room) in have, w is not None and left.get(u, 0) + w > lim
        if not once and not short:
            left[u] = left.get(u, 0) + (w or 0)
            have.add((u, room))
        want.append((i, not once and not short, once, short))
    assert sorted((r.id, r.accepted, r.short_once, r.short_purse) for r in got.collect()) == sorted(want)
    assert bool(rounds) == (fold_rows == 12)


def upgraded(spark, frames, monkeypatch):
    """Outputs of a batch in which one purse pays two of four rooms; no rounds are allowed."""
    from studyhall.operators import settle
    monkeypatch.setattr(settle, "running", lambda *a, **k: pytest.fail("rounds"))
    t = frames()
    t["rooms"] = spark.createDataFrame([(1, 60.0), (2, 50.0), (3, 40.0), (4, 5.0)], "id long, p double").select(
        "id", F.col("p").cast("decimal(10,2)").alias("paid_price"))
    t["room_members"] = spark.createDataFrame([(r, 7, True, "free") for r in (1, 2, 3, 4)],
                                              "room_id long, student_id long, is_active boolean, access_tier string")
    t["wallet_transactions"] = spark.createDataFrame([(7, "deposit", "completed", 100.0)],
                                                     "user_id long, type string, status string, a double").select(
        "user_id", "type", "status", F.col("a").cast("decimal(12,2)").alias("amount"))
    q = spark.createDataFrame([(r, 7, r, T0) for r in (1, 2, 3, 4)],
                              "request_id long, student_id long, room_id long, requested_at timestamp_ntz")
    return rooms.upgrade_outputs(t, rooms.upgrade_room_access(t, q))


def test_upgraded_members_without_rounds(spark, frames, monkeypatch):
    got = upgraded(spark, frames, monkeypatch)["room_members_patches"].collect()
    assert sorted((r.room_id, r.student_id, r.access_tier) for r in got) == [(1, 7, "paid"), (3, 7, "paid")]


def test_upgrade_ledger_without_rounds(spark, frames, monkeypatch):
    got = upgraded(spark, frames, monkeypatch)["wallet_transactions"].collect()
    assert sorted((r.user_id, int(r.amount), r.reference_id) for r in got) == [(7, 40, 3), (7, 60, 1)]
