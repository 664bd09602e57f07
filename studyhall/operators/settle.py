"""Settling a batch of requests in order against shared limits, as if they came one by one (JOB-01, JOB-09).

A request takes ``weight`` from each of its resources (a seat of a session, money of a purse, the one booking a student may
have of a session) and passes if, after the requests that passed before it, every resource still holds enough. A refused request
takes nothing. Whether one passes depends on all earlier ones that share a resource with it, so a running total over
all requests is not enough: it would count those that were refused.

1. **Slack first.** A resource whose whole demand fits its limit can refuse nobody: one aggregate per resource. Requests
   whose resources are all slack pass at once; only the others, the tight ones, go on.
2. **One pass per group.** If one resource's keys are among those of every other one (a student's purse, a room once per student),
   requests of different groups of these keys share nothing: each group of up to FOLD_ROWS tight requests is walked through once in order,
   with the sums taken so far as the only state.
3. **Rounds.** Over the other tight requests two running totals per resource, in request order: what passed before and what is still
   undecided before. A request passes if it fits even when all undecided ones before it pass; it is refused if
   it does not fit even when all of them are refused. The earliest undecided request is always decided, a crowded session or
   purse takes two or three rounds; more only as far as undecided requests wait for each other across resources.
4. **Codes.** After the rounds a last pass tells for each refused request which resources were short when its turn came.

Running totals are the skew-safe ones of ``operators.prefix``: no task holds a hot key; the order is cut into chunks once, for
all resources and rounds. Each round ends with a stored table.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyhall.operators.prefix import in_chunks, running
from studyhall.session import stored


# Tight requests of one group that one task walks through; larger groups are settled in rounds, spread over all tasks.
FOLD_ROWS = 100_000


@dataclass(frozen=True)
class Resource:
    """``limit`` (NULL: none) is shared by all requests equal on ``keys`` (NULL is a key like any other); a request needs
    ``weight`` >= 0 of it (NULL: takes nothing and is never short)."""
    name: str
    keys: Sequence[str]
    weight: Column
    limit: Column


def _all(conditions, empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(empty))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _one_pass(rows: DataFrame, columns: Sequence[str], by: Sequence[Column], common: Sequence[str], active: Sequence[Resource],
              resources: Sequence[Resource]) -> DataFrame:
    """Tight requests settled by walking through each group of equal ``common`` keys in order."""
    names, names_all = [r.name for r in active], [r.name for r in resources]
    inner = {r.name: [k for k in r.keys if k not in common] for r in active}
    columns, common = list(columns), list(common)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, {}
        for batch in batches:
            keys = [*zip(*(batch.column(k).to_pylist() for k in common))]
            told = {x: [] for x in ["accepted", *names]}
            cells = [[batch.column(f"_{c}_{n}").to_pylist() for c in ("tight", "w", "lim")]
                     + [[*zip(*(batch.column(k).to_pylist() for k in inner[n]))] if inner[n] else [()] * len(keys)] for n in names]
            for i, key in enumerate(keys):
                if key != group:
                    group, taken = key, {n: defaultdict(int) for n in names}
                ok = True
                for n, (tight, w, lim, at) in zip(names, cells):
                    short = tight[i] and w[i] is not None and taken[n][at[i]] + w[i] > lim[i]
                    told[n].append(short)
                    ok = ok and not short
                told["accepted"].append(ok)
                if ok:
                    for n, (tight, w, _, at) in zip(names, cells):
                        if tight[i] and w[i] is not None:
                            taken[n][at[i]] += w[i]
            never = pa.array([False] * len(keys), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(told["accepted"], pa.bool_())]
                + [pa.array(told[n], pa.bool_()) if n in told else never for n in names_all],
                [*columns, "accepted", *[f"short_{n}" for n in names_all]])

    schema = T.StructType([*rows.select(*columns).schema.fields, *[
        T.StructField(c, T.BooleanType()) for c in ["accepted", *[f"short_{n}" for n in names_all]]]])
    return rows.repartition(*common).sortWithinPartitions(*common, *by).mapInArrow(walk, schema)


def settle_in_order(df: DataFrame, order: Sequence[str], resources: Sequence[Resource], where: Column) -> DataFrame:
    """``df`` with ``accepted`` and, per resource, ``short_<name>``: it had too little left at the request's turn.

    Only rows for which ``where`` holds take part; the others are not accepted and never short. Rows that are equal in
    ``order`` are taken in any one order, the same in all rounds.
    """
    columns = df.columns
    base = stored(df.select("*", F.coalesce(where, F.lit(False)).alias("_part")))
    shorts = [F.lit(False).alias(f"short_{r.name}") for r in resources]
    apart = base.filter(~F.col("_part")).select(*columns, F.lit(False).alias("accepted"), *shorts)
    live = base.filter("_part").select("*", F.monotonically_increasing_id().alias("_row"), *[
        r.weight.alias(f"_w_{r.name}") for r in resources], *[r.limit.alias(f"_lim_{r.name}") for r in resources])
    # Each resource's whole demand, joined to its requests.
    for r in resources:
        demand = live.groupBy(*[F.col(k).alias(f"_d_{k}") for k in r.keys]).agg(F.sum(f"_w_{r.name}").alias("_demand"))
        same = _all(F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in r.keys)
        tight = F.coalesce(F.col("_demand") > F.col(f"_lim_{r.name}"), F.lit(False))
        live = live.join(demand, same, "left").withColumn(f"_tight_{r.name}", tight).drop(
            "_demand", *[f"_d_{k}" for k in r.keys])
    by = [F.col(o) for o in order] + [F.col("_row")]
    live = stored(live.withColumn("_state", F.lit(0)))
    tight_row = _any(F.col(f"_tight_{r.name}") for r in resources)
    done = apart.unionByName(live.filter(~tight_row).select(*columns, F.lit(True).alias("accepted"), *shorts))
    n_tight = live.agg(*[F.count_if(f"_tight_{r.name}").alias(r.name) for r in resources]).first()
    active = [r for r in resources if n_tight[r.name]]
    if not active:
        return done
    rows = live.filter(tight_row)
    common = next((r.keys for r in active if all(set(r.keys) <= set(o.keys) for o in active)), None)
    if common is not None:
        large = stored(rows.groupBy(*[F.col(k).alias(f"_d_{k}") for k in common]).count().filter(F.col("count") > FOLD_ROWS).drop("count"))
        if large.isEmpty():
            return done.unionByName(_one_pass(rows, columns, by, common, active, resources))
        same = _all(F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in common)
        done = done.unionByName(_one_pass(rows.join(large, same, "left_anti"), columns, by, common, active, resources))
        rows = rows.join(large, same, "left_semi")
    # Chunks of the request order, the same for all resources and rounds.
    rows = in_chunks(rows, [], by)
    kept = rows.columns

    def totals(rows: DataFrame) -> DataFrame:
        for r in active:
            w = F.coalesce(F.col(f"_w_{r.name}"), F.lit(0))
            rows = running(rows, [f"_tight_{r.name}", *r.keys], by, {
                f"_used_{r.name}": ("sum", F.when(F.col("_state") > 0, w)),
                f"_open_{r.name}": ("sum", F.when(F.col("_state") == 0, w))}, exclusive=True)
        return rows

    def short(r: Resource, before: Column) -> Column:
        return F.col(f"_tight_{r.name}") & F.coalesce(before + F.col(f"_w_{r.name}") > F.col(f"_lim_{r.name}"), F.lit(False))

    def used(r: Resource) -> Column:
        return F.col(f"_used_{r.name}")

    while True:
        sure = _all(~short(r, used(r) + F.col(f"_open_{r.name}")) for r in active)
        out = _any(short(r, used(r)) for r in active)
        state = F.when(F.col("_state") != 0, F.col("_state")).when(sure, 1).when(out, -1).otherwise(0)
        rows = stored(totals(rows).withColumn("_state", state).select(*kept))
        if rows.filter("_state = 0").isEmpty():
            break
    return done.unionByName(totals(rows).select(
        *columns, (F.col("_state") > 0).alias("accepted"),
        *[(short(r, used(r)) if r in active else F.lit(False)).alias(f"short_{r.name}") for r in resources]))
