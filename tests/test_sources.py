"""Stored tables, views, SQL function, payload and array sources, JSON documents."""

import tempfile

from pyspark.sql import functions as F

from studyhall.session import configure
from studyhall.sources import tables as S
from studyhall.sources.fixtures import DOMAIN_TABLES, Fixtures, StoredFixtures


def test_materialize_and_load_with_fixed_schemas(spark, tables):
    path = tempfile.mkdtemp(prefix="studyhall-test-tables-", dir="/tmp")
    names = ["users", "sessions", "bookings", "wallet_transactions", "rooms"]
    sub = {n: tables[n] for n in names}
    S.materialize(_Keys(sub), path)
    loaded = S.load_tables(spark, path, names)
    for n in names:
        assert loaded[n].count() == tables[n].count()
        want = {f.name: f.dataType for f in S.SCHEMAS[n].fields}
        got = {f.name: f.dataType for f in loaded[n].schema.fields if not f.name.endswith("_month")}
        assert got == want, n
    # month partitions prune: a one-month filter reads one partition folder
    from studyhall.functions.exprs import prune_months
    pruned = prune_months(loaded["bookings"], "booked_at", frm="1996-01-15 00:00:00", to="1996-02-10 00:00:00")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "booked_at_month" in plan
    whole = tables["bookings"].drop("booked_at_month")  # without the month column nothing can be pruned
    assert prune_months(whole, "booked_at", frm="1996-01-15 00:00:00") is whole
    assert set(S.SCHEMAS) == set(DOMAIN_TABLES)


class _Keys(dict):
    pass


def test_views_and_wallet_balance_function(spark, tables):
    S.register_views(spark, tables, "1998-07-01 12:00:00")
    got = spark.sql("SELECT user_id, get_wallet_balance(user_id) AS b FROM (SELECT DISTINCT user_id "
                    "FROM wallet_transactions) ORDER BY user_id LIMIT 5").collect()
    from studyhall.plans.wallet import balances_by_user
    want = {r.user_id: r.balance for r in balances_by_user(tables["wallet_transactions"]).collect()}
    assert got and all(r.b == want[r.user_id] for r in got)
    assert spark.sql("SELECT count(*) AS n FROM center_analytics").first().n == tables["centers"].count()
    assert spark.sql("SELECT get_wallet_balance(-1) AS b").first().b == 0


def test_rows_from_array_and_json_payload(spark):
    df = spark.createDataFrame([(1, [5, 6], '{"k": 3}'), (2, [], '{"k": 4}')], "id long, ids array<long>, p string")
    rows = S.rows_from_array(df, "ids", keep=["id"]).collect()
    assert [(r.id, r.pos, r.item) for r in rows] == [(1, 0, 5), (1, 1, 6)]
    parsed = S.parse_json_column(df, "p", "k int").select("p_parsed.k").collect()
    assert [r.k for r in parsed] == [3, 4]
    variant = S.parse_json_column(df, "p").select(F.variant_get("p_parsed", "$.k", "int").alias("k")).collect()
    assert [r.k for r in variant] == [3, 4]


def test_json_documents_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id long, name string")
    assert S.to_json_documents(df).first().document == '{"id":1,"name":null}'


def test_operators_on_the_partitioned_deployment_layout(spark, tables):
    """The same operators over month-partitioned snapshots read by load_tables give the same rows."""
    from studyhall.jobs import maintenance
    from studyhall.plans import admin, center, discovery, teacher, wallet
    path = tempfile.mkdtemp(prefix="studyhall-test-deploy-", dir="/tmp")
    S.materialize(_Keys({n: tables[n] for n in DOMAIN_TABLES}), path)
    loaded = S.load_tables(spark, path)
    ops = [admin.recent_activity, discovery.center_upcoming_sessions, discovery.teacher_discovery,
           wallet.wallet_balance, center.center_analytics, teacher.teacher_sessions, maintenance.check_constraints,
           lambda t: admin.audit_log_search(t, frm="2024-01-05 00:00:00", to="2024-01-20 00:00:00")]
    for op in ops:
        a, b = op(tables), op(loaded)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect())), op


def test_packed_parquet_is_not_taken_for_a_small_table(spark, tmp_path):
    # Millions of narrow rows in a few MB of files: not broadcast by the guess from the files' bytes.
    path = str(tmp_path / "facts")
    spark.range(4_000_000).selectExpr("id", "id % 7 as k", "'completed' as status").write.parquet(path)
    facts = configure(spark).read.parquet(path)
    other = facts.select(F.col("id").alias("o_id"), "k")
    plan = other.join(facts.select("id", F.lit(1).alias("one")), F.col("o_id") == F.col("id"))._jdf.queryExecution()
    assert "Broadcast" not in plan.sparkPlan().toString()


def test_facts_are_clustered_by_month_before_their_texts_are_built(spark, tables, tmp_path):
    fx = StoredFixtures(spark, tables.sf_dir, str(tmp_path))
    for name, text in (("bookings", "qr_code"), ("sessions", "grade_level"), ("wallet_transactions", "description")):
        frame = Fixtures.__getitem__(fx, name)
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("RebalancePartitions")
        assert text in above and text not in below, name


def test_broadcasts_stay_small_as_measured(spark):
    """A side of 16 MB of rows, known only once it has run, is not collected on the driver."""
    few = spark.range(1_000_000).groupBy((F.col("id") * 7).alias("k")).agg(F.count("*").alias("n"))
    many = spark.range(1_500_000).groupBy((F.col("id") * 3).alias("j")).agg(F.count("*").alias("m"))
    rows = many.join(few, F.col("j") == F.col("k")).agg(F.count("*").alias("rows"))
    assert rows.collect()[0].rows == 214_286
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


def test_measured_sides_of_megabytes_are_not_broadcast(spark):
    """6 MB of rows, a dozen of which a job in rounds would hold as hash tables on the driver."""
    few = spark.range(250_000).groupBy((F.col("id") * 7).alias("k")).agg(F.count("*").alias("n"))
    many = spark.range(1_500_000).groupBy((F.col("id") * 3).alias("j")).agg(F.count("*").alias("m"))
    rows = many.join(few, F.col("j") == F.col("k")).agg(F.count("*").alias("rows"))
    assert rows.collect()[0].rows == 83_334
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan
