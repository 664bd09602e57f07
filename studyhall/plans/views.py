"""The SQL surface (SRC-03, SURVEY 2.15): the domain tables, the three declared views and the
``get_wallet_balance`` function, queried with ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.constants import SESSION_AS_OF
from studyhall.operators.prefix import running_count
from studyhall.sources.tables import register_views


def center_analytics_view(t, *, as_of=SESSION_AS_OF) -> DataFrame:
    """The ``center_analytics`` view read through SQL."""
    spark = t["centers"].sparkSession
    register_views(spark, t, as_of)
    return spark.sql("SELECT * FROM center_analytics")


def wallet_balance_function(t, *, as_of=SESSION_AS_OF) -> DataFrame:
    """``get_wallet_balance(user_id)`` for every user with ledger rows (Catalyst turns the
    function's correlated subquery into an aggregate joined back)."""
    spark = t["centers"].sparkSession
    register_views(spark, t, as_of)
    return spark.sql("SELECT user_id, get_wallet_balance(user_id) AS balance "
                     "FROM (SELECT DISTINCT user_id FROM wallet_transactions)")


def register_room_content(spark, t) -> None:
    """The SQL table function ``student_room_content(student, room)`` (Q-26): the items of an active room in their order, as
    an active member of it sees them. The items' places in their rooms are a view, counted without gathering a room."""
    items = t["content_items"]
    placed = running_count(items, ["room_id"], [F.asc_nulls_last("sort_order"), F.asc_nulls_last("created_at"), F.col("id")],
                           "position")
    placed.createOrReplaceTempView("placed_content_items")
    for name in ("rooms", "room_members"):
        t[name].createOrReplaceTempView(name)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION student_room_content(p_student BIGINT, p_room BIGINT)
        RETURNS TABLE (access_tier STRING, position BIGINT, content_id BIGINT, type STRING, title STRING, is_free BOOLEAN,
                       url STRING, thumbnail_url STRING)
        RETURN SELECT m.access_tier, i.position, i.id, i.type, i.title, i.is_free,
                      CASE WHEN i.is_free OR m.access_tier = 'paid' THEN i.url END,
                      CASE WHEN i.is_free OR m.access_tier = 'paid' THEN i.thumbnail_url END
               FROM room_members m JOIN rooms r ON r.id = m.room_id AND r.is_active
               JOIN placed_content_items i ON i.room_id = m.room_id
               WHERE m.student_id = p_student AND m.room_id = p_room AND m.is_active""")


def member_room_content(t, requests: DataFrame | None = None) -> DataFrame:
    """Q-26 per member: the content list of every request (student_id, room_id), by default of every membership, through the table
    function joined laterally. Requests of others, of inactive members and for inactive rooms have no row."""
    spark = t["room_members"].sparkSession
    register_room_content(spark, t)
    asked = requests if requests is not None else t["room_members"].select("student_id", "room_id")
    asked.createOrReplaceTempView("room_content_requests")
    return spark.sql("""SELECT q.student_id, q.room_id, c.* FROM room_content_requests q,
                        LATERAL student_room_content(q.student_id, q.room_id) c""")
