"""Pairs of classes, and the pairs of their members, without a hot class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Members of a class that are put into one block; blocks meet each other, so that no class is capped.
BLOCK = 2000


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``a < b``: the pairs of ids of the class pairs (``class_a``, ``class_b``); a class paired with itself gives its members' pairs.

    members: ``class_id`` and ``id``, of which each id stands once. The members of a class are lists of about
    :data:`BLOCK` ids, and a pair of lists is expanded where it lies, so that no row of a pair is shuffled.
    """
    sizes = members.groupBy("class_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    lists = members.join(sizes, "class_id").select("class_id", "blocks", block, "id").groupBy("class_id", "blocks", "block").agg(F.collect_list("id").alias("ids"))
    lists = written(lists, "lists")
    left = lists.select(F.col("class_id").alias("class_a"), F.col("block").alias("i"), F.col("ids").alias("ids_a"))
    right = lists.select(F.col("class_id").alias("class_b"), F.col("block").alias("j"), F.col("ids").alias("ids_b"))
    both = pairs.select("class_a", "class_b").join(left, "class_a").join(right, "class_b").where("class_a <> class_b or i <= j")
    each = both.select((F.col("class_a").eqNullSafe(F.col("class_b")) & (F.col("i") == F.col("j"))).alias("same"), F.explode("ids_a").alias("x"), "ids_b")
    each = each.select("same", "x", F.explode("ids_b").alias("y")).where("not same or x < y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
