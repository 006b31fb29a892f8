"""Pairs by classes: items that are equal in all that a pair is judged by are one class.

Classes are paired and judged once, however many items they have; the items
come in at the end, in one join that makes each pair and moves none of them
again, or not at all where pairs are only counted or few of them are wanted.
Where every item is a class of its own, this is the plain join of the items.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import saved, topk_per_group

#: Members of a class that meet its partners in one task, and pairs that a task makes, both roughly.
CHUNK, TASK_PAIRS = 4096, 8_000_000


class Classes:
    """``kinds``: class, columns, n, least (the smallest key); ``members``: key, class, chunk and the columns carried along.

    Rows are of one class if they are equal in ``columns``, nulls taken as
    values.  Rows without a key are left out.
    """

    def __init__(self, rows: DataFrame, key: str, columns: list[str], carry: list[str] | None = None):
        self.key, self.columns, self.carry = key, columns, carry or []
        known = rows.filter(F.col(key).isNotNull())
        self.kinds = saved(known.groupBy(*columns).agg(F.count("*").alias("n"), F.min(key).alias("least")).withColumn("class", F.monotonically_increasing_id()), "classes")
        named = self.kinds.select("class", F.ceil(F.col("n") / CHUNK).alias("_chunks"), *[F.col(c).alias(f"_k_{c}") for c in columns])
        equal = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns]
        met = known.select(key, *dict.fromkeys([*columns, *self.carry])).join(named, equal)
        self.members = saved(met.select(key, "class", F.pmod(F.xxhash64(key), F.col("_chunks")).alias("chunk"), *self.carry), "members")

    def only(self, keep: str) -> Classes:
        """The same classes with those members alone that meet a condition, so that anchors and candidates share their classes' numbers."""
        some = copy(self)
        some.members = self.members.filter(keep)
        sizes = some.members.groupBy("class").agg(F.count("*").alias("n"), F.min(self.key).alias("least"))
        some.kinds = saved(self.kinds.drop("n", "least").join(sizes, "class"), "classes")
        return some

    def first(self, k: int) -> DataFrame:
        """key, class: the ``k`` smallest keys of each class."""
        return topk_per_group(self.members.select(self.key, "class"), ["class"], [F.asc(self.key)], k)


def pairs(found: DataFrame, anchors: Classes, candidates: Classes) -> DataFrame:
    """anchor, candidate, what the two sides carry (``a_`` and ``c_`` before it) and the columns of ``found`` (a_class, c_class, ...): all pairs of items, but none with itself."""
    a, c = anchors.kinds.select(F.col("class").alias("a_class"), F.col("n").alias("_a")), candidates.kinds.select(F.col("class").alias("c_class"), F.col("n").alias("_c"))
    total = found.select("a_class", "c_class").join(a, "a_class").join(c, "c_class").agg(F.sum(F.col("_a") * F.col("_c").cast("double"))).first()[0] or 0
    parts = int(min(4000, max(1, -(-total // TASK_PAIRS), found.sparkSession.sparkContext.defaultParallelism)))
    left = candidates.members.select(F.col(candidates.key).alias("candidate"), F.col("class").alias("c_class"), "chunk", *[F.col(x).alias(f"c_{x}") for x in candidates.carry])
    mine = anchors.members.select(F.col(anchors.key).alias("anchor"), F.col("class").alias("a_class"), *[F.col(x).alias(f"a_{x}") for x in anchors.carry])
    chunks = candidates.kinds.select(F.col("class").alias("c_class"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / CHUNK) - 1)).alias("chunk"))
    right = found.join(chunks, "c_class").join(mine, "a_class").drop("a_class")
    both = left.repartition(parts, "c_class", "chunk").join(right.repartition(parts, "c_class", "chunk"), ["c_class", "chunk"])
    return both.filter("anchor <> candidate").drop("c_class", "chunk")


def counts(found: DataFrame, anchors: Classes, candidates: Classes) -> DataFrame:
    """``found`` with pairs: how many ``pairs`` would make of a row, where there are any."""
    a, c = anchors.kinds.select(F.col("class").alias("a_class"), F.col("n").alias("_a")), candidates.kinds.select(F.col("class").alias("c_class"), F.col("n").alias("_c"))
    mine, other = anchors.members.select(F.col(anchors.key).alias("_key"), F.col("class").alias("a_class")), candidates.members.select(F.col(candidates.key).alias("_key"), F.col("class").alias("c_class"))
    same = mine.join(other, "_key").groupBy("a_class", "c_class").agg(F.count("*").alias("_same"))
    every = found.join(a, "a_class").join(c, "c_class").join(same, ["a_class", "c_class"], "left")
    return every.withColumn("pairs", F.col("_a") * F.col("_c") - F.coalesce("_same", F.lit(0))).filter("pairs > 0").drop("_a", "_c", "_same")


def handed_out(lists: DataFrame, anchors: Classes, k: int) -> DataFrame:
    """anchor, candidate, score, rank: each anchor's ``k`` best, from the k + 1 best (a_class, candidate, score) of its class, in which it may stand itself."""
    best = lists.groupBy(F.col("a_class").alias("class")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_minus"), "candidate", "score"))).alias("_all"))
    mine = anchors.members.select(F.col(anchors.key).alias("anchor"), "class").join(best, "class")
    others = F.slice(F.filter("_all", lambda x: x["candidate"] != F.col("anchor")), 1, k)
    return mine.select("anchor", F.posexplode(others).alias("_n", "_x")).select("anchor", "_x.candidate", "_x.score", (F.col("_n") + 1).alias("rank"))


def best(found: DataFrame, anchors: Classes, candidates: Classes, k: int) -> DataFrame:
    """anchor, candidate, score, rank: each anchor's ``k`` best of the pairs of ``found`` (a_class, c_class, score), ties by candidate.

    The k + 1 best items of a class of anchors are in the k + 1 best classes,
    ties by the smallest member, and not in those behind k + 1 better items.
    """
    sized = found.select("a_class", "c_class", "score").join(candidates.kinds.select(F.col("class").alias("c_class"), "n", "least"), "c_class")
    some = topk_per_group(sized, ["a_class"], [F.desc("score"), F.asc("least")], k + 1)
    before = F.sum("n").over(Window.partitionBy("a_class").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(Window.partitionBy("a_class", "score"))
    near = some.withColumn("_before", before).filter(F.col("_before") <= k).select("a_class", "c_class", "score")
    first = candidates.first(k + 1).select(F.col(candidates.key).alias("candidate"), F.col("class").alias("c_class"))
    return handed_out(topk_per_group(near.join(first, "c_class"), ["a_class"], [F.desc("score"), F.asc("candidate")], k + 1), anchors, k)
