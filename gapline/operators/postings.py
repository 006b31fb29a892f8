"""The best partners of many anchors by shared values, from posting lists, without making the pairs.

Items are dealt into chunks and anchors into blocks; where the two meet, the
chunk's items are listed by value, and an anchor adds up the lists of its own
values, the heaviest first.  Once its best few are so good that the values
still to come can lift no other item among them, lists are only looked up for
items that were met, and those that cannot catch up are dropped.  A value that
a third of all items have is a list of a chunk's length at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classes import Classes, handed_out
from .relational import saved, topk_per_group
from .similarity import WEIGHTS

#: Items of a chunk and anchors of a block.
CHUNK, BLOCK = 8192, 2048
#: A partner shares a value of GATE and of one of NEEDED.
GATE, NEEDED = "genres", ("themes", "modes", "perspectives")


class Lists:
    """A chunk's items by value: ``of[facet][value]`` has the positions of the items that have it, each once."""

    def __init__(self, columns: dict[str, list]):
        self.size = len(next(iter(columns.values())))
        self.of: dict[str, dict[str, np.ndarray]] = {}
        for facet, rows in columns.items():
            found: dict[str, list[int]] = {}
            for i, values in enumerate(rows):
                for v in set(values or ()):
                    if v is not None:
                        found.setdefault(v, []).append(i)
            self.of[facet] = {v: np.array(at, np.int64) for v, at in found.items()}

    def allowed(self, anchor: dict[str, list]) -> np.ndarray:
        """Which items share what a partner has to share."""
        gate, needed = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for facet, flags in [(GATE, gate), *[(f, needed) for f in NEEDED]]:
            for v in anchor.get(facet) or ():
                if (at := self.of.get(facet, {}).get(v)) is not None:
                    flags[at] = True
        return gate & needed

    def best(self, anchor: dict[str, list], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best items, ties by position."""
        lists = sorted(((WEIGHTS[f], at) for f, values in anchor.items() for v in set(values or ()) if (at := self.of.get(f, {}).get(v)) is not None), key=lambda x: (-x[0], len(x[1])))
        allowed = self.allowed(anchor)
        score, left, met = np.zeros(self.size, np.int64), sum(w for w, _ in lists), None
        for n, (weight, at) in enumerate(lists):
            left -= weight
            if met is None:
                score[at] += weight
                some = np.flatnonzero(allowed & (score > 0)) if n >= 1 or len(lists) == 1 else ()
                if len(some) > k and (least := np.partition(score[some], -k)[-k]) > left:
                    met = some[score[some] + left >= least]  # others can't reach the k-th best any more
            else:
                score[met[np.isin(met, at, assume_unique=True)]] += weight
                least = np.partition(score[met], -k)[-k] if len(met) > k else 0
                met = met[score[met] + left >= least]
        met = np.flatnonzero(allowed) if met is None else met
        first = met[np.argsort(-score[met], kind="stable")[:k]]
        return first, score[first]


def top_shared(anchors: DataFrame, items: DataFrame, k: int, key: str = "item") -> DataFrame:
    """anchor, candidate, score, rank: of the pairs that ``similarity.shared_facets`` has, each anchor's ``k`` best, ties by candidate.

    Anchors with the same facets look for partners once, among the k + 1
    smallest keys of each class of items with the same facets.  Each of these
    goes to as many blocks of anchors as there are, and each task gives k + 1
    rows a class of anchors at most.  Null arrays and values share nothing.
    """
    facets = [f for f in WEIGHTS if f in items.columns]
    asking, listed = Classes(anchors, key, facets), Classes(items, key, facets)
    some = saved(listed.first(k + 1).join(listed.kinds.select("class", *facets), "class").drop("class"), "listed")
    blocks, chunks = max(1, -(-asking.kinds.count() // BLOCK)), max(1, -(-some.count() // CHUNK))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asking.kinds.select("class", *facets).withColumn("_block", number("class", blocks)).withColumn("_chunk", each(chunks))
    c = some.withColumn("_chunk", number(key, chunks)).withColumn("_block", each(blocks))
    kind = items.schema[key].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by(key)
        lists = Lists({f: right.column(f).to_pylist() for f in facets}) if right.num_rows else None
        rows = {f: left.column(f).to_pylist() for f in facets}
        out: list[tuple[np.ndarray, np.ndarray]] = [lists.best({f: rows[f][i] for f in facets}, k + 1) for i in range(left.num_rows if lists else 0)]
        whose = np.repeat(np.arange(len(out)), [len(f) for f, _ in out])
        found, score = (np.concatenate([x[n] for x in out]) if out else np.zeros(0, np.int64) for n in (0, 1))
        return pa.table({"a_class": left.column("class").take(pa.array(whose)), "candidate": right.column(key).take(pa.array(found)), "score": score})

    near = a.groupBy("_block", "_chunk").cogroup(c.groupBy("_block", "_chunk")).applyInArrow(meet, f"a_class long, candidate {kind}, score long")
    return handed_out(topk_per_group(near, ["a_class"], [F.desc("score"), F.asc("candidate")], k + 1), asking, k)
