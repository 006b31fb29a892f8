"""A dictionary of phrases as an automaton over words: texts are walked once, at the same cost a word whatever phrases share.

States are beginnings of phrases.  Where a text leaves a phrase, a failure link
leads to the longest other beginning that the words so far end with, so no word
is looked at twice.  The dictionary is dealt into shards of bounded size; each
is built in a task and stored as one row, and goes to all tasks in turn.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .relational import saved

#: Phrases of one shard, about: what is built in a task and sent to every task at once.
SHARD = 100_000
_WORD = re.compile("[a-z0-9]+")


class Automaton:
    """Phrases, as lists of words, each with a number."""

    def __init__(self, phrases: list[tuple[int, list[str]]]):
        self.words: dict[str, int] = {}
        self.next: dict[tuple[int, int], int] = {}
        self.ends: list[list[int]] = [[]]
        parents = [(0, 0)]
        for number, phrase in phrases:
            state = 0
            for word in phrase:
                w = self.words.setdefault(word, len(self.words))
                after = self.next.get((state, w))
                if after is None:
                    after = self.next[state, w] = len(parents)
                    parents.append((state, w))
                    self.ends.append([])
                state = after
            if state:
                self.ends[state].append(number)
        self.fail, self.also = [0] * len(parents), [0] * len(parents)
        for state in self._by_depth(parents):
            parent, w = parents[state]
            at = self.fail[parent] if parent else -1
            while at > 0 and (at, w) not in self.next:
                at = self.fail[at]
            at = self.next.get((at, w), 0) if at >= 0 else 0
            self.fail[state] = at
            self.also[state] = at if self.ends[at] else self.also[at]

    @staticmethod
    def _by_depth(parents: list[tuple[int, int]]) -> list[int]:
        """States but the first, shorter beginnings first; a state's parent has a smaller number."""
        depth = [0] * len(parents)
        for state in range(1, len(parents)):
            depth[state] = depth[parents[state][0]] + 1
        return sorted(range(1, len(parents)), key=depth.__getitem__)

    def found(self, words: list[str]) -> set[int]:
        """The numbers of the phrases that stand among the words."""
        out: set[int] = set()
        state = 0
        for word in words:
            w = self.words.get(word, -1)
            if w < 0:
                state = 0
                continue
            while state and (state, w) not in self.next:
                state = self.fail[state]
            state = self.next.get((state, w), 0)
            at = state if self.ends[state] else self.also[state]
            while at and not out.issuperset(self.ends[at]):  # where these are known, so are the shorter ones behind them
                out.update(self.ends[at])
                at = self.also[at]
        return out


def _shards(entries: DataFrame, id: str, size: int) -> DataFrame:
    """shard, built: each shard's automaton and its phrases' ids and lengths, pickled; one row a shard."""
    shards = max(1, -(-entries.count() // size))
    ids = to_arrow_type(entries.schema[id].dataType)

    def build(table: pa.Table) -> pa.Table:
        known, whole = table.column(id).to_pylist(), table.column("_whole").to_pylist()
        automaton = Automaton([(n, w.split(" ")) for n, w in enumerate(whole)])
        return pa.table({"built": pa.array([pickle.dumps((automaton, pa.array(known, ids), [len(w) for w in whole]), 5)], pa.binary())})

    return saved(entries.withColumn("_shard", F.pmod(F.xxhash64("_whole"), F.lit(shards))).groupBy("_shard").applyInArrow(build, "built binary"), "automata")


def mentions(articles: DataFrame, entries: DataFrame, key: str, id: str, columns: list[str], size: int = SHARD) -> DataFrame:
    """key, id, _where, _length: the phrases, ``_whole`` with single spaces, that stand in each of the text ``columns``, once a text."""
    kind, id_kind = articles.schema[key].dataType.simpleString(), entries.schema[id].dataType
    out, schema = None, f"`{key}` {kind}, `{id}` {id_kind.simpleString()}, _where string, _length int"
    for shard in _shards(entries, id, size).toLocalIterator():
        spread = articles.sparkSession.sparkContext.broadcast(bytes(shard.built))

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            automaton, known, lengths = pickle.loads(spread.value)
            for batch in batches:
                rows, found, where = [], [], []
                for n, name in enumerate(columns):
                    for i, text in enumerate(batch.column(n + 1).to_pylist()):
                        numbers = automaton.found(_WORD.findall(text.lower())) if text else ()
                        rows += [i] * len(numbers)
                        found += numbers
                        where += [name] * len(numbers)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), known.take(pa.array(found, pa.int64())), pa.array(where, pa.string()), pa.array([lengths[n] for n in found], pa.int32())], names=[key, id, "_where", "_length"])

        now = articles.select(key, *columns).mapInArrow(run, schema)
        out = now if out is None else out.unionByName(now)
    return out if out is not None else articles.sparkSession.createDataFrame([], schema)
