"""Similar items: shared facets, hashed embeddings, nearest neighbours, re-ranking, selection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, titles
from . import classes
from .neighbors import nearest  # noqa: F401
from .relational import broadcast_if_small, saved, topk_per_group

#: What a shared value of each facet adds, and a shared outlet or critic.
WEIGHTS = {"themes": 100, "genres": 60, "modes": 24, "perspectives": 18, "studios": 10, "publishers": 6}
OUTLET, CRITIC, HIGH = 3, 2, 180
#: Fixed value: the width of hashed embeddings.
DIMENSIONS = 384
_WORD = re.compile("[a-z0-9]{2,}")
#: How much a selected item of the same group takes from those that follow.
REPEAT_PENALTY = 150


def shared_facets(anchors: DataFrame, items: DataFrame, key: str = "item") -> DataFrame:
    """anchor, candidate, score, confidence: pairs that share a genre and a theme, mode or perspective.

    ``items`` has the key and an array for each facet of WEIGHTS that is known.
    Pairs meet in an equi join on (genre, value of another facet), so that no
    pair is made that can't count; arrays come back by key afterwards.
    """
    return _shared(anchors, items, key).filter("anchor <> candidate")


def _shared(anchors: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The same with the pairs of equal keys, if they share as much."""
    facets = [f for f in WEIGHTS if f in items.columns]
    others = [f for f in ("themes", "modes", "perspectives") if f in facets]

    def entries(rows: DataFrame, name: str) -> DataFrame:
        named = lambda f: F.transform(F.coalesce(f, F.expr("cast(array() as array<string>)")), lambda v: F.concat(F.lit(f"{f}:"), v))
        values = F.concat(*map(named, others))
        return rows.select(F.col(key).alias(name), F.explode("genres").alias("_genre"), values.alias("_values")).select(name, "_genre", F.explode("_values").alias("_value"))

    pairs = entries(anchors, "anchor").join(entries(items, "candidate"), ["_genre", "_value"]).select("anchor", "candidate").distinct()
    a = anchors.select(F.col(key).alias("anchor"), *[F.col(f).alias(f"a_{f}") for f in facets])
    c = items.select(F.col(key).alias("candidate"), *[F.col(f).alias(f"c_{f}") for f in facets])
    shared = pairs.join(broadcast_if_small(a), "anchor").join(c, "candidate")
    score = sum((F.coalesce(F.size(F.array_intersect(f"a_{f}", f"c_{f}")), F.lit(0)) * WEIGHTS[f] for f in facets), F.lit(0))
    return shared.select("anchor", "candidate", score.cast("long").alias("score")).withColumn("confidence", F.when(F.col("score") >= HIGH, "high").otherwise("medium"))


class SharedFacets:
    """The pairs of ``shared_facets`` by classes of items with the same facets.

    ``scores`` has a_class, c_class, score, confidence and what either side is
    also told apart by (``a_by`` and ``c_by``, with ``a_`` and ``c_`` before
    it); ``anchors`` and ``items`` are the classes, with the items' columns
    that are carried along.
    """

    def __init__(self, anchors: DataFrame, items: DataFrame, key: str = "item", a_by: list[str] | None = None, c_by: list[str] | None = None, a_carry: list[str] | None = None, c_carry: list[str] | None = None):
        facets = [f for f in WEIGHTS if f in items.columns]
        self.anchors, self.items = classes.Classes(anchors, key, facets + (a_by or []), a_carry), classes.Classes(items, key, facets + (c_by or []), c_carry)
        found = _shared(self.anchors.kinds, self.items.kinds, "class").withColumnsRenamed({"anchor": "a_class", "candidate": "c_class"})
        for side, kinds, by in (("a", self.anchors.kinds, a_by), ("c", self.items.kinds, c_by)):
            if by:
                found = found.join(kinds.select(F.col("class").alias(f"{side}_class"), *[F.col(x).alias(f"{side}_{x}") for x in by]), f"{side}_class")
        self.scores = saved(found, "scores")

    def pairs(self, scores: DataFrame | None = None) -> DataFrame:
        """anchor, candidate and the columns of ``scores``, all or those given."""
        return classes.pairs(self.scores if scores is None else scores, self.anchors, self.items)

    def counts(self) -> DataFrame:
        return classes.counts(self.scores, self.anchors, self.items)

    def best(self, k: int) -> DataFrame:
        """anchor, candidate, score, rank."""
        return classes.best(self.scores, self.anchors, self.items, k)


@lru_cache(maxsize=1 << 17)
def _place(word: str, dimensions: int) -> tuple[int, int]:
    """A word's bucket and sign; as ``hashing.bucket`` and ``hashing.sign`` have them."""
    number = lambda text: int(sha256(text.encode()).hexdigest()[:16], 16)
    return number(word) % dimensions, -1 if number(f"{word}:sign") % 2 else 1


def embeddings(docs: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, bucket, value: signed feature hashes of the content words, of length 1; the sparse form, nothing for texts without words.

    A word that stands n times weighs 1 + 0.15 * min(n, 5).  Each row is
    embedded where it is, with words hashed once a task: made of DataFrame
    functions, this was a row a word, shuffled, and two SHA-256 for each.
    Rows that share a key are embedded apart.
    """
    kind = docs.schema[key].dataType.simpleString()
    stop = frozenset(titles.STOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, buckets, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = Counter(w for w in _WORD.findall((text or "").lower()) if w not in stop)
                if not counts:
                    continue
                places = [_place(w, dimensions) for w in counts]
                # Whole twentieths, so that sums are exact in any order.
                weight = 20 + 3 * np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 5)
                sums = np.bincount([b for b, _ in places], weight * [s for _, s in places], dimensions).astype(np.int64)
                at = np.flatnonzero(sums)
                if len(at):
                    rows.append(np.full(len(at), i))
                    buckets.append(at.astype(np.int32))
                    values.append(sums[at] / np.sqrt(float((sums[at] * sums[at]).sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(values))], names=[key, "bucket", "value"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, bucket int, value double")


def dense(sparse: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, vector array<double> of the sparse form."""
    filled = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("_m"))
    return filled.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; 0 for missing, empty or unlike vectors."""
    exact = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(exact, F.lit(0.0))))).otherwise(0.0)


def precision_at_k(neighbors: DataFrame, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """anchor, hits, precision: neighbours among the first ``k`` that share the anchor's label."""
    a, c = labels.select(F.col(key).alias("anchor"), F.col(label).alias("_a")), labels.select(F.col(key).alias("candidate"), F.col(label).alias("_c"))
    joined = neighbors.filter(F.col("rank") <= k).join(a, "anchor").join(c, "candidate")
    return joined.groupBy("anchor").agg(F.count_if(F.col("_a") == F.col("_c")).alias("hits"), F.count("*").alias("_n")).select("anchor", "hits", (F.col("hits") / F.greatest(F.lit(1), F.least(F.lit(k), F.col("_n")))).alias("precision"))


def rerank(a_words: Column, b_words: Column, telling: list[str]) -> Column:
    """Jaccard similarity of word sets, and 0.08 for each shared telling word up to five; at most 1."""
    shared = F.array_intersect(a_words, b_words)
    hits = F.size(F.filter(shared, lambda w: w.isin(*telling))) if telling else F.lit(0)
    jaccard = F.try_divide(F.size(shared).cast("double"), F.size(F.array_union(a_words, b_words)))
    return F.least(F.lit(1.0), F.coalesce(jaccard, F.lit(0.0)) + F.least(hits, F.lit(5)) * 0.08)


def pool_of(k: int) -> int:
    """Among how many of an anchor's best ``k`` are chosen: sixty for each place, 600 at least."""
    return max(60 * k, 600)


def diverse(pairs: DataFrame, k: int, anchor: str = "anchor", group: str = "group", score: str = "score", tie: str = "candidate", pool: int | None = None) -> DataFrame:
    """anchor, candidate, place: greedy selection in which each chosen candidate makes its group cost REPEAT_PENALTY more.

    The choice is sequential; it runs anchor by anchor over the best ``pool``
    candidates, which is the feature's own bound: sixty for each place, 600 at least.
    """
    best = topk_per_group(pairs, [anchor], [F.desc(score), F.asc(tie)], pool or pool_of(k))
    key, candidate = pairs.schema[anchor].dataType.simpleString(), pairs.schema[tie].dataType.simpleString()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        left = sorted(frame[[score, tie, group]].itertuples(index=False), key=lambda r: (-r[0], r[1]))
        taken: dict[str, int] = {}
        out = []
        while left and len(out) < k:
            at = max(range(len(left)), key=lambda i: (left[i][0] - REPEAT_PENALTY * taken.get(left[i][2], 0), left[i][0], -i))
            one = left.pop(at)
            taken[one[2]] = taken.get(one[2], 0) + 1
            out.append((frame[anchor].iloc[0], one[1], len(out) + 1))
        return pd.DataFrame(out, columns=["anchor", "candidate", "place"])

    return best.select(anchor, tie, group, score).groupBy(anchor).applyInPandas(choose, f"anchor {key}, candidate {candidate}, place int")


def by_lanes(pairs: DataFrame, lanes: list[tuple[str, int]], k: int, anchor: str = "anchor", lane: str = "lane", score: str = "score", tie: str = "candidate") -> DataFrame:
    """anchor, candidate, place: first up to each lane's number of its best, in the lanes' order, then the best of the rest."""
    within = topk_per_group(pairs, [anchor, lane], [F.desc(score), F.asc(tie)], k, "_n")
    table = F.create_map(*[F.lit(x) for i, (name, _) in enumerate(lanes) for x in (name, i)])
    most = F.create_map(*[F.lit(x) for name, n in lanes for x in (name, n)])
    reserved = F.col("_n") <= F.coalesce(F.try_element_at(most, F.col(lane)), F.lit(0))
    place = F.when(reserved, F.try_element_at(table, F.col(lane))).otherwise(len(lanes))
    ranked = topk_per_group(within.withColumn("_lane", place), [anchor], [F.asc("_lane"), F.desc(score), F.asc(tie)], k, "place")
    return ranked.select(F.col(anchor).alias("anchor"), F.col(tie).alias("candidate"), "place")


def first_source(*ranked: DataFrame, anchor: str = "anchor", least: int = 2) -> DataFrame:
    """For each anchor the neighbours of the first frame that has at least ``least`` for it."""
    out = None
    for rows in ranked:
        enough = rows.groupBy(anchor).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(anchor)
        some = rows.join(enough, anchor, "left_semi")
        out = some if out is None else out.unionByName(some.join(out.select(anchor).distinct(), anchor, "left_anti"))
    return out


#: Fixed values of the local scoring profile: the parts' weights, the divisor of the facet score, and what a published pair has at least.
PROFILE = {"taxonomy": 0.72, "text": 0.08, "facet": 0.05, "prototype": 0.04, "rerank": 0.08, "prior": 0.03}
DIVISOR, PUBLISHED, LEAST_TAXONOMY = 300, 0.42, 0.38


def sparse_cosine(pairs: DataFrame, sparse: DataFrame, key: str, others: DataFrame | None = None) -> DataFrame:
    """anchor, candidate, cosine of unit vectors in sparse form, the candidates' in ``others`` if given; pairs without a common bucket have none. Dense vectors are never made."""
    a = sparse.select(F.col(key).alias("anchor"), "bucket", F.col("value").alias("_a"))
    c = (sparse if others is None else others).select(F.col(key).alias("candidate"), "bucket", F.col("value").alias("_c"))
    met = pairs.select("anchor", "candidate").join(a, "anchor").join(c, ["candidate", "bucket"])
    return met.groupBy("anchor", "candidate").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("_a") * F.col("_c")))).alias("cosine"))


def final_scores(pairs: DataFrame, profile: dict[str, float] | None = None) -> DataFrame:
    """``pairs`` with taxonomy (from score) and final, where both are high enough to be published.

    Parts that ``pairs`` lacks count nothing; negative prototypes cost three tenths of their value; an adjustment is added as it is.
    """
    taxonomy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / DIVISOR))
    part = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in pairs.columns else F.lit(0.0)
    weights = profile or PROFILE
    known = pairs.withColumn("taxonomy", taxonomy)
    final = sum((F.greatest(F.lit(0.0), part(n)) * w for n, w in weights.items() if n != "taxonomy"), F.col("taxonomy") * weights["taxonomy"]) + F.least(F.lit(0.0), part("prototype")) * 0.3 + part("adjustment")
    return known.withColumn("final", final).filter((F.col("final") >= PUBLISHED) & (F.col("taxonomy") >= LEAST_TAXONOMY))


def vector_exceptions(pairs: DataFrame) -> DataFrame:
    """Pairs outside the taxonomy that are let in: text and re-rank very alike, a positive prototype, and at least one facet shared."""
    return pairs.filter("text >= 0.88 AND rerank >= 0.80 AND prototype > 0 AND shared > 0")


#: The longest fused document, and the words below which a summary is made up for it.
LONGEST_DOCUMENT, FEW_WORDS = 16_000, 60
#: Fixed value: an anchor with fewer neighbours is hidden.
LEAST_PUBLISHED = 2


def fused_documents(rows: DataFrame, fingerprint: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, title, provider_text, labels, summary) with fingerprint and fused: the parts under their headings, cut to the feature's bound.

    The summary stands in for a missing or short text.
    """
    axes = fingerprint.groupBy(key, "axis").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("_v"))
    prints = axes.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "axis", "_v"))), "\n").alias("fingerprint"))
    short = F.col("provider_text").isNull() | (F.size(F.split(F.trim("provider_text"), r"\s+")) < FEW_WORDS)
    part = lambda name, text: F.when(F.length(F.trim(text)) > 0, F.concat(F.lit(f"[{name}]\n"), F.trim(text)))
    parts = [part("title", F.col("title")), part("fingerprint", F.col("fingerprint")), part("labels", F.col("labels")), part("provider_text", F.col("provider_text")), part("synthetic_summary", F.when(short, F.col("summary")))]
    return rows.join(prints, key, "left").withColumn("fused", F.substring(F.concat_ws("\n\n", *parts), 1, LONGEST_DOCUMENT))


def nearest_texts(anchors: DataFrame, docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """anchor, candidate, score, rank: the ``k`` nearest others by the cosine of the hashed embeddings, rounded to six places, ties by candidate.

    Equal texts are embedded and compared once; they are nearest to each other.
    """
    asking, listed = classes.Classes(anchors, key, [text]), classes.Classes(docs, key, [text])
    vectors = saved(dense(embeddings(listed.kinds, "least", text), "least"), "vectors")
    mine = listed.kinds.select("class", "least", text)
    own = asking.kinds.select(F.col("class").alias("a_class"), F.col(text).alias("_t")).join(mine, F.col("_t").eqNullSafe(F.col(text))).select("a_class", F.col("class").alias("c_class"), "least")
    asked = saved(vectors.join(own, "least"), "asked")
    # By the classes' smallest keys, so that ties are those of the items.
    near = nearest(asked.select("least", "vector"), vectors, k, "least", "vector")
    met = near.join(asked.select(F.col("least").alias("anchor"), "a_class"), "anchor").join(mine.select(F.col("least").alias("candidate"), F.col("class").alias("c_class")), "candidate")
    found = met.select("a_class", "c_class", F.col("similarity").alias("score")).unionByName(asked.select("a_class", "c_class", F.lit(1.0).alias("score")))
    return classes.best(found, asking, listed, k)


def embedded(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """kind, key, bucket, value: the hashed embeddings of each document column."""
    out = None
    for c in columns:
        found = embeddings(docs, key, c).select(F.lit(c).alias("kind"), key, "bucket", "value")
        out = found if out is None else out.unionByName(found)
    return out


def pools(sources: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """anchor, candidate, pools: the union of each source's best (anchor, candidate, score), so many an anchor."""
    every = None
    for name, (pairs, k) in sources.items():
        best = topk_per_group(pairs.select("anchor", "candidate", "score"), ["anchor"], [F.desc("score"), F.asc("candidate")], k).select("anchor", "candidate", F.lit(name).alias("pool"))
        every = best if every is None else every.unionByName(best)
    return every.groupBy("anchor", "candidate").agg(F.array_sort(F.collect_set("pool")).alias("pools"))


def lane_fit(fingerprint: DataFrame, signals: dict[str, tuple[str, list[str]]], conflicts: list[tuple[str, str | None]], least: int, key: str) -> DataFrame:
    """key, hits, conflicts, fits: how many of a lane's signals (axis, values) a fingerprint has, and whether anything speaks against it."""
    hit = F.lit(None).cast("string")
    for name, (axis, values) in signals.items():
        hit = F.when((F.col("axis") == axis) & F.col("value").isin(*values), name).otherwise(hit)
    against = F.lit(False)
    for axis, value in conflicts:
        against = against | ((F.col("axis") == axis) & (F.lit(True) if value is None else F.col("value") == value))
    found = fingerprint.groupBy(key).agg(F.countDistinct(hit).alias("hits"), F.bool_or(against).alias("conflicts"))
    return found.withColumn("fits", (F.col("hits") >= least) & ~F.col("conflicts"))


def publish(anchors: DataFrame, scored: DataFrame, k: int, least: int = LEAST_PUBLISHED) -> tuple[DataFrame, DataFrame]:
    """The neighbours (anchor, candidate, final, rank) of anchors that have enough, and per anchor status, audit_state, published."""
    best = topk_per_group(scored, ["anchor"], [F.desc("final"), F.asc("candidate")], k, "rank")
    counts = anchors.join(best.groupBy("anchor").agg(F.count("*").alias("published")), "anchor", "left").withColumn("published", F.coalesce("published", F.lit(0).cast("long")))
    hidden = F.col("published") < least
    state = F.when(F.col("published") == 0, "insufficient_signal").when(hidden, "conflict_ambiguous")
    run = counts.select("anchor", F.when(hidden, "hidden").otherwise("computed").alias("status"), state.alias("audit_state"), "published")
    return best.join(run.filter("status = 'computed'").select("anchor"), "anchor", "left_semi"), run


def mark_dirty(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """``rows`` (…, dirty, reasons) with new reasons behind those there are, each once; changed tells rows that have to be written."""
    new = F.transform(F.array(*map(F.lit, reasons)), labels.token)
    merged = labels.ordered_union(F.col("reasons"), new)
    marked = rows.withColumn("_merged", merged).withColumn("changed", ~F.col("dirty") | (F.col("_merged") != F.col("reasons")))
    return marked.withColumn("reasons", F.col("_merged")).withColumn("dirty", F.lit(True)).drop("_merged")


def explanation(reasons: Column, final: Column, relationship: Column, components: dict[str, Column]) -> Column:
    """The stored payload of a pair as JSON: three reasons, confidence, relationship, rounded components."""
    confidence = F.when(final >= 0.82, "high").when(final >= 0.70, "medium").otherwise("low")
    return F.to_json(F.struct(F.slice(reasons, 1, 3).alias("match_reasons"), confidence.alias("confidence"), relationship.alias("relationship_type"), F.struct(*[F.round(c, 4).alias(n) for n, c in components.items()]).alias("components")))


def profiles(spark: SparkSession) -> DataFrame:
    """The scoring profiles: name, the parts' weights, divisor, published, least_taxonomy."""
    other = {"taxonomy": 0.5, "text": 0.2, "facet": 0.1, "prototype": 0.05, "rerank": 0.1, "prior": 0.05}
    rows = [(n, *p.values(), DIVISOR, out, low) for n, p, out, low in (("local", PROFILE, PUBLISHED, LEAST_TAXONOMY), ("vectors", other, 0.5, 0.3))]
    return spark.createDataFrame(rows, "name string, taxonomy double, text double, facet double, prototype double, rerank double, prior double, divisor int, published double, least_taxonomy double")
