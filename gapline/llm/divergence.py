"""How far the sources of a language diverge in their words, by inclusion and exclusion over supports.

Every source is a smoothed distribution over all kept terms of its language,
but a source lacks most of them.  The distance of two sources is therefore put
together from what is there: each source's terms are priced as if the other
had none of them, which a histogram of its counts is enough for; the terms
that both have are met in a join of the sparse postings and corrected; all the
others differ by a constant.  No (source, term) row with count zero is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, merged
from .words import utf8

#: A term is kept if it stands in so many documents of its language.
LEAST_DOCS = 30
#: Added to each count.
SMOOTH = 5
SCALE = 1_000_000_000
#: Terms of each source that are reported.
TOP = 50
#: (lang, source, term) counts that a task gathers before it passes them on.
GATHER = 400_000
#: Letters A-Z to lower case; the bytes outside a-z and below 0x80 to a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n, docs: partial counts of the words of whole texts, gathered within a task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(found: dict[tuple[str, str], dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for (of, by), terms in found.items():
            for at in range(0, len(keys := list(terms)), 50_000):
                some = keys[at : at + 50_000]
                counts = [terms[t] for t in some]
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(some)), pa.array([by] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[0] for c in counts]), pa.array([c[1] for c in counts])], schema=schema)
        found.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for of, by, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                terms, own = found.setdefault((of, by), {}), {}
                for word in raw.translate(_LETTERS).split():
                    own[word] = own.get(word, 0) + 1
                size -= len(terms)
                for word, n in own.items():
                    if (c := terms.get(word)) is None:
                        terms[word] = [n, 1]
                    else:
                        c[0] += n
                        c[1] += 1
                size += len(terms)
                if size > GATHER:
                    yield from flush(found)
                    size = 0
        yield from flush(found)

    named = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text))
    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n long, lang_n long: a row for each source that has a kept term; materialised.

    Words are counted whole text by whole text and added up within a task, so
    that a hot source or word is shuffled as a few rows a task.
    """
    counts = _counted(docs, lang, source, text).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("by"))  # a row a source
    return cut(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n", F.explode("by").alias("_s")).select("lang", "_s.source", "term", "_s.n", "lang_n"))


def price(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * size)), exact at any size."""
    above, below = (F.lit(SCALE).cast("decimal(19,0)") * (n + SMOOTH).cast("decimal(19,0)")), (total + SMOOTH * size).cast("decimal(19,0)")
    return F.call_function("div", above, below) + F.lit(1)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value long, rank int: distances of sources, and the terms a source has too many of.

    Part ``pair``: for each other source of the language the sum over all kept
    terms of the absolute difference in price.  Part ``term``: the ``top``
    terms of a source whose price is above the language's, with the
    difference.  Ranks go by value, the largest first, and item.

    Null text, lang and source are ''.  A source without terms is compared
    like any other; a language without kept terms gives distances of 0, a
    language with one source no pairs.  Repeated rows are documents of their
    own.  Empty tables give no rows; further columns are not read.
    """
    docs = merged(docs)
    terms = kept_terms(docs, least_docs, lang, source, text)
    every = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    sizes = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    zero = F.lit(0).cast("long")
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "support", "size", "lang_total"])
    groups = cut(groups.withColumn("none", F.when(F.col("size") > 0, price(zero, F.col("total"), F.col("size"))).otherwise(zero)))

    few = broadcast_if_small(groups.select("lang", "source", "total", "size", "none", "lang_total"), 512)
    priced = terms.join(few, ["lang", "source"]).select("lang", "source", "term", "n", "none", price(F.col("n"), F.col("total"), F.col("size")).alias("p"), price(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q"))
    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # Distances: constants, each side alone, both.
    a, b = groups.select("lang", "size", *[F.col(c).alias(f"a_{c}") for c in ("source", "none", "support")]), groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "none", "support")])
    two = a.join(broadcast_if_small(b, 512), "lang").filter("a_source != b_source")
    nothing = two.select("lang", "a_source", "b_source", ((F.col("size") - F.col("a_support") - F.col("b_support")) * F.abs(F.col("a_none") - F.col("b_none"))).alias("value"))
    histogram = cut(priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")))
    alone = histogram.withColumnRenamed("source", "a_source").join(broadcast_if_small(b, 512), "lang").filter("a_source != b_source")
    alone = alone.groupBy("lang", "a_source", "b_source").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("b_none"))).alias("value"))
    left, right = priced.select("lang", "term", *[F.col(c).alias(f"a_{c}") for c in ("source", "p", "none")]), priced.select("lang", "term", *[F.col(c).alias(f"b_{c}") for c in ("source", "p", "none")])
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = left.join(right, ["lang", "term"]).filter("a_source < b_source").groupBy("lang", "a_source", "b_source")
    both = both.agg(F.sum(gap("a_p", "b_p") - gap("a_p", "b_none") - gap("a_none", "b_p") + gap("a_none", "b_none")).alias("value"))
    turned = lambda df: df.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "value")
    both = cut(both)
    parts = nothing.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    pairs = parts.groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value")).select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return best.unionByName(pairs.withColumn("rank", F.row_number().over(ranked))).select("lang", "source", "part", "item", "value", "rank")
