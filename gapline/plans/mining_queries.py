"""Queries on similarity, taxonomy and linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles
from ..operators import classes, linking, neighbors, postings, relational, resolving, similarity, taxonomy
from ..sources import bindings as b
from .registry import query, views
from .series_queries import _STOP


def facets(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return b.items(spark, d).select("item", F.array("type").alias("genres"), titles.words(F.col("title")).alias("themes"), F.array("brand").alias("modes"), *columns)


_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_FACETS = f"f AS (SELECT item, [type] AS genres, {_WORDS.format('title')} AS themes, [brand] AS modes FROM items)"
_SHARED = f"""+{_FACETS}, p AS (SELECT a.item AS anchor, c.item AS candidate, len(list_intersect(a.genres, c.genres)) AS g, len(list_intersect(a.themes, c.themes)) AS t, len(list_intersect(a.modes, c.modes)) AS m FROM f a JOIN f c ON a.item <> c.item WHERE a.item % 50 = 0),
    s AS (SELECT anchor, candidate, CAST(t * 100 + g * 60 + m * 24 AS BIGINT) AS score FROM p WHERE g > 0 AND (t > 0 OR m > 0))"""


@query("TAX-05_shared_facets", views("items", then=_SHARED + " SELECT anchor, candidate, score, CASE WHEN score >= 180 THEN 'high' ELSE 'medium' END AS confidence FROM s"))
def shared_facets(spark, d):
    rows = facets(spark, d)
    return similarity.shared_facets(rows.filter("item % 50 = 0"), rows)


def facet_classes(spark, d, a_by=None, c_by=None, a_carry=None, c_carry=None) -> similarity.SharedFacets:
    """The same pairs by classes; items have also brand, title, released, size and price."""
    rows = facets(spark, d, "brand", "title", "type", "released", "size", "price")
    return similarity.SharedFacets(rows.filter("item % 50 = 0"), rows, a_by=a_by, c_by=c_by, a_carry=a_carry, c_carry=c_carry)


def dearest(spark, d, column: str, k: int) -> DataFrame:
    """anchor, candidate, score, rank: the ``k`` dearest others that are equal in ``column``."""
    items = b.items(spark, d).select("item", column, "price")
    asking, listed = classes.Classes(items.filter("item % 50 = 0"), "item", [column]), classes.Classes(items, "item", [column, "price"])
    found = asking.kinds.select(F.col("class").alias("a_class"), column).join(listed.kinds.select(F.col("class").alias("c_class"), column, F.col("price").alias("score")), column)
    return classes.best(found, asking, listed, k)


@query("SRT-05_top_similar", views("items", then=_SHARED + " SELECT anchor, candidate, score, CAST(row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"))
def top_similar(spark, d, k=5):
    rows = facets(spark, d)
    return postings.top_shared(rows.filter("item % 50 = 0"), rows, k)


@query("SRT-05_top_of_all", views("items", then=_SHARED.replace(" WHERE a.item % 50 = 0", "") + " SELECT anchor, candidate, score, CAST(row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"))
def top_of_all(spark, d):
    """Every item is an anchor."""
    rows = facets(spark, d)
    return postings.top_shared(rows, rows, 5)


@query("SRT-06_diverse")
def diverse(spark, d):
    k, pool = 5, similarity.pool_of(5)
    best = facet_classes(spark, d).best(pool)
    return similarity.diverse(best.join(b.items(spark, d).select(F.col("item").alias("candidate"), F.col("brand").alias("group")), "candidate"), k)


@query("SRT-08_lanes", views("items", then=_SHARED + f""", l AS (SELECT s.*, i.brand AS lane FROM s JOIN items i ON s.candidate = i.item), n AS (SELECT *, row_number() OVER (PARTITION BY anchor, lane ORDER BY score DESC, candidate) AS n FROM l),
    q AS (SELECT *, CASE WHEN lane = 'Brand#11' AND n <= 2 THEN 0 WHEN lane = 'Brand#23' AND n <= 1 THEN 1 ELSE 2 END AS o FROM n WHERE n <= 6)
    SELECT anchor, candidate, CAST(row_number() OVER (PARTITION BY anchor ORDER BY o, score DESC, candidate) AS INTEGER) AS place FROM q QUALIFY place <= 6"""))
def lanes(spark, d):
    pairs = shared_facets(spark, d).join(b.items(spark, d).select(F.col("item").alias("candidate"), F.col("brand").alias("lane")), "candidate")
    return similarity.by_lanes(pairs, [("Brand#11", 2), ("Brand#23", 1)], 6)


@query("JOI-14_overlap", views("items", then=f"""+t AS (SELECT DISTINCT type FROM items), w AS (SELECT item, unnest(list_distinct({_WORDS.format('title')})) AS v FROM items), k AS (SELECT type, unnest(list_distinct({_WORDS.format("type || ' green forest'")})) AS v FROM t)
    SELECT type, item, count(*) AS shared FROM k JOIN w ON k.v = w.v GROUP BY 1, 2"""))
def overlap(spark, d):
    items = b.items(spark, d)
    kinds = items.select("type").distinct().withColumn("wanted", titles.words(F.concat("type", F.lit(" green forest"))))
    return relational.overlap_join(kinds, items.select("item", titles.words(F.col("title")).alias("words")), "type", "item", "wanted", "words")


_KNN = """a AS (SELECT vec_id AS anchor, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS candidate, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label AS c_label FROM embeddings),
    n AS (SELECT anchor, candidate, label, c_label, round(list_cosine_similarity(a.v, c.v), 6) AS similarity, CAST(row_number() OVER (PARTITION BY anchor ORDER BY round(list_cosine_similarity(a.v, c.v), 6) DESC, candidate) AS INTEGER) AS rank FROM a JOIN c ON anchor <> candidate QUALIFY rank <= 10)"""


@query("SRT-09_nearest", f"WITH {_KNN} SELECT anchor, candidate, similarity, rank FROM n")
def nearest(spark, d):
    vectors = b.table(spark, d, "embeddings")
    return similarity.nearest(vectors.filter("vec_id % 50 = 0"), vectors, 10, "vec_id", "embedding")


@query("SRT-09_indexed")
def indexed(spark, d):
    """The same by an inverted file, with as many probes as the measured recall asks for."""
    vectors = b.table(spark, d, "embeddings")
    anchors, index = vectors.filter("vec_id % 50 = 0"), neighbors.InvertedFile(vectors, "vec_id", "embedding")
    return index.search(anchors, 10, index.probes_for(anchors, 10))


@query("AGG-24_precision_at_5", f"WITH {_KNN} SELECT anchor, count(*) FILTER (label = c_label) AS hits, count(*) FILTER (label = c_label) / CAST(greatest(1, least(5, count(*))) AS DOUBLE) AS precision FROM n WHERE rank <= 5 GROUP BY anchor")
def precision(spark, d):
    return similarity.precision_at_k(nearest(spark, d), b.table(spark, d, "embeddings"), "vec_id", "label", 5)


_EMBED = f"""w AS (SELECT doc_id, unnest(list_filter({_WORDS.format('text')}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
    s AS (SELECT doc_id, CAST((('0x' || sha256(word)[1:16])::UBIGINT) % 384 AS INTEGER) AS bucket, sum(CASE WHEN (('0x' || sha256(word || ':sign')[1:16])::UBIGINT) % 2 = 1 THEN -1 ELSE 1 END * (20 + least(n, 5) * 3)) AS w FROM n GROUP BY 1, 2 HAVING sum(CASE WHEN (('0x' || sha256(word || ':sign')[1:16])::UBIGINT) % 2 = 1 THEN -1 ELSE 1 END * (20 + least(n, 5) * 3)) <> 0)"""


@query("SIM-03_hashed_embeddings", f"WITH {_EMBED} SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS value FROM s")
def hashed_embeddings(spark, d):
    return similarity.embeddings(b.table(spark, d, "documents"), "doc_id", "text").withColumn("value", F.round("value", 9))


@query("SIM-05_rerank", f"""WITH t AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b, list_distinct({_WORDS.format('a.p_name')}) AS x, list_distinct({_WORDS.format('b.p_name')}) AS y FROM t a JOIN t b ON a.p_name < b.p_name)
    SELECT a, b, round(least(1, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) + 0.08::DOUBLE * least(5, len(list_filter(list_intersect(x, y), lambda w: w IN ('green', 'red', 'steel'))))), 6) AS score FROM p WHERE len(list_intersect(x, y)) > 0""")
def rerank(spark, d):
    names = b.items(spark, d).select("title").distinct().withColumn("words", F.array_distinct(titles.words(F.col("title"))))
    pairs = relational.overlap_join(names.withColumnRenamed("title", "a"), names.withColumnRenamed("title", "b"), "a", "b", "words", "words").filter("a < b")
    score = similarity.rerank(F.array_distinct(titles.words(F.col("a"))), F.array_distinct(titles.words(F.col("b"))), ["green", "red", "steel"])
    return pairs.select("a", "b", F.round(score, 6).alias("score"))


# --- taxonomy

#: Axis values per archetype; ours, over the words of the test tables.
AXES = [
    ("bright", "required", "word", ["red", "yellow", "white", "green"]), ("bright", "required", "size", ["small", "medium"]), ("bright", "preferred", "brand", ["brand 11", "brand 12"]),
    ("heavy", "required", "word", ["steel", "brass", "copper", "nickel"]), ("heavy", "required", "size", ["large", "medium"]), ("heavy", "required", "kind", ["economy", "standard"]), ("heavy", "preferred", "word", ["blue"]),
    ("plain", "required", "kind", ["standard", "small"]), ("plain", "required", "size", ["small", "large"]), ("plain", "preferred", "brand", ["brand 23"]),
]
EXCLUDED = [("no metal", "heavy")]


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence from names, types, brands and sizes, of two sources and several confidences.

    Items are dealt out before they become rows of evidence, so that fingerprints and what is made of them item by item stay where they are.
    """
    items = b.items(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item")
    size = F.when(F.col("size") <= 15, "small").when(F.col("size") <= 35, "medium").otherwise("large")
    words = lambda c: titles.words(F.col(c))
    entry = lambda field, values, source, conf: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(source).alias("source"), conf.alias("confidence")))
    conf = 0.5 + (F.col("item") % 5) / 10
    every = F.concat(
        entry("word", words("title"), "store", conf), entry("word", words("title"), "catalog", conf - 0.1), entry("kind", words("type"), "store", F.lit(0.7)), entry("brand", F.array(F.array_join(words("brand"), " ")), "catalog", F.lit(0.65)),
        entry("size", F.array(size), "catalog", F.lit(0.9)), entry("hard_exclusions", F.when(F.col("item") % 7 == 0, F.array(F.lit("no metal"))).otherwise(F.expr("cast(array() as array<string>)")), "catalog", conf + 0.1),
    )
    return items.select("item", F.explode(every).alias("e")).select("item", "e.*")


def axes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, k, x, v) for a, k, x, vs in AXES for v in vs], "archetype string, kind string, axis string, value string")


_EVIDENCE = f"""e AS (SELECT item, 'word' AS field, unnest({_WORDS.format('title')}) AS value, 'store' AS source, 0.5::DOUBLE + (item % 5) / 10::DOUBLE AS confidence FROM items UNION ALL SELECT item, 'word', unnest({_WORDS.format('title')}), 'catalog', 0.5::DOUBLE + (item % 5) / 10::DOUBLE - 0.1::DOUBLE FROM items
    UNION ALL SELECT item, 'kind', unnest({_WORDS.format('type')}), 'store', 0.7::DOUBLE FROM items UNION ALL SELECT item, 'brand', array_to_string({_WORDS.format('brand')}, ' '), 'catalog', 0.65::DOUBLE FROM items
    UNION ALL SELECT item, 'size', CASE WHEN size <= 15 THEN 'small' WHEN size <= 35 THEN 'medium' ELSE 'large' END, 'catalog', 0.9::DOUBLE FROM items UNION ALL SELECT item, 'hard_exclusions', 'no metal', 'catalog', 0.5::DOUBLE + (item % 5) / 10::DOUBLE + 0.1::DOUBLE FROM items WHERE item % 7 = 0),
    g AS (SELECT item, field AS axis, value, round(least(0.99::DOUBLE, max(least(0.99::DOUBLE, confidence)) + 0.04::DOUBLE * (count(DISTINCT source) - 1)), 6) AS confidence, count(DISTINCT source) AS sources FROM e GROUP BY 1, 2, 3),
    fp AS (SELECT * FROM g WHERE confidence >= CASE WHEN axis = 'hard_exclusions' THEN 0.8 ELSE 0.6 END)"""
_AXES = "ax(archetype, kind, axis, value) AS (VALUES " + ", ".join(f"('{a}', '{k}', '{x}', '{v}')" for a, k, x, vs in AXES for v in vs) + ")"
_HITS = f"""{_AXES}, best AS (SELECT item, archetype, kind, fp.axis, max(confidence) AS c FROM fp JOIN ax ON fp.axis = ax.axis AND fp.value = ax.value GROUP BY ALL),
    tot AS (SELECT archetype, count(DISTINCT axis) FILTER (kind = 'required') AS rt, count(DISTINCT axis) FILTER (kind = 'preferred') AS pt FROM ax GROUP BY 1),
    hits AS (SELECT item, b.archetype, count(*) FILTER (kind = 'required') AS required_hits, count(*) FILTER (kind = 'preferred') AS preferred_hits, sum(CAST(c AS DECIMAL(18, 6)))::DOUBLE AS s, count(*) AS n, any_value(rt) AS rt, any_value(pt) AS pt FROM best b JOIN tot ON b.archetype = tot.archetype
        WHERE NOT EXISTS (SELECT 1 FROM fp x WHERE x.item = b.item AND x.axis = 'hard_exclusions' AND x.value = 'no metal' AND b.archetype = 'heavy') GROUP BY 1, 2)"""


@query("TAX-16_fingerprints", views("items", then=f"+{_EVIDENCE} SELECT * FROM fp"))
def fingerprints(spark, d):
    return taxonomy.aggregate_evidence(evidence(spark, d))


@query("TAX-20_archetypes", views("items", then=f"""+{_EVIDENCE}, {_HITS},
    s AS (SELECT item, archetype, required_hits * 100 + preferred_hits * 25 + CAST(round(s / n * 10) AS BIGINT) AS score, round(least(0.99::DOUBLE, 0.35::DOUBLE + coalesce(required_hits / nullif(rt, 0)::DOUBLE, 0) * 0.35::DOUBLE + coalesce(preferred_hits / nullif(pt, 0)::DOUBLE, 0) * 0.1::DOUBLE + s / n * 0.2::DOUBLE), 6) AS confidence, required_hits, preferred_hits
        FROM hits WHERE required_hits >= greatest(2, ceil(rt * 0.6)))
    SELECT item, archetype, score, required_hits, preferred_hits, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, confidence DESC, archetype) AS INTEGER) AS rank FROM s"""))
def archetypes(spark, d):
    excluded = spark.createDataFrame(EXCLUDED, "value string, archetype string")
    return taxonomy.archetypes(fingerprints(spark, d), axes(spark), excluded).drop("confidence")


def secondaries(spark, d):
    excluded = spark.createDataFrame(EXCLUDED, "value string, archetype string")
    return taxonomy.primary_and_secondary(taxonomy.archetypes(fingerprints(spark, d), axes(spark), excluded))


@query("TAX-23_near_misses", views("items", then=f"""+{_EVIDENCE}, {_HITS} SELECT item, archetype, required_hits * 100 + preferred_hits * 20 - (rt - required_hits) * 15 AS closeness, required_hits, rt - required_hits AS missing, preferred_hits,
    CAST(row_number() OVER (PARTITION BY item ORDER BY required_hits DESC, rt - required_hits, preferred_hits DESC, closeness DESC, archetype) AS INTEGER) AS rank FROM hits"""))
def near_misses(spark, d):
    excluded = spark.createDataFrame(EXCLUDED, "value string, archetype string")
    return taxonomy.near_misses(fingerprints(spark, d), axes(spark), excluded)


@query("TAX-18_derived", views("items", then=f"""+{_EVIDENCE} SELECT item, axis, value, confidence FROM fp UNION ALL
    SELECT DISTINCT item, 'mood', 'sturdy', 0.7::DOUBLE FROM fp a WHERE axis = 'word' AND value = 'steel' AND EXISTS (SELECT 1 FROM fp x WHERE x.item = a.item AND x.axis = 'size' AND x.value = 'large')"""))
def derived(spark, d):
    return taxonomy.derived(fingerprints(spark, d), [([("word", "steel"), ("size", "large")], ("mood", "sturdy", 0.7))])


@query("TAX-10_phrases", f"""WITH w AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), p AS (SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS r FROM w)
    SELECT item_id, array_to_string(r, ' ') AS phrase FROM p WHERE NOT list_contains({_STOP}, r[1]) AND NOT list_contains({_STOP}, r[2])""")
def phrases(spark, d):
    return taxonomy.phrases(b.table(spark, d, "benchmark"), "item_id", "text", 2)


@query("AGG-18_phrase_frequency", f"""WITH w AS (SELECT doc_id, lang, {_WORDS.format('text')} AS w FROM documents), p AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS r FROM w)
    SELECT lang, array_to_string(r, ' ') AS phrase, count(DISTINCT doc_id) AS documents FROM p WHERE NOT list_contains({_STOP}, r[1]) AND NOT list_contains({_STOP}, r[2]) GROUP BY 1, 2 ORDER BY documents DESC, phrase, lang LIMIT 100""")
def phrase_frequency(spark, d):
    docs = b.table(spark, d, "documents")
    found = taxonomy.phrases(docs.withColumn("key", F.struct("lang", "doc_id")), "key", "text", 2)
    return found.groupBy(F.col("key.lang").alias("lang"), "phrase").agg(F.countDistinct("key.doc_id").alias("documents")).orderBy(F.desc("documents"), F.asc("phrase"), F.asc("lang")).limit(100)


RULES = [("topic", "licence", r"\b(licen[cs]ed?|copyright)\b", 0.9, 1), ("topic", "the", r"\bthe\b", 0.6, 20), ("junk", "shouting", r"!!", 0.7, 5), ("junk", "table", r" \| ", 0.8, 3)]


@query("TAX-14_text_evidence", r"""SELECT doc_id, 'topic' AS field, 'licence' AS value, 'text' AS source, 0.9::DOUBLE AS confidence FROM documents WHERE len(regexp_extract_all(lower(text), '\b(?:licen[cs]ed?|copyright)\b')) >= 1
    UNION ALL SELECT doc_id, 'topic', 'the', 'text', 0.6::DOUBLE FROM documents WHERE len(regexp_extract_all(lower(text), '\bthe\b')) >= 20 UNION ALL SELECT doc_id, 'junk', 'shouting', 'text', 0.7::DOUBLE FROM documents WHERE len(regexp_extract_all(lower(text), '!!')) >= 5
    UNION ALL SELECT doc_id, 'junk', 'table', 'text', 0.8::DOUBLE FROM documents WHERE len(regexp_extract_all(lower(text), ' \| ')) >= 3""")
def text_evidence(spark, d):
    return taxonomy.text_evidence(b.table(spark, d, "documents"), RULES, "doc_id", "text", "text")


def boilerplate(spark, d):
    parts = taxonomy.segments(b.table(spark, d, "documents"), "doc_id", "text")
    return taxonomy.flagged_segments(parts, [("licence", r"licensed under|all rights reserved"), ("contact", r"@|https?://")], [r"\bopen world\b"]).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("AGG-16_label_audit", views("items", then=f"""+l AS (SELECT item, type, unnest({_WORDS.format('title')}) AS label FROM items) SELECT type, label, count(*) AS n, count(DISTINCT item) AS items FROM l GROUP BY 1, 2 HAVING count(*) >= 2"""))
def label_audit(spark, d):
    labels = b.items(spark, d).select("item", "type", F.explode(titles.words(F.col("title"))).alias("label"))
    return labels.groupBy("type", "label").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items")).filter("n >= 2")


# --- linking


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one to five words, from the benchmark's texts."""
    text = b.table(spark, d, "benchmark")
    return text.select(F.col("item_id").alias("item"), F.array_join(F.slice(titles.words(F.col("text")), F.lit(1), (F.col("item_id") % 5 + 1).cast("int")), " ").alias("title"))


#: All titles of the dictionary are looked for, of one letter, too.
SHORTEST = 1


def stories(spark: SparkSession, d: str) -> DataFrame:
    return b.articles(spark, d).select("article", "headline", F.col("text").alias("description"))


_LINKS = f"""dict AS (SELECT item_id AS item, array_to_string(list_slice({_WORDS.format('text')}, 1, item_id % 5 + 1), ' ') AS title FROM benchmark), s AS (SELECT doc_id AS article, ' ' || array_to_string({_WORDS.format("split_part(text, chr(10), 1)")}, ' ') || ' ' AS h, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS x FROM documents),
    c AS (SELECT article, item, contains(h, ' ' || title || ' ') AS in_headline, contains(x, ' ' || title || ' ') AS in_description, length(title) AS n FROM s, dict WHERE title <> '' AND (contains(h, ' ' || title || ' ') OR contains(x, ' ' || title || ' '))),
    scored AS (SELECT article, item, in_headline, in_description, CAST(n + CASE WHEN in_headline THEN 90 ELSE 0 END + CASE WHEN in_description THEN 65 ELSE 0 END AS INTEGER) AS score FROM c)"""


@query("LNK-03_phrase_candidates", f"WITH {_LINKS} SELECT * FROM scored")
def phrase_candidates(spark, d):
    return linking.phrase_candidates(stories(spark, d), dictionary(spark, d), least=SHORTEST)


@query("LNK-07_winners", f"""WITH {_LINKS}, a AS (SELECT *, bool_or(in_headline) OVER (PARTITION BY article) AS any_head FROM scored), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM a WHERE NOT any_head OR in_headline WINDOW w AS (PARTITION BY article ORDER BY score DESC, item))
    SELECT article, item, score FROM r WHERE k = 1 AND score >= 65 AND (second IS NULL OR score - second >= 8)""")
def winners(spark, d):
    return linking.winners(phrase_candidates(spark, d))


def fallback(spark, d):
    """All words count, and titles of two words do."""
    return linking.fallback(stories(spark, d), dictionary(spark, d), least_words=2, stop=[], least_word=1)


@query("LNK-09_relinked", f"""WITH {_LINKS}, n AS (SELECT article, max_by(item, {{'s': score, 'i': -item}}) AS item FROM scored GROUP BY article), o AS (SELECT doc_id AS article, doc_id % 20 AS item FROM documents WHERE doc_id % 3 = 0)
    SELECT coalesce(o.article, n.article) AS article, o.item AS was, n.item AS now, CASE WHEN o.item IS NULL THEN 'linked' WHEN n.item IS NULL THEN 'cleared' WHEN o.item = n.item THEN 'same' ELSE 'relinked' END AS change FROM o FULL JOIN n ON o.article = n.article""")
def relinked(spark, d):
    new = relational.topk_per_group(phrase_candidates(spark, d), ["article"], [F.desc("score"), F.asc("item")])
    return linking.relinked(b.articles(spark, d).select("article", "item"), new)


def resolved(spark, d):
    names = b.items(spark, d).select("title").distinct()
    wanted = names.select(F.col("title").alias("id"), F.concat(F.initcap("title"), F.lit(": Edition")).alias("title"), F.lit(None).cast("date").alias("released"))
    return resolving.resolve(wanted, names.select(F.col("title").alias("entry"), F.col("title").alias("name"), F.lit(None).cast("date").alias("date")), plain=True)
