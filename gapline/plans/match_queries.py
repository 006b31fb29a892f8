"""Queries on mentions of titles in texts and on resolving typed or sent titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, mentions, titles
from ..operators import linking, relational, resolving
from ..sources import bindings as b
from . import mining_queries as mq
from .registry import query, views

#: Word lists for the test tables' vocabulary.
LISTS = {"common": ["that", "re", "the", "and", "onesen"], "stop": ["the", "a", "of", "to"], "context": ["is", "was", "in", "ha"], "followups": ["and", "onesen", "eroundth", "for", "in"]}
_IN = {k: ", ".join(f"'{w}'" for w in v) for k, v in LISTS.items()}
_NORM = r"trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(lower(coalesce({0}, '')), '’', ''''), '‘', ''''), '\b(\d+)(?:st|nd|rd|th)\b', '\1', 'g'), '\b([a-z0-9]+)''s\b', '\1', 'g'), '''', ''), '[^a-z0-9]+', ' ', 'g'))"
_NWORDS = "list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> '')"
_PREP = ", ".join(f"'{w}'" for w in mentions.PREPOSITIONS)
_PHRASES = "|".join(mentions.REFERENCE_PHRASES)


@query("LNK-01_normalized", views("articles", then=f"+t AS (SELECT article, headline || CASE article % 4 WHEN 0 THEN ' Rayman’s 2nd' WHEN 1 THEN ' Don''t it''s' WHEN 2 THEN ' the 21st -- X' ELSE '' END AS h FROM articles) SELECT article, {_NORM.format('h')} AS text FROM t"))
def normalized(spark, d):
    k = F.col("article") % 4
    end = F.when(k == 0, " Rayman’s 2nd").when(k == 1, " Don't it's").when(k == 2, " the 21st -- X").otherwise("")
    return b.articles(spark, d).select("article", mentions.normalized(F.concat("headline", end)).alias("text"))


@query("LNK-02_title_variants", """SELECT p_partkey, array_to_string(list_sort(CASE p_partkey % 4 WHEN 0 THEN [p_name || ' ii', p_name || ' 2'] WHEN 1 THEN [p_name || ' 3', p_name || ' iii'] WHEN 2 THEN ['x 4 ' || p_name, 'x iv ' || p_name, '10 4 ' || p_name, '10 iv ' || p_name] ELSE [p_name] END), '|') AS variants,
    CASE p_partkey % 4 WHEN 3 THEN TRUE WHEN 2 THEN FALSE END AS segmented FROM part""")
def title_variants(spark, d):
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat("p_name", F.lit(" II"))).when(k == 1, F.concat("p_name", F.lit(" 3"))).when(k == 2, F.concat(F.lit("X 4 "), "p_name")).otherwise(F.col("p_name"))
    colon = F.when(k == 3, F.concat("p_name", F.lit(": Second Part"))).when(k == 2, F.concat("p_name", F.lit(": Missing"))).otherwise(F.col("p_name"))
    text = F.concat(F.lit("The "), F.upper("p_name"), F.lit(" saga, second part's review"))
    return b.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(mentions.numeral_variants(title, titles.ROMAN)), "|").alias("variants"), mentions.segments_match(text, colon).alias("segmented"))


_DICT = f"""dict AS (SELECT item_id AS item, array_to_string(list_slice({mq._WORDS.format('text')}, 1, item_id % 5 + 1), ' ') AS title FROM benchmark), dt AS (SELECT item, {_NWORDS.format('title')} AS t FROM dict), tell AS (SELECT item, t, list_filter(t, lambda w: w NOT IN ({_IN['stop']})) AS m FROM dt),
    fr AS (SELECT w, count(*) AS n FROM (SELECT item, unnest(list_distinct(m)) AS w FROM tell) GROUP BY w), oft AS (SELECT item, max(n) AS often FROM (SELECT item, unnest(list_distinct(m)) AS w FROM tell) x JOIN fr USING (w) GROUP BY item),
    amb AS (SELECT tell.item, t, m, coalesce(m[1], t[1]) AS p, coalesce(len(m) = 1 AND NOT regexp_full_match(m[1], '[0-9]+|[ivxlcdm]+') AND (m[1] IN ({_IN['common']}) OR length(m[1]) <= 5 OR coalesce(often, 0) > 1) OR len(m) = 2 AND (len(list_filter(m, lambda w: w NOT IN ({_IN['common']}))) = 0 OR coalesce(often, 0) > 10), FALSE) AS a,
        coalesce(len(m) = 1 AND NOT regexp_full_match(m[1], '[0-9]+|[ivxlcdm]+') AND (m[1] IN ({_IN['common']}) OR length(m[1]) <= 5), FALSE) AS r FROM tell LEFT JOIN oft ON oft.item = tell.item)"""


def titled(spark: SparkSession, d: str) -> DataFrame:
    words = mq.dictionary(spark, d).select("item", mentions.words(F.col("title")).alias("t")).join(linking.title_frequency(mq.dictionary(spark, d), LISTS["stop"]), "item", "left")
    return words.select("item", "t", mentions.primary_word(F.col("t"), LISTS["stop"]).alias("p"), mentions.ambiguous(F.col("t"), F.coalesce("often", F.lit(0)), LISTS["common"], LISTS["stop"]).alias("a"), mentions.risky(F.col("t"), LISTS["common"], LISTS["stop"]).alias("r"))


@query("LNK-04_ambiguity", f"WITH {_DICT} SELECT item, p AS primary_word, a AS ambiguous, r AS risky FROM amb")
def ambiguity(spark, d):
    return titled(spark, d).select("item", F.col("p").alias("primary_word"), F.col("a").alias("ambiguous"), F.col("r").alias("risky"))


def _flags(x: str) -> str:
    """The flags of a title's words ``t`` in the words ``x``, as SQL columns."""
    occ = f"list_filter(range(1, len({x}) - len(t) + 2), lambda i: {x}[i:i + len(t) - 1] = t)"
    one = f"list_filter(range(1, len({x}) + 1), lambda i: {x}[i] = p)"
    sequel = f"len(list_filter({occ}, lambda i: regexp_full_match(coalesce({x}[i + len(t)], ''), '[2-9]|1[0-9]|20'))) > 0"
    referred = f"(len(t) >= 2 AND len({occ}) > 0 AND len(list_filter({occ}, lambda i: NOT (coalesce({x}[i + len(t)], '') IN ('inspired', 'like') OR (i > 1 AND {x}[i - 1] IN ({', '.join(repr(w) for w in mentions.REFERENCE_PREFIX)})) OR regexp_matches(array_to_string({x}[greatest(1, i - 3):i - 1], ' '), '(^| )(?:{_PHRASES})$')))) = 0)"
    context = f"len(list_filter({one}, lambda i: NOT ((i > 1 AND {x}[i - 1] IN ({_PREP})) OR coalesce({x}[i + 1], '') IN ({_PREP})) AND len(list_filter(list_concat({x}[greatest(1, i - 3):i - 1], {x}[i + 1:i + 3]), lambda w: w IN ({_IN['context']}) OR regexp_full_match(w, '[0-9]+|[ivxlcdm]+'))) > 0)) > 0"
    before = f"len(list_filter({one}, lambda i: i > 1 AND {x}[i - 1] NOT IN ({_IN['stop']}, {_PREP}, {_IN['followups']}, {_IN['context']}) AND NOT regexp_full_match({x}[i - 1], '[0-9]+|[ivxlcdm]+'))) > 0"
    lead = f"(len({x}) >= 2 AND {x}[1] = p AND {x}[2] IN ({_IN['followups']}))"
    return f"{sequel} AS {x}_sequel, {referred} AS {x}_referred, {context} AS {x}_context, {before} AS {x}_before, {lead} AS {x}_lead"


_STORIES = "cw AS (SELECT c.article, c.item, c.in_headline, c.in_description, scored.score, {0} AS h, {1} AS x FROM c JOIN scored ON scored.article = c.article AND scored.item = c.item JOIN st ON st.article = c.article)"


def _texts(headline: str, text: str) -> str:
    """Candidates with their texts' words: links over the stories that have made-up ends, so that every flag occurs."""
    return f"""{_DICT}, st AS (SELECT doc_id AS article, {headline} AS headline, {text} AS text FROM documents), s AS (SELECT article, ' ' || array_to_string({mq._WORDS.format('headline')}, ' ') || ' ' AS h, ' ' || array_to_string({mq._WORDS.format('text')}, ' ') || ' ' AS x FROM st),
    c AS (SELECT article, item, contains(h, ' ' || title || ' ') AS in_headline, contains(x, ' ' || title || ' ') AS in_description, length(title) AS n FROM s, dict WHERE title <> '' AND (contains(h, ' ' || title || ' ') OR contains(x, ' ' || title || ' '))),
    scored AS (SELECT article, item, CAST(n + CASE WHEN in_headline THEN 90 ELSE 0 END + CASE WHEN in_description THEN 65 ELSE 0 END AS INTEGER) AS score FROM c),
    cw AS (SELECT c.article, c.item, c.in_headline, c.in_description, scored.score, {_NWORDS.format('st.headline')} AS h, {_NWORDS.format('st.text')} AS x FROM c JOIN scored ON scored.article = c.article AND scored.item = c.item JOIN st ON st.article = c.article),
    fl AS (SELECT cw.*, t, p, a, r, {_flags('h')}, {_flags('x')} FROM cw JOIN amb ON amb.item = cw.item)"""


_HEAD = "split_part(text, chr(10), 1) || coalesce(CASE doc_id % 4 WHEN 0 THEN ' fans of ' || (SELECT title FROM dict WHERE dict.item = doc_id % 40) WHEN 1 THEN ' ' || (SELECT title FROM dict WHERE dict.item = doc_id % 40) || ' 2' WHEN 2 THEN ' ' || (SELECT title FROM dict WHERE dict.item = doc_id % 40) || ' is in' END, '')"
_MENTIONS = _texts(_HEAD, "text")


def told_stories(spark: SparkSession, d: str) -> DataFrame:
    """Articles with titles put behind their headlines: referred to, numbered, in context."""
    docs = b.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item"))
    named = docs.join(mq.dictionary(spark, d), "item", "left")
    k = F.col("doc_id") % 4
    end = F.when(k == 0, F.concat(F.lit(" fans of "), "title")).when(k == 1, F.concat(F.lit(" "), "title", F.lit(" 2"))).when(k == 2, F.concat(F.lit(" "), "title", F.lit(" is in")))
    return named.select(F.col("doc_id").alias("article"), F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.coalesce(end, F.lit(""))).alias("headline"), F.col("text").alias("description"))


@query("LNK-06_mention_flags", f"WITH {_MENTIONS} SELECT article, item, coalesce(h_sequel, FALSE) AS sequel, coalesce(h_referred, FALSE) AS referred, coalesce(h_context, FALSE) AS context, coalesce(h_before, FALSE) AS before, coalesce(h_lead, FALSE) AS lead FROM fl WHERE in_headline")
def mention_flags(spark, d):
    stories = told_stories(spark, d)
    pairs = linking.phrase_candidates(stories, mq.dictionary(spark, d), least=mq.SHORTEST).filter("in_headline").select("article", "item")
    rows = pairs.join(titled(spark, d), "item").join(stories.select("article", mentions.words(F.col("headline")).alias("h")), "article")
    h, t, p = F.col("h"), F.col("t"), F.col("p")
    allowed = [*LISTS["stop"], *mentions.PREPOSITIONS, *LISTS["followups"], *LISTS["context"]]
    flags = {"sequel": mentions.sequel_follows(h, t), "referred": mentions.only_referred_to(h, t), "context": mentions.near_context(h, p, LISTS["context"]), "before": mentions.other_word_before(h, p, allowed), "lead": mentions.generic_lead(h, p, LISTS["followups"])}
    return rows.select("article", "item", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def _adjusted(x: str, on: str, a: int, b_: int, c: int, lead: int, before: int) -> str:
    numbered = "regexp_full_match(t[len(t)], '[2-9]|1[0-9]|20')"
    return f"CASE WHEN {on} THEN CASE WHEN {x}_referred THEN {a} ELSE 0 END + CASE WHEN {x}_sequel THEN CASE WHEN {numbered} THEN {c} ELSE {b_} END ELSE 0 END + CASE WHEN a AND {x}_lead AND p IN ({_IN['common']}) THEN {lead} ELSE 0 END + CASE WHEN a AND r AND {x}_before THEN {before} ELSE 0 END ELSE 0 END"


_ADJUSTED = f"""adj AS (SELECT article, item, in_headline, in_description, CAST(score + {_adjusted('h', 'in_headline', -130, -140, 25, -130, -140)} + {_adjusted('x', 'in_description', -100, -110, 15, 0, -110)}
    + CASE WHEN a THEN CASE WHEN (in_headline AND h_context) OR (in_description AND x_context) THEN 30 WHEN r THEN -120 WHEN in_headline AND NOT in_description THEN -70 WHEN in_description AND NOT in_headline THEN -45 ELSE -35 END ELSE 0 END AS INTEGER) AS score FROM fl)"""


@query("LNK-05_adjusted_candidates", f"WITH {_MENTIONS}, {_ADJUSTED} SELECT article, item, score FROM adj")
def adjusted_candidates(spark, d):
    return adjusted(spark, d).select("article", "item", "score")


def adjusted(spark: SparkSession, d: str) -> DataFrame:
    stories, dictionary = told_stories(spark, d), mq.dictionary(spark, d)
    return linking.adjusted_candidates(linking.phrase_candidates(stories, dictionary, least=mq.SHORTEST), stories, dictionary, LISTS)


@query("LNK-07_adjusted_winners", f"""WITH {_MENTIONS}, {_ADJUSTED}, an AS (SELECT *, bool_or(in_headline) OVER (PARTITION BY article) AS any_head FROM adj), rk AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM an WHERE NOT any_head OR in_headline WINDOW w AS (PARTITION BY article ORDER BY score DESC, item))
    SELECT article, item, score FROM rk WHERE k = 1 AND score >= 65 AND (second IS NULL OR score - second >= 8)""")
def adjusted_winners(spark, d):
    return linking.winners(adjusted(spark, d))


# --- resolving


#: An ending that leaves too few letters alike relates a title to itself only by a word of four letters.
_TELLING = "len(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 4)) > 0"


@query("RES-02_batch", views("items", then=f"+t AS (SELECT DISTINCT title, {_TELLING} AS tells FROM items), a AS (SELECT tells FROM t UNION ALL SELECT false FROM (SELECT DISTINCT type FROM items)) SELECT CASE WHEN tells THEN 'matched' ELSE 'unmatched' END AS outcome, count(*) AS n FROM a GROUP BY 1"))
def batch(spark, d):
    """Every title and every kind is asked for; titles with a telling word find themselves, kinds nothing."""
    items = b.items(spark, d)
    names = items.select("title").distinct()
    asked = names.select(F.col("title").alias("id"), F.concat(F.initcap("title"), F.lit(" - Remastered")).alias("title")).unionByName(items.select(F.concat(F.lit("kind "), "type").alias("id"), F.lit("qqq zzz").alias("title")).distinct())
    found = resolving.resolve(asked.withColumn("released", F.lit(None).cast("date")), names.select(F.col("title").alias("entry"), F.col("title").alias("name"), F.lit(None).cast("date").alias("date")))
    return asked.join(found, "id", "left").groupBy(F.when(F.col("match").isNotNull(), "matched").otherwise("unmatched").alias("outcome")).agg(F.count("*").alias("n"))


def asked_and_listed(spark, d):
    """Titles as they are asked for, and a catalogue: the first words of the documents, in other spellings and with other dates."""
    docs = b.table(spark, d, "documents").select("doc_id", F.split(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[^a-zA-Z0-9 ]", ""), " ").alias("w"))
    listed = docs.select("doc_id", F.trim(F.array_join(F.slice("w", 1, 5), " ")).alias("name")).filter("name <> ''").groupBy("name").agg(F.min("doc_id").alias("entry"))
    k, day = F.col("entry") % 6, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("entry") % 500).cast("int"))
    catalog = listed.select("entry", "name", F.when(k != 5, day).alias("date"), F.when(F.col("entry") % 4 == 0, "dlc").otherwise("game").alias("kind"))
    cut = F.substring_index("name", " ", 3)
    title = F.when(k == 0, F.upper("name")).when(k == 1, F.concat("name", F.lit(" Collection"))).when(k == 2, F.regexp_replace("name", "e", "")).when(k == 3, F.concat(cut, F.lit(": Chapter 2"))).otherwise(cut)
    asked = listed.select(F.col("entry").alias("id"), title.alias("title"), F.when(F.col("entry") % 7 != 0, F.date_add(day, F.when(F.col("entry") % 5 == 0, 200).otherwise(3))).alias("released"))
    return asked, catalog


@query("RES-01_store_matches")
def store_matches(spark, d):
    return resolving.resolve(*asked_and_listed(spark, d)).select("id", "match", "similarity", "reason")


@query("RES-02_outcomes")
def outcomes(spark, d):
    """How all titles come out; every fiftieth has an entry given by hand."""
    asked, listed = asked_and_listed(spark, d)
    given = listed.filter("entry % 50 = 0").select(F.col("entry").alias("id"), (F.col("entry") + 1).alias("entry"))
    found = resolving.resolve(asked, listed, given)
    return asked.join(found, "id", "left").groupBy(F.coalesce("reason", F.lit("unmatched")).alias("outcome")).agg(F.count("*").alias("n"))


@query("RES-03_lookup", views("items", then="""+a(asked) AS (VALUES ('Large Bolt'), ('idget'), ('cold'), ('small WID'), ('nothing'), (' medium gear ')), m AS (SELECT asked, item AS entry, title, lower(trim(asked)) AS low, lower(title) AS t FROM a JOIN items ON contains(lower(title), lower(trim(asked))))
    SELECT asked, entry, title FROM m QUALIFY row_number() OVER (PARTITION BY asked ORDER BY (t = low) DESC, starts_with(t, low) DESC, length(title), entry DESC) = 1"""))
def lookup(spark, d):
    wanted = spark.createDataFrame([(x,) for x in ("Large Bolt", "idget", "cold", "small WID", "nothing", " medium gear ")], "asked string")
    return linking.lookup(wanted, b.items(spark, d).select(F.col("item").alias("entry"), "title"))


@query("RES-04_reconciled_dates", views("items", then="""+n AS (SELECT item, CASE item % 4 WHEN 0 THEN released + 200 WHEN 1 THEN released + 30 WHEN 2 THEN NULL ELSE DATE '1997-01-01' END AS sent FROM items WHERE item % 2 = 0 OR item < 60), t AS (SELECT i.item, i.released, n.sent FROM items i JOIN n ON n.item = i.item)
    SELECT item, released AS was, CASE WHEN sent IS NULL THEN released WHEN released IS NULL THEN sent WHEN sent - released >= 120 THEN sent ELSE released END AS now FROM t WHERE CASE WHEN sent IS NULL THEN released WHEN released IS NULL THEN sent WHEN sent - released >= 120 THEN sent ELSE released END IS DISTINCT FROM released"""))
def reconciled_dates(spark, d):
    """Tracked items whose shop moved the date far enough; the others keep theirs."""
    items = b.items(spark, d).select("item", "released")
    k = F.col("item") % 4
    sent = items.filter("item % 2 = 0 OR item < 60").select("item", F.when(k == 0, F.date_add("released", 200)).when(k == 1, F.date_add("released", 30)).when(k == 3, F.lit("1997-01-01").cast("date")).alias("sent"))
    now = items.join(sent, "item").select("item", F.col("released").alias("was"), dates.scraped_release(F.col("released"), F.col("sent")).alias("now"))
    return now.filter(~F.col("was").eqNullSafe(F.col("now")))


@query("RES-04_ensured", views("items", then="SELECT item, title FROM items WHERE item % 5 <> 0 UNION ALL SELECT item, 'tracked ' || title FROM items WHERE item % 10 = 0"))
def ensured(spark, d):
    """The catalogue lacks some tracked items; those are put in."""
    items = b.items(spark, d).select("item", "title")
    tracked = items.filter("item % 10 = 0 OR item % 10 = 1").withColumn("title", F.concat(F.lit("tracked "), "title"))
    return relational.insert_absent(items.filter("item % 5 <> 0"), tracked, ["item"])


@query("RES-05_store_results", views("items", then="""+t AS (SELECT item, title || CASE item % 3 WHEN 0 THEN '' WHEN 1 THEN ': Bolt' ELSE ' (Large)' END AS name, split_part(title, ' ', 1) AS q FROM items), r AS (SELECT q, item, name, CASE WHEN n = q THEN 3 WHEN starts_with(n, q) THEN 2 WHEN contains(n, q) THEN 1 ELSE 0 END AS rank FROM (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM t))
    SELECT q AS query, item, name, rank FROM r QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank DESC, length(name) DESC, item) = 1"""))
def store_results(spark, d):
    k = F.col("item") % 3
    sent = b.items(spark, d).select(F.split_part("title", F.lit(" "), F.lit(1)).alias("query"), "item", F.concat("title", F.when(k == 1, ": Bolt").when(k == 2, " (Large)").otherwise("")).alias("name"))
    ranked = sent.withColumn("rank", linking.store_rank(F.col("query"), F.col("name")))
    return relational.topk_per_group(ranked, ["query"], [F.desc("rank"), F.desc(F.length("name")), F.asc("item")])


@query("RES-05_imports", views("items", then="""SELECT item AS store_id, CASE item % 4 WHEN 0 THEN 'x' WHEN 3 THEN 'new ' || item ELSE 'One ' || item END AS title, CASE item % 4 WHEN 3 THEN NULL WHEN 2 THEN NULL ELSE item END AS item, CASE item % 4 WHEN 0 THEN 'updated' WHEN 1 THEN 'linked' WHEN 2 THEN 'refused' ELSE 'created' END AS action FROM items"""))
def imports(spark, d):
    k = F.col("item") % 4
    catalog = b.items(spark, d).filter(k != 3).select("item", F.concat(F.lit("one "), F.col("item").cast("string")).alias("title"), F.when(k == 0, F.col("item")).when(k == 2, -F.col("item")).alias("store_id"))
    sent = b.items(spark, d).select(F.col("item").alias("store_id"), F.when(k == 0, "x").when(k == 3, F.concat(F.lit("new "), F.col("item").cast("string"))).otherwise(F.concat(F.lit("One "), F.col("item").cast("string"))).alias("title"))
    return linking.import_actions(sent, catalog)


@query("FN-20_plain_labels", r"SELECT doc_id, trim(regexp_replace(replace(replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]+', '', 'g')), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS label FROM documents")
def plain_labels(spark, d):
    return b.table(spark, d, "documents").select("doc_id", titles.ascii_label("text").alias("label"))


@query("AGG-20_flagged_totals", "WITH " + r"seg AS (SELECT doc_id, unnest(s) AS segment FROM (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), '\s*[•*]\s+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 24)) AS s FROM documents WHERE text IS NOT NULL)), f AS (SELECT doc_id, CASE WHEN regexp_matches(lower(segment), 'licensed under|all rights reserved') THEN 'licence' WHEN regexp_matches(lower(segment), '@|https?://') THEN 'contact' END AS category FROM seg WHERE NOT regexp_matches(lower(segment), '\bopen world\b')) SELECT category, count(*) AS n, count(DISTINCT doc_id) AS documents FROM f WHERE category IS NOT NULL GROUP BY category")
def flagged_totals(spark, d):
    return mq.boilerplate(spark, d)


@query("RES-01_best_titles", views("items", then="+t AS (SELECT DISTINCT title FROM items) SELECT title AS id, title AS match FROM t"))
def best_titles(spark, d):
    return mq.resolved(spark, d).select("id", "match")


@query("LNK-08_words_in_order", f"""WITH {_DICT}, s AS (SELECT doc_id AS article, {mq._WORDS.format("split_part(text, chr(10), 1)")} AS h FROM documents), dw AS (SELECT item, title, {mq._WORDS.format('title')} AS t FROM dict), w AS (SELECT item, t, title, unnest(list_distinct(t)) AS word FROM dw WHERE len(t) >= 2), o AS (SELECT word, count(*) AS n FROM w GROUP BY word),
    an AS (SELECT item, t, title, word FROM w JOIN o USING (word) WHERE n <= 12 QUALIFY row_number() OVER (PARTITION BY item ORDER BY n, length(word) DESC, word) = 1),
    m AS (SELECT article, item, t, title FROM s JOIN an ON list_contains(h, word) WHERE regexp_matches(' ' || array_to_string(h, ' ') || ' ', ' ' || array_to_string(t, ' (?:.* )?') || ' '))
    SELECT article, item FROM m QUALIFY row_number() OVER (PARTITION BY article ORDER BY len(list_distinct(t)) DESC, length(array_to_string(t, ' ')) DESC, item) = 1""")
def words_in_order(spark, d):
    return mq.fallback(spark, d)
