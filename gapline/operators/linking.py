"""Linking articles to titles: phrases by an automaton, rephrased titles by their rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, mentions, titles
from . import phrases
from .relational import broadcast_if_small, topk_per_group

#: What a title found in headline or description scores, the least score and lead, and how common a rarest word may be.
IN_HEADLINE, IN_DESCRIPTION, LEAST, LEAD, MOST_COMMON = 90, 65, 65, 8, 12
#: The letters a title has at least, and for titles in other words the telling words and their letters.
LEAST_LETTERS, LEAST_WORDS, LEAST_WORD = 4, 3, 3


def phrase_candidates(articles: DataFrame, dictionary: DataFrame, key: str = "article", id: str = "item", least: int = LEAST_LETTERS, shard: int = phrases.SHARD) -> DataFrame:
    """key, id, in_headline, in_description, score: titles whose words stand next to each other in an article.

    Titles of fewer than ``least`` characters, as they are or as words, are
    left out.  The texts are walked once for each ``shard`` titles.
    """
    whole = F.array_join(titles.words(F.col("title")), " ")
    entries = dictionary.filter(F.length("title") >= least).select(id, whole.alias("_whole")).filter(F.length("_whole") >= least)
    sure = phrases.mentions(articles, entries, key, id, ["headline", "description"], shard)
    both = sure.groupBy(key, id).agg(F.bool_or(F.col("_where") == "headline").alias("in_headline"), F.bool_or(F.col("_where") == "description").alias("in_description"), F.max("_length").alias("_length"))
    score = F.col("_length") + F.when(F.col("in_headline"), IN_HEADLINE).otherwise(0) + F.when(F.col("in_description"), IN_DESCRIPTION).otherwise(0)
    return both.select(key, id, "in_headline", "in_description", score.alias("score"))


def winners(candidates: DataFrame, key: str = "article", id: str = "item") -> DataFrame:
    """key, id, score: an article's best title, if it is good enough and ahead of the second.

    If any title stands in the headline, those only in the description don't count.
    """
    per = Window.partitionBy(key)
    allowed = candidates.withColumn("_any", F.bool_or("in_headline").over(per)).filter(~F.col("_any") | F.col("in_headline"))
    first_two = topk_per_group(allowed, [key], [F.desc("score"), F.asc(id)], 2, "_rank")
    led = first_two.groupBy(key).agg(F.max(F.when(F.col("_rank") == 1, F.struct(id, "score"))).alias("_one"), F.max(F.when(F.col("_rank") == 2, F.col("score"))).alias("_two"))
    sure = (F.col("_one.score") >= LEAST) & (F.col("_two").isNull() | (F.col("_one.score") - F.col("_two") >= LEAD))
    return led.filter(sure).select(key, F.col(f"_one.{id}").alias(id), F.col("_one.score").alias("score"))


def fallback(articles: DataFrame, dictionary: DataFrame, key: str = "article", id: str = "item", least_words: int = LEAST_WORDS, stop: list[str] = titles.STOP, least_word: int = LEAST_WORD) -> DataFrame:
    """key, id: titles all of whose telling words stand in a headline in order, whatever is between; the longest title wins.

    Telling words are numbers, numerals and words of ``least_word`` letters that
    are not in ``stop``; titles with fewer than ``least_words`` are left out.
    Titles and headlines meet on the title's rarest word, which at most
    MOST_COMMON titles may have.
    """
    telling = lambda w: ~w.isin(*stop) & (w.rlike("^([0-9]+|[ivxlcdm]+)$") | (F.length(w) >= least_word))
    entries = dictionary.select(id, F.filter(titles.words(F.col("title")), telling).alias("_t")).filter(F.size("_t") >= least_words)
    each = entries.select(id, "_t", F.explode(F.array_distinct("_t")).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("n"))
    anchors = topk_per_group(each.join(often, "word").filter(F.col("n") <= MOST_COMMON), [id], [F.asc("n"), F.desc(F.length("word")), F.asc("word")])
    heads = articles.select(key, titles.words(F.col("headline")).alias("_h")).select(key, "_h", F.explode(F.array_distinct("_h")).alias("word"))
    met = heads.join(broadcast_if_small(anchors.select(id, "_t", "word")), "word").filter(F.size(F.array_except("_t", "_h")) == 0)
    # Walk the title's words through the headline: each has to stand behind the one before.
    behind = lambda at, w: F.when(at < 0, at).otherwise(F.coalesce(F.get(F.filter(F.sequence(at + 1, F.size("_h") + 1), lambda i: F.get("_h", i - 1) == w), F.lit(0)), F.lit(-1)))
    ordered = met.filter(F.aggregate("_t", F.lit(0), behind) > 0)
    return topk_per_group(ordered.withColumn("_n", F.size(F.array_distinct("_t"))), [key], [F.desc("_n"), F.desc(F.length(F.array_join("_t", " "))), F.asc(id)]).select(key, id)


def relinked(old: DataFrame, new: DataFrame, key: str = "article", id: str = "item") -> DataFrame:
    """key, was, now, change: linked, relinked, cleared or same, by comparing links; unlinked on both sides is left out."""
    both = old.select(key, F.col(id).alias("was")).join(new.select(key, F.col(id).alias("now")), key, "full").filter("was IS NOT NULL OR now IS NOT NULL")
    change = F.when(F.col("was").isNull(), "linked").when(F.col("now").isNull(), "cleared").when(F.col("was") == F.col("now"), "same").otherwise("relinked")
    return both.withColumn("change", change)


def title_frequency(dictionary: DataFrame, stop: list[str], id: str = "item") -> DataFrame:
    """id, often: in how many titles the most frequent telling word of each stands."""
    each = dictionary.select(id, F.explode(F.array_distinct(F.filter(mentions.words(F.col("title")), lambda w: ~w.isin(*stop)))).alias("_word"))
    counts = each.groupBy("_word").agg(F.count("*").alias("_n"))
    return each.join(counts, "_word").groupBy(id).agg(F.max("_n").alias("often"))


def adjusted_candidates(candidates: DataFrame, articles: DataFrame, dictionary: DataFrame, lists: dict[str, list[str]], key: str = "article", id: str = "item") -> DataFrame:
    """``candidates`` with score adjusted: mere references, sequels, ambiguous titles with and without context.

    ``lists`` has the words that are common, stop, context and followups.  The
    flags are looked up in the texts of candidate pairs only.
    """
    titled = dictionary.select(id, mentions.words(F.col("title")).alias("_t")).join(title_frequency(dictionary, lists["stop"], id), id, "left")
    titled = titled.withColumns({"_primary": mentions.primary_word(F.col("_t"), lists["stop"]), "_ambiguous": mentions.ambiguous(F.col("_t"), F.coalesce("often", F.lit(0)), lists["common"], lists["stop"]), "_risky": mentions.risky(F.col("_t"), lists["common"], lists["stop"])})
    texts = articles.select(key, mentions.words(F.col("headline")).alias("_h"), mentions.words(F.col("description")).alias("_d"))
    texts = texts.withColumns({f"{c}_followed": mentions.numbered(F.col(c)) for c in ("_h", "_d")})
    rows = candidates.join(broadcast_if_small(titled), id).join(texts, key)
    # What several flags need is worked out once: where an ambiguous title's primary word stands.
    rows = rows.withColumns({f"{c}_at": F.when(F.col(on) & F.col("_ambiguous"), mentions.spots(F.col(c), F.col("_primary"))) for c, on in (("_h", "in_headline"), ("_d", "in_description"))})
    flag = lambda c, name, on: F.when(F.col(on), mentions.adjustment(F.col(c), F.col("_t"), F.col("_primary"), F.col("_ambiguous"), F.col("_risky"), lists, name, F.col(f"{c}_followed"), F.col(f"{c}_at"))).otherwise(0)
    context = (F.col("in_headline") & mentions.near_context(F.col("_h"), F.col("_primary"), lists["context"], F.col("_h_at"))) | (F.col("in_description") & mentions.near_context(F.col("_d"), F.col("_primary"), lists["context"], F.col("_d_at")))
    plain = F.when(F.col("in_headline") & ~F.col("in_description"), -70).when(~F.col("in_headline") & F.col("in_description"), -45).otherwise(-35)
    doubt = F.when(F.col("_ambiguous"), F.when(context, 30).when(F.col("_risky"), -120).otherwise(plain)).otherwise(0)
    score = F.col("score") + flag("_h", True, "in_headline") + flag("_d", False, "in_description") + doubt
    return rows.select(key, id, "in_headline", "in_description", score.cast("int").alias("score"))


def lookup(wanted: DataFrame, catalog: DataFrame, most: int = 25) -> DataFrame:
    """asked, entry, title: the entry that a typed text names best.

    Exact titles first, then plain forms that agree, beginnings, containment,
    shorter titles, newer ids.  ``wanted`` has asked, ``catalog`` entry, title;
    they meet on a trigram of the asked text that few titles have, so that no
    text is tried against all titles; texts of under three letters find nothing.
    """
    low, plain = F.lower(F.trim("asked")), labels.plain_label(F.col("asked"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3))))
    entries = catalog.select("entry", "title", F.explode(grams(F.lower("title"))).alias("_gram"))
    often = entries.groupBy("_gram").agg(F.count("*").alias("_n"))
    asked = wanted.select("asked", F.explode(grams(low)).alias("_gram")).join(often, "_gram")
    rarest = topk_per_group(asked, ["asked"], [F.asc("_n"), F.asc("_gram")]).select("asked", "_gram")
    met = rarest.join(entries, "_gram").filter(F.contains(F.lower("title"), low))
    title, other = F.lower("title"), labels.plain_label(F.col("title"))
    order = [F.desc(title == low), F.desc(other == plain), F.desc(title.startswith(low)), F.desc(F.contains(other, plain)), F.asc(F.length("title")), F.desc("entry")]
    return topk_per_group(met, ["asked"], order).select("asked", "entry", "title")


def store_rank(query: Column, name: Column) -> Column:
    """3 for the same plain title, 2 for a beginning, 1 for containment, else 0."""
    q, n = labels.plain_label(query), labels.plain_label(name)
    return F.when(n == q, 3).when(n.startswith(q), 2).when(F.contains(n, q), 1).otherwise(0)


def import_actions(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """store_id, title, item, action: how a store's entries enter the catalogue (item, title, store_id).

    By store id first, then by title; a title that already has another store id is refused.
    """
    by_id = catalog.filter("store_id IS NOT NULL").select("store_id", F.col("item").alias("_by_id"))
    by_title = catalog.groupBy(F.lower("title").alias("_low")).agg(F.max(F.struct(F.col("store_id").isNotNull(), "item", "store_id")).alias("_t"))
    both = found.withColumn("_low", F.lower("title")).join(by_id, "store_id", "left").join(by_title, "_low", "left")
    clash = F.col("_t.store_id").isNotNull() & (F.col("_t.store_id") != F.col("store_id"))
    action = F.when(F.col("_by_id").isNotNull(), "updated").when(F.col("_t.item").isNull(), "created").when(clash, "refused").otherwise("linked")
    return both.select("store_id", "title", F.coalesce("_by_id", F.when(~clash, F.col("_t.item"))).alias("item"), action.alias("action"))
