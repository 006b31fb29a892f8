"""Taxonomy: labels and prose to evidence, evidence to fingerprints, fingerprints to archetypes.

Rules are data: small tables that callers give, joined or unrolled into
expressions.  A fingerprint is held long: item, axis, value, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, titles
from .relational import broadcast_if_small, topk_per_group

#: Thresholds of combined confidence, what another source adds, the ceiling.
THRESHOLD, EXCLUSION_THRESHOLD, PER_SOURCE, CEILING = 0.6, 0.8, 0.04, 0.99
EXCLUSIONS = "hard_exclusions"
SEGMENT_LETTERS = 24


def segments(docs: DataFrame, key: str, text: str, least: int = SEGMENT_LETTERS) -> DataFrame:
    """key, n, segment: paragraphs and sentences of at least ``least`` characters, repeats left out."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n|(?<=[.!?])\s+|\s*[•*]\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return docs.select(key, F.posexplode(F.array_distinct(parts)).alias("n", "segment"))


def flagged_segments(parts: DataFrame, rules: list[tuple[str, str]], vetoes: list[str]) -> DataFrame:
    """``parts`` with category: the first rule (category, pattern) a segment meets, unless a veto pattern saves it."""
    category = F.coalesce(*[F.when(F.lower("segment").rlike(pattern), F.lit(name)) for name, pattern in rules])
    saved = F.lower("segment").rlike("|".join(vetoes)) if vetoes else F.lit(False)
    return parts.withColumn("category", F.when(~saved, category))


def phrases(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, phrase: runs of ``n`` words that neither begin nor end with a stop word."""
    telling = F.filter(titles.runs(F.col(text), n), lambda r: ~F.element_at(r, 1).isin(*titles.STOP) & ~F.element_at(r, n).isin(*titles.STOP))
    return docs.select(key, F.explode(F.transform(telling, lambda r: F.array_join(r, " "))).alias("phrase"))


def text_evidence(docs: DataFrame, rules: list[tuple[str, str, str, float, int]], key: str, text: str, source: str) -> DataFrame:
    """key, field, value, source, confidence: rules (field, value, pattern, confidence, least matches) met by a text.

    All rules stand in one projection, so the texts are read once and nothing is shuffled.
    """
    hits = [F.when(F.regexp_count(F.lower(text), F.lit(p)) >= least, F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(c).alias("confidence"))) for f, v, p, c, least in rules]
    return docs.select(key, F.explode(F.array_compact(F.array(*hits))).alias("e")).select(key, "e.field", "e.value", F.lit(source).alias("source"), "e.confidence")


def label_evidence(labels: DataFrame, rules: DataFrame, key: str = "item") -> DataFrame:
    """key, field, value, source, confidence: labels (key, source, facet, label) by rules (facet, label, field, value, confidence).

    A rule for the label's facet goes before one for any facet (null).
    """
    small = broadcast_if_small(rules.withColumnRenamed("facet", "_facet"))
    found = labels.join(small, "label").filter(F.col("_facet").isNull() | (F.col("_facet") == F.col("facet")))
    return topk_per_group(found, [key, "source", "facet", "label", "field", "value"], [F.asc_nulls_last("_facet"), F.desc("confidence")]).select(key, "field", "value", "source", "confidence")


def aggregate_evidence(evidence: DataFrame, key: str = "item", source_weights: dict[str, float] | None = None) -> DataFrame:
    """key, axis, value, confidence, sources: evidence that is strong enough.

    The strongest record counts, weighted by its source; each further source
    adds PER_SOURCE.  Exclusions need EXCLUSION_THRESHOLD.
    """
    weights = source_weights or {}
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(1.0)) if weights else F.lit(1.0)
    one = F.least(F.lit(CEILING), F.col("confidence") * weight)
    found = evidence.groupBy(key, F.col("field").alias("axis"), "value").agg(F.max(one).alias("_best"), F.countDistinct("source").alias("sources"))
    both = found.withColumn("confidence", F.round(F.least(F.lit(CEILING), F.col("_best") + PER_SOURCE * (F.col("sources") - 1)), 6))
    return both.filter(F.col("confidence") >= F.when(F.col("axis") == EXCLUSIONS, EXCLUSION_THRESHOLD).otherwise(THRESHOLD)).select(key, "axis", "value", "confidence", "sources")


def derived(fingerprint: DataFrame, rules: list[tuple[list[tuple[str, str]], tuple[str, str, float]]], key: str = "item") -> DataFrame:
    """``fingerprint`` and what rules infer from it: ([(axis, value), ...], (axis, value, confidence)), all conditions met; values already there stay as they are."""
    spark = fingerprint.sparkSession
    conditions = spark.createDataFrame([(i, a, v, len(needs)) for i, (needs, _) in enumerate(rules) for a, v in needs], "rule int, axis string, value string, needed int")
    results = spark.createDataFrame([(i, *then) for i, (_, then) in enumerate(rules)], "rule int, axis string, value string, confidence double")
    met = fingerprint.select(key, "axis", "value").distinct().join(F.broadcast(conditions), ["axis", "value"]).groupBy(key, "rule", "needed").agg(F.count("*").alias("_n")).filter("_n = needed")  # rules are a few rows
    new = met.join(F.broadcast(results), "rule").groupBy(key, "axis", "value").agg(F.max("confidence").alias("confidence"))
    new = new.join(fingerprint.select(key, "axis", "value"), [key, "axis", "value"], "left_anti")
    return fingerprint.select(key, "axis", "value", "confidence").unionByName(new.select(key, "axis", "value", "confidence"))


def overridden(fingerprint: DataFrame, overrides: DataFrame, key: str = "item") -> DataFrame:
    """Overrides (key, axis, action, value): replace an axis, add or remove a value."""
    replaced = overrides.filter("action = 'replace'").select(key, "axis").distinct()
    removed = overrides.filter("action = 'remove'").select(key, "axis", "value")
    added = overrides.filter("action IN ('replace', 'add')").select(key, "axis", "value", F.lit(CEILING).alias("confidence"))
    kept = fingerprint.select(key, "axis", "value", "confidence").join(replaced, [key, "axis"], "left_anti").join(removed, [key, "axis", "value"], "left_anti")
    return kept.join(added.select(key, "axis", "value"), [key, "axis", "value"], "left_anti").unionByName(added.distinct())


def _hits(fingerprint: DataFrame, axes: DataFrame, key: str, exclusions: DataFrame | None = None) -> DataFrame:
    """key, archetype and what of its axes (archetype, kind, axis, value) the fingerprint meets, unless an exclusion in it (value, archetype) rules the archetype out.

    Axes and exclusions are looked up at once, so that a fingerprint is made and dealt out by its key only once.
    """
    table = axes.select("archetype", "kind", "axis", "value")
    if exclusions is not None:
        table = table.unionByName(exclusions.select("archetype", F.lit("excluded").alias("kind"), F.lit(EXCLUSIONS).alias("axis"), "value"))
    best = fingerprint.join(broadcast_if_small(table), ["axis", "value"]).groupBy(key, "archetype", "kind", "axis").agg(F.max("confidence").alias("c"))
    out, required = F.col("kind") == "excluded", F.col("kind") == "required"
    preferred = ~required & ~out
    hits = best.groupBy(key, "archetype").agg(
        F.count_if(required).alias("required_hits"), F.count_if(preferred).alias("preferred_hits"), F.sum(F.when(~out, F.col("c"))).alias("_sum"), F.count_if(~out).alias("_n"),
        F.array_sort(F.collect_set(F.when(required, F.col("axis")))).alias("matched"), F.bool_or(out).alias("_out"),
    )
    totals = axes.groupBy("archetype").agg(F.countDistinct(F.when(required, F.col("axis"))).alias("required_total"), F.countDistinct(F.when(~required, F.col("axis"))).alias("preferred_total"))
    return hits.filter("_n > 0 AND NOT _out").drop("_out").join(broadcast_if_small(totals), "archetype")


def archetypes(fingerprint: DataFrame, axes: DataFrame, exclusions: DataFrame | None = None, key: str = "item", least: int = 2) -> DataFrame:
    """key, archetype, score, confidence, required_hits, preferred_hits, rank: those whose axes a fingerprint meets well enough.

    At least two and three fifths of the required axes are needed; an
    exclusion in the fingerprint (table value, archetype) rules out.
    """
    hits = _hits(fingerprint, axes, key, exclusions)
    enough = F.greatest(F.lit(least), F.ceil(F.col("required_total") * 0.6))
    mean = F.col("_sum") / F.col("_n")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    confidence = F.round(F.least(F.lit(CEILING), 0.35 + share("required_hits", "required_total") * 0.35 + share("preferred_hits", "preferred_total") * 0.1 + mean * 0.2), 6)
    some = hits.filter(F.col("required_hits") >= enough).select(key, "archetype", (F.col("required_hits") * 100 + F.col("preferred_hits") * 25 + F.round(mean * 10).cast("long")).alias("score"), confidence.alias("confidence"), "required_hits", "preferred_hits")
    return topk_per_group(some, [key], [F.desc("score"), F.desc("confidence"), F.asc("archetype")], 1 << 20, "rank")


def primary_and_secondary(ranked: DataFrame, key: str = "item") -> DataFrame:
    """key, primary, secondaries: those that reach 60 and seven tenths of the first, three at most."""
    every = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "archetype", "score"))).alias("_all"))
    top = F.get("_all", F.lit(0))
    near = F.filter(F.slice("_all", F.lit(2), F.size("_all")), lambda x: x["score"] >= F.greatest(F.lit(60), F.floor(top["score"] * 0.7)))
    return every.filter(top["rank"] == 1).select(key, top["archetype"].alias("primary"), F.transform(F.slice(near, 1, 3), lambda x: x["archetype"]).alias("secondaries"))


def near_misses(fingerprint: DataFrame, axes: DataFrame, exclusions: DataFrame | None = None, key: str = "item", k: int = 5) -> DataFrame:
    """key, archetype, closeness, required_hits, missing, preferred_hits, rank: the closest archetypes, met or not."""
    hits = _hits(fingerprint, axes, key, exclusions).withColumn("missing", F.col("required_total") - F.col("required_hits"))
    close = hits.withColumn("closeness", F.col("required_hits") * 100 + F.col("preferred_hits") * 20 - F.col("missing") * 15)
    order = [F.desc("required_hits"), F.asc("missing"), F.desc("preferred_hits"), F.desc("closeness"), F.asc("archetype")]
    return topk_per_group(close, [key], order, k, "rank").select(key, "archetype", "closeness", "required_hits", "missing", "preferred_hits", "rank")


def relationships(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (anchor, candidate, a_primary, c_primary, c_secondaries) with relationship: same, then the edges' own kinds, then those to secondaries."""
    kinds = ["strong", "bridge", "adjacent"]
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    e = broadcast_if_small(edges.select(F.col("src").alias("a_primary"), F.col("dst"), "relation"))
    targets = pairs.withColumn("_t", F.concat(F.array(F.struct(F.col("c_primary").alias("dst"), F.lit("_neighbor").alias("end"))), F.transform("c_secondaries", lambda s: F.struct(s.alias("dst"), F.lit("_secondary").alias("end")))))
    met = targets.select("anchor", "candidate", "a_primary", F.explode("_t").alias("t")).select("anchor", "candidate", "a_primary", "t.dst", "t.end").join(e, ["a_primary", "dst"])
    best = met.groupBy("anchor", "candidate").agg(F.min(F.struct((F.col("end") == "_secondary").alias("late"), order[F.col("relation")].alias("o"), F.concat("relation", "end").alias("relationship")))["relationship"].alias("_found"))
    return pairs.join(best, ["anchor", "candidate"], "left").withColumn("relationship", F.when(F.col("a_primary") == F.col("c_primary"), "same").otherwise(F.col("_found"))).drop("_found")


# --- labels of providers


def source_labels(payloads: DataFrame, source: str, facets: dict[str, list[str]], key: str, column: str) -> DataFrame:
    """key, source, facet, label: the labels of JSON payloads, of each facet under any of its keys, repeats in other case left out."""
    found = [F.struct(F.lit(f).alias("facet"), labels.distinct_labels(F.flatten(F.array(*[labels.json_names(F.get_json_object(column, f"$.{k}")) for k in keys]))).alias("found")) for f, keys in facets.items()]
    rows = payloads.select(key, F.explode(F.array(*found)).alias("f"))
    return rows.select(key, F.lit(source).alias("source"), "f.facet", F.explode("f.found").alias("label"))


def changed_label_sets(old: DataFrame, new: DataFrame, key: str = "item", longest: int = 255) -> DataFrame:
    """The rows of ``new`` (key, source, facet, label) of those sources whose plain labels differ from ``old``'s; overlong labels go, repeats of a plain form too."""
    by = [key, "source"]

    def plain(rows: DataFrame) -> DataFrame:
        some = rows.filter(F.length("label") <= longest).withColumn("_plain", labels.plain_label(F.col("label"))).filter("_plain <> ''")
        return some.groupBy(*by, "facet", "_plain").agg(F.min("label").alias("label"))

    sets = lambda rows, name: plain(rows).groupBy(*by).agg(F.array_sort(F.collect_set(F.concat_ws("/", "facet", "_plain"))).alias(name))
    differs = sets(new, "_new").join(sets(old, "_old"), by, "left").filter(~F.col("_new").eqNullSafe(F.col("_old"))).select(*by)
    return plain(new).join(differs, by, "left_semi").select(*by, "facet", "label")


def mapped_labels(rows: DataFrame, mappings: DataFrame, heuristics: list[tuple[list[str], str, str, str]], key: str = "item") -> DataFrame:
    """key, source, axis, value: labels (key, source, facet, label) by the source's own mapping, else the general one, else the first heuristic.

    ``mappings`` has source (null: any), facet, label, axis, value.
    ``heuristics`` are (facets, pattern, axis, value) in order; those with the
    same pattern count together.
    """
    known = rows.select(key, "source", "facet", labels.plain_label(F.col("label")).alias("label")).filter("label <> ''")
    # Of each facet and label all that the table says: one look, and each label's row is judged where it is.
    told = F.struct(F.col("source").alias("source"), F.struct("axis", "value").alias("to"))
    m = mappings.groupBy(F.col("facet"), F.col("label")).agg(F.collect_list(told).alias("_told"))
    met = known.join(broadcast_if_small(m), ["facet", "label"], "left")
    to = lambda keep: F.transform(F.filter("_told", keep), lambda t: t["to"])
    own, general = to(lambda t: t["source"] == F.col("source")), to(lambda t: t["source"].isNull())
    groups: dict[tuple, list[tuple[str, str]]] = {}
    for facets, pattern, axis, value in heuristics:
        groups.setdefault((tuple(facets), pattern), []).append((axis, value))
    listed = lambda found: F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(v).alias("value")) for a, v in found])
    ladder = [F.when(F.col("facet").isin(*facets) & F.col("label").rlike(pattern), listed(found)) for (facets, pattern), found in groups.items()]
    found = F.coalesce(F.when(F.size(own) > 0, own), F.when(F.size(general) > 0, general), *ladder)
    return met.select(key, "source", F.explode(found).alias("g")).select(key, "source", "g.axis", "g.value").distinct()


def rebuilt(mapped: DataFrame, overrides: DataFrame, key: str = "item") -> DataFrame:
    """key, axis, vals (sorted), sources (sorted): the union of the sources, with overrides (key, axis, action add or remove, value)."""
    every = mapped.select(key, "axis", "value", "source", F.lit("map").alias("_do")).unionByName(overrides.select(key, "axis", "value", F.lit("override").alias("source"), F.col("action").alias("_do")))
    all_of = lambda do, what: F.collect_set(F.when(F.col("_do") == do, what))
    met = every.groupBy(key, "axis").agg(all_of("map", F.struct("value", "source")).alias("_map"), all_of("remove", F.col("value")).alias("_out"), all_of("add", F.struct("value", "source")).alias("_in"))
    kept = F.concat(F.filter("_map", lambda x: ~F.coalesce(F.array_contains("_out", x["value"]), F.lit(False))), F.col("_in"))
    of = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform("_kept", lambda x: x[name]), lambda v: v.isNotNull())))
    return met.withColumn("_kept", kept).filter(F.size("_kept") > 0).select(key, "axis", of("value").alias("vals"), of("source").alias("sources"))


def classified(rows: DataFrame, gaps: DataFrame, suppressed: DataFrame, ignored: DataFrame, rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (source, facet, label) with plain and classification: provider_gap, suppressed, ignored, mapped or unmapped.

    ``gaps`` and ``suppressed`` have source (null: any), facet, label;
    ``ignored`` label; ``rules`` label; ``aliases`` label, alias.
    """
    known = rows.withColumn("plain", labels.plain_label(F.col("label")))

    def listed(rules: DataFrame, mark: str) -> DataFrame:
        return broadcast_if_small(rules.select(F.col("source").alias("_s"), F.col("facet").alias("_f"), F.col("label").alias("_l")).distinct().withColumn(mark, F.lit(True)))

    def marked(left: DataFrame, table: DataFrame, mark: str) -> DataFrame:
        own, general = table.filter("_s IS NOT NULL"), table.filter("_s IS NULL").select("_f", "_l", F.lit(True).alias("_general"))
        out = left.join(own, (F.col("source") == F.col("_s")) & (F.col("facet") == F.col("_f")) & (F.col("plain") == F.col("_l")), "left").drop("_s", "_f", "_l")
        out = out.join(broadcast_if_small(general), (F.col("facet") == F.col("_f")) & (F.col("plain") == F.col("_l")), "left").drop("_f", "_l")
        return out.withColumn(mark, F.coalesce(mark, "_general")).drop("_general")

    out = marked(marked(known, listed(gaps, "_gap"), "_gap"), listed(suppressed, "_suppressed"), "_suppressed")
    out = out.join(broadcast_if_small(ignored.select(F.col("label").alias("plain"), F.lit(True).alias("_ignored")).distinct()), "plain", "left")
    every = rules.select(F.col("label").alias("plain")).union(aliases.join(rules.select(F.col("label").alias("alias")).distinct(), "alias").select(F.col("label").alias("plain"))).distinct()
    out = out.join(broadcast_if_small(every.withColumn("_mapped", F.lit(True))), "plain", "left")
    kind = F.when(F.col("plain") == "", "unmapped").when(F.col("_gap"), "provider_gap").when(F.col("_suppressed"), "suppressed").when(F.col("_ignored"), "ignored").when(F.col("_mapped"), "mapped").otherwise("unmapped")
    return out.withColumn("classification", kind).select(*rows.columns, "plain", "classification")


def rarity(documents: Column) -> Column:
    """common, uncommon or rare, by the number of items with a value."""
    return F.when(documents <= 3, "rare").when(documents <= 10, "uncommon").otherwise("common")


def analysed(classes: DataFrame, rules: DataFrame, identity_fields: list[str]) -> DataFrame:
    """source, facet, plain, classification, items, rarity, signals (sorted field:value), role: what each label is worth.

    ``classes`` is ``classified``'s output with item; ``rules`` have label, field, value.
    """
    found = classes.groupBy("source", "facet", "plain", "classification").agg(F.countDistinct("item").alias("items"))
    signals = rules.groupBy(F.col("label").alias("plain")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "field", "value"))).alias("_signals"), F.bool_or(F.col("field").isin(*identity_fields)).alias("_identity"))
    out = found.join(broadcast_if_small(signals), "plain", "left")
    none = F.expr("cast(array() as array<string>)")
    emits = F.col("classification") == "mapped"
    role = F.when(F.col("classification").isin("suppressed", "ignored"), "filter_only").when(emits & F.col("_identity"), "identity_driving").when(emits, "supporting")
    return out.select("source", "facet", "plain", "classification", "items", rarity(F.col("items")).alias("rarity"), F.when(emits, F.coalesce("_signals", none)).otherwise(none).alias("signals"), role.alias("role"))


# --- prose


def without_noise(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str]], vetoes: list[str], reset: str, least: int = 1) -> DataFrame:
    """key, text: the segments that no rule flags, each once, from the last segment with ``reset`` on; the whole text, spaces tidied, if none is left."""
    parts = flagged_segments(segments(docs, key, text, least), rules, vetoes).withColumn("_reset", F.lower("segment").contains(reset))
    last = parts.groupBy(F.col(key).alias("_key")).agg(F.max(F.when(F.col("_reset"), F.col("n"))).alias("_from"))
    bare = F.trim(F.regexp_replace("segment", rf"(?i)\b{reset}\b[:\s-]*", ""))
    kept = parts.join(last, F.col(key).eqNullSafe(F.col("_key"))).filter("_from IS NULL OR n >= _from").withColumn("segment", bare).filter("category IS NULL AND segment <> ''")
    first = kept.groupBy(key, F.lower("segment").alias("_low")).agg(F.min(F.struct("n", "segment")).alias("s"))
    joined = first.groupBy(F.col(key).alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["segment"]), "\n\n").alias("_kept"))
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    return docs.select(key, text).join(joined, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("_kept", tidy).alias("text"))


def merged_corpus(texts: DataFrame, key: str, columns: list[str], most: int = 12_000) -> DataFrame:
    """key, corpus, sources: an item's texts in order of ``columns``, without those that another contains, cut to ``most`` characters (the feature's bound)."""
    start = F.expr("cast(array() as array<struct<source:string,plain:string,text:string>>)")

    def add(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda k: F.contains(k["plain"], x["plain"]))
        covers = F.exists(kept, lambda k: F.contains(x["plain"], k["plain"]))
        at = F.array_position(F.transform(kept, lambda k: F.contains(x["plain"], k["plain"])), F.lit(True))
        swapped = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["source"].alias("source"), x["plain"].alias("plain"), x["text"].alias("text"))).otherwise(k))
        return F.when(x["plain"].isNull() | (x["plain"] == "") | inside, kept).when(covers, swapped).otherwise(F.array_append(kept, x))

    every = F.array(*[F.struct(F.lit(c).alias("source"), labels.plain_label(F.col(c)).alias("plain"), F.trim(F.regexp_replace(c, r"\s+", " ")).alias("text")) for c in columns])
    found = texts.select(key, F.aggregate(every, start, add).alias("k"))
    return found.select(key, F.substring(F.array_join(F.transform("k", lambda x: x["text"]), "\n\n"), 1, most).alias("corpus"), F.transform("k", lambda x: x["source"]).alias("sources"))


# --- from evidence to pairs


def effective(evidence: DataFrame, source_weights: dict[str, float], role_weights: dict[str, float], rare_bonus: dict[str, float]) -> DataFrame:
    """``evidence`` (…, source, role, rarity, confidence) with confidence weighed by source and role, and a bonus for rare values, at most CEILING."""
    table = lambda of, column, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col(column)), F.lit(default))
    weighed = F.col("confidence") * table(source_weights, "source", 1.0) * table(role_weights, "role", 1.0) + table(rare_bonus, "rarity", 0.0)
    return evidence.withColumn("confidence", F.round(F.least(F.lit(CEILING), weighed), 6))


def gated(fingerprint: DataFrame, provenance: DataFrame, gates: list[dict], key: str = "item") -> DataFrame:
    """``fingerprint`` without values whose gate stays shut.

    A gate has field, value, and any of: fields (one of which the item needs),
    provenance (of which one is needed), not_only (provenances that don't
    suffice).  ``provenance`` has key, axis, value, source.
    """
    small = fingerprint.sparkSession.createDataFrame([(g["field"], g["value"], g.get("fields", []), g.get("provenance", []), g.get("not_only", [])) for g in gates], "axis string, value string, _fields array<string>, _needed array<string>, _weak array<string>")
    at_stake = fingerprint.select(key, "axis", "value").join(F.broadcast(small), ["axis", "value"])  # a few gates
    axes = fingerprint.groupBy(key).agg(F.collect_set("axis").alias("_axes"))
    sources = provenance.groupBy(key, "axis", "value").agg(F.collect_set("source").alias("_sources"))
    judged = at_stake.join(axes, key).join(sources, [key, "axis", "value"], "left").withColumn("_sources", F.coalesce("_sources", F.expr("cast(array() as array<string>)")))
    has_field = F.arrays_overlap("_fields", "_axes")
    has_source = F.arrays_overlap("_sources", "_needed")
    weak_only = (F.size("_weak") > 0) & (F.size(F.array_except("_sources", "_weak")) == 0)
    strong = (F.size("_weak") > 0) & (F.size("_sources") > 0) & ~weak_only
    opened = (has_field & ((F.size("_needed") == 0) | has_source) & ~weak_only) | (~has_field & (F.size("_needed") == 0) & (F.size("_fields") == 0) & ~weak_only)
    refused = ~has_field & (F.size("_needed") > 0) & ~has_source
    shut = judged.filter(refused | ~(opened | strong)).select(key, "axis", "value")
    return fingerprint.join(shut, [key, "axis", "value"], "left_anti")


def preferred(ranked: DataFrame, fingerprint: DataFrame, preferences: list[tuple[str, str, str, str, int]], key: str = "item") -> DataFrame:
    """``ranked`` archetypes (key, archetype, score, rank) with rank again, after preference rules.

    A rule (over, prefer, axis, value, within) puts ``prefer`` before the
    leading ``over`` if the item has that value and the scores are at most
    ``within`` apart.
    """
    small = ranked.sparkSession.createDataFrame([(o, p, a, v, w) for o, p, a, v, w in preferences], "over string, prefer string, axis string, value string, within int")
    rules = fingerprint.join(broadcast_if_small(small), ["axis", "value"]).groupBy(key).agg(F.collect_set(F.struct("over", "prefer", "within")).alias("_rules"))
    every = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("_was"), *[c for c in ranked.columns if c not in (key, "rank")]))).alias("_all")).join(rules, key, "left")
    lead = F.get("_all", F.lit(0))
    meets = lambda x, r: (r["over"] == lead["archetype"]) & (r["prefer"] == x["archetype"]) & (lead["score"] - x["score"] <= r["within"])
    first = lambda x: (lead["_was"] == 1) & (x["_was"] > 1) & F.coalesce(F.exists("_rules", lambda r: meets(x, r)), F.lit(False))
    placed = every.select(key, F.posexplode(F.concat(F.filter("_all", first), F.filter("_all", lambda x: ~first(x)))).alias("_n", "_x"))
    return placed.select(*[F.col(key) if c == key else (F.col("_n") + 1).alias("rank") if c == "rank" else F.col(f"_x.{c}") for c in ranked.columns])


def audit_state(evidence: Column, candidates: Column, gaps: Column, unmapped: Column, near_hits: Column, near_total: Column) -> Column:
    """Why an item has or lacks an archetype: computed, provider_gap, mapping_gap, curation_required, conflict_ambiguous or insufficient_signal."""
    lacking = F.when(gaps > 0, "provider_gap").when(unmapped > 0, "mapping_gap")
    near = F.when(near_total.isNull(), "insufficient_signal").when((near_total > 0) & (near_hits >= F.greatest(F.lit(2), near_total - 1)), "curation_required").otherwise("conflict_ambiguous")
    return F.when((evidence > 0) & (candidates > 0), "computed").otherwise(F.coalesce(lacking, F.when(evidence == 0, "insufficient_signal").otherwise(near)))


def allowed_archetypes(primaries: DataFrame, edges: DataFrame, key: str = "item") -> DataFrame:
    """key, archetype: an item's primary, its neighbours by any edge, and its own secondaries."""
    own = primaries.select(key, F.explode(F.array_union(F.array("primary"), "secondaries")).alias("archetype"))
    near = primaries.select(key, F.col("primary").alias("src")).join(broadcast_if_small(edges.select("src", F.col("dst").alias("archetype"))), "src").select(key, "archetype")
    return own.unionByName(near).distinct()


def conditional_edges(pairs: DataFrame, edges: DataFrame, shared: DataFrame) -> DataFrame:
    """anchor, candidate, relation: the edges between primaries whose condition (axis, null: none) the pair's shared values meet."""
    met = pairs.join(broadcast_if_small(edges.select(F.col("src").alias("a_primary"), F.col("dst").alias("c_primary"), "relation", F.col("axis").alias("_axis"))), ["a_primary", "c_primary"])
    axes = shared.groupBy("anchor", "candidate").agg(F.collect_set("axis").alias("_axes"))
    return met.join(axes, ["anchor", "candidate"], "left").filter(F.col("_axis").isNull() | F.coalesce(F.array_contains("_axes", F.col("_axis")), F.lit(False))).select("anchor", "candidate", "relation")


def shared_values(pairs: DataFrame, fingerprint: DataFrame, key: str = "item") -> DataFrame:
    """anchor, candidate, axis, value: what both of a pair have."""
    a, c = fingerprint.select(F.col(key).alias("anchor"), "axis", "value"), fingerprint.select(F.col(key).alias("candidate"), "axis", "value")
    return pairs.select("anchor", "candidate").join(a, "anchor").join(c, ["candidate", "axis", "value"])


def token_scores(shared: DataFrame, weights: DataFrame, defaults: dict[str, int], rarities: DataFrame) -> DataFrame:
    """anchor, candidate, axis, score: per axis the sum of its shared values' weights (axis, value, weight), or the axis's default, and 2 for an uncommon and 4 for a rare value (value, rarity)."""
    default = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]), F.col("axis")), F.lit(0))
    rows = shared.join(broadcast_if_small(weights), ["axis", "value"], "left").join(broadcast_if_small(rarities), "value", "left")
    one = F.coalesce("weight", default) + F.when(F.col("rarity") == "uncommon", 2).when(F.col("rarity") == "rare", 4).otherwise(0)
    return rows.groupBy("anchor", "candidate", "axis").agg(F.sum(one).alias("score"))


#: What an unlisted relation adds, a candidate among the anchor's secondaries, and the bounds of confidence.
RELATION, SECONDARY_BONUS, CONFIDENT, MEDIUM = 120, 36, 280, 200


def pair_scores(
    pairs: DataFrame, fingerprint: DataFrame, blocked: DataFrame, exclusions: DataFrame, relation_weights: dict[str, int], weights: DataFrame, defaults: dict[str, int], rarities: DataFrame,
    needs: list[list[str]], penalties: list[tuple[str, str, int]], reasons: list[tuple[str, str]], key: str = "item",
) -> DataFrame:
    """anchor, candidate, relationship, score, confidence, reasons: how alike the fingerprints of pairs are.

    ``pairs`` has a_primary, c_primary, a_secondaries and relationship.  Pairs
    go whose archetypes block each other (``blocked``: src, dst, either way),
    or of which one has an exclusion (archetype, value) of the other's
    archetype; and those that share no axis of one of ``needs``.  A penalty
    (axis, value, points) is for a value that only the candidate has.
    ``reasons`` (axis, text) are given in order, after the archetype, three in all.
    """
    related = pairs.filter("relationship IS NOT NULL")
    both = blocked.select(F.col("src").alias("a_primary"), F.col("dst").alias("c_primary")).union(blocked.select("dst", "src")).distinct()
    related = related.join(broadcast_if_small(both), ["a_primary", "c_primary"], "left_anti")
    has = fingerprint.filter(F.col("axis") == EXCLUSIONS).join(broadcast_if_small(exclusions), "value").select(key, "archetype").distinct()
    related = related.join(has.select(F.col(key).alias("candidate"), F.col("archetype").alias("a_primary")), ["candidate", "a_primary"], "left_anti")
    related = related.join(has.select(F.col(key).alias("anchor"), F.col("archetype").alias("c_primary")), ["anchor", "c_primary"], "left_anti")
    shared = shared_values(related, fingerprint, key)
    per_axis = token_scores(shared, weights, defaults, rarities).join(shared.groupBy("anchor", "candidate", "axis").agg(F.array_sort(F.collect_set("value")).alias("_vals")), ["anchor", "candidate", "axis"])
    summed = per_axis.groupBy("anchor", "candidate").agg(F.sum("score").alias("_shared"), F.map_from_entries(F.collect_list(F.struct("axis", "_vals"))).alias("_by"))
    axes = F.map_keys("_by")
    enough = F.lit(True)
    for group in needs:
        enough = enough & F.arrays_overlap(axes, F.array(*map(F.lit, group)))
    rows = related.join(summed, ["anchor", "candidate"]).filter(enough)
    listed = F.create_map(*[F.lit(x) for kv in relation_weights.items() for x in kv])
    score = F.coalesce(F.try_element_at(listed, F.col("relationship")), F.lit(RELATION)) + F.col("_shared") + F.when((F.col("relationship") != "same") & F.array_contains("a_secondaries", F.col("c_primary")), SECONDARY_BONUS).otherwise(0)
    if penalties:
        table = fingerprint.sparkSession.createDataFrame(penalties, "axis string, value string, points int")
        costly = fingerprint.select(key, "axis", "value").join(F.broadcast(table), ["axis", "value"])  # a few penalties
        mine = costly.select(F.col(key).alias("candidate"), "axis", "value", "points")
        theirs = costly.select(F.col(key).alias("anchor"), "axis", "value")
        lost = rows.select("anchor", "candidate").join(mine, "candidate").join(theirs, ["anchor", "axis", "value"], "left_anti").groupBy("anchor", "candidate").agg(F.sum("points").alias("_lost"))
        rows = rows.join(lost, ["anchor", "candidate"], "left")
        score = score - F.coalesce("_lost", F.lit(0))
    kind = F.when(F.col("relationship") == "same", F.concat(F.lit("Same archetype: "), labels.shown(F.col("a_primary")))).when(F.col("relationship").startswith("strong"), F.concat(F.lit("Neighbor archetype: "), labels.shown(F.col("c_primary"))))
    kind = kind.when(F.col("relationship").startswith("bridge"), F.concat(F.lit("Bridge archetype: "), labels.shown(F.col("c_primary")))).otherwise(F.concat(F.lit("Adjacent archetype: "), labels.shown(F.col("c_primary"))))
    said = [F.when(F.array_contains(axes, axis), F.concat(F.lit(f"{text}: "), labels.human_list(F.transform(F.col("_by")[axis], labels.shown)))) for axis, text in reasons]
    out = rows.withColumn("score", score.cast("long")).withColumn("reasons", F.slice(F.array_compact(F.array(kind, *said)), 1, 3))
    confidence = F.when(F.col("score") >= CONFIDENT, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    return out.select("anchor", "candidate", "relationship", "score", confidence.alias("confidence"), "reasons")


def fingerprint_diff(stored: DataFrame, computed: DataFrame, key: str = "item") -> DataFrame:
    """key, axis, value, state: values only stored, only computed, or with another confidence."""
    a, b = stored.select(key, "axis", "value", F.col("confidence").alias("_a")), computed.select(key, "axis", "value", F.col("confidence").alias("_b"))
    state = F.when(F.col("_a").isNull(), "computed").when(F.col("_b").isNull(), "stored").when(F.col("_a") != F.col("_b"), "differs")
    return a.join(b, [key, "axis", "value"], "full").withColumn("state", state).filter("state IS NOT NULL").select(key, "axis", "value", "state")
