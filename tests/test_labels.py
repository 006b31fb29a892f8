"""Labels, mentions, gates and pair scores on odd values: nulls, empties, ties, repeats."""

import pytest
from pyspark.sql import functions as F

from gapline import plans
from gapline.functions import labels, mentions, titles
from gapline.operators import linking, relational, similarity, taxonomy
from gapline.sources import payloads


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize("value, want", [(None, None), ("", ""), ("Role-Playing & More's", "role_playing_and_mores"), ("  RPG ", "rpg")])
def test_tokens(spark, value, want):
    assert one(spark, value, labels.token(F.col("v"))) == want


@pytest.mark.parametrize("value, want", [("rpg", "RPG"), ("action_rpg", "Action RPG"), ("pvpve", "PvPvE"), ("open_world", "Open World"), ("", "")])
def test_shown_tokens(spark, value, want):
    assert one(spark, value, labels.shown(F.col("v"))) == want


@pytest.mark.parametrize("value, want", [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")])
def test_human_lists(spark, value, want):
    assert one(spark, value, labels.human_list(F.col("v")), "array<string>") == want


def test_distinct_labels_keep_the_first(spark):
    assert one(spark, ["B", " a", "b", "", "A "], labels.distinct_labels(F.col("v")), "array<string>") == ["B", "a"]


@pytest.mark.parametrize("value, want", [
    ('"a, b/c"', ["a", "b", "c"]), ('{"slug": "s", "name": " n "}', ["n"]), ('[{"title": "t"}, "u", 3, null]', ["t", "u"]), ("{broken", []), (None, []), ("plain, text", ["plain", "text"]), ('{"label": {"name": "deep"}}', ["deep"]), ("[]", []),
])
def test_json_names(spark, value, want):
    assert one(spark, value, labels.json_names(F.col("v"))) == want


@pytest.mark.parametrize("value, want", [("", "811c9dc5"), ("a", "e40c292c"), ("foobar", "bf9cf968")])
def test_fnv_by_its_published_values(spark, value, want):
    assert one(spark, value, labels.fnv32(F.col("v"))) == want


@pytest.mark.parametrize("value, want", [
    ("Hollow Star review: great", "Hollow Star"), ("How to win", None), ("Solo", None), ("Iron Crown II gets a trailer", "Iron Crown II"), ("2077 is here", None), ("", None), ("Best deals of the day", None), ("Lord of the Rings", "Lord of the Rings"),
])
def test_inferred_titles(spark, value, want):
    assert one(spark, value, labels.inferred_title(F.col("v"))) == want


def test_search_queries_in_order(spark):
    assert one(spark, "Delta Force: Black Hawk - Gold Edition", labels.search_queries(F.col("v"))) == ["Delta Force: Black Hawk - Gold Edition", "Δ Force: Black Hawk - Gold Edition", "Delta Force", "Black Hawk - Gold Edition", "Delta Force: Black Hawk", "Gold Edition"]
    assert one(spark, "Tale: Episode 2 x", labels.search_queries(F.col("v"), splits=False)) == ["Tale: Episode 2 x", "Tale"]


@pytest.mark.parametrize("text, title, sequel, referred", [
    ("helldivers 2 is out", "helldivers", True, False), ("helldivers is out", "helldivers", False, False), ("a game inspired by mirrors edge", "mirrors edge", False, True), ("mirrors edge like mirrors edge", "mirrors edge", False, True),
    ("fans of mirrors edge get mirrors edge news", "mirrors edge", False, False), ("", "x y", False, False), ("mirrors edge inspired this", "mirrors edge", False, True), ("edge", "", False, False),
])
def test_mentions(spark, text, title, sequel, referred):
    df = spark.createDataFrame([(text, title)], "a string, b string").select(mentions.words(F.col("a")).alias("a"), mentions.words(F.col("b")).alias("b"))
    row = df.select(mentions.sequel_follows(F.col("a"), F.col("b")).alias("s"), mentions.only_referred_to(F.col("a"), F.col("b")).alias("r")).first()
    assert (bool(row.s), bool(row.r)) == (sequel, referred)


@pytest.mark.parametrize("text, want", [("control trailer shows", True), ("in control of review", False), ("lost control again", False), ("review the new control", True), ("control 2", True)])
def test_context(spark, text, want):
    df = spark.createDataFrame([(text, "control")], "a string, w string").select(mentions.words(F.col("a")).alias("a"), "w")
    assert df.select(mentions.near_context(F.col("a"), F.col("w"), ["trailer", "review"]).alias("x")).first().x is want


def test_ambiguous_titles(spark):
    titles_of = ["control", "the control", "crimson", "iv", "edge of night", "inside out"]
    df = spark.createDataFrame([(t, 1) for t in titles_of], "t string, often int").select("t", mentions.words(F.col("t")).alias("w"), "often")
    found = {r.t: r.x for r in df.select("t", mentions.ambiguous(F.col("w"), F.col("often"), ["control", "inside", "out"], ["the", "of"]).alias("x")).collect()}
    assert found == {"control": True, "the control": True, "crimson": False, "iv": False, "edge of night": False, "inside out": True}


def test_numeral_variants(spark):
    assert one(spark, "Part II of 3", mentions.numeral_variants(F.col("v"), titles.ROMAN)) == ["part ii of 3", "part ii of iii", "part 2 of 3", "part 2 of iii"]
    assert one(spark, None, mentions.numeral_variants(F.col("v"), titles.ROMAN)) == [""]


def test_gates(spark):
    fp = spark.createDataFrame([(1, "mood", "cozy", 0.9), (1, "setting", "farm", 0.8), (2, "mood", "cozy", 0.9), (3, "mood", "cozy", 0.7), (3, "setting", "farm", 0.7)], "item int, axis string, value string, confidence double")
    seen = spark.createDataFrame([(1, "mood", "cozy", "tag"), (3, "mood", "cozy", "text"), (2, "mood", "cozy", "tag")], "item int, axis string, value string, source string")
    kept = lambda gate: sorted(r.item for r in taxonomy.gated(fp, seen, [{"field": "mood", "value": "cozy", **gate}]).filter("axis = 'mood'").collect())
    assert kept({"fields": ["setting"]}) == [1, 3]
    assert kept({"provenance": ["tag"]}) == []
    assert kept({"fields": ["setting"], "provenance": ["tag"]}) == [1]
    assert kept({"fields": ["setting"], "not_only": ["text"]}) == [1, 2]
    assert kept({"not_only": ["tag"]}) == [3]
    assert taxonomy.gated(fp.limit(0), seen, [{"field": "mood", "value": "cozy"}]).count() == 0


def test_noise_resets_and_falls_back(spark):
    docs = spark.createDataFrame([(1, "Bonus pack! About the Game: It is fun. It is fun."), (2, "Buy  now"), (3, None), (4, "")], "item int, text string")
    found = {r.item: r.text for r in taxonomy.without_noise(docs, "item", "text", [("shop", "buy now|bonus|buy  now")], [], "about the game").collect()}
    assert found == {1: "It is fun.", 2: "Buy now", 3: None, 4: ""}


def test_corpus_drops_contained_texts(spark):
    df = spark.createDataFrame([(1, "a b", "A  b c", None, "z"), (2, None, None, None, None), (3, "x", "x", "", "x")], "item int, p string, q string, r string, s string")
    found = {r.item: (r.corpus, r.sources) for r in taxonomy.merged_corpus(df, "item", ["p", "q", "r", "s"]).collect()}
    assert found == {1: ("A b c\n\nz", ["p", "s"]), 2: ("", []), 3: ("x", ["p"])}


def test_pair_scores_gates_and_penalties(spark):
    fp = spark.createDataFrame([(i, a, v) for i, a, v in [(1, "world", "open"), (1, "tone", "grim"), (2, "world", "open"), (2, "tone", "grim"), (2, "tone", "cozy"), (3, "tone", "grim"), (4, "world", "open"), (4, "tone", "grim"), (4, "hard_exclusions", "sport")]], "item int, axis string, value string").withColumn("confidence", F.lit(0.9))
    pairs = spark.createDataFrame([(1, 2, "a", "b", ["b"], "bridge_neighbor"), (1, 3, "a", "a", [], "same"), (1, 4, "a", "a", [], "same"), (1, 5, "a", "c", [], None)], "anchor int, candidate int, a_primary string, c_primary string, a_secondaries array<string>, relationship string")
    empty = spark.createDataFrame([], "src string, dst string")
    excluded = spark.createDataFrame([("sport", "a")], "value string, archetype string")
    weights, rare = spark.createDataFrame([("tone", "grim", 20)], "axis string, value string, weight int"), spark.createDataFrame([("open", "rare")], "value string, rarity string")
    run = lambda blocked: taxonomy.pair_scores(pairs, fp, blocked, excluded, {"same": 150}, weights, {"world": 45, "tone": 6}, rare, [["world"]], [("tone", "cozy", 10)], [("world", "Shared world"), ("tone", "Shared tone")])
    assert [tuple(r) for r in run(empty).collect()] == [(1, 2, "bridge_neighbor", 120 + 49 + 20 + 36 - 10, "medium", ["Bridge archetype: B", "Shared world: Open", "Shared tone: Grim"])]
    assert run(spark.createDataFrame([("b", "a")], "src string, dst string")).count() == 0


def test_publishing_and_dirty_marks(spark):
    anchors = spark.createDataFrame([(1,), (2,), (3,)], "anchor int")
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5), (1, 9, 0.4), (2, 7, 0.9)], "anchor int, candidate int, final double")
    rows, run = similarity.publish(anchors, scored, 2)
    assert sorted(map(tuple, rows.collect())) == [(1, 7, 0.5, 1), (1, 8, 0.5, 2)]
    assert sorted(map(tuple, run.collect())) == [(1, "computed", None, 2), (2, "hidden", "conflict_ambiguous", 1), (3, "hidden", "insufficient_signal", 0)]
    marks = spark.createDataFrame([(1, False, []), (2, True, ["a_b"])], "item int, dirty boolean, reasons array<string>")
    assert sorted((r.item, r.dirty, r.reasons, r.changed) for r in similarity.mark_dirty(marks, ["A b", "a-b"]).collect()) == [(1, True, ["a_b"], True), (2, True, ["a_b"], False)]


def test_imports_and_lookup(spark):
    catalog = spark.createDataFrame([(1, "One", 10), (2, "Two", None), (3, "Three", 30)], "item int, title string, store_id int")
    sent = spark.createDataFrame([(10, "Renamed"), (20, "two"), (31, "THREE"), (40, "Four")], "store_id int, title string")
    assert {r.store_id: (r.item, r.action) for r in linking.import_actions(sent, catalog).collect()} == {10: (1, "updated"), 20: (2, "linked"), 31: (None, "refused"), 40: (None, "created")}
    asked = spark.createDataFrame([("thr",), ("zzz",)], "asked string")
    assert [tuple(r) for r in linking.lookup(asked, catalog.select(F.col("item").alias("entry"), "title")).collect()] == [("thr", 3, "Three")]


def test_scratch_folders_and_rule_tables(spark):
    df = spark.range(3)
    assert relational.saved(df, "x").count() == 3
    assert sorted(map(tuple, payloads.rule_table(spark, payloads.deep_merge({"a": {"b": 1}}, {"a": {"c": [2]}})).collect())) == [("a.b", "1"), ("a.c", "[2]")]


def test_titles_are_found_in_shards_of_any_size(spark):
    texts = [(1, "Iron Crown review", "the iron crown II is iron"), (2, None, None), (3, "IRON crown iron CROWN", ""), (4, "a b c d e f g h i j", "a b c d e f g h x j"), (4, "a b c d e f g h i j", None)]
    articles = spark.createDataFrame(texts, "article int, headline string, description string")
    names = spark.createDataFrame([(1, "Iron Crown"), (2, "Iron"), (3, "a b c d e f g h i"), (4, ""), (5, None), (6, "crown, II"), (7, "iron crown")], "item int, title string")
    ways = [sorted(map(tuple, linking.phrase_candidates(articles, names, shard=n).collect())) for n in (1, 3, 100)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 8
    assert linking.phrase_candidates(articles, names.limit(0)).count() == 0 and linking.phrase_candidates(articles.limit(0), names).count() == 0


def test_words_of_phrases_are_walked_once(spark):
    """Against all phrases at all places, with phrases that begin and end within each other."""
    import random

    from gapline.operators import phrases

    rng = random.Random(6)
    known = [[rng.choice("abc") for _ in range(rng.randint(1, 5))] for _ in range(60)] + [["the"] * n for n in range(1, 40)]
    automaton = phrases.Automaton(list(enumerate(known)))
    for _ in range(200):
        text = [rng.choice(["a", "b", "c", "the", "x"]) for _ in range(rng.randint(0, 60))]
        want = {n for n, p in enumerate(known) if any(text[i : i + len(p)] == p for i in range(len(text)))}
        assert automaton.found(text) == want
    assert phrases.Automaton([]).found(["a"]) == set()


@pytest.mark.parametrize("name, most", [("AGG-21_confusion", 1), ("TAX-03_mapped_labels", 1), ("TAX-04_rebuilt", 3), ("TAX-21_preferred", 2)])
def test_labels_and_evidence_are_made_once(spark, name, most):
    """Each further use of them in a plan was another scan, with shuffles of its own."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [") <= most
