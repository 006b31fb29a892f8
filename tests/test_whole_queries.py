"""Linking and resolving queries on small tables of their own: what a shorter job would leave out is found."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gapline import plans
from gapline.functions import mentions

BENCHMARK = [(5, "Ox carts of old"), (10, "a new one"), (1, "go on then"), (6, "moon base again"), (2, "sea of ice melts"), (7, "or by it so"), (15, None), (20, "")]
DOCUMENTS = [
    (1, "The ox is slow\nmore of it"), (2, "We go on\nand an ox"), (3, "moon base\nas ever"), (4, "sea and of all ice\nx"), (5, "the moon has a base\nx"), (6, "so or so by it\nx"),
    (9, None), (12, ""), (40, "nothing here\nnothing there"),
]
PARTS = [(i, t, "b", "kind", 1, 2.0) for i, t in enumerate(["hot rod", "red rod", "go on", "iv", "x", "large bolt", "hot rod"])]
OX = 5


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    documents = [(i, text, "en", "web") for i, text in DOCUMENTS]
    part = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    for name, rows, schema in (("benchmark", BENCHMARK, "item_id long, text string"), ("documents", documents, "doc_id long, text string, lang string, source string"), ("part", PARTS, part)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def rows_and_sql(spark, d, name):
    """A query's rows, which are those of its SQL, as dicts."""
    con = duckdb.connect()
    for t in os.listdir(d):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{d}/{t}/*.parquet')")
    want = con.sql(plans.ORACLE_SQL[name])
    columns, rows = want.columns, want.fetchall()
    con.close()
    found = [r.asDict() for r in plans.QUERIES[name](spark, d).collect()]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found) == sorted(map(repr, rows))
    return found


def test_short_titles_are_candidates(spark, tables):
    found = {(r["article"], r["item"]): r["score"] for r in rows_and_sql(spark, tables, "LNK-03_phrase_candidates")}
    assert found[1, OX] == 2 + 90 + 65 and found[2, OX] == 2 + 65 and (5, 10) in found


def test_short_titles_win(spark, tables):
    assert (1, OX) in {(r["article"], r["item"]) for r in rows_and_sql(spark, tables, "LNK-07_winners")}


def test_short_titles_are_linked_anew(spark, tables):
    found = {r["article"]: (r["was"], r["now"], r["change"]) for r in rows_and_sql(spark, tables, "LNK-09_relinked")}
    assert found[1] == (None, OX, "linked") and found[6] == (6, None, "cleared") and found[9] == (9, None, "cleared")


def test_short_titles_are_counted(spark, tables):
    assert {r["item"]: (r["articles"], r["headlines"]) for r in rows_and_sql(spark, tables, "JOI-16_titles_in_articles")}[OX] == (2, 1)


def test_short_titles_get_flags(spark, tables):
    found = {(r["article"], r["item"]): r for r in rows_and_sql(spark, tables, "LNK-06_mention_flags")}
    assert found[5, OX]["sequel"] and found[1, OX]["context"]


def test_short_titles_are_adjusted(spark, tables):
    found = {(r["article"], r["item"]): r["score"] for r in rows_and_sql(spark, tables, "LNK-05_adjusted_candidates")}
    assert found[1, OX] == 2 + 90 + 65 + 30 and (5, OX) in found


def test_short_titles_win_when_adjusted(spark, tables):
    assert (1, OX) in {(r["article"], r["item"]) for r in rows_and_sql(spark, tables, "LNK-07_adjusted_winners")}


def test_titles_of_short_words_find_themselves(spark, tables):
    found = {r["id"]: r["match"] for r in rows_and_sql(spark, tables, "RES-01_best_titles")}
    assert found == {t: t for t in ("hot rod", "red rod", "go on", "iv", "x", "large bolt")}


def test_titles_of_two_or_short_words_are_found_in_order(spark, tables):
    found = {r["article"]: r["item"] for r in rows_and_sql(spark, tables, "LNK-08_words_in_order")}
    assert found[5] == 6 and found[4] == 2 and found[6] == 7 and found[2] == 1


def test_places_of_titles_are_those_of_plain_python(spark):
    """What is worked out once for all flags, on texts of few words, so that titles overlap, end texts and repeat."""
    rng = random.Random(5)
    some = lambda least, most: rng.choices(["a", "b", "2", "20", "21", "0", "x"], k=rng.randint(least, most))
    rows = [(i, some(0, 9), some(0, 3), rng.choice(["a", "b", "2", None])) for i in range(400)] + [(400, None, ["a"], "a"), (401, ["a"], None, "a")]
    x, t, w = F.col("x"), F.col("t"), F.col("w")
    found = spark.createDataFrame(rows, "i int, x array<string>, t array<string>, w string").select("i", mentions.places(x, t).alias("places"), mentions.spots(x, w).alias("spots"), mentions.numbered(x).alias("numbered"), mentions.sequel_follows(x, t).alias("sequel"))
    found = {r.i: r for r in found.collect()}
    for i, text, title, word in rows[:400]:
        n = len(title)
        places = [k + 1 for k in range(len(text) - n + 1) if n and text[k : k + n] == title]
        assert found[i].places == places and found[i].spots == [k + 1 for k, v in enumerate(text) if v == word]
        assert found[i].numbered == list(dict.fromkeys(v for v, after in zip(text, text[1:]) if after in ("2", "20")))
        assert found[i].sequel == any(text[k - 1 + n : k + n] in (["2"], ["20"]) for k in places) and (not found[i].sequel or title[-1] in found[i].numbered)
    assert found[400].places == found[400].spots == found[401].places == []
