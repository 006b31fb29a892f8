"""Mixing, sharding and chat formatting against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm import chat, mixing, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, size long, shard string, _key int, target string"
ODD = [
    (1, None, "en", None, 1, "x", 1, "t"),
    (2, "", None, "b", None, "x", 1, "t"),
    (3, "a " * 5000, "en", "b", 1, "x", 1, "t"),
    (4, "a b\tc\nd", "en", "a", 1, "x", 1, "t"),
    (4, "a b\tc\nd", "en", "a", 1, "x", 1, "t"),
    (None, "nul l é", "en", "é", 1, "x", 1, "t"),
    (6, " \n", "en", "z", 1, "x", 1, "t"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_algorithm(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    for n in (1, 2, 7, 40, 1000):
        for h, at in rows.select("h", sharding.jump_shard(F.col("h"), n).alias("at")).collect():
            key = int(h[:16], 16)
            assert (at.shard, at.grown) == (jump(key, n), jump(key, n + 1))


def check_shards(rows, docs):
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        key = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 40), jump(key, 41), "key")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want


def test_sharding(spark, odd):
    check_shards(sharding.assign_shards(odd, 40).collect(), [(r[0], r[1]) for r in ODD])
    assert sharding.assign_shards(odd.limit(0), 40).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_shards(queries.op2_sharding(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        got = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if got[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return got
        capped |= over


def check_mix(rows, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, t, s in docs:
        sizes[s] += words(t)
    want, by_id = targets(sizes), defaultdict(list)
    for d, t, s in docs:
        by_id[d].append((words(t), s))
    assert len(rows) == len(docs)
    for r in rows:
        size, s = next(x for x in by_id[r.doc_id] if x[0] == r.size)
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mixing(spark, odd):
    check_mix(mixing.mix(odd).collect(), [(r[0], r[1], r[3]) for r in ODD])
    assert mixing.mix(odd.limit(0)).count() == 0
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check_mix(rows, docs)
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1 + 1e-9
    assert all(r.position is None for r in rows[len(at):])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    whole = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), whole=True).collect()
    assert all(r.taken == r.passes * r.size for r in whole)


def test_one_source_cannot_exceed_its_cap(spark):
    rows = [(i, "w " * n, s, s) for i, (n, s) in enumerate([(1, "a"), (1, "b"), (2, "c"), (500, "d"), (0, "e")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    check_mix(mixing.mix(docs).collect(), [(r[0], r[1], r[3]) for r in rows])


def test_position_inverts_the_integrated_schedule(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in [(0.0, 1.0), (0.25, 3.0), (1.0, 0.0)]])
    df = spark.range(11).select((F.col("id") / 10 * (0.5 + 1.125)).alias("area"), mixing._pieces(knots).alias("p"))
    for area, t in df.select("area", mixing._time_at(F.col("p"), F.col("area"))).collect():
        integral = t + 4 * t * t if t <= 0.25 else 0.5 + 3 * (t - 0.25) - 2 * (t - 0.25) ** 2
        assert integral == pytest.approx(area)


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.OP1_SQL).fetchall()
    got = [tuple(r) for r in queries.op1_mixing(spark, SF).collect()]
    assert sorted(want) == sorted(got)


CHATS = [
    (1, 1, "assistant", "hi </s>", "x"), (1, 0, "user", "a <s> b [INST] \\ <\\s> [\\\\/INST]", "x"),
    (2, 0, "system", None, "x"), (2, 1, "user", "", "x"), (2, 2, "assistant", "é\n😀 <</SYS>><<SYS>> <<TURN>> <</TURN>>", "x"), (2, 3, "user", "q", "x"), (2, 4, "assistant", "<<s>>", "x"),
    (3, 0, "assistant", "first", "x"), (3, 0, "assistant", "first", "x"), (3, None, None, "nobody", "x"), (3, 5, "tool<</ROLE>>", "[/INST]", "x"),
    (None, 0, "user", "x" * 100000, "x"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(rows)
    out = {r.conv_id: r for r in chat.read_chats(made).collect()}
    convs = defaultdict(list)
    for c, t, r, x, _ in sorted(CHATS, key=lambda v: (v[0] or 0, -1 if v[1] is None else v[1], v[2] or "")):
        convs[c].append((r or "", x or ""))
    assert set(out) == set(convs)
    for c, turns in convs.items():
        assert [(t.role, t.text) for t in out[c].turns] == turns
        assert out[c].loss_texts == [x for r, x in turns if r == "assistant"]
    assert {c: r.valid for c, r in out.items()} == {1: True, 2: True, 3: False, None: False}
    for r in made.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        for s in r.segments:
            assert not s.loss or not re.search(r"[<\[]/?(?:s>|INST\]|<SYS>>)", s.text)
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_op9_on_the_table(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = queries.op9_chat(spark, SF).collect()
    assert len(rows) == len(convs)
    for r in rows:
        turns = sorted(convs[r.conv_id])
        said, learned = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_escape_is_reversible(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "SYS>>", "a"]), max_size=12).map("".join), min_size=200, max_size=400))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], T.StructType([T.StructField("t", T.StringType())]))
        bad = df.withColumn("e", chat.escape(F.col("t"))).filter((chat.unescape(F.col("e")) != F.col("t")) | F.col("e").rlike(r"</?s>|\[/?INST\]|<</?SYS>>"))
        assert bad.count() == 0

    run()


def test_rows_that_stand_very_often_are_dealt_out(spark):
    from gapline.llm import common

    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1000), ("d", 7)], "k string, n long")
    for together in (1, 3, 100, 10_000):
        got = sorted((r.k, r.i) for r in common.copies(df, "n", "i", together).collect())
        assert got == [(k, i) for k, n in [("a", 1), ("b", 3), ("c", 1000), ("d", 7)] for i in range(n)]
    assert common.copies(df.limit(0), "n", "i").count() == 0


def test_repeated_rows_and_null_keys_keep_their_places(spark):
    rows = [(None, f"w {i % 5}", "s") for i in range(600)] + [(7, "a b c", "s")] * 500 + [(i, "x y", "t") for i in range(100)] + [(None, None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = sharding.assign_shards(docs, 6).collect()
    assert len(dealt) == len(rows)
    for shard in {r.shard for r in dealt}:
        assert sorted(r.slot for r in dealt if r.shard == shard) == list(range(sum(r.shard == shard for r in dealt)))
    mixed = mixing.mix(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in mixed) == sorted((str(k), len((t or "").split())) for k, t, _ in rows)
    for source, words in (("s", 600 * 2 + 500 * 3), ("t", 200)):
        some = [r for r in mixed if r.source_size == words]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 1 and all(r.taken <= 3 * r["size"] for r in some)
