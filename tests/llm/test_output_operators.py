"""Token files, Matroska columns, passages, languages and the pipeline against brute force and round trips."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gapline.llm import common, decontamination, languages, matroska, mixing, passages, queries, records, simhash, tokens

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "It's <|endoftext|> we'LL ½²", "x"), (4, "It's <|endoftext|> we'LL ½²", "x"), (None, "nul l é", "x"), (None, None, "x"),
    (-5, "ΣΑΣ İ日本語 “q” a\x1cb\x85c\xa0d e_f__", "x"), (9, "wörter und words " * 4000, "x"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_tokens string")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- token files


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).collect()]
    assert sorted(map(tuple, queries.op6_tokens(spark, SF).collect())) == plain_tokens(rows)


def test_token_files_of_odd_rows(spark, odd):
    got = tokens.read_tokens(spark, tokens.write_tokens(odd, queries.tokenizer_path()), ids=True).collect()
    want = plain_tokens([r[:2] for r in ODD])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(k), n, c) for k, _, n, c in want)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [k for k, *_ in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert tokens.read_tokens(spark, tokens.write_tokens(odd.limit(0), queries.tokenizer_path())).count() == 0


def test_one_key_goes_to_many_files(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same words here "), (F.col("id") % 2).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = tokens.write_tokens(docs, queries.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written.index(spark).select("file").distinct().count() > 1
    assert tokens.read_tokens(spark, written).count() == 3000


def test_encoder_equals_the_library():
    rng = random.Random(4)
    alphabet = "abcXYZ '’.,!?éÉßΣ12²½_\x1c\x85\xa0́\n\t<|>日ﬁİ"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["<|startoftext|>A <|EndOfText|>"]
    encode = tokens.Encoder(queries.tokenizer_path(), 900)
    want = [x.ids for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids.tolist() for i in range(0, len(texts), 50) for ids in encode(texts[i : i + 50])]
    assert got == want


def test_frames_and_checksums():
    def plain(raw):
        crc = 0xFFFFFFFF
        for x in raw:
            crc ^= x
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert plain(b"123456789") == 0xE3069283
    bodies = [random.Random(n).randbytes(n) for n in (4, 5, 8, 255, 256, 257, 511, 513, 1500)]
    assert records.crc32c(bodies).tolist() == [plain(b) for b in bodies]
    framed = records.frames(bodies)
    assert records.bodies_of(framed) == bodies
    for f, b in zip(framed, bodies, strict=True):
        crc = plain(f[:8])
        assert struct.unpack("<QI", f[:12]) == (len(b), ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF)
    for at in (3, 9, 20, -1):
        broken = bytearray(framed[-1])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.bodies_of([bytes(broken)])


def test_files_can_be_scanned_without_the_index(spark, odd):
    written = tokens.write_tokens(odd, queries.tokenizer_path())
    found = [(key, ids.tolist()) for r in written.index(spark).select("file").distinct().collect() for key, ids in records.scan(f"{written.folder}/records", r.file)]
    assert len(found) == len(ODD) and all(ids[-1] == 2 for _, ids in found)


# --- Matroska


def test_matroska_on_the_table(spark):
    rows = {r.doc_id: r for r in queries.op8_matroska(spark, SF).collect()}
    for d in docs_of(spark).collect():
        raw = d.text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        media = matroska.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_matroska_of_odd_rows(spark, odd):
    media = matroska.store_media(odd)
    rows = matroska.media_digest(media).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes) for r in rows) == sorted((str(k), len((t or "").encode()), max(64, -(-len((t or "").encode()) // 64) * 64)) for k, t, _ in ODD)
    table = matroska.packets(media).collect()
    stored = {(r.doc_id, r.n_bytes): r.media for r in media.collect()}
    last = [p for p in table if p.doc_id == 9]
    raw = stored[9, len(ODD[-1][1].encode())]
    assert b"".join(raw[p.start : p.end] for p in sorted(last, key=lambda p: p.n)).rstrip(b"\0") == ODD[-1][1].encode()
    assert [p.timestamp_ns for p in sorted(last, key=lambda p: p.n)] == [512 * 125_000 * i for i in range(len(last))]
    assert matroska.media_digest(matroska.store_media(odd.limit(0))).count() == 0


def test_broken_files_are_told_and_harm_no_other(spark):
    rng = random.Random(4)
    good = matroska.mux(rng.randbytes(6400))
    broken = [good[:n] for n in range(1, len(good), 997)] + [bytes(x ^ (rng.random() < 0.02) * 255 for x in good) for _ in range(40)] + [b"", b"\x01", b"\x1f\x43\xb6\x75"]
    media = spark.createDataFrame([(n, bytearray(b), len(b)) for n, b in enumerate(broken)] + [(1000, bytearray(good), 6400), (1001, None, 0)], "doc_id long, media binary, n_bytes long")
    found = {r.doc_id: r for r in matroska.media_digest(media).collect()}
    assert len(found) == len(broken) + 2 and found[1000].error is None and found[1000].payload_bytes == 6400 and found[1001].media_bytes is None
    wrong = {k for k, r in found.items() if r.error is not None}
    assert wrong and all(found[k].feature is None and found[k].media_bytes == len(broken[k]) for k in wrong)
    packets = matroska.packets(media).collect()
    assert {r.doc_id for r in packets if r.error is not None} == wrong and all(r.n is None and r.start is None for r in packets if r.error is not None)


def test_all_kinds_of_lacing_and_unknown_sizes():
    rng = random.Random(2)
    m = matroska
    packets = [rng.randbytes(n) for n in (300, 5, 255, 256, 17000, 1)]
    for kind in (m.XIPH, m.EBML_LACING):
        block = m.vint(1) + struct.pack(">hB", -3, kind << 1) + m.lace(packets, kind)
        track, moment, _, ranges = m.unlace(block, 0, len(block))
        assert (track, moment, [block[a:b] for a, b in ranges]) == (1, -3, packets)
    even = [rng.randbytes(77) for _ in range(5)]
    block = m.vint(300) + struct.pack(">hB", 9, m.FIXED << 1) + m.lace(even, m.FIXED)
    assert m.unlace(block, 0, len(block))[0] == 300 and [block[a:b] for a, b in m.unlace(block, 0, len(block))[3]] == even
    one = lambda t, n: m.unsigned(m.TIMESTAMP, t) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.vint(1) + struct.pack(">hB", n, 0) + even[n]) + (m.element(m.REFERENCE_BLOCK, b"\xff") if n else b""))
    open_ended = lambda kind, data: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + data
    data = m.element(m.EBML, b"") + open_ended(m.SEGMENT, open_ended(m.CLUSTER, one(10, 0)) + open_ended(m.CLUSTER, one(20, 1)) + m.element(m.CUES, b""))
    found = m.demux(data)
    assert [(t, when, data[a:b], key, c) for t, when, a, b, key, c in found.packets] == [(1, 10_000_000, even[0], True, 0), (1, 21_000_000, even[1], False, 1)]
    for n in (64, 576, 4096, 4160, 32832, 100032):
        payload = rng.randbytes(n)
        file = m.mux(payload)
        media = m.demux(file)
        assert m.samples(file, media) == payload and {p for _, _, p in media.cues} == set(media.clusters)
        assert all(file[a : a + 4] == b"\x1f\x43\xb6\x75" for a in (p + file.index(b"\x15\x49\xa9\x66") for p in media.clusters))


# --- passages


def plain_passages(rows, least=passages.UNIT_WORDS, words=passages.PASSAGE_WORDS):
    units = []
    for key, text in rows:
        n, at = 0, 0
        for m in [*re.finditer(r"\n+|[.!?]+(?=[ \t-\r])", text or ""), None]:
            end = m.end() if m else len(text or "")
            body = (text or "")[at:end]
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), body))
            if len(found) >= least:
                space = " \t\n\r\x0b\x0c"
                units.append((key, n, at + len(body) - len(body.lstrip(space)), at + len(body.rstrip(space)), len(found), " ".join(found)))
                n += 1
            at = end
    order = lambda k: (k is None, k or 0)
    first, count = {}, defaultdict(int)
    for key, *_, digest in units:
        first[digest] = min(first.get(digest, key), key, key=order)
        count[digest] += 1
    seen, repeated = defaultdict(set), defaultdict(set)
    position = 0
    for position, (key, text) in enumerate(rows):
        for u in [u for u in units_of_row(units, rows, position)]:
            fresh = u[5] not in seen[position]
            seen[position].add(u[5])
            if count[u[5]] > 1 and not (first[u[5]] == key and fresh):
                repeated[key].add((u[1], u[2], u[3], u[4], first[u[5]]))
    out = []
    for key, found in repeated.items():
        runs = []
        for n, start, end, size, by in sorted(found, key=lambda x: x[:3]):
            if runs and runs[-1]["n"] + 1 == n and start >= runs[-1]["end"]:
                runs[-1].update(n=n, end=end, words=runs[-1]["words"] + size, by=runs[-1]["by"] | {by})
            else:
                runs.append({"n": n, "start": start, "end": end, "words": size, "by": {by}})
        out += [(key, r["start"], r["end"], r["words"], sorted(r["by"], key=order)) for r in runs if r["words"] >= words]
    return sorted(out, key=str)


def units_of_row(units, rows, position):
    """The units of one row: rows come in order, and a row's units are numbered from 0."""
    starts = [i for i, u in enumerate(units) if u[1] == 0] + [len(units)]
    with_units = [p for p, (_, t) in enumerate(rows) if any(True for _ in [0]) and has_units(t)]
    if position not in with_units:
        return []
    k = with_units.index(position)
    return units[starts[k] : starts[k + 1]]


def has_units(text):
    return bool(passages.units_of((text or "").encode(), line=None))


def check_passages(docs, rows):
    got = sorted(((r.doc_id, r.start, r.end, r.n_words, r.first_keys) for r in passages.repeated_passages(docs, line=None).collect()), key=str)
    want = plain_passages(rows)
    assert got == want
    return got


def test_passages_on_the_table(spark):
    docs = docs_of(spark)
    assert check_passages(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_passages_of_odd_rows(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(["Äb", "cd", "ef", "gé", "hi"]) + str(rng.randint(0, 99)) for _ in range(9)) + "."
    p = [" ".join(sentence() for _ in range(3)) for _ in range(6)]
    rows = [
        (1, None), (2, ""), (3, "\n\n . "), (4, p[0] + "\n" + p[1]), (5, sentence() + " " + p[0].upper().replace("Ä", "Ä") + " Yes. " + sentence()), (6, p[1] + " Ok. " + p[0]), (6, p[1] + " Ok. " + p[0]),
        (7, p[2] + "\n" + p[2]), (None, p[3]), (None, p[3] + " tail"), (8, p[3]), (9, "a b c d. " * 3000), (0, "a b c d."), (10, "heading with five words here\n" + sentence()), (11, "heading with five words here\n" + sentence()),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, start int")
    found = check_passages(docs, rows)
    assert not any(k in (1, 2, 3, 4, 8, 10, 11) for k, *_ in found)
    assert passages.repeated_passages(docs.limit(0)).count() == 0
    cleaned = {r.doc_id: r.text for r in passages.without_passages(docs.filter("doc_id is not null"), passages.repeated_passages(docs, line=None)).collect()}
    spans = defaultdict(list)
    for k, a, b, *_ in found:
        spans[k].append((a, b))
    for k, t in rows:
        if k is not None:
            want = t
            for a, b in sorted(spans.get(k, []), reverse=True):
                want = want[:a] + want[b:]
            assert cleaned[k] == want


def stretches_of(rows, size=passages.PASSAGE_WORDS):
    """(key, word, start, end, first key) of the stretches that stand before, by comparing all of them."""
    order = lambda k: (k is None, k or 0)
    found, first = [], {}
    for n, (key, text) in enumerate(rows):
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))]
        for i in range(len(words) - size + 1):
            run = tuple(w for w, *_ in words[i : i + size])
            found.append((run, n, key, i, words[i][1], words[i + size - 1][2]))
            first[run] = min(first.get(run, key), key, key=order)
    seen, out = set(), []
    for run, n, key, i, start, end in found:
        if first[run] != key or (n, run) in seen:
            out.append((key, i, start, end, first[run]))
        seen.add((n, run))
    return sorted(out, key=str)


def check_stretches(docs, rows):
    found = passages.copied_passages(docs, line=None).collect()
    inside = lambda key, a, b: any(p.doc_id == key and p.start <= a and b <= p.end for p in found)
    assert all(inside(key, a, b) for key, _, a, b, _ in stretches_of(rows))
    assert all(inside(r.doc_id, r.start, r.end) for r in passages.repeated_passages(docs, line=None).collect())
    assert all(p.n_words >= passages.PASSAGE_WORDS for p in found)
    return found


def test_stretches_on_the_table(spark):
    docs = docs_of(spark)
    assert check_stretches(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_stretches_of_odd_rows(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["Äb", "cd", "ef", "gé", "日本"]) + str(rng.randint(0, 99)) for _ in range(n))
    p = [words(40) for _ in range(4)]
    rows = [
        (1, None), (2, ""), (3, "..."), (4, p[0] + " " + p[1]), (5, words(7) + " " + p[1].upper().replace("Ä", "Ä").replace("É", "é") + "\n" + words(30)), (6, p[2]), (6, p[2]), (7, p[2] + words(2)), (None, p[3]), (None, p[3] + " x"),
        (8, p[3]), (9, "a " * 500), (0, "a " * 19), (10, p[0][: len(p[0]) // 2] + "! " + p[2]), (11, "x" * 300_000 + " " + p[0]),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, start int")
    check_stretches(docs, rows)
    assert passages.copied_passages(docs.limit(0)).count() == 0


def test_copies_of_short_units_are_found(spark):
    rng = random.Random(7)
    copy = "".join(f"{rng.choice('abcdef')}{rng.randint(0, 999)}!! " for _ in range(155)).strip()
    verse = "\n".join(f"line {rng.randint(0, 999)}" for _ in range(40))
    docs = spark.createDataFrame([(1, copy), (2, "Other words come first here. " + copy), (3, verse), (4, verse)], "doc_id long, text string")
    found = {r.doc_id: (r.start, r.n_words, r.first_keys) for r in passages.copied_passages(docs).collect()}
    assert found == {2: (29, 155, [1]), 4: (0, 80, [3])}


def test_copies_that_start_and_end_within_sentences_are_found(spark):
    word = iter(f"w{i}" for i in range(10_000))
    words = lambda n: " ".join(next(word) for _ in range(n))
    copy = f"{words(17)}. {words(9)}. {words(9)}. {words(18)}"
    long = words(60)
    docs = spark.createDataFrame([(1, f"{words(5)} {copy} {words(4)}."), (2, f"{words(6)} {copy} {words(3)}."), (3, f"{words(2)} {long} {words(2)}"), (4, f"{words(3)} {long}")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: (texts[r.doc_id][r.start : r.end], r.n_words, r.first_keys) for r in passages.copied_passages(docs).collect()}
    assert found == {2: (copy, 53, [1]), 4: (long, 60, [3])}
    assert passages.repeated_passages(docs).count() == 0


def lines_of(rows, least=passages.LINE_WORDS):
    """(key, start, end) of the whole lines of so many words that stand before."""
    order = lambda k: (k is None, k or 0)
    found, first = [], {}
    for n, (key, text) in enumerate(rows):
        for m in re.finditer(r"[^\n]+", text or ""):
            body = m[0]
            words = tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), body)))
            if len(words) >= least:
                space = " \t\n\r\x0b\x0c"
                found.append((words, n, key, m.start() + len(body) - len(body.lstrip(space)), m.start() + len(body.rstrip(space))))
                first[words] = min(first.get(words, key), key, key=order)
    seen, out = set(), []
    for words, n, key, start, end in found:
        if first[words] != key or (n, words) in seen:
            out.append((key, start, end))
        seen.add((n, words))
    return out


def check_lines(docs, rows):
    """Whole repeated lines go, and what goes besides is a passage of its own."""
    lines = lines_of(rows)
    found, without = passages.copied_passages(docs).collect(), passages.copied_passages(docs, line=None).collect()
    inside = lambda some, key, a, b: any(p.doc_id == key and p.start <= a and b <= p.end for p in some)
    assert all(inside(found, *x) for x in lines) and all(inside(found, p.doc_id, p.start, p.end) for p in without)
    for p in found:
        assert p.n_words >= passages.PASSAGE_WORDS or any(k == p.doc_id and p.start <= a and b <= p.end for k, a, b in lines)
    return [p for p in found if not inside(without, p.doc_id, p.start, p.end)]


def test_whole_lines_of_the_table(spark):
    docs = docs_of(spark)
    check_lines(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_whole_lines_that_stand_alone_go(spark):
    word = iter(f"w{i}" for i in range(10_000))
    words = lambda n: " ".join(next(word) for _ in range(n))
    one, several, short = words(12), f"{words(5)}. Oh! {words(4)}. {words(2)}", words(7)
    rows = [(n, f"{words(30)}\n{one}\n{words(9)}\n  {several} \n{short}\n{words(25)}") for n in range(3)] + [(5, one.upper() + "!"), (6, f"{one} {words(3)}"), (None, one), (7, "\n".join([one] * 4)), (8, None), (9, several + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = check_lines(docs, rows)
    texts = dict(rows)
    cut = defaultdict(list)
    for p in more:
        cut[p.doc_id].append(texts[p.doc_id][p.start : p.end].strip())
    both = sorted([one, f"{several} \n{short}"])  # a repeated line that touches goes, too
    assert {k: sorted(v) for k, v in cut.items()} == {1: both, 2: both, 5: [one.upper() + "!"], None: [one], 9: [several]}
    assert any(p.doc_id == 7 for p in passages.copied_passages(docs).collect())


def test_texts_without_spaces_are_found(spark):
    rng = random.Random(8)
    han = "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(600))
    kana = "".join(chr(rng.randint(0x3041, 0x3090)) for _ in range(60))
    rows = [(1, han), (2, han), (3, kana + "abc def"), (4, f"xyz {kana}"), (5, han[:10]), (6, "word " + han[100:130] + " other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.start, r.end, r.n_words) for r in passages.copied_passages(docs).collect()}
    assert found == {2: (0, 600, 600), 4: (4, 64, 60), 6: (5, 35, 30)}


def test_a_full_bit_map_changes_nothing(spark, monkeypatch):
    """With few bits nearly all pieces are let through, with many nearly none: the passages are the same."""
    docs = docs_of(spark)
    want = sorted(map(str, passages.copied_passages(docs).collect()))
    every = passages.pieces(docs)
    twice = every.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    kept = passages._let_through(every, twice)
    assert kept.columns == every.columns and kept.count() < every.count() and kept.join(twice, "digest").count() == every.join(twice, "digest").count()
    monkeypatch.setattr(passages, "MAP_BITS", 64)
    assert sorted(map(str, passages.copied_passages(docs).collect())) == want
    assert passages._let_through(every, twice).count() == every.count()


# --- languages


def test_automaton_has_all_substrings_and_no_others():
    rng = random.Random(1)
    text = "".join(rng.choices("ab ", k=60))
    states = languages.suffix_automaton(text)
    for _ in range(3000):
        s = "".join(rng.choices("abc ", k=rng.randint(1, 7)))
        at = 0
        for c in s:
            at = states[at].get(c)
            if at is None:
                break
        assert (at is not None) == (s in text)


def plain_phrases(letters, fit):
    """Phrases that end within a text, by substring search."""
    n, now = 0, ""
    for c in letters:
        if now + c in fit:
            now += c
        else:
            n += 1
            now = c if c in fit else ""
    return n


def check_parse(model, texts):
    letters, bits = model.bits(texts)
    for t, n, found in zip(texts, letters, bits, strict=True):
        plain = languages.letters_of(t)
        if not plain:
            assert n == 0
            continue
        assert n - len(plain) in (0, 1)  # a space behind the last word may count
        padded = plain + " " * int(n - len(plain))
        for (_, fit), b in zip(model.texts, found, strict=True):
            assert b == pytest.approx(plain_phrases(padded, fit) * np.log2(len(fit) + 1) / n)


def test_cross_parse_against_substring_search(monkeypatch):
    """Texts are parsed whole: phrases go on from stretch to stretch, and from part to part of a text that is taken in parts."""
    rng = random.Random(3)
    fits = ["".join(rng.choices("abcd é", k=900)), "".join(rng.choices("aabbe ", k=500))]
    model = languages.Model((("x", fits[0]), ("y", fits[1])))
    texts = [None, "", "12 .", "日本", "A", fits[0] * 3, fits[1][40:480] * 5, "a" * 3000, *["".join(rng.choices("abCdÉe  .1ñ", k=rng.randint(1, 1800))) for _ in range(40)]]
    check_parse(model, texts)
    monkeypatch.setattr(languages, "STRETCH", 50)
    monkeypatch.setattr(languages, "BATCH", 700)
    check_parse(model, texts)


def test_a_very_long_text_equals_the_whole_parse():
    rng = random.Random(4)
    model = languages.Model((("x", "".join(rng.choices("abc ", k=300))), ("y", "".join(rng.choices("cde ", k=300)))))
    check_parse(model, ["".join(rng.choices("abcde ", k=100_000))])


def test_packed_automata_of_large_alphabets():
    """Thousands of letters take room by their transitions, not by states times letters."""
    rng = random.Random(5)
    text = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(3000))
    walker = languages._Walker(languages.Model((("zh", text), ("x", "abc"))))
    assert sum(t.nbytes for t, *_ in walker.tables) < 1 << 20
    assert walker.bits([text])[1][0].argmin() == 0 and walker.bits(["abcabc"])[1][0].argmin() == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op10_languages(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark, odd):
    docs = docs_of(spark)
    model = languages.fit(docs)
    found = {(r.doc_id, r.lang_pred, r.score) for r in languages.identify(odd, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0)} <= found
    assert len(languages.identify(odd, model).collect()) == len(ODD)
    nothing = languages.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in languages.identify(odd, nothing).collect()} == {"und"}
    assert languages.fit(docs.limit(0)).texts == () and languages.identify(odd.limit(0), model).count() == 0
    kept = languages.in_a_known_language(docs.unionByName(spark.createDataFrame([(-1, "日本語 テスト", "en", "s", 1), (-2, "123", "en", "s", 1)], docs.schema)), model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())
    rng = random.Random(6)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=2000)), " ".join("".join(rng.choice(["szcz", "prz", "krz", "wj", "yj", "dzw"]) for _ in range(3)) for _ in range(200))]
    noisy = spark.createDataFrame([(-3 - i, t, "en", "s", 1) for i, t in enumerate(noise)], docs.schema)
    assert languages.in_a_known_language(noisy, model).count() == 0
    one = languages.fit(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in languages.identify(docs, one).collect()} == {"en"}


def test_many_labels(spark, monkeypatch):
    """Every label is learned, the 65th too; too many for their texts are an error."""
    rng = random.Random(7)
    sets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüß", 6)) for _ in range(65)]
    rows = [(65 * k + i, " ".join("".join(rng.choices(s, k=5)) for _ in range(60)), f"l{i:02d}") for k in range(6) for i, s in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(docs)
    assert len(model.texts) == 65
    found = {r.doc_id: r.lang_pred for r in languages.identify(docs, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)
    monkeypatch.setattr(languages, "FIT_LETTERS", 64 * languages.LEAST_LETTERS)
    with pytest.raises(ValueError, match="over 64 labels"):
        languages.fit(docs)


# --- pipeline


def test_pipeline(spark):
    docs, kept = docs_of(spark), docs_of(spark)
    by_id = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert all(r == by_id[r.doc_id] for r in kept.collect())
        out[name] = sorted(r.doc_id for r in kept.collect())
    assert out["language_id"] == sorted(by_id)
    groups = {r.doc_id: r.component for r in simhash.near_duplicates(docs).collect()}
    assert out["near_dedup"] == sorted(set(groups.values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = decontamination.brute_force([(i, by_id[i].text) for i in out["near_dedup"]], items)
    assert out["decontamination"] == [i for i, words, hit, _ in hits if not (hit and 20 * hit >= words)]
    clean = docs.filter(F.col("doc_id").isin(out["decontamination"]))
    clean = clean.withColumn("row", common.row_digest("doc_id", "text"))
    passes = {r.doc_id: r.passes for r in mixing.mix(clean, whole=True, key="row").join(clean.select("row", "doc_id"), "row").collect()}
    assert out["mixing"] == sorted(i for i, n in passes.items() for _ in range(n))
    want = plain_tokens([(i, by_id[i].text) for i in out["mixing"]])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + " x y z", "en", None, 1), (None, None, "en", "a", 1), (2, None, None, "b", 1), (3, "", "de", "b", None), (4, "un deux trois", "fr", "b", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    clean = decontamination.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == sorted(["None", "None", "", "un deux trois"])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    total = {None: 0, "a": 0, "b": 0}
    for r in mixed.collect():
        total[r.source] += len((r.text or "").split())
    assert total[None] <= 3 * 43 and total["a"] and mixing.mixed_documents(docs.limit(0)).count() == 0
    assert decontamination.clean_documents(docs.limit(0), items).count() == 0


def test_digests_are_of_normalised_words():
    raw = "Ab cd, EF gh!  Next line has words\nlast".encode()
    assert [(a, b, n) for a, b, n, *_ in passages.units_of(raw)] == [(0, 13, 4), (15, 34, 4), (0, 34, 8)]  # and the line of both
    assert passages.units_of(raw)[0][3] == xxhash.xxh3_64_intdigest(b"ab cd ef gh")


def plain_units(raw, least, line):
    """Units cut by a regular expression, one after the other."""
    out, begin, at = [], 0, 0
    for m in [*re.finditer(rb"\n+|[.!?]+(?=\s)", raw), None]:
        end, ends = (m.end(), m.group()[:1] == b"\n") if m else (len(raw), True)
        if not ends and raw[end : end + 1] == b"\n":
            continue
        whole = ends and at == begin and line is not None
        for a, kind in [(at, passages.WHOLE if whole else passages.UNIT)] + ([(begin, passages.LINE)] if ends and at != begin and line is not None else []):
            body, n = raw[a:end], len(passages.word_places(raw[a:end])[0])
            if n >= least and (kind != passages.LINE or n >= line):
                digest = xxhash.xxh3_64_intdigest(b" ".join(body.translate(passages._ALNUM).split()))
                out.append((a + len(body) - len(body.lstrip()), a + len(body.rstrip()), n, digest, passages.UNIT if kind == passages.WHOLE and n < line else kind))
        begin, at = end if ends else begin, end
    return out


def test_units_are_those_of_a_regular_expression():
    rng = random.Random(12)
    parts = ["a", "b1", " ", "  ", "\n", "\n\n", ".", "...", "! ", "?", "\t", "\r\n", "\x0b", "\x1c", "é", "日", "本語", "\x00", "ab cd ef gh ij kl mn op "]
    for _ in range(1500):
        raw = "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 10, 60]))).encode()
        for least, line in ((4, 8), (1, 2), (1, None)):
            assert passages.units_of(raw, least, line) == plain_units(raw, least, line)


def test_words_around_places(spark):
    text = "One two, drei 日本 (five) six. " * 3
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x y")], "doc_id int, text string")
    wanted = spark.createDataFrame([(1, [2 * w + s for w in (0, 3, 20, 21) for s in (0, 1)]), (2, [0, 1]), (3, [3])], "_key int, _at array<long>")
    found = {(r._key, r.word, r.side): (r.digests, r.places) for r in passages._contexts(docs, wanted, 4, "doc_id", "text").collect()}
    assert len(found) == 11 and found[2, 0, 0] == found[2, 0, 1] == ([], [])
    raw = text.encode()
    start, end = passages.word_places(raw)
    digests = passages._word_digests(raw, start, end).view(np.int64).tolist()
    start, end = (passages._code_points(raw)[x].tolist() for x in (start, end))
    for w in (0, 3, 20, 21):
        assert found[1, w, 0] == (digests[max(0, w - 4) : w][::-1], start[max(0, w - 4) : w][::-1]) and found[1, w, 1] == (digests[w : w + 4], end[w : w + 4])
    assert found[3, 1, 1][1] == [3]


# --- stored media, read by another reader


def read_tree(data, at, end, parents=(0x18538067, 0x1F43B675, 0x1654AE6B, 0xAE, 0x1C53BB6B, 0xBB, 0xB7)):
    """(ids from the root, data) of all elements of known size, by recursion."""
    def number(at, keep):
        n = 1
        while not data[at] & (0x80 >> (n - 1)):
            n += 1
        value = int.from_bytes(data[at : at + n], "big")
        return (value if keep else value & ((1 << 7 * n) - 1)), at + n

    while at < end:
        kind, at = number(at, True)
        size, at = number(at, False)
        yield (kind,), data[at : at + size]
        if kind in parents:
            for path, body in read_tree(data, at, at + size, parents):
                yield (kind, *path), body
        at += size


def plain_media(data):
    """Payload and feature of a file with one track of laced simple blocks, by the specification."""
    payload, blocks, packets, clusters, cues, tracks = b"", 0, 0, 0, 0, 0
    for path, body in read_tree(data, 0, len(data)):
        tracks += path[-1] == 0xAE
        clusters += path[-1] == 0x1F43B675
        cues += path[-1] == 0xF1
        if path[-1] == 0xA3:
            blocks += 1
            body, lacing = body[4:], body[3] >> 1 & 3
            if lacing == 0:
                packets += 1
            else:
                count = body[0] + 1
                body = body[1:]
                packets += count
                if lacing == 3:  # sizes: the first, then signed differences
                    at, n = 0, 0
                    while n < count - 1:
                        width = 1
                        while not body[at] & (0x80 >> (width - 1)):
                            width += 1
                        at, n = at + width, n + 1
                    body = body[at:]
            payload += body
    level = [b - 128 for b in payload]
    crossings = sum((x < 0) != (y < 0) for x, y in zip(level, level[1:], strict=False))
    last = (packets - 1) * 512 * 125
    return payload, f"tracks={tracks};clusters={clusters};blocks={blocks};packets={packets};cues={cues};last_us={last};level={sum(map(abs, level)) * 1000 // len(level)};crossings={crossings}"


def test_media_and_features_by_another_reader(spark):
    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    files = {r.doc_id: r.media for r in matroska.store_media(docs_of(spark)).collect()}
    for r in queries.op8_matroska(spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        payload, feature = plain_media(files[r.doc_id])
        assert payload == padded and r.feature == feature
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
