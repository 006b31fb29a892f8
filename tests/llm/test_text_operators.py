"""Decontamination and licence scans against brute force."""

import random
import re

import pytest

from gapline.llm import decontamination as dc
from gapline.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")


def check_decontamination(docs, items, **more):
    got = dc.contaminated_words(docs, items, **more).withColumn("n", dc.n_hit()).collect()
    want = dc.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], more.get("window", 13))
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.n, r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(set(r["items"]) <= set(r.near_items) for r in got)
    return got


def test_decontamination_on_the_table(spark):
    got = check_decontamination(*docs_of(spark))
    assert any(r.n for r in got)


def test_decontamination_in_blocks(spark):
    check_decontamination(*docs_of(spark), block_bytes=1500)


def test_decontamination_odd_rows(spark):
    random.seed(5)
    line = lambda n: " ".join(random.choice("abc") for _ in range(n))
    rows = [(1, None), (2, ""), (3, "A-B c!"), (3, "A-B c!"), (None, "x a b c"), (4, "...")] + [(10 + i, line(random.randint(1, 60))) for i in range(40)] + [(99, line(200_000))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, items string, n_words int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "?!"), (None, "C c"), (6, line(20)), (7, line(13)), (7, line(15))], "item_id long, text string")
    check_decontamination(docs, items)
    check_decontamination(docs, items, window=3)
    check_decontamination(docs, items.limit(0))
    assert check_decontamination(docs.limit(0), items) == []


def test_proximity(spark):
    words = [f"w{i}" for i in range(13)]
    moved = words[:5] + ["extra"] + words[5:]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, "w0 w5 w9 nothing else"), (3, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r for r in dc.contaminated_words(docs, items).collect()}
    assert (got[1]["items"], got[1].near_items) == ([], ["7"]) and got[2].near_items == [] and got[3]["items"] == ["7"]


def plain_near(docs, items, window=13, slop=dc.SLOP, share=dc.NEAR_SHARE):
    windows = dc.windows_of([(str(k), t.encode()) for k, t in items], window)
    out = {}
    for key, text in docs:
        words, out[key] = dc.alnum_words(text.encode()), set()
        for w, ids in windows.items():
            for s in range(-len(w) - slop, len(words) + slop + 1):
                if sum(x in words[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, x in enumerate(w)) >= share * len(w):
                    out[key] |= ids
                    break
    return {k: sorted(v) for k, v in out.items()}


def test_proximity_whatever_word_is_lost(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(13)]
    texts = [words[:i] + ["new"] + words[i + 1 :] for i in range(13)] + [words[2:], words[:-2], words[1:-1], words[:6], words[6:], words[3:], words[:-3]]
    texts += [rng.sample(words, 13) for _ in range(20)] + [[rng.choice([w, "w4", "x"]) if rng.random() < 0.2 else w for w in words] for _ in range(20)] + [[w for w in words for _ in range(rng.randint(0, 2))] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, f"w{i % 9} " * 50) for i in range(9)]
    items = [(7, " ".join(words)), (8, "w1 w2 w3"), (9, " ".join(words[:5])), (10, "never here at all w5 w6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.near_items for r in dc.contaminated_words(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all("7" in got[i] for i in range(16))
    assert got == plain_near(rows, items)


def base_scan(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({x for _, x in at})


def check_licenses(docs):
    rows = docs.collect()
    got = sorted(((r.doc_id, *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")]) for r in licenses.scan_licenses(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *base_scan(r.text)) for r in rows), key=str)


def test_licenses(spark):
    check_licenses(docs_of(spark)[0])
    rows = [(1, None), (2, ""), (3, "MIT License, mit-license! CC BY"), (4, "mit license mit license cc by by cc by"), (4, "mit license mit license cc by by cc by"), (None, "GNU General Public LICENSE the apache\nlicensé apache\tlicense"), (5, "cc by nc " * 20000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, score int")
    check_licenses(docs)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert all(0 <= r.score <= 1 for r in queries.op4_licenses(spark, SF).collect())


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["mit"]), ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
    ("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", ["mit", "apache-2.0", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"]),
    ("MIT OR", ["mit"]), ("OR MIT", []), ("", []), ("(MIT", []), ("MIT) x", ["mit"]),
])
def test_shunting_yard(text, postfix):
    assert licenses.to_postfix(text) == postfix


def all_choices(postfix):
    """Every choice of an expression, by multiplying out."""
    stack = []
    for token in postfix:
        if token not in licenses.PRECEDENCE:
            stack.append([frozenset([token])])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "or":
            stack.append([*a, *(x for x in b if x not in a)])
        elif token == "and":
            stack.append(list(dict.fromkeys(x | y for x in a for y in b)))
        else:
            stack.append([frozenset(f"{i} with {j}" for i in x for j in y) for x in a for y in b])
    return stack[0] if stack else []


def test_expressions():
    got = licenses.scan(b"// SPDX-License-Identifier: MIT OR (GPL-2.0-only AND Zlib)\nint x;", licenses.automaton())
    assert got["labels"] == ["gpl-2.0-only", "mit", "permissive", "zlib"] and got["choices"] == ["mit"] and got["score"] == 1.0 and got["n_base"] == 0
    both = licenses.scan(b"SPDX-License-Identifier: MIT AND GPL-2.0-only", licenses.automaton())
    assert both["labels"] == ["gpl-2.0-only", "mit", "strong-copyleft"] and both["choices"] == ["gpl-2.0-only and mit"]
    odd = licenses.scan(b"SPDX-License-Identifier: Foo-1.0 OR GPL-3.0-only WITH GCC-exception-3.1", licenses.automaton())
    assert odd["choices"] == ["gpl-3.0-only with gcc-exception-3.1"] and "weak-copyleft" in odd["labels"] and odd["score"] == 1.0
    assert licenses.scan(b"SPDX-License-Identifier: Foo-1.0", licenses.automaton())["score"] == 0.9


def test_evaluation_finds_the_best_of_all_choices():
    rng = random.Random(11)
    names = ["mit", "isc", "gpl-2.0", "lgpl-2.1", "foo", "agpl-3.0", "mpl-2.0", "bsd-3-clause"]

    def expression(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([rng.choice(names), f"{rng.choice(names)} with classpath-exception-2.0"])
        return f"({expression(depth - 1)}) {rng.choice(['and', 'or'])} ({expression(depth - 1)})"

    for _ in range(300):
        postfix = licenses.to_postfix(expression(rng.randint(0, 4)))
        terms, choice = licenses.evaluate(postfix)
        worst = lambda c: min(map(licenses.terms_of, c))
        every = all_choices(postfix)
        assert frozenset(choice) in every and terms == worst(choice) == max(map(worst, every))
    long = licenses.to_postfix(" and ".join(f"({a} or gpl-2.0)" for a in [f"bsd-{n}" for n in range(20_000)]))
    assert licenses.evaluate(long)[0] == licenses.PERMISSIVE and len(licenses.evaluate(long)[1]) == 20_000


@pytest.mark.parametrize("text, expressions", [
    ("SPDX-License-Identifier: MIT ... SPDX-License-Identifier: Apache-2.0", ["mit", "apache-2.0"]),
    ("x spdx license identifier MIT OR Zlib, SPDX-License-Identifier: SPDX-License-Identifier: (ISC) y\nSPDX-License-\nIdentifier: BSD-3-Clause\nISC", ["mit zlib or", "isc", "bsd-3-clause"]),
    ("SPDX-License-Identifier: MIT xspdx-license-identifiers: Zlib", ["mit"]),
])
def test_every_tag_of_a_line_is_parsed(text, expressions):
    assert licenses.scan(text.encode(), licenses.automaton())["expressions"] == expressions


def test_labels_of_long_expressions():
    many = [f"l{i}" for i in range(40)]
    got = licenses.scan(f"SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 AND ({' OR '.join(many)}) AND ({' OR '.join(many)})".encode(), licenses.automaton())
    assert got["labels"] == sorted(["gpl-2.0 with classpath-exception-2.0", "unknown-terms", *many])
    for text in ("a", "a or b and c with d", "(a or b) with c and a", "a with (b or c)", "(a or b) and (c or a with d)", "a with b with c"):
        postfix = licenses.to_postfix(text)
        assert licenses.labels_of(postfix) == {x for choice in all_choices(postfix) for x in choice}


def plain_labels(text):
    """Labels and score by comparing every phrase at every word, and every tag's expression by its operands."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = lambda phrase: any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))
    labels = {v for p, v in licenses.BASE.items() if at(p)}
    score = max([licenses.BASE_SCORE for p in licenses.BASE if at(p)] + [s for p, (_, s) in licenses.NOTICES.items() if at(p)], default=0.0)
    labels |= {v for p, (v, _) in licenses.NOTICES.items() if at(p)}
    for found in re.findall(r"SPDX-License-Identifier: ([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)", text or ""):
        terms = found.split(" ")
        worst, chosen = max(((min(map(licenses.terms_of, c)), -len(c), [-ord(x) for x in "".join(sorted(c))], c) for c in all_choices(licenses.to_postfix(found))), key=lambda x: x[:3])[::3]
        labels.add(licenses.TERMS[worst])
        score = max(score, 0.9 if any(licenses.terms_of(x) == licenses.UNKNOWN for x in chosen) else 1.0)
        i = 0
        while i < len(terms):
            if i + 2 < len(terms) and terms[i + 1] == "WITH":
                labels.add(f"{terms[i]} with {terms[i + 2]}".lower())
                i += 4
            else:
                labels.add(terms[i].lower())
                i += 2
    return sorted(labels), score


def test_labels_and_scores_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    parts = [*licenses.BASE, *licenses.NOTICES, "filler words", "Apache, License;", "MIT", "SPDX-License-Identifier: MIT\n", "SPDX-License-Identifier: Apache-2.0 OR MIT\n", "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 AND BSD\n"]
    docs += [(-i, " . ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(1, 300)]
    found = {r.doc_id: (list(r.labels), r.score) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for key, text in docs:
        assert found[key] == plain_labels(text), text
