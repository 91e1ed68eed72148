"""Repeated rows, null ids, decoys and many items: the Jaccard join and the latent search."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import decontaminate, html_blocks, jaccard, licenses
from sparkmeter.llm.registry import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def words(rng, n, names="abcdefghijklmnopqrstuvwxyz"):
    return ["".join(rng.choice(names) for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_repeated_rows_do_not_multiply_links(spark):
    rng = random.Random(1)
    base = words(rng, 80)
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base))] * 40 + [(2, " ".join(near))] * 40
    rows += [(None, " ".join(base))] * 5 + [(None, " ".join(words(rng, 30)))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    body = F.col("text")
    keyed = docs.select("doc_id", F.xxhash64(body).alias("key"), body.alias("text"))
    links = jaccard.Join(keyed, 5, 80).links().collect()
    assert len(links) == 1  # two sets, one link, however often they are repeated
    got = jaccard.similar_documents(docs).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (None, 1), (None, None)}
    kept = jaccard.one_of_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


@pytest.fixture(scope="module")
def benchmark_items():
    rng = random.Random(2)
    common = words(rng, 60)
    return [(k, " ".join(rng.choice(common) if rng.random() < 0.4 else w for w in words(rng, 40)))
            for k in range(12)]


def leaks(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, table).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in found]
    assert len(pairs) == len(set(pairs))  # one row per document and item
    return set(pairs)


def brute_leaks(docs, items):
    """Windows of all documents against all items, by common subsequence alone."""
    out = set()
    for d, text in docs:
        have = (text or "").split()
        for i, item in items:
            own = item.split()
            need = -(-6 * len(own) // 10)
            for at in range(0, max(1, len(have) - len(own) // 2), 8):
                around = have[at : at + len(own) + 40]
                row = [0] * (len(around) + 1)
                for a in own:
                    last = 0
                    for k, b in enumerate(around, 1):
                        last, row[k] = row[k], last + 1 if a == b else max(row[k], row[k - 1])
                if row[-1] >= need:
                    out.add((d, i))
                    break
    return out


def changed(rng, text, share):
    return " ".join(w if rng.random() >= share else rng.choice(words(rng, 3)) for w in text.split())


def test_every_place_of_an_item_is_tried(spark, benchmark_items):
    rng = random.Random(3)
    docs = []
    for k, item in benchmark_items:
        decoy = item.split()
        rng.shuffle(decoy)
        held = changed(rng, item, 0.12)
        docs.append((k, " ".join([*decoy, *words(rng, 60), held, *words(rng, 20)])))
        docs.append((100 + k, " ".join([*decoy, *words(rng, 60)])))
        docs.append((200 + k, " ".join(words(rng, 150))))
    docs += [(300, None), (301, ""), (0, docs[0][1]), (None, docs[0][1]), (None, docs[3][1])]
    got = leaks(spark, docs, benchmark_items + [(0, benchmark_items[0][1]), (77, None), (78, "")])
    expected = brute_leaks(docs, benchmark_items)
    assert {(k, k) for k, _ in benchmark_items} <= expected
    assert got <= expected and len(expected - got) <= 1
    assert not {p for p in got if p[0] is not None and p[0] >= 100}


def test_items_in_any_number_of_passes(spark, benchmark_items, monkeypatch):
    rng = random.Random(5)
    docs = [(k, changed(rng, item, 0.1)) for k, item in benchmark_items] * 2
    items = benchmark_items + benchmark_items[:5]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 5)
    assert leaks(spark, docs, items) == whole and whole


def test_guards_change_no_canonical_text(spark):
    rng = random.Random(6)
    parts = ["Copyright (C) 2020 me\n", "© x", "(c) y\n", "licence", "sub-licence", "sub licensing",
             "copyright owner", "non-infringement", "acknowledgement", "per cent", "percent", "\n",
             " ", "word", "LICENCE", "ﬁ", "Ⓒ", "COPYRIGHT by z\n", "(C)"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(12)) for _ in range(400)]
    plain = F.regexp_replace(F.lower("t"), licenses._COPYRIGHT, " ")
    plain = F.trim(F.regexp_replace(plain, licenses._SIGNS, " "))
    for pattern, replacement in licenses.SPELLINGS:
        plain = F.regexp_replace(plain, pattern, replacement)
    table = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    for r in table.select("t", plain.alias("a"), licenses.canonical(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_pages_with_clashing_columns_and_unclosed_tags(spark):
    rows = [(1, "<article><p>One two three.</p></article>", "a", "b", "c", 7), (2, None, None, "b", "c", 7)]
    pages = spark.createDataFrame(rows, "page_id long, html string, _page string, row string, page string, text int")
    got = {r["page_id"]: r for r in html_blocks.extract(pages).collect()}
    assert got[1].asDict() == {"page_id": 1, "_page": "a", "row": "b", "page": "c", "text": "One two three."}
    assert got[2]["text"] == ""
    start = time.perf_counter()
    for tag in ("<script ", "<style", "<textarea x=1 "):
        assert html_blocks.main_text("<p>a</p>" + tag * 60_000) == html_blocks.main_text("<p>a</p>")
    assert time.perf_counter() - start < 5
