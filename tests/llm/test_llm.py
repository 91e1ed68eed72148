"""The operators against brute force, SQL and odd tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from functools import reduce

import numpy as np
import pytest
from check_oracles import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmeter.llm import classifier, decontaminate, html_blocks, jaccard, licenses, line_quality
from sparkmeter.llm import packing, personal, sharding, substrings
from sparkmeter.llm.queries import ORACLES, QUERIES
from sparkmeter.llm.registry import ship_package
from sparkmeter.session import settle

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, texts):
    return spark.createDataFrame([(d, t, None, "s", 0) for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd_texts():
    """Nulls, empty and very long texts, ties, copies, near copies, a shared passage."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a " * 4000), (6, "x" * 60_000)]
    for group in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows) * 7 + group, " ".join(copy)))
    for _ in range(12):
        own = [rng.choice(words) for _ in range(40)]
        rows.append((len(rows) * 7, " ".join(own + passage + own[:5])))
    return rows


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).limit(0)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    model = personal.train(spark)
    for df in (
        sharding.shard_rows(none, 4), licenses.find_licenses(none), line_quality.measure(none),
        decontaminate.find_leaks(none, items), classifier.score_documents(none, marks),
        jaccard.similar_documents(none), jaccard.one_of_each(none), personal.describe(none, model),
        substrings.remove_repeats(none), packing.pack_documents(none),
        html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.collect() == []


def test_shards(spark, odd_texts):
    rows = [*odd_texts, *odd_texts[:9]]
    got = sharding.shard_rows(table(spark, rows), 5).collect()
    assert len(got) == len(rows)
    sizes = collections.defaultdict(int)
    shards = collections.defaultdict(list)
    home = {}
    for r in got:
        sizes[r["digest"]] += r["bytes"]
        shards[r["shard"]].append(r["slot"])
        assert home.setdefault(r["digest"], r["shard"]) == r["shard"]
    for slots in shards.values():
        assert sorted(slots) == list(range(len(slots)))
    ordered = [sizes[d] for d in sorted(sizes)]
    loads = collections.Counter()
    for d, n in sizes.items():
        loads[home[d]] += n
    assert max(loads.values()) == least_capacity(ordered, 5)


def least_capacity(sizes, shards):
    def enough(capacity):
        used, load = 1, 0
        for size in sizes:
            if size > capacity:
                return False
            if load + size > capacity:
                used, load = used + 1, 0
            load += size
        return used <= shards

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def test_shard_search_narrows_bins():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([1, rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(rng.randint(1, 200))]
        ends = np.cumsum(sizes).tolist()

        def summary(ranges, parts, ends=ends):
            found = {}
            for end in ends:
                for k, (low, high) in enumerate(ranges):
                    if low <= end <= high:
                        width = max(1, -(-(high - low + 1) // parts))
                        found.setdefault((k, (end - low) // width), []).append(end)
            return [sharding.Bin(min(v), max(v), len(v)) for v in found.values()]

        shards = rng.randint(1, 17)
        capacity, cuts = sharding.search(summary, shards, ends[-1], rng.choice([1, 3, 64]))
        assert capacity == least_capacity(sizes, shards)
        assert cuts[-1] == ends[-1] and set(cuts) <= set(ends)


def test_licenses(spark):
    notice = "Copyright (c) 2020 A. Person\n"
    rows = [(1, notice + licenses._MIT.upper()), (2, "text\nReleased under the MIT Licence.\nmore"), (3, "MIT"), (4, None)]
    got = {(r["doc_id"], r["scope"], r["license_id"]) for r in licenses.find_licenses(table(spark, rows)).collect()}
    assert got == {(1, "document", "MIT"), (2, "line", "MIT")}


def test_line_rules_keep_prose(spark):
    prose = "This is a line of prose that ends as it should. " * 3
    rows = [(1, prose + "\n" + "Home | News | About"), (2, "AND!! THEN!! THEY!! SHOUTED!! AT!! ALL!! OF!! US!! FOR!! HOURS!! ON!! END!!"), (3, None)]
    got = rows_of(line_quality.measure(table(spark, rows)))
    assert [got[k]["base_failed"] for k in (1, 2, 3)] == [True, False, True]
    assert not got[2]["kept"]


def brute_spans(text):
    def luhn(digits):
        total = 0
        for k, c in enumerate(reversed(digits)):
            value = int(c) * (1 + k % 2)
            total += value - 9 if value > 9 else value
        return total % 10 == 0

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for number, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, odd_texts):
    rng = random.Random(4)
    noise = ["".join(rng.choice("a1+@.- (5)é2x%_\n") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts = [*enumerate(noise), *[(1000 + d, t) for d, t in odd_texts], (5000, "a@b.c_d@e.f"), (5001, "1 " * 9000)]
    texts += [(6000, 'the token = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d" here'), (6001, "order 2504982509303916 left")]
    model = personal.train(spark)
    got = rows_of(personal.describe(table(spark, texts), model))
    for d, t in texts:
        spans = brute_spans(t)
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == got[d]["base_sha256"], t
        assert set(spans) <= set(got[d]["spans"].split(",")) | {""}
    assert got[6000]["spans"].startswith("secret:") and got[6001]["spans"] == ""
    clean = rows_of(personal.redact(table(spark, [(1, "mail é a@b.cc now, or +1 (555) 123-4567."), (2, None)]), model))
    assert clean[1]["text"] == "mail é [EMAIL] now, or [PHONE]." and clean[2]["text"] is None


def brute_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").encode().lower())
        grams = [tuple(w[k : k + words]) for k in range(len(w) - words + 1)] or ([tuple(w)] if w else [])
        sets[d] = frozenset(grams)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, odd_texts, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 4)  # so that leaders are used
    got = rows_of(jaccard.similar_documents(table(spark, odd_texts), words=words, percent=percent))
    expected = brute_components(odd_texts, words, percent)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == expected


def brute_removed(rows):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (d, k)) != (d, k):
                gone[k : k + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages(spark, odd_texts):
    got = rows_of(substrings.remove_repeats(table(spark, odd_texts)))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == brute_removed(odd_texts)


def test_packing(spark, odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = [*odd_texts, (9001, "ends <|endoftext|> here")]
    got = packing.pack_documents(table(spark, rows)).collect()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    used, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        used[r["doc_id"]] += len(piece)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert used == {d: len(v) for d, v in ids.items()}
    assert sorted(places) == list(range(len(places)))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_best_fit_is_tightest():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 64, 500)
    windows, _ = packing.best_fit(lengths, 64)
    rooms: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[k]
        else:
            rooms.append(64 - lengths[k])
    loads = np.bincount(windows, lengths)
    assert sorted(64 - loads) == sorted(rooms)


def test_pages():
    for page, labels in html_blocks.LABELLED:
        kept = [b.text for b, y in zip(html_blocks.blocks_of(page), labels, strict=True) if y == "1"]
        assert html_blocks.main_text(page) == "\n".join(kept)
    assert html_blocks.main_text(None) == html_blocks.main_text("<script>var a='<p>x'") == ""
    assert html_blocks.main_text("<article><p>a<b>b</b>&amp;c<br>d  e</p><p>x &lt; y") == "ab&c d e\nx < y"


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    got = QUERIES["op5_fourier_quality"](spark, sf).toPandas()
    known = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[got["held_out"]].merge(known, on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_leaks(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    planted = [(10**6 + i, f"before it all. {t} after it all.") for i, t in asked]
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = decontaminate.find_leaks(base.union(table(spark, planted)), items).collect()
    hit = {(r["doc_id"], r["item_id"]) for r in found}
    assert sum((d, d - 10**6) in hit for d, _ in planted) >= 0.9 * len(planted)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    clean = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not [s for _, t in clean for s in brute_spans(t)]
    assert corpus_pipeline.token_packing(spark, docs, sf).select("doc_id").distinct().count() == len(clean)


def test_stages_keep_columns_with_clashing_names(spark, sf):
    names = "own_id own_key row key kept n_words n_lost_chars base found _id _key hit own".split()
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.union(table(spark, [(None, None), (-1, ""), (-2, "word " * 3000)]))
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    plain = settle(docs)
    more = settle(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = settle(stage(spark, plain, sf))
        more = settle(stage(spark, more, sf))
        assert more.columns == [*plain.columns, *names], name
        assert sorted(more.select(*plain.columns).collect()) == sorted(plain.collect()), name
        wrong = [~F.col(n).eqNullSafe(F.concat(F.lit(n), F.col("doc_id").cast("string"))) for n in names]
        assert more.filter(reduce(lambda a, b: a | b, wrong)).isEmpty(), name
    assert corpus_pipeline.token_packing(spark, more, sf).count() >= more.count()
