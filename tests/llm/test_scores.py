"""Host reputation, incremental centroids and collocations against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import centroids, collocations, reputation
from sparkmeter.llm.registry import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# --- host reputation -------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http:///path", "https://EXAMPLE.com/en/x?q=/fr/#a",
    "https://www.example.com/en/", "http://Sub.www.example.com/en/1", "http://example.com",
    "http://example.com?x=/en/", "http://example.com#/en/", "http://a.net/es/1", "http://a.net/fr/",
    "http://a.net/FR/", "http://net/es/", "http://internet/es/", "http://user@a.net:80/en/",
    "x://y://z.com/", "http://10.0.0.1/fr/", "http://a.co.uk/en/", "http://b.a.co.uk./es/",
    "http://ünï.com/en/", "http://x.org/" + "p" * 20_000, "http://example.com/en", "://h.com/",
    "http://a.net\n/es/2",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path, rules):
    fitting = [
        r for r in rules
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fitting, key=lambda r: len(r.name), default=None)


def brute_levels(host):
    bare = re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host)))
    if re.fullmatch(r"[0-9.]+", bare):
        return bare, ""
    labels = bare.split(".")
    take = 2 if ".".join(labels[-2:]) in reputation.SUFFIXES and len(labels) > 1 else 1
    return ".".join(labels[-take - 1 :]), ".".join(labels[-take:])


def brute_bounds(outcomes):
    """Lower bound of each host's rate of bad pages; outcomes: (host, 0, 1 or None)."""
    sums = [collections.defaultdict(lambda: [0, 0]) for _ in range(3)]
    for host, bad in outcomes:
        domain, suffix = brute_levels(host)
        for level, key in enumerate((host, (domain, suffix), suffix)):
            own = sums[level][key]
            own[0] += bad is not None
            own[1] += bad or 0

    def weight(level):
        groups = [(n, b) for n, b in level.values() if n > 1]
        if not groups:
            return reputation.MOST_WEIGHT
        mean = sum(b / n for n, b in groups) / len(groups)
        both = sum(b * (b - 1) / (n * (n - 1)) for n, b in groups) / len(groups)
        if both <= mean * mean:
            return reputation.MOST_WEIGHT
        own = (mean - both) / (both - mean * mean)
        return min(reputation.MOST_WEIGHT, max(reputation.LEAST_WEIGHT, own))

    n = sum(x for x, _ in sums[0].values())
    prior = sum(b for _, b in sums[0].values()) / n if n else 0.0
    w_host, w_domain, w_suffix = (weight(level) for level in sums)
    bounds = {}
    for host, (n, bad) in sums[0].items():
        domain, suffix = brute_levels(host)
        ns, bs = sums[2][suffix]
        nd, bd = sums[1][domain, suffix]
        top = (bs + prior * w_suffix) / (ns + w_suffix)
        mid = (bd + top * w_domain) / (nd + w_domain)
        a, b = bad + mid * w_host, n - bad + (1 - mid) * w_host
        spread = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        bounds[host] = a / (a + b) - reputation.DEVIATIONS * spread
    return bounds


def test_urls_and_rules_by_brute_force(spark):
    rng = random.Random(5)
    hosts = [f"{rng.choice('abcdef')}.{rng.choice(['x', 'y', 'example'])}.{t}" for t in
             ("net", "com", "org", "co.uk") for _ in range(8)]
    urls = URLS + [
        f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{k}" for k in range(600)
    ]
    urls += ["http://hot.z.net/es/1"] * 200 + ["http://hot.z.net/en/1"] * 3
    names = "page_id long, url string, host string, path string, rule string, _url string, n long, bad long"
    pages = spark.createDataFrame([(k, u, "h", "p", "r", "u", 1, 1) for k, u in enumerate(urls)], names)
    got = {r["page_id"]: r for r in reputation.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    parts = [brute_url(u) for u in urls]
    rules = [brute_rule(*p, reputation.RULES) for p in parts]
    marks = [None if r is None else int(r.verdict == "block") for r in rules]
    bounds = brute_bounds([(p[0], m) for p, m in zip(parts, marks, strict=True)])
    verdicts = set()
    for k, ((host, path), rule) in enumerate(zip(parts, rules, strict=True)):
        own = "block" if bounds[host] >= reputation.LIMIT else "allow"
        expected = (host, path, rule and rule.name, rule.verdict if rule else own)
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == expected, urls[k]
        verdicts.add((rule is None, expected[3]))
    assert len(verdicts) == 4  # both verdicts by rules and by reputation


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("a.bad.net", 1)] * 300 + [("b.bad.net", None)] + [("c.good.net", 0)] * 300
    rows += [("d.good.net", None), ("e.good.net", 1)]
    table = spark.createDataFrame(rows, "host string, bad int")
    got = {r["host"]: r for r in reputation.reputations(table).collect()}
    bounds = brute_bounds(rows)
    assert got.keys() == bounds.keys()
    for host, bound in bounds.items():
        assert abs(got[host]["bound"] - bound) < 1e-6
    assert got["b.bad.net"]["mean"] > 0.9 > 0.2 > got["d.good.net"]["mean"]
    assert got["a.bad.net"]["bound"] > got["b.bad.net"]["bound"]


def test_weights_of_priors():
    assert reputation.prior_weight(0, None, None) == reputation.MOST_WEIGHT
    half = reputation.SCALE // 2
    # All groups alike: the prior holds fully. Groups of one kind only: it hardly does.
    assert reputation.prior_weight(4, 4 * half, 4 * half // 2) == reputation.MOST_WEIGHT
    assert reputation.prior_weight(4, 4 * half, 4 * half) == reputation.LEAST_WEIGHT


def test_pages_without_rows_labels_or_hosts(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge_urls(none).collect() == []
    rows = [(None, None), (None, None), (1, "ftp://x.org/")]
    got = reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"}


# --- centroids -------------------------------------------------------------------------------


def brute_clusters(rows, clusters, rounds, width):
    kept = []
    for key, v in rows:
        if v is None or len(v) != width or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(256 * float(np.float32(c))))) for c in v]
        kept.append((key, x))
    digest = lambda k: hashlib.sha256(f"2:{'null' if k is None else k}".encode()).hexdigest()
    centres = [list(x) for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def nearest(x):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        own = [nearest(x)[0] for _, x in kept]
        for c in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centres[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return sorted(((k, *nearest(x)) for k, x in kept), key=str), centres


@pytest.mark.parametrize(("clusters", "width"), [(5, 3), (40, 8)])
def test_clusters_by_brute_force(spark, clusters, width):
    rng = random.Random(clusters)
    rows = [(k, [rng.gauss(0, 1) for _ in range(width)]) for k in range(160)]
    same = [0.25] * width
    rows += [(1000 + k, same) for k in range(80)]  # a third of all rows are one vector
    rows += [(7, same), (7, same), (None, [1e30] * width), (None, [-1e30] * width)]
    rows += [(1, None), (2, []), (3, same[1:]), (4, [float("nan")] * width), (5, [float("inf")] * width),
             (6, [None, *same[1:]])]
    schema = "vec_id long, embedding array<float>, x array<int>, cluster int, distance long"
    table = spark.createDataFrame([(k, v, [1], 9, 9) for k, v in rows], schema).repartition(3)
    state, centres = centroids.cluster_vectors(table, clusters, 4, width)
    expected, expected_centres = brute_clusters(rows, clusters, 4, width)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()), key=str)
    assert got == expected and centres.tolist() == expected_centres
    # The products that were carried along are those of the last centroids.
    for r in state.limit(50).collect():
        assert r["dots"] == (centres @ np.array(r["x"])).tolist()
    facts = centroids.describe(state, centres).collect()
    assert {r["inertia"] for r in facts} == {sum(d for _, _, d in expected)}
    sums = collections.Counter()
    for _, c, d in expected:
        sums[c] += d
    assert {(r["cluster"], r["cluster_inertia"]) for r in facts} == set(sums.items())


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    state, centres = centroids.cluster_vectors(spark.createDataFrame([(1, [0.5, 0.5])], schema), 3, 2, 2)
    assert [(r["cluster"], r["distance"]) for r in state.collect()] == [(0, 0)] and len(centres) == 1
    none = centroids.cluster_vectors(spark.createDataFrame([(1, None)], schema), 3, 2, 2)
    assert centroids.describe(*none).collect() == []


# --- collocations ----------------------------------------------------------------------------


def brute_collocations(rows, threshold, most, covered, first):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, most + 1):
                for k in range(len(words) - n + 1):
                    counts[lang][tuple(words[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        inside = collections.defaultdict(int)
        for p, a in held.items():
            for n in range(2, len(p)):
                for k in range(len(p) - n + 1):
                    inside[p[k : k + n]] = max(inside[p[k : k + n]], a)
        ranked = []
        for p, a in held.items():
            if 100 * inside[p] >= covered * a:
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l_, r) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l_, r, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdeé" for b in ("", "x", "Y", "'s", "-1")]
    rows = [(None, "en"), ("", None), (" \t ,;.\n", "en"), ("word", "en"), ("x" * 30_000, "de")]
    for k in range(240):
        text = "".join(
            rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\r\n", "!"])
            for _ in range(rng.randint(1, 60))
        )
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [("The Big  apple of new york city, new york", "en")] * 40
    rows += [("a " * 3000, "en"), ("new\x0byork new\x0cyork", "en"), ("\u00a0 \u2003 x", "fr")] * 3
    return rows


@pytest.mark.parametrize(("threshold", "most", "bits"), [(10, 3, 1 << 26), (3, 3, 64), (4, 4, 1 << 12)])
def test_collocations_by_brute_force(spark, phrases, threshold, most, bits, monkeypatch):
    monkeypatch.setattr(collocations, "PARTITION_BYTES", 3000)
    schema = "text string, lang string, phrase string, n long, part long, rank long"
    table = spark.createDataFrame([(t, g, "p", 1, 2, 3) for t, g in phrases], schema).repartition(5)
    got = collocations.collocations(table, threshold, most, 50, 60, bits=bits)
    expected = brute_collocations(phrases, threshold, most, 50, 60)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 6


def test_no_collocations(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    rare = spark.createDataFrame([("all words differ here", "en")], "text string, lang string")
    assert collocations.collocations(rare).collect() == []


def test_counts_pass_64_bits(spark):
    big = 4_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    (row,) = collocations.best_cuts(counts).collect()
    assert row["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 1))


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for turn in range(60):
        threshold = int(rng.integers(2, 30))
        heavy = rng.zipf(1.3, 4000) % 5000
        rare = rng.integers(0, 1 << 40, 6000)
        stream = np.concatenate([heavy, rare]).astype(np.uint64)
        rng.shuffle(stream)
        summary = collocations.Summary(threshold)
        summary.mass = len(stream)
        for block in np.array_split(stream, int(rng.integers(1, 40))):
            summary.add(*np.unique(block, return_counts=True))
            if turn % 2:
                summary.fold()
                assert len(summary.keys) <= summary.capacity
        kept = set(summary.survivors().tolist())
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold].tolist()) <= kept
        assert summary.taken <= threshold / 2


def test_blocks_hold_what_was_counted():
    rng = np.random.default_rng(4)
    for count in (1, 1000):
        values = rng.integers(0, 1 << 63, count).astype(np.uint64)
        assert (collocations._numbers(collocations._packed(values), count) == values).all()
    batch = pa.record_batch([pa.array(["a b a b", "b a"]), pa.array(["x", "x"])], names=["text", "lang"])
    rows = [r for b in collocations.count_blocks(3, 2, 30)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["size"] for r in rows if r["kind"] == 0) == 6 + 4
    assert sum(r["size"] for r in rows if r["kind"] == 1) == 4
