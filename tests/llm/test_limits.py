"""Bounds of memory, disk and work inside tasks."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import collocations, decontaminate, jaccard
from sparkmeter.llm.registry import ship_package
from sparkmeter.session import settle


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def shuffle_files(spark) -> int:
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = held.mkString(" ").split()
    return sum("/shuffle_" in x or x.startswith("shuffle_") for x in names)


def settles_to(spark, most: int) -> bool:
    """Files go just after a query's end."""
    for _ in range(50):
        if shuffle_files(spark) <= most:
            return True
        time.sleep(0.1)
    return False


def test_bound_of_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    texts = spark.createDataFrame([(1, 1, "a b c d")], "doc_id long, key long, text string")
    jaccard.Join(texts, 3, 90)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    wide = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("tokens"))
    found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    spark.conf.set(key, before)
    assert sum(found) > 8000 * 3000
    assert max(found) < 8 << 20


def test_settled_tables_leave_no_shuffle_files(spark):
    grouped = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count()
    before = shuffle_files(spark)
    grouped.write.mode("overwrite").format("noop").save()
    assert shuffle_files(spark) > before
    before = shuffle_files(spark)
    assert settle(grouped, "grouped").count() == 1000
    # The count's own shuffle stays.
    assert settles_to(spark, before + 4)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_marks_leave_no_shuffle_files(spark):
    texts = spark.createDataFrame([("en", "one two three four " * 20)] * 40, "lang string, text string")
    texts = texts.repartition(8).cache()
    size = collocations.text_bytes(texts)
    before = shuffle_files(spark)
    marked = collocations.frequent_marks(texts, size, 10, 3, 1 << 16)
    assert marked.any()
    assert settles_to(spark, before)
    texts.unpersist()


def test_places_are_told_by_item(monkeypatch):
    """As place by place, but with two passes over the words per item and not per row and item."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, size=n)) for n in [0, 5, 200, 400, 30, 1000] * 5]
    asked = [{"item_id": k, "text": " ".join(rng.choice(words, size=n))} for k, n in enumerate((3, 12, 40))]
    items, _ = decontaminate._items(asked, np.ones(decontaminate.DIMENSIONS))
    found, hashes = decontaminate._word_hashes(pa.array(texts))
    start, row, first = decontaminate._passages(found, len(texts))
    owners = np.tile(np.arange(len(items)), len(first))
    at = np.repeat(first, len(items))
    places = [row[at], owners, np.ones(len(at)), start[at]]
    wanted = decontaminate.Wanted(items)
    calls = []
    among = wanted.among
    monkeypatch.setattr(wanted, "among", lambda *x: calls.append(1) or among(*x))
    ids = wanted.ids(hashes)
    hit = wanted.likely(places, found, ids)
    assert len(calls) == 2 * len(items)
    assert 0 < hit.sum() < len(hit)
    for k, i, begin, own in zip(places[0], owners, places[3], hit, strict=True):
        item, low, high = items[i], found.rows[k], found.rows[k + 1]
        reach = len(item.words) + decontaminate.BLOCK
        near = hashes[max(low, begin - reach) : min(high, begin + 2 * decontaminate.BLOCK + reach)]
        enough = np.isin(near, item.words).sum() >= item.needs()
        answer = np.isin(near, np.array(sorted(item.answer), dtype=np.uint64)).sum()
        assert own == (enough and answer / len(item.answer) >= decontaminate.ANSWER_SHARE)


def test_unlike_texts_move_no_sets(spark, monkeypatch):
    """Texts that share a phrase and little else are told apart by marks, before whole sets move."""
    rng = np.random.default_rng(5)
    words = [f"v{k}" for k in range(5000)]
    texts = [" ".join([*rng.choice(words, size=200), "one same phrase"]) for _ in range(60)]
    texts += [texts[0] + " more", texts[1] + " more"]
    rows = [(k, k, text) for k, text in enumerate(texts)]
    asked = []
    details = jaccard.Join.details
    monkeypatch.setattr(
        jaccard.Join, "details", lambda own, names, *more: asked.append(names.count()) or details(own, names, *more)
    )
    join = jaccard.Join(spark.createDataFrame(rows, "doc_id long, key long, text string"), 3, 90)
    assert {frozenset(r) for r in join.links().collect()} == {
        frozenset(bytes(jaccard._name(x)) for x in jaccard.shingle_sets(pa.array([texts[k], texts[60 + k]]), 3)) for k in (0, 1)
    }
    assert sum(asked) <= 12


def test_marks_bound_the_intersection():
    rng = np.random.default_rng(6)
    for na, nb, both in [(0, 5, 0), (1, 1, 1), (10, 12, 9), (300, 330, 280), (300, 900, 10), (15, 17, 0), (5000, 4000, 2500)]:
        tokens = rng.integers(0, 1 << 63, size=na + nb - both, dtype=np.uint64)
        a, b = np.sort(tokens[:na]), np.sort(tokens[na - both :])
        most = jaccard._most_shared(jaccard._marks(a), jaccard._marks(b), len(a), len(b))
        assert both <= most <= both + 0.4 * min(na, nb) + 2


def test_rows_without_the_words_cost_no_counts(monkeypatch):
    """Rows that lack an item's words are passed over by flags, and no row that holds an item is lost."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)]
    asked = [{"item_id": k, "text": " ".join(rng.choice(words, size=n))} for k, n in enumerate((3, 12, 40))]
    texts = [" ".join(rng.choice(words[:100], size=n)) for n in [0, 5, 200, 400] * 5]
    texts += [f"{texts[2]} {x['text']} {texts[3]}" for x in asked]
    items, _ = decontaminate._items(asked, np.ones(decontaminate.DIMENSIONS))
    found, hashes = decontaminate._word_hashes(pa.array(texts))
    start, row, first = decontaminate._passages(found, len(texts))
    owners, at = np.tile(np.arange(len(items)), len(first)), np.repeat(first, len(items))
    places = [row[at], owners, np.ones(len(at)), start[at]]
    wanted = decontaminate.Wanted(items)
    likely, counted = wanted.likely, []
    monkeypatch.setattr(wanted, "likely", lambda own, *x: counted.append(len(own[0])) or likely(own, *x))
    for flags in (1, 1 << 24):
        monkeypatch.setattr(decontaminate, "FLAGS", flags)
        got = {(k, i) for k, i, *_ in decontaminate._verified(places, wanted, found, hashes)}
        assert {(20, 0), (21, 1), (22, 2)} <= got
    assert counted[0] == counted[1] < len(at) / 2


def test_rows_move_once_to_their_representatives(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "g h i j k l"), (3, ""), (3, None)]
    found = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "hashpartitioning(own_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["1", "3", "None"]
