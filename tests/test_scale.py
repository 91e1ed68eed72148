"""Operators that split hot groups against brute force, and the plans Spark makes."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from sparkmeter.functions.labels import human_number
from sparkmeter.functions.text import (
    ABSOLUTELY_RIGHT,
    PERFECT,
    PLEASE,
    PROFANITY,
    THANKS,
    count_matches,
    required_literal,
)
from sparkmeter.operators.anonymise import anonymise_projects
from sparkmeter.operators.carry import carry_forward
from sparkmeter.operators.dedupe import batch_gate, dedupe_responses
from sparkmeter.operators.documents import TOPIC_PATTERNS, document_kind, plain_path
from sparkmeter.operators.facts import new_rows
from sparkmeter.operators.filters import date_range_filter
from sparkmeter.operators.ranking import global_row_number
from sparkmeter.operators.sessions import distinct_sessions, session_bits
from sparkmeter.operators.skew import spread_join
from sparkmeter.operators.upsert import assign_ids
from sparkmeter.plans.inputs import table, usage
from sparkmeter.schemas import USAGE, conform
from sparkmeter.session import scratch_path
from sparkmeter.store.index import refresh_sessions
from sparkmeter.store.tables import Store


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def hot(spark, n=3000):
    """Rows of which a third share one key."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97))
    return spark.range(n).select("id", key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    rows = hot(spark)
    lookup = rows.filter("key = 'hot' OR id % 2 = 0").groupBy("key").agg(F.count("*").alias("n"))
    spread = spread_join(rows, lookup, ["key"], ["id"], how)
    plain = rows.join(lookup, ["key"], how)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_never_broadcasts_its_copies(spark, how):
    # A stored lookup is far smaller as a file than its copies are in memory.
    path = scratch_path(spark, "lookup")
    hot(spark).select("key").distinct().write.parquet(path)
    plan = plan_of(spread_join(hot(spark), spark.read.parquet(path), ["key"], ["id"], how))
    assert "Broadcast" not in plan
    assert "SortMergeJoin" in plan


def test_session_bitmaps_broadcast_no_sessions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = F.lit("2024-01-01").alias("date")
    store.append("usage", conform(hot(spark).select(F.col("key").alias("session_id"), day), USAGE))
    refresh_sessions(store)
    plan = plan_of(session_bits(store.read("usage"), store.read("sessions")))
    assert "Broadcast" not in plan
    assert distinct_sessions(store.read("session_bits")).collect()[0]["sessions"] == 98


def test_spread_join_refuses_other_joins(spark):
    with pytest.raises(ValueError):
        spread_join(hot(spark), hot(spark), ["key"], ["id"], "full_outer")


def test_chunked_carry_equals_one_window(spark):
    rows = hot(spark).select(
        "id",
        "key",
        F.expr("id DIV 250").alias("chunk"),
        F.when(F.col("id") % 41 == 0, F.col("id")).alias("a"),
        F.when(F.col("id") % 577 == 5, F.concat(F.lit("v"), F.col("id"))).alias("b"),
    )
    args = (["key"], ["id"], ["a", "b"])
    count = ("n", F.col("id") % 5 == 0)
    split = carry_forward(rows, *args, chunk="chunk", count=count)
    whole = carry_forward(rows, *args, count=count)
    assert sorted(map(str, split.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_global_row_number_equals_window(spark):
    rows = hot(spark)
    order = [F.desc("key"), F.col("id")]
    mine = global_row_number(rows, order, "rank").select("id", "rank")
    plain = rows.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, plain.collect()))


def test_ids_are_dense_and_repeatable(spark):
    rows = hot(spark)
    first = assign_ids(rows.drop("id").withColumn("u", F.col("key")).distinct(), ["u"], F.lit(100))
    again = assign_ids(
        rows.drop("id").withColumn("u", F.col("key")).distinct().repartition(3), ["u"], F.lit(100)
    )
    n = first.count()
    assert sorted(r.id for r in first.collect()) == list(range(101, 101 + n))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_known_rows_by_brute_force(spark, sf):
    facts = usage(spark, sf).withColumn("message_uuid", F.concat(F.lit("m"), F.col("id") % 37))
    facts = facts.withColumn("session_id", F.concat(F.lit("s"), F.col("id") % 11))
    stored = facts.filter("id % 4 = 0 AND id % 37 < 30")
    gated = batch_gate(facts.filter("id % 4 <> 0"), ["id"])
    held = [(r.message_uuid, r.session_id) for r in stored.collect()]
    uuids, pairs = {u for u, _ in held}, set(held)
    expected = sorted(
        r.id
        for r in gated.collect()
        if (r.message_uuid not in uuids)
        or (r.message_type == "user" and (r.message_uuid, r.session_id) not in pairs)
    )
    assert sorted(r.id for r in new_rows(gated, stored).collect()) == expected and expected


def test_strict_anonymisation_masks_unused_folders(spark, sf):
    facts = usage(spark, sf).withColumn(
        "folder",
        F.when(F.col("message_type") == "user", "/only/prompts").otherwise(F.col("folder")),
    )
    names = {r.folder for r in anonymise_projects(facts).select("folder").distinct().collect()}
    strict = anonymise_projects(facts, strict=True).select("folder").distinct()
    assert "/only/prompts" in names
    assert {r.folder for r in strict.collect()} == (names - {"/only/prompts"}) | {"project-unused"}


def test_numbers_round_like_printed_doubles(spark):
    values = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 1450, 99950, 999949, 999950, 1_250_000,
              1_150_000, 523_650_000, 1_450_000_000, 1_350_000_000, 2**40]
    values += [1000 + 50 * i for i in range(400)] + [1_000_000 + 50_000 * i for i in range(400)]

    def printed(n):
        for size, unit in ((10**9, "bn"), (10**6, "M"), (10**3, "K")):
            if n >= size:
                return f"{n / size:.1f}{unit}"
        return str(n)

    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    for row in df.select("n", human_number(F.col("n")).alias("t")).collect():
        assert row.t == printed(row.n)


def test_literal_guards_are_part_of_every_match(spark):
    samples = (
        "fuck fuuuck fcking crap crappy asshole arse damn dam bitch hell hellll piss cock dicks"
        " twat f*ck sh*t perfect! excellent. you're absolutely right thank thx ty thanku thnks"
        " please plz ples pls indent: 4 tabs or spaces 4 spaces indent snake case black concise"
        " avoid emoji npm run x make y `npm test` src/app rest api orm design pattern prisma"
    )
    for patterns in (PROFANITY, PERFECT, ABSOLUTELY_RIGHT, THANKS, PLEASE, *TOPIC_PATTERNS.values()):
        expected = sum(len(re.findall(p, samples)) for p in patterns)
        df = spark.createDataFrame([(samples,)], "t string")
        assert df.select(count_matches(F.col("t"), patterns)).collect()[0][0] == expected
        for pattern in patterns:
            found = re.search(pattern, samples)
            if found:
                assert required_literal(pattern) in found.group(0)


def test_paths_are_resolved(spark):
    cases = {"/a/./b//c": "/a/b/c", "/a/../b/x/..": "/b", "/../a": "/a", "/": "/"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.q for r in df.select("p", plain_path(F.col("p")).alias("q")).collect()}
    assert got == cases


def test_document_kinds(spark):
    cases = {
        "/repo/CLAUDE.md": "project",
        "/repo/.claude/CLAUDE.md": "project",
        "/repo/a/CLAUDE.local.md": "local",
        "/x/rules/a.md": "rule",
        "/repo/a/b/CLAUDE.md": "subtree",
        "/repo/.hidden/CLAUDE.md": None,
        "/repo/a/dist/CLAUDE.md": None,
        "/CLAUDE.md": "parent",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.k for r in df.select("p", document_kind(F.col("p"), "/repo").alias("k")).collect()}
    assert got == cases


# --- plans -----------------------------------------------------------------------------------

JOBS = {
    "save_full", "save_full_daily", "rebuild", "rebuild_daily", "snapshot_table", "ingest",
    "push_all", "compact", "stream_ingest", "stream_dashboard", "stream_totals",
    "stream_ingest_and_push", "stream_replays",
}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - JOBS))
def test_no_cross_join_and_no_python_in_plans(name, spark, sf):
    plan = plan_of(entry.queries()[name](spark, sf))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                 "MapInPandas", "FlatMapGroups"):
        assert node not in plan


def test_dedupe_limits_groups_before_the_shuffle(spark, sf):
    plan = plan_of(dedupe_responses(usage(spark, sf), ["id"]))
    assert re.search(r"WindowGroupLimit[\s\S]*Partial", plan)


def test_new_rows_is_an_equi_anti_join(spark, sf):
    facts = usage(spark, sf)
    plan = plan_of(new_rows(batch_gate(facts, ["id"]), facts))
    assert "LeftAnti" in plan and "LeftSemi" in plan and "NestedLoop" not in plan


def test_date_range_prunes_day_partitions(spark, sf):
    store = Store(spark, scratch_path(spark, "plan"))
    store.append("usage", usage(spark, sf))
    rows = date_range_filter(store.read("usage"), "2024-01-05", "2024-01-06")
    plan = plan_of(rows.groupBy("model").agg(F.sum("total_tokens")))
    assert re.search(r"PartitionFilters: \[.*date.*2024-01-05", plan)
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"model", "total_tokens"}


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(entry.queries()["year_filter"](spark, sf))
    columns = set(re.findall(r"(\w+):(?!struct)", re.search(r"ReadSchema: (.*)", plan).group(1)))
    assert "l_comment" not in columns and "l_returnflag" not in columns
    assert "l_shipdate" in columns


def test_top_n_needs_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["top_projects"](spark, sf))


class Session:
    """What ``scratch_path`` asks a session for."""

    def __init__(self, setting, master="spark://host:7077"):
        self.conf, self.sparkContext, self.setting, self.master = self, self, setting, master

    def get(self, key, default):
        return self.setting if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_scratch_follows_the_session_setting():
    assert scratch_path(Session("hdfs:///shared/cp/"), "x").startswith("hdfs:///shared/cp/x-")
    with pytest.raises(RuntimeError):
        scratch_path(Session(None), "x")


def test_registered_tables_are_read_whole(sf, spark):
    assert table(spark, sf, "events").count() == usage(spark, sf).count()
