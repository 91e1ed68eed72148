"""Queries over log lines: events and messages are rendered as lines and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.functions.labels import sanitize_device_id
from sparkmeter.operators.cost import token_cost
from sparkmeter.operators.filters import history_or_daily, load_history
from sparkmeter.plans.inputs import (
    daily,
    day,
    day_sql,
    line_daily,
    line_usage,
    moment,
    moment_sql,
    now,
    table,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.schemas import COUNTERS, MANIFEST, PRICING, conform
from sparkmeter.session import scratch_path
from sparkmeter.sources.api_events import parse_api_events
from sparkmeter.sources.logs import malformed_lines, scan_logs
from sparkmeter.sources.manifest import (
    prune_manifest,
    stale_files,
    tracked_files,
    update_manifest,
)
from sparkmeter.sources.pricing import load_pricing, parse_pricing, upsert_pricing
from sparkmeter.sources.registry import (
    DEVICE_ID_PATTERN,
    Source,
    ingest_sources,
    validate_sources,
)
from sparkmeter.sources.results import write_results
from sparkmeter.sources.rollouts import parse_rollouts
from sparkmeter.sources.transcripts import parse_transcripts

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
FILE = "concat('/logs/f', CAST({id} DIV 1000 AS STRING), '.jsonl')"


def placed(df: DataFrame, key: str, value) -> DataFrame:
    """Rendered lines with a position: 1,000 consecutive keys per file, 100 per chunk."""
    return df.select(
        F.expr(FILE.format(id=key)).alias("file_path"),
        F.expr(f"{key} DIV 100").alias("chunk"),
        F.col(key).alias("pos"),
        value.alias("value"),
    )


def transcript_lines(facts: DataFrame, content=None) -> DataFrame:
    """Facts as lines of dialect A; every 97th is broken, every fifth has no request id."""
    fields = {
        "type": F.col("message_type"),
        "timestamp": F.date_format("ts", _ISO),
        "sessionId": F.when(F.col("id") % 13 != 0, F.col("session_id")),
        "uuid": F.concat(F.lit("u"), F.col("id")),
        "requestId": F.when(F.col("id") % 5 != 0, F.concat(F.lit("req"), F.col("id") % 11)),
        "cwd": F.col("folder"),
        "gitBranch": F.col("git_branch"),
        "version": F.col("version"),
        "message": F.struct(
            F.when(F.col("id") % 17 != 0, F.col("message_uuid")).alias("id"),
            F.when(F.col("id") % 89 == 0, "<synthetic>").otherwise(F.col("model")).alias("model"),
            F.struct(
                "input_tokens",
                "output_tokens",
                F.col("cache_read_tokens").alias("cache_read_input_tokens"),
                F.struct(
                    (F.col("cache_creation_tokens") - F.col("cache_creation_1h_tokens")).alias(
                        "ephemeral_5m_input_tokens"
                    ),
                    F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens"),
                ).alias("cache_creation"),
            ).alias("usage"),
        ),
    }
    line = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return placed(facts, "id", F.when(F.col("id") % 97 == 0, "{broken").otherwise(line))


_IDENTITY = (
    "CASE WHEN message_type = 'assistant' AND id % 17 <> 0 THEN CASE WHEN id % 5 <> 0 THEN"
    " concat(message_uuid, ':req', id % 11) ELSE message_uuid END ELSE concat('u', id) END"
)
_PARSED = (
    f"SELECT id, {moment_sql()}, {day_sql()},"
    " CASE WHEN id % 13 <> 0 THEN session_id ELSE 'unknown' END AS session_id,"
    f" {_IDENTITY} AS message_uuid, message_type, model, folder, git_branch, version,"
    " input_tokens, output_tokens, cache_creation_tokens, cache_creation_1h_tokens,"
    " cache_read_tokens, total_tokens FROM usage WHERE id % 97 <> 0 AND id % 89 <> 0"
)
_FACT_COLUMNS = (
    "message_uuid message_type model folder git_branch version input_tokens output_tokens"
    " cache_creation_tokens cache_creation_1h_tokens cache_read_tokens total_tokens"
).split()


@query("parse_transcripts", with_ctes("usage", _PARSED))
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    facts = parse_transcripts(transcript_lines(usage(spark, sf)))
    return facts.select(
        F.col("pos").alias("id"), moment(), day(), "session_id", *_FACT_COLUMNS
    )


@query(
    "response_identity",
    with_ctes(
        "usage",
        f"SELECT message_uuid, count(*) AS n FROM (SELECT {_IDENTITY} AS message_uuid FROM usage"
        " WHERE id % 97 <> 0 AND id % 89 <> 0) GROUP BY message_uuid",
    ),
)
def identities(spark: SparkSession, sf: str) -> DataFrame:
    facts = parse_transcripts(transcript_lines(usage(spark, sf)))
    return facts.groupBy("message_uuid").agg(F.count("*").alias("n"))


@query(
    "message_text",
    "SELECT conv_id, turn, md5(content) AS content, coalesce(length(content), 0) AS char_count"
    " FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN"
    " concat(text, chr(10), chr(10), role) WHEN 2 THEN concat('[', text, ']') END AS content"
    " FROM conversations)",
)
def message_texts(spark: SparkSession, sf: str) -> DataFrame:
    def line(content):
        return F.to_json(
            F.struct(
                F.lit("user").alias("type"),
                F.lit("2024-01-02T03:04:05Z").alias("timestamp"),
                F.concat_ws("/", "conv_id", "turn").alias("uuid"),
                F.struct(content.alias("content")).alias("message"),
            )
        )

    def block(kind, text=None):
        text = F.lit(None).cast("string") if text is None else text
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    blocks = F.array(
        block("text", F.col("text")),
        block("image", F.lit("ignored")),
        block("text"),
        block("text", F.col("role")),
    )
    turn = F.col("turn") % 4
    value = (
        F.when(turn == 0, line(F.col("text")))
        .when(turn == 1, line(blocks))
        .when(turn == 2, line(F.concat(F.lit("["), F.col("text"), F.lit("]"))))
        .otherwise(line(F.array(block("image"))))
    )
    lines = table(spark, sf, "conversations").select(
        F.lit("/logs/c.jsonl").alias("file_path"), value.alias("value")
    )
    facts = parse_transcripts(lines, content=True)
    return facts.select(
        F.split_part("message_uuid", F.lit("/"), F.lit(1)).cast("bigint").alias("conv_id"),
        F.split_part("message_uuid", F.lit("/"), F.lit(2)).cast("bigint").alias("turn"),
        F.md5("content").alias("content"),
        "char_count",
    )


@query(
    "malformed_lines",
    "SELECT event_id // 1000 AS file_no, event_id % 1000 + 1 AS line_no, CASE WHEN"
    " event_id % 97 = 0 THEN '{broken' ELSE '{\"a\":1} {\"b\":2}' END AS value FROM events"
    " WHERE event_id % 97 = 0 OR event_id % 101 = 5",
)
def malformed(spark: SparkSession, sf: str) -> DataFrame:
    value = F.expr(
        "CASE WHEN event_id % 97 = 0 THEN '{broken' WHEN event_id % 101 = 5 THEN"
        " '{\"a\":1} {\"b\":2}' WHEN event_id % 10 = 3 THEN '' ELSE props END"
    )
    bad = malformed_lines(placed(table(spark, sf, "events"), "event_id", value))
    return bad.select(
        F.regexp_extract("file_path", r"f(\d+)\.", 1).cast("bigint").alias("file_no"),
        "line_no",
        "value",
    )


def rollout_lines(events: DataFrame) -> DataFrame:
    """Events as lines of dialect B: one file per user; clicks set the context."""
    when = F.date_format("ts", _ISO).alias("timestamp")
    number = F.expr("CAST(floor(value) AS BIGINT)")
    meta = F.to_json(
        F.struct(
            F.lit("session_meta").alias("type"),
            when,
            F.struct(
                F.concat(F.lit("/w/"), F.col("event_id") % 7).alias("cwd"),
                F.concat(F.lit("cli-"), F.col("event_id") % 5).alias("cli_version"),
            ).alias("payload"),
        )
    )
    context = F.to_json(
        F.struct(
            F.lit("turn_context").alias("type"),
            when,
            F.struct(
                F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("event_id") % 9))
                .otherwise("")
                .alias("model")
            ).alias("payload"),
        )
    )
    turn = F.to_json(
        F.struct(
            F.lit("event_msg").alias("type"),
            when,
            F.struct(
                F.lit("token_count").alias("type"),
                F.struct(
                    F.struct(
                        number.alias("input_tokens"),
                        (F.col("event_id") % 20).alias("cached_input_tokens"),
                        (F.col("event_id") % 2).alias("output_tokens"),
                    ).alias("last_token_usage")
                ).alias("info"),
            ).alias("payload"),
        )
    )
    kind = F.col("event_type")
    return events.select(
        F.expr("concat('/logs/roll.', CAST(user_id AS STRING), '.jsonl')").alias("file_path"),
        F.expr("event_id DIV 500").alias("chunk"),
        F.col("event_id").alias("pos"),
        F.when(kind == "signup", meta)
        .when(kind == "click", context)
        .when(F.col("event_id") % 31 == 0, "{broken")
        .otherwise(turn)
        .alias("value"),
    )


@query(
    "parse_rollouts",
    "WITH l AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN"
    " concat('m', event_id % 9) END AS m, CASE WHEN event_type = 'signup' THEN"
    " concat('/w/', event_id % 7) END AS f, CASE WHEN event_type = 'signup' THEN"
    " concat('cli-', event_id % 5) END AS v, event_type NOT IN ('signup', 'click')"
    " AND event_id % 31 <> 0 AND (floor(value) > 0 OR event_id % 20 > 0 OR event_id % 2 > 0)"
    " AS billed, greatest(CAST(floor(value) AS BIGINT) - event_id % 20, 0) AS input_tokens,"
    " event_id % 2 AS output_tokens, event_id % 20 AS cache_read_tokens FROM events),"
    " c AS (SELECT *, last_value(m IGNORE NULLS) OVER w AS model, last_value(f IGNORE NULLS) OVER w"
    " AS folder, last_value(v IGNORE NULLS) OVER w AS version, count(*) FILTER (billed) OVER w AS n"
    " FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"
    " SELECT event_id AS id, concat('roll.', user_id) AS session_id,"
    " concat('roll.', user_id, ':t', n) AS message_uuid, coalesce(model, 'codex-unknown') AS model,"
    " coalesce(folder, 'unknown') AS folder, coalesce(version, 'codex') AS version, input_tokens,"
    " output_tokens, cache_read_tokens, input_tokens + output_tokens + cache_read_tokens AS"
    " total_tokens FROM c WHERE billed",
)
def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    facts = parse_rollouts(rollout_lines(table(spark, sf, "events")), now())
    return facts.select(
        F.col("pos").alias("id"), "session_id", "message_uuid", "model", "folder", "version",
        "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens",
    )


def api_lines(events: DataFrame) -> DataFrame:
    """Events as lines of dialect C, with counters of several JSON types."""
    line = (
        "concat('{\"type\":\"', CASE WHEN event_id % 23 = 0 THEN 'other' ELSE 'hermes_usage' END,"
        " '\",', CASE event_id % 3 WHEN 0 THEN concat('\"ended_at\":', 1700000000 + event_id, '.5,')"
        " WHEN 1 THEN concat('\"timestamp\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\",')"
        " ELSE '' END, '\"session_id\":\"', CASE WHEN event_id % 29 = 0 THEN ' ' ELSE"
        " concat('s', user_id) END, '\",\"api_request_id\":', CASE WHEN event_id % 7 = 0 THEN 'null'"
        " ELSE concat('\"r', event_id, '\"') END, ',\"message_uuid\":\"alt', event_id, '\",',"
        " CASE WHEN event_id % 4 = 0 THEN '\"cwd\":\"/w\",' ELSE '\"platform\":\"chat\",' END,"
        " '\"provider\":\" p', user_id % 3, ' \",\"model\":\"', event_type, '\",',"
        " CASE WHEN event_id % 6 = 0 THEN '\"response_model\":\"rm\",' ELSE '' END,"
        " '\"usage\":{\"input_tokens\":', CAST(floor(value) AS BIGINT) - 5,"
        " ',\"output_tokens\":\"', event_id % 10, '\",\"cache_read_tokens\":\"bad\",',"
        " '\"cache_write_tokens\":', event_id % 4, '.9}}')"
    )
    return placed(events, "event_id", F.expr(line))


@query(
    "parse_api_events",
    "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN strftime(make_timestamp(CAST((1700000000.5"
    " + event_id) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') WHEN 1 THEN"
    " strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') ELSE '2024-03-01 12:00:00.000000'"
    " END AS ts, concat('s', user_id) AS session_id, CASE WHEN event_id % 7 = 0 THEN"
    " concat('alt', event_id) ELSE concat('r', event_id) END AS message_uuid, CASE WHEN"
    " event_id % 6 = 0 THEN 'rm' ELSE event_type END AS model, CASE WHEN event_id % 4 = 0 THEN '/w'"
    " ELSE 'hermes:chat' END AS folder, concat('hermes:p', user_id % 3) AS version, i AS"
    " input_tokens, o AS output_tokens, w AS cache_creation_tokens, CAST(0 AS BIGINT) AS"
    " cache_read_tokens, i + o + w AS total_tokens FROM (SELECT *,"
    " greatest(CAST(floor(value) AS BIGINT) - 5, 0) AS i, event_id % 10 AS o, event_id % 4 AS w"
    " FROM events) WHERE i + o + w > 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0",
)
def api_events(spark: SparkSession, sf: str) -> DataFrame:
    facts = parse_api_events(api_lines(table(spark, sf, "events")), now())
    return facts.select(
        F.col("pos").alias("id"), moment(), "session_id", "message_uuid", "model", "folder",
        "version", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
        "total_tokens",
    )


def write_tree(lines: DataFrame, path: str) -> None:
    """Write rendered lines as a folder per file name, in order."""
    rows = lines.withColumn("file", F.regexp_extract("file_path", "([^/]+)$", 1))
    (
        rows.repartitionByRange("file", "pos")
        .sortWithinPartitions("file", "pos")
        .select("value", "file")
        .write.partitionBy("file")
        .text(path)
    )


@query(
    "scan_logs",
    "SELECT event_id // 1000 AS file_no, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS chars,"
    " CAST(0 AS BIGINT) AS out_of_order FROM events WHERE event_id % 10 <> 3 GROUP BY 1",
)
def scans(spark: SparkSession, sf: str) -> DataFrame:
    # Padded and blank lines are written; the order is checked by a number in every line.
    value = F.expr(
        "CASE WHEN event_id % 10 = 3 THEN '   ' ELSE"
        " concat('  ', lpad(CAST(event_id AS STRING), 12, '0'), props, '\\t') END"
    )
    path = scratch_path(spark, "scan")
    write_tree(placed(table(spark, sf, "events"), "event_id", value), path)
    lines = scan_logs(spark, path, "*.txt")
    seen = Window.partitionBy("file_path", "chunk").orderBy("pos")
    checked = lines.withColumn("_late", F.lag("value").over(seen) > F.col("value"))
    return checked.groupBy(
        F.regexp_extract("file_path", r"file=f(\d+)\.", 1).cast("bigint").alias("file_no")
    ).agg(
        F.count("*").alias("n"),
        F.sum(F.length("value") - 12).cast("bigint").alias("chars"),
        F.count_if("_late").alias("out_of_order"),
    )


@query(
    "ingest_sources",
    with_ctes(
        "usage",
        "SELECT 'laptop' AS device_id, message_type, count(*) AS n, CAST(sum(total_tokens) AS BIGINT)"
        " AS tokens FROM usage WHERE id % 97 <> 0 AND id % 89 <> 0 GROUP BY 2 UNION ALL"
        " SELECT 'bot', 'assistant', count(*), CAST(sum(t) AS BIGINT) FROM (SELECT"
        " greatest(CAST(floor(value) AS BIGINT) - 5, 0) + event_id % 10 + event_id % 4 AS t"
        " FROM events WHERE event_id % 23 <> 0 AND event_id % 29 <> 0) WHERE t > 0 UNION ALL"
        " SELECT 'coder', 'assistant', count(*), CAST(sum(greatest(v, event_id % 20) + event_id % 2)"
        " AS BIGINT) FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events) WHERE event_type"
        " NOT IN ('signup', 'click') AND event_id % 31 <> 0 AND (v > 0 OR event_id % 20 > 0"
        " OR event_id % 2 > 0)",
    ),
)
def ingested(spark: SparkSession, sf: str) -> DataFrame:
    events, trees = table(spark, sf, "events"), []
    for source_format, device, lines in [
        ("claude", "laptop", transcript_lines(usage(spark, sf))),
        ("codex", "coder", rollout_lines(events)),
        ("hermes", "bot", api_lines(events)),
    ]:
        path = scratch_path(spark, device)
        lines.select("value").write.text(path)
        trees.append(Source(path, source_format, device, device.title(), "linux"))
    facts = ingest_sources(spark, trees, now(), glob="*.txt")
    return facts.groupBy("device_id", "message_type").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")
    )


_REGISTRY = (
    "SELECT s_suppkey AS entry, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE concat('/logs/', s_name)"
    " END AS path, CASE s_suppkey % 5 WHEN 0 THEN concat('-bad', s_suppkey) WHEN 1 THEN"
    " concat('dev_', s_suppkey) WHEN 2 THEN concat('a b', s_suppkey) WHEN 3 THEN repeat('x', 65)"
    " ELSE concat('d-', s_suppkey) END AS device_id, CASE WHEN s_suppkey % 7 = 0 THEN 'Café' ELSE"
    " s_name END AS device_name, CASE s_suppkey % 4 WHEN 0 THEN 'macos' WHEN 1 THEN 'windows'"
    " WHEN 2 THEN 'linux' ELSE 'bsd' END AS device_type, CASE s_suppkey % 6 WHEN 0 THEN 'claude'"
    " WHEN 1 THEN 'codex' WHEN 2 THEN 'hermes' ELSE 'other' END AS format FROM {supplier}"
)


@query(
    "validate_sources",
    "SELECT entry, path, device_id, device_type, CASE WHEN format IN ('claude', 'codex', 'hermes')"
    f" THEN format ELSE 'claude' END AS format FROM ({_REGISTRY.format(supplier='supplier')})"
    f" WHERE path <> '' AND regexp_matches(device_id, '{DEVICE_ID_PATTERN}')"
    " AND regexp_matches(device_name, '^[\\x20-\\x7E]{1,128}$')"
    " AND device_type IN ('macos', 'windows', 'linux')",
)
def valid_sources(spark: SparkSession, sf: str) -> DataFrame:
    registry = spark.sql(
        _REGISTRY.format(supplier="{supplier}"), supplier=table(spark, sf, "supplier")
    )
    return validate_sources(registry).drop("device_name")


_RAW_ID = (
    "CASE c_custkey % 6 WHEN 0 THEN concat('#', c_name) WHEN 1 THEN concat(c_name, ' é/', c_mktsegment)"
    " WHEN 2 THEN repeat(c_name, 6) WHEN 3 THEN concat('-', c_name) WHEN 4 THEN '' ELSE c_name END"
)


@query(
    "sanitize_device_id",
    "SELECT c_custkey, CASE WHEN raw <> '' THEN (CASE WHEN regexp_matches(clean, '^[a-zA-Z0-9]')"
    " THEN clean ELSE concat('x', clean) END)[1:64] END AS device_id FROM (SELECT *,"
    f" regexp_replace(raw, '[^a-zA-Z0-9_-]', '_', 'g') AS clean FROM (SELECT c_custkey, {_RAW_ID}"
    " AS raw FROM customer))",
)
def sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", sanitize_device_id(F.expr(_RAW_ID)).alias("device_id")
    )


@query(
    "load_pricing",
    "SELECT p_name || p_partkey AS model_name, s * 0.5 AS input_price, CASE WHEN p_partkey % 4 <> 0"
    " THEN s * 2.5 ELSE 0 END AS output_price, s * 0.625 AS cache_write_price, CASE WHEN"
    " p_partkey % 3 = 0 THEN s * 1.25 ELSE round(s * 0.625 * 1.6, 4) END AS cache_write_1h_price,"
    " s * 0.125 AS cache_read_price, p_brand AS notes FROM (SELECT *, CAST(p_size AS DOUBLE) AS s"
    " FROM part)",
)
def priced(spark: SparkSession, sf: str) -> DataFrame:
    # One JSON text per part, in the layout of a price file.
    size = F.col("p_size")
    price = F.struct(
        (size * 0.5).alias("input_per_mtok"),
        F.when(F.col("p_partkey") % 4 != 0, size * 2.5).alias("output_per_mtok"),
        (size * 0.625).alias("cache_write_per_mtok"),
        F.when(F.col("p_partkey") % 3 == 0, size * 1.25).alias("cache_write_1h_per_mtok"),
        (size * 0.125).alias("cache_read_per_mtok"),
        F.col("p_brand").alias("notes"),
    )
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    texts = table(spark, sf, "part").select(
        F.to_json(F.struct(F.create_map(name, price).alias("models"))).alias("value")
    )
    return parse_pricing(texts, now()).drop("last_updated")


@query(
    "upsert_pricing",
    "SELECT concat('p', p_partkey) AS model_name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2"
    " ELSE p_retailprice END AS input_price FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0",
)
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")

    def prices(condition: str, factor: int) -> DataFrame:
        rows = part.filter(condition).select(
            F.concat(F.lit("p"), "p_partkey").alias("model_name"),
            (F.col("p_retailprice") * factor).alias("input_price"),
        )
        return conform(rows, PRICING)

    merged = upsert_pricing(prices("p_partkey % 2 = 0", 2), prices("p_partkey % 3 <> 0", 1))
    return merged.select("model_name", "input_price")


@query(
    "load_history",
    with_ctes(
        "usage",
        f"SELECT id, {day_sql()}, input_tokens + output_tokens > 0 AS has_usage, CASE WHEN"
        " input_tokens + output_tokens > 0 THEN cache_read_tokens END AS cache_read_tokens, CASE"
        " WHEN input_tokens + output_tokens > 0 THEN CAST(0 AS BIGINT) END AS"
        " cache_creation_1h_tokens, CASE WHEN input_tokens + output_tokens > 0 THEN total_tokens END"
        " AS total_tokens FROM usage WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'",
    ),
)
def history(spark: SparkSession, sf: str) -> DataFrame:
    return load_history(usage(spark, sf), "2024-01-05", "2024-01-12").select(
        "id", day(), "has_usage", "cache_read_tokens", "cache_creation_1h_tokens", "total_tokens"
    )


@query(
    "history_or_daily",
    with_ctes(
        "line_daily usage daily",
        f"SELECT 'stored' AS case_, {day_sql()}, session_id, CAST(sum(CASE WHEN input_tokens +"
        " output_tokens > 0 THEN total_tokens END) AS BIGINT) AS tokens FROM usage"
        " WHERE date >= DATE '2024-01-20' GROUP BY date, session_id UNION ALL"
        " SELECT 'rollup', CAST(date AS VARCHAR), concat('daily-', CAST(date AS VARCHAR)),"
        " total_tokens FROM line_daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
    ),
)
def history_fallback(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    stored = history_or_daily(facts, daily(spark, sf), "2024-01-20")
    rollup = history_or_daily(facts, line_daily(spark, sf), "1996-01-01", "1996-12-31")
    both = stored.withColumn("case_", F.lit("stored")).unionByName(
        rollup.withColumn("case_", F.lit("rollup"))
    )
    return both.groupBy("case_", "date", "session_id").agg(
        F.sum("total_tokens").alias("tokens")
    ).withColumn("date", day())


def _files(spark: SparkSession, sf: str, condition: str, shift: str = "0") -> DataFrame:
    return conform(
        table(spark, sf, "orders").filter(condition).selectExpr(
            "concat('/logs/', CAST(o_orderkey AS STRING), '.jsonl') AS file_path",
            f"o_custkey * 1000 + ({shift}) AS mtime_ns",
            "CAST(o_totalprice AS BIGINT) AS size_bytes",
            "o_orderkey % 50 AS record_count",
        ),
        MANIFEST,
    )


_CHANGED = "CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END"


@query(
    "stale_files",
    "SELECT concat('/logs/', o_orderkey, '.jsonl') AS file_path, CASE o_orderkey % 10 WHEN 1 THEN"
    " 'new' WHEN 2 THEN 'deleted' WHEN 3 THEN 'modified' ELSE 'unchanged' END AS status FROM orders",
)
def stale(spark: SparkSession, sf: str) -> DataFrame:
    current = _files(spark, sf, "o_orderkey % 10 <> 2", _CHANGED).drop("record_count", "last_parsed")
    status = stale_files(current, _files(spark, sf, "o_orderkey % 10 <> 1"))
    return status.select("file_path", "status")


@query(
    "update_manifest",
    "SELECT concat('/logs/', o_orderkey, '.jsonl') AS file_path, o_custkey * 1000 + CASE WHEN"
    " o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS mtime_ns, CASE WHEN o_orderkey % 10 IN (1, 3)"
    " THEN 7 ELSE o_orderkey % 50 END AS record_count FROM orders",
)
def manifest_update(spark: SparkSession, sf: str) -> DataFrame:
    stats = _files(spark, sf, "o_orderkey % 10 <> 2", _CHANGED).select(
        "file_path", "mtime_ns", "size_bytes"
    )
    parsed = (
        _files(spark, sf, "o_orderkey % 10 IN (1, 3)")
        .select("file_path")
        .withColumn("record_count", F.lit(7))
    )
    manifest = _files(spark, sf, "o_orderkey % 10 <> 1")
    return update_manifest(manifest, parsed, stats, now()).select(
        "file_path", "mtime_ns", "record_count"
    )


@query(
    "prune_manifest",
    "SELECT o_orderkey % 50 AS record_count, count(*) AS n, (SELECT count(*) FROM orders WHERE"
    " o_orderkey % 10 NOT IN (1, 2)) AS files FROM orders WHERE o_orderkey % 10 NOT IN (1, 2)"
    " GROUP BY 1",
)
def pruned(spark: SparkSession, sf: str) -> DataFrame:
    manifest = _files(spark, sf, "o_orderkey % 10 <> 1")
    left = prune_manifest(manifest, _files(spark, sf, "o_orderkey % 10 = 2"))
    return left.groupBy("record_count").agg(F.count("*").alias("n")).withColumn(
        "files", tracked_files(left).scalar()
    )


@query(
    "write_results",
    with_ctes(
        "line_usage",
        "SELECT fmt, folder, device_id, tokens FROM (SELECT folder, device_id,"
        " CAST(sum(total_tokens) AS BIGINT) AS tokens FROM line_usage GROUP BY ALL),"
        " (VALUES ('csv'), ('json')) AS f(fmt)",
    ),
)
def written(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_usage(spark, sf).groupBy("folder", "device_id").agg(
        F.sum("total_tokens").alias("tokens")
    )
    ddl, parts = "folder string, device_id string, tokens bigint", []
    for fmt in ("csv", "json"):
        path = scratch_path(spark, fmt)
        write_results(rows, path, fmt)
        read = spark.read.schema(ddl).option("header", "true").format(fmt).load(path)
        parts.append(read.withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1])


@query(
    "built_in_prices",
    with_ctes(
        "line_usage",
        "SELECT folder, round(sum(input_tokens) / 1000000 * i + sum(output_tokens) / 1000000 * o"
        " + sum(cache_read_tokens) / 1000000 * r, 8) AS cost FROM line_usage JOIN (VALUES"
        " (0, 3.0, 15.0, 0.3), (1, 5.0, 30.0, 0.5)) AS v(k, i, o, r)"
        " ON CAST(string_split(folder, '/')[3] AS INT) % 2 = k GROUP BY folder, i, o, r",
    ),
)
def built_in(spark: SparkSession, sf: str) -> DataFrame:
    sums = line_usage(spark, sf).groupBy("folder").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    odd = F.substring_index("folder", "/", -1).cast("int") % 2 == 1
    named = sums.withColumn(
        "model_name", F.when(odd, "gpt-5.5").otherwise("claude-sonnet-4-6")
    )
    return named.join(load_pricing(spark, None, now()), "model_name").select(
        "folder", F.round(token_cost(F.col("cache_write_1h_price")), 8).alias("cost")
    )
