"""Changes to the fact table: upgrade, gated insert, delete, device columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.functions.predicates import is_response
from sparkmeter.operators.dedupe import batch_gate, scope
from sparkmeter.operators.upsert import assign_ids, same_keys
from sparkmeter.schemas import COUNTERS, DEVICE_COLUMNS, USAGE, conform

#: Columns a larger repeat of a response replaces; day, model, session and folder stay as first seen.
UPGRADED = ["ts", *COUNTERS, "total_tokens"]
#: Above the number of any batch.
_EVER = (1 << 31) - 1


def last_sequence(usage: DataFrame) -> DataFrame:
    """Largest id or update number used so far, 0 for an empty table, as one row."""
    used = F.greatest("id", F.coalesce("updated_seq", "id"))
    return usage.agg(F.coalesce(F.max(used), F.lit(0)).alias("last"))


def upgrades(usage: DataFrame, best: DataFrame) -> DataFrame:
    """New values for stored responses that the batch brings with more tokens.

    ``best`` has one row per response id. The result is keyed by ``date`` and ``message_uuid``.
    """
    stored = usage.filter(is_response()).select("date", "message_uuid", "total_tokens").alias("u")
    batch = best.filter(is_response()).select("message_uuid", *UPGRADED).alias("b")
    larger = (F.col("u.message_uuid") == F.col("b.message_uuid")) & (
        F.col("b.total_tokens") > F.col("u.total_tokens")
    )
    return stored.join(batch, larger).select(
        "u.date", "u.message_uuid", *[F.col(f"b.{c}").alias(c) for c in UPGRADED]
    )


def largest_of(gated: DataFrame, order: str) -> DataFrame:
    """Of the responses of several gated batches the one of each id that ends as its usage.

    ``order`` numbers the batches. Applied one after the other, each larger repeat replaces what is
    stored, so the largest stays and of equal ones the first batch's.
    """
    first = Window.partitionBy("message_uuid").orderBy(F.desc("total_tokens"), order)
    return (
        gated.filter(is_response())
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def apply_upgrades(usage: DataFrame, changes: DataFrame, seq: Column) -> DataFrame:
    """Fact rows with the new values; prompts and all other rows are unchanged."""
    prompts = usage.filter(~is_response())
    u, b = usage.filter(is_response()).alias("u"), changes.alias("b")
    hit = F.col("b.message_uuid").isNotNull()
    new = {c: F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"u.{c}")) for c in UPGRADED}
    new["updated_seq"] = F.when(hit, seq).otherwise(F.col("u.updated_seq"))
    responses = u.join(
        b,
        (F.col("u.message_uuid") == F.col("b.message_uuid")) & (F.col("u.date") == F.col("b.date")),
        "left",
    ).select(*[new.get(c, F.col(f"u.{c}")).alias(c) for c in usage.columns])
    return prompts.unionByName(responses)


def upgrade_existing(staging: DataFrame, usage: DataFrame, tiebreak: list[str]) -> DataFrame:
    """The fact table after larger repeats in the batch replaced stored usage (never smaller)."""
    usage = conform(usage, USAGE)
    best = batch_gate(staging.filter(is_response()), tiebreak)
    return apply_upgrades(usage, upgrades(usage, best), last_sequence(usage).scalar() + 1)


def new_rows(
    gated: DataFrame,
    usage: DataFrame,
    order: str | None = None,
    shared: DataFrame | None = None,
) -> DataFrame:
    """Rows of a gated batch that the fact table does not hold.

    A response is known when any row has its id, a prompt when a row of the same session has it.
    Both tests become one equi anti-join on (id, scope): every stored row offers both scopes.
    Only stored rows with an id of the batch are considered, and equal offers collapse first, so
    one frequent id does not meet itself row by row.

    With ``order`` these are several batches, and that column numbers them. In ``usage`` it is the
    batch that deletes a row (null: none does), so only batches before it know the row. ``shared`` has
    the ids of more than one batch, if there are any. The result is as if the batches were saved in
    that order (see ``order_matters``).
    """
    extra = [] if order is None else [order]
    candidates = usage.select("message_uuid", "session_id", *extra).join(
        gated.select("message_uuid").distinct(), "message_uuid", "left_semi"
    )
    offers = candidates.select(
        "message_uuid",
        F.explode(
            F.array(F.lit("r"), F.concat(F.lit("s"), F.coalesce("session_id", F.lit(""))))
        ).alias("_scope"),
        *extra,
    )
    scoped, keys = gated.withColumn("_scope", scope()), ["message_uuid", "_scope"]
    if order is None:
        return scoped.join(offers.distinct(), keys, "left_anti").drop("_scope")
    until = F.max(F.coalesce(order, F.lit(_EVER))).alias("_until")
    known = offers.groupBy(*keys).agg(until).alias("k")
    g = scoped.alias("g")
    met = (F.col("g.message_uuid") == F.col("k.message_uuid")) & (
        F.col("g._scope") == F.col("k._scope")
    )
    unknown = g.join(known, met & (F.col("k._until") > F.col(f"g.{order}")), "left_anti")
    if shared is not None:
        ids = shared.select("message_uuid")
        alone = unknown.join(ids, "message_uuid", "left_anti")
        several = unknown.join(ids, "message_uuid", "left_semi")
        unknown = alone.unionByName(_first_of(several, order))
    return unknown.drop("_scope")


def _first_of(rows: DataFrame, order: str) -> DataFrame:
    """The first batch's row of each id and scope, with the usage of larger repeats after it.

    A key has one row per batch, so the frame of a window is as long as there are batches.
    """
    placed = Window.partitionBy("message_uuid", "_scope").orderBy(order)
    whole = placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.max_by(F.struct(*UPGRADED), F.struct("total_tokens", -F.col(order))).over(whole)
    first = rows.withColumns({"_rank": F.row_number().over(placed), "_best": best}).filter(
        F.col("_rank") == 1
    )
    hit = is_response() & F.col("total_tokens").isNotNull()
    new = {c: F.when(hit, F.col(f"_best.{c}")).otherwise(F.col(c)) for c in UPGRADED}
    return first.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def shared_ids(gated: DataFrame, order: str) -> DataFrame:
    """Ids in more than one of several gated batches, and whether of responses and prompts (mixed)."""
    kind = F.coalesce(is_response(), F.lit(False))
    found = gated.filter("message_uuid IS NOT NULL").groupBy("message_uuid").agg(
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        (F.min(kind) < F.max(kind)).alias("mixed"),
    )
    return found.filter("_first < _last").select("message_uuid", "mixed")


def order_matters(
    gated: DataFrame, shared: DataFrame, order: str, devices: list[str | None]
) -> bool:
    """Whether several gated batches must be rebuilt one after the other.

    So it is when two have a session of one device, as the later deletes what the earlier added, or
    an id that is a response's in one and a prompt's in another. ``devices`` are those of the batches.
    """
    if not shared.filter("mixed").isEmpty():
        return True
    for device in {d for d in devices if devices.count(d) > 1}:
        mine = F.col("device_id").eqNullSafe(F.lit(device)) & F.col("session_id").isNotNull()
        numbers = gated.filter(mine).groupBy("session_id").agg(
            F.min(order).alias("_first"), F.max(order).alias("_last")
        )
        if not numbers.filter("_first < _last").isEmpty():
            return True
    return False


def insert_new(
    staging: DataFrame,
    usage: DataFrame,
    tiebreak: list[str],
    device: tuple[str | None, str | None, str | None] | None = None,
) -> DataFrame:
    """The rows a batch adds to the fact table, with ids after the stored ones.

    ``device`` sets the device columns; without it the batch's own are kept.
    """
    fresh = new_rows(batch_gate(staging, tiebreak), usage)
    if device is not None:
        fresh = fresh.withColumns(
            {c: F.lit(v).cast("string") for c, v in zip(DEVICE_COLUMNS, device, strict=True)}
        )
    return number_rows(fresh, last_sequence(conform(usage, USAGE)).scalar())


def number_rows(fresh: DataFrame, start: Column) -> DataFrame:
    """Fact rows with ids after ``start``."""
    numbered = assign_ids(
        fresh.drop("id", "updated_seq"), ["message_uuid", "session_id", "message_type"], start
    )
    return conform(numbered.withColumn("updated_seq", F.col("id")), USAGE)


def save_batch(staging: DataFrame, usage: DataFrame, tiebreak: list[str]) -> DataFrame:
    """The fact table after a batch: larger repeats upgrade, unknown rows are added."""
    usage = conform(usage, USAGE)
    return upgrade_existing(staging, usage, tiebreak).unionByName(
        insert_new(staging, usage, tiebreak)
    )


def _same_session() -> Column:
    return same_keys("u", "s", ["device_id"]) & (F.col("u.session_id") == F.col("s.session_id"))


def session_rows(
    usage: DataFrame, sessions: DataFrame, device: str | None = None, by_device: bool = False
) -> DataFrame:
    """Rows of the listed sessions that belong to one device (null: rows without device).

    With ``by_device`` each session is listed with its own ``device_id``.
    """
    if by_device:
        return usage.alias("u").join(sessions.alias("s"), _same_session(), "left_semi")
    mine = F.col("device_id").eqNullSafe(F.lit(device))
    return usage.filter(mine).join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def delete_sessions(
    usage: DataFrame, sessions: DataFrame, device: str | None = None, by_device: bool = False
) -> DataFrame:
    """The fact table without the listed sessions of one device, or ``by_device``."""
    if by_device:
        return usage.alias("u").join(sessions.alias("s"), _same_session(), "left_anti")
    mine = F.col("device_id").eqNullSafe(F.lit(device))
    others = usage.filter(~mine)
    kept = usage.filter(mine).join(
        sessions.select("session_id").distinct(), "session_id", "left_anti"
    )
    return others.unionByName(kept)


def mark_sessions(usage: DataFrame, sessions: DataFrame, name: str) -> DataFrame:
    """Rows with a column of the listed sessions (unique by device), null where none is theirs."""
    joined = usage.alias("u").join(sessions.alias("s"), _same_session(), "left")
    return joined.select("u.*", F.col(f"s.{name}").alias(name))


def deleted_dates(
    usage: DataFrame, sessions: DataFrame, device: str | None = None, by_device: bool = False
) -> DataFrame:
    """Days that ``delete_sessions`` touches, ``by_device`` beside the device."""
    keys = ["date", "device_id"] if by_device else ["date"]
    return session_rows(usage, sessions, device, by_device).select(*keys).distinct()


def backfill_device(df: DataFrame, device_id: str, name: str, kind: str) -> DataFrame:
    """Add missing device columns and set them where no device is recorded."""
    for column in DEVICE_COLUMNS:
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("string"))
    unknown = F.col("device_id").isNull()
    values = dict(zip(DEVICE_COLUMNS, (device_id, name, kind), strict=True))
    return df.withColumns(
        {c: F.when(unknown, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    )


def unattributed(df: DataFrame) -> DataFrame:
    """Number of rows that ``backfill_device`` would set."""
    if "device_id" not in df.columns:
        return df.agg(F.count("*").alias("updated"))
    return df.agg(F.count_if(F.col("device_id").isNull()).alias("updated"))
