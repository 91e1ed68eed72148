"""Project names replaced by their rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmeter.operators.metrics import tokens_by_folder
from sparkmeter.operators.ranking import global_row_number
from sparkmeter.operators.skew import spread_join

MASKED = "project-unused"


def project_aliases(usage: DataFrame) -> DataFrame:
    """``folder``, ``alias`` of every folder with usage: project-001 has most tokens."""
    ranked = global_row_number(
        tokens_by_folder(usage).filter(F.col("folder").isNotNull()),
        [F.desc("tokens"), F.col("folder")],
        "rank",
    )
    # A format string pads, but never cuts, numbers of more than three digits.
    return ranked.select("folder", "rank", F.format_string("project-%03d", "rank").alias("alias"))


def anonymise_projects(usage: DataFrame, strict: bool = False) -> DataFrame:
    """Facts with folders replaced by their alias.

    Folders without usage have no rank and keep their name, unless ``strict`` masks them.
    """
    aliases = project_aliases(usage).select("folder", "alias")
    joined = spread_join(usage, aliases, ["folder"], ["session_id", "message_uuid"], "left")
    other = F.lit(MASKED) if strict else F.col("folder")
    return joined.withColumn("folder", F.coalesce("alias", other)).drop("alias")
