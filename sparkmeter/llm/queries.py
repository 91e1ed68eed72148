"""All registered queries of this subpackage."""

from __future__ import annotations

from sparkmeter.llm import (  # noqa: F401
    centroids,
    classifier,
    collocations,
    decontaminate,
    html_blocks,
    jaccard,
    licenses,
    line_quality,
    packing,
    personal,
    reputation,
    sharding,
    substrings,
)
from sparkmeter.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
