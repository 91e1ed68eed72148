"""Counters over message text."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrase patterns that are counted, matched on lower-case text.
PROFANITY = [
    r"\bf[u\*]c?k+(?:ing|ed|er|s)?\b",
    r"\bf+[aeiou]*c?k+\b",
    r"\bfck(?:ing|ed|er|s)?\b",
    r"\bfuk(?:ing|ed|er|s)?\b",
    r"\bphuck(?:ing|ed|er|s)?\b",
    r"\bsh[i\*]t+(?:ty|ting|ted|s)?\b",
    r"\bsht(?:ty|ting|ted|s)?\b",
    r"\bshyt(?:ty|ting|ted|s)?\b",
    r"\bcr[a\*]p+(?:py|ping|ped|s)?\b",
    r"\bass+h[o\*]le?s?\b",
    r"\ba+rse+(?:hole)?s?\b",
    r"\bd[a\*]mn+(?:ed|ing|s)?\b",
    r"\bd[a\*]m+(?:ed|ing|s)?\b",
    r"\bb[i\*]tch+(?:ing|ed|es|y)?\b",
    r"\bbstard+s?\b",
    r"\bhell+\b",
    r"\bpiss+(?:ed|ing|es)?\b",
    r"\bc[o\*]ck+(?:s)?\b",
    r"\bd[i\*]ck+(?:s|head)?\b",
    r"\btw[a\*]t+s?\b",
]
PERFECT = [r"\bperfect!", r"\bperfect\.", r"\bexcellent!", r"\bexcellent\."]
ABSOLUTELY_RIGHT = [
    r"\byou'?re?\s+absolutely\s+right\b",
    r"\byou\s+are\s+absolutely\s+right\b",
]
THANKS = [
    r"\bthank+(?:s|you|u)?\b",
    r"\bthn?x\b",
    r"\bty\b",
    r"\bthanku\b",
    r"\bthnk+s?\b",
]
PLEASE = [r"\bplease\b", r"\bpl[sz]e?\b", r"\bples[ae]?\b", r"\bpls\b"]

#: Word and space classes follow Unicode.
UNICODE = "(?U)"


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern contains.

    Groups, classes, escapes and optional characters are cut out; what is left must occur.
    """
    for part in (r"\([^()]*\)[?*+]?", r"\[[^\]]*\][?*+]?", r"\\.[?*+]?", r".[?*]", r"\+"):
        pattern = re.sub(part, "\0", pattern)
    return max(pattern.split("\0"), key=len)


def count_matches(lowered: Column, patterns: list[str], any_guard: bool = False) -> Column:
    """Sum of the matches of every pattern in a lower-case text, 0 for null.

    Overlapping patterns each count. A pattern runs only on texts that contain its literal part,
    which is a plain byte search. ``any_guard`` first tests all patterns (which must start at a
    word boundary) in one expression; that pays for many patterns with short literals.
    """

    def count(pattern: str) -> Column:
        matches = F.regexp_count(lowered, F.lit(UNICODE + pattern))
        literal = required_literal(pattern)
        if not literal:
            return matches
        return F.when(F.contains(lowered, F.lit(literal)), matches).otherwise(0)

    total = reduce(add, [count(p) for p in patterns])
    if any_guard:
        rest = [p.removeprefix(r"\b") for p in patterns]
        total = F.when(lowered.rlike(UNICODE + r"\b(?:" + "|".join(rest) + ")"), total)
    return F.coalesce(total, F.lit(0)).cast("bigint")


def count_profanity(text: Column) -> Column:
    return count_matches(F.lower(text), PROFANITY, any_guard=True)


def count_perfect(text: Column) -> Column:
    return count_matches(F.lower(text), PERFECT)


def count_absolutely_right(text: Column) -> Column:
    return count_matches(F.lower(text), ABSOLUTELY_RIGHT)


def count_thanks(text: Column) -> Column:
    return count_matches(F.lower(text), THANKS)


def count_please(text: Column) -> Column:
    return count_matches(F.lower(text), PLEASE)


def char_count(text: Column) -> Column:
    """Code points, 0 for null."""
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")
