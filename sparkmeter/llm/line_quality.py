"""Quality rules: clean by lines first, then reject documents that lost too much text.

Each line with a word is judged alone by three families of rules:

- punctuation: three or more words without any sentence mark, shouting (more capitals than small
  letters, or ``!!`` after every fifth word), or more than one sign of ``[#*$%&<>]`` per five words;
- navigation: a separator (``|`` or ``»``) for every five words or fewer, or a menu of one-word items;
- boilerplate: one of a few fixed phrases in a line of at most forty words.

Failing lines are removed. A document is kept when it passes the base rules and at most half of
its characters (of lines with a word) were removed. A null text is an empty text: no words, base
rules failed, not kept. Everything is a column expression, so rows are independent of each other:
repeated rows and repeated ids give one result each, and other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import let, table, words_of
from sparkmeter.llm.registry import query

#: Fixed phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "accept all cookies", "use of cookies", "cookie policy", "privacy policy", "terms of service",
    "all rights reserved", "enable javascript", "javascript is disabled", "subscribe to our newsletter",
    "sign up for our", "click here to", "back to top", "skip to content", "share this article",
    "follow us on", "lorem ipsum",
)
BOILERPLATE_WORDS = 40
#: Share of the characters that a kept document may lose, in percent.
MAX_LOSS = 50
_LINE_SYMBOLS = "[#*$%&<>]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is removed."""
    words = _count(line, r"[^\x20\x09-\x0D]+")

    def rules(n: Column) -> Column:
        punctuation = (
            ((n >= 3) & ~line.rlike(r"[.!?…:;。！？]"))
            | (_count(line, r"\p{Lu}") > _count(line, r"\p{Ll}"))
            | (_count(line, "!!") * 5 >= n)
            | (_count(line, _LINE_SYMBOLS) * 5 > n)
        )
        navigation = _count(line, r"[|»]") * 5 >= n
        boilerplate = (n <= BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))
        return punctuation | navigation | boilerplate

    return let(words, rules)


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words in windows of ``size`` words that are found twice or more in the text.

    Windows are compared by a 64-bit hash within one text. Only texts with a repeated window sort
    their windows; each repeated place then adds the words not covered by the one before.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        total = F.aggregate(
            places,
            start,
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")
            ),
        )
        return total["n"]

    def among(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def same(s: Column) -> Column:
            def beside(x: Column, i: Column) -> Column:
                after = F.get(s, i + 1)["h"] == x["h"]
                before = F.when(i > 0, F.get(s, i - 1)["h"] == x["h"])
                return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, beside), lambda x: x["p"]))

        return F.when(
            F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)
        ).otherwise(let(let(placed, same), covered))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]),
    )
    return F.when(F.size(words) > size, let(windows, among)).otherwise(F.lit(0)).cast("bigint")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the word counts, the base verdict, the share of text lost and the verdict to each row.

    Columns of the same names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("again"))

    def of_lines(lines: Column) -> Column:
        length = lambda found: F.aggregate(
            found, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)
        )
        return F.struct(
            F.size(lines).cast("bigint").alias("n"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("again"),
            length(lines).alias("chars"),
            length(F.filter(lines, line_fails)).alias("lost"),
        )

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.withColumns(
        {"_words": let(words_of(body), of_words), "_lines": let(lines, of_lines)}
    )
    failed = (F.col("_words.n") < 10) | (100 * F.col("_words.again") > 20 * F.col("_words.n"))
    lost = F.col("_lines.lost") * 100 <= MAX_LOSS * F.col("_lines.chars")
    return measured.withColumns(
        {
            "n_words": F.col("_words.n"),
            "word_chars": F.length(F.translate(body, " \t\n\v\f\r", "")).cast("bigint"),
            "n_symbols": (
                F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
            ).cast("bigint"),
            "n_dup_lines": F.col("_lines.again"),
            "n_repeat_words": F.col("_words.again"),
            "base_failed": failed,
            "kept": ~failed & lost,
            "n_lost_chars": F.col("_lines.lost"),
        }
    ).drop("_words", "_lines")


def cleaned_text(text: Column) -> Column:
    """The text without its failing lines; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    keep = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(x)
    return F.array_join(F.filter(lines, keep), "\n")


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept documents without their failing lines, with the columns they came with.

    Columns that share a name with a result are kept as they came.
    """
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    cleaned = F.when(F.col("n_lost_chars") > 0, cleaned_text(F.col("text"))).otherwise(F.col("text"))
    return measure(held).filter("kept").select(
        *[(cleaned if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    )


COLUMNS = (
    "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lost_chars"
).split()

_FAILS = f"""
 (w >= 3 AND NOT regexp_matches(l, '[.!?…:;。！？]'))
 OR len(regexp_extract_all(l, '\\p{{Lu}}')) > len(regexp_extract_all(l, '\\p{{Ll}}'))
 OR len(regexp_extract_all(l, '!!')) * 5 >= w
 OR len(regexp_extract_all(l, '{_LINE_SYMBOLS}')) * 5 > w
 OR len(regexp_extract_all(l, '[|»]')) * 5 >= w
 OR (w <= {BOILERPLATE_WORDS} AND regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))"""

#: One row per row of ``documents``; ``r`` numbers the rows, as ids may repeat.
MEASURED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
wd AS (SELECT r, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w,
              generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS p FROM d),
g AS (SELECT r, p, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN
              concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS x
      FROM wd WINDOW o AS (PARTITION BY r ORDER BY p)),
g2 AS (SELECT r, p, x IS NOT NULL AND count(*) OVER (PARTITION BY r, x) > 1 AS twice FROM g),
cov AS (SELECT r, sum(CASE WHEN c THEN 1 ELSE 0 END) AS again FROM (
          SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM g2) GROUP BY r),
ws AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM wd GROUP BY r),
ln AS (SELECT r, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS w
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
ls AS (SELECT r, count(*) - count(DISTINCT l) AS again, sum(length(l)) AS chars,
              sum(CASE WHEN {_FAILS} THEN length(l) ELSE 0 END) AS lost FROM ln WHERE w > 0 GROUP BY r),
m AS (SELECT d.doc_id, d.r, coalesce(ws.n, 0) AS n_words, CAST(coalesce(ws.chars, 0) AS BIGINT) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(ls.again, 0) AS n_dup_lines,
        CAST(coalesce(cov.again, 0) AS BIGINT) AS n_repeat_words, coalesce(ls.chars, 0) AS line_chars,
        CAST(coalesce(ls.lost, 0) AS BIGINT) AS n_lost_chars
      FROM d LEFT JOIN ws USING (r) LEFT JOIN cov USING (r) LEFT JOIN ls USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_lost_chars * 100 <= {MAX_LOSS} * line_chars AS kept, n_lost_chars
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""


@query("op4_line_quality", MEASURED_SQL)
def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).select(*COLUMNS)
