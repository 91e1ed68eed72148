"""Queries over instruction documents: phrases are added to the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators import documents
from sparkmeter.plans.inputs import table
from sparkmeter.plans.registry import query

ROOT, HOME = "/repo", "/home/me"
_ARCHITECTURE = " WHEN 4 THEN ' @../shared/./a-b_c.md we use redux with a database schema'"
_CONTENT = (
    "concat(text, CASE doc_id % 6 WHEN 0 THEN ' see @docs/style.md and `@skip/me.md` use snake_case'"
    " WHEN 1 THEN ' be consistent, @~/notes.md' WHEN 2 THEN ' @/abs/../etc/x.md ```\n@in/code.md"
    "\n``` I prefer tabs or spaces' WHEN 3 THEN ' follow best practices and keep it simple;"
    f" run pytest, npm run build, make all'{_ARCHITECTURE} ELSE '' END)"
)
# The same documents without the phrases on architecture, so that a topic may stay open.
_OPEN_CONTENT = _CONTENT.replace(_ARCHITECTURE, "")
_PATH = (
    "concat('/repo/', source, '/', CAST(doc_id AS {S}), CASE doc_id % 4 WHEN 0 THEN '/CLAUDE.md'"
    " WHEN 1 THEN '/CLAUDE.local.md' WHEN 2 THEN '/.claude/rules/r.md' ELSE '/sub/CLAUDE.md' END)"
)
_DOCS = (
    f"SELECT doc_id, {_PATH.format(S='VARCHAR')} AS path, {_CONTENT} AS content,"
    f" regexp_replace(lower({_CONTENT}), '[^\\x00-\\x7F]', 'x', 'g') AS plain FROM documents"
)


def _docs(spark: SparkSession, sf: str, content: str = _CONTENT) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", f"{_PATH.format(S='STRING')} AS path", f"{content} AS content"
    )


def _sql(body: str, **more: str) -> str:
    parts = {"docs": _DOCS, **more}
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + " " + body


_IMPORTS = (
    "SELECT path, unnest(imports) AS import FROM (SELECT path, list_filter(regexp_extract_all("
    "regexp_replace(regexp_replace(content, '```[\\s\\S]*?```', '', 'g'), '`[^`]+`', '', 'g'),"
    " '@(~?[\\w\\-\\./]+)', 1), lambda m: contains(m, '/') OR starts_with(m, '~')) AS imports"
    " FROM docs)"
)


@query("extract_imports", _sql(f"SELECT path, concat('@', import) AS import FROM ({_IMPORTS})"))
def imports(spark: SparkSession, sf: str) -> DataFrame:
    return documents.extract_imports(_docs(spark, sf)).select("path", "import")


def _matches(patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(plain, '{p}'))" for p in patterns)


_TOPICS = " UNION ALL ".join(
    f"SELECT path, '{key}' AS topic, '{name}' AS name,"
    f" CAST({_matches(documents.TOPIC_PATTERNS[key])} AS BIGINT) AS matches FROM docs"
    for key, name, _ in documents.TOPICS
)


@query(
    "topic_coverage",
    _sql(
        "SELECT *, CASE WHEN matches >= 3 THEN 'strong' WHEN matches >= 1 THEN 'weak' ELSE 'none'"
        f" END AS strength FROM ({_TOPICS})"
    ),
)
def topics(spark: SparkSession, sf: str) -> DataFrame:
    return documents.topic_coverage(_docs(spark, sf))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VAGUE = " UNION ALL ".join(
    f"SELECT path, {i} AS phrase_no, regexp_extract(plain, '{pattern}') AS found,"
    f" {_quoted(question)} AS question FROM docs"
    for i, (pattern, question) in enumerate(documents.VAGUE)
)


@query("vague_phrases", _sql(f"SELECT * FROM ({_VAGUE}) WHERE found <> ''"))
def vague(spark: SparkSession, sf: str) -> DataFrame:
    return documents.vague_phrases(_docs(spark, sf))


_KIND = (
    "CASE WHEN contains(path, 'CLAUDE.local.md') THEN 'local' WHEN path LIKE '%/rules/r.md' THEN"
    " 'rule' WHEN path IN ('/repo/src1/CLAUDE.md') THEN 'project' ELSE 'subtree' END"
)


def _first(phrases: list[str]) -> str:
    whens = " ".join(f"WHEN contains(lower(content), '{p}') THEN '{p}'" for p in phrases)
    return f"CASE {whens} END"


@query(
    "scope_issues",
    _sql(
        "SELECT path, kind, phrase, CASE kind WHEN 'project' THEN concat('Personal preference in"
        " shared file: ''', phrase, ''' → consider .local.md') ELSE concat('Team standard in local"
        " file: ''', phrase, ''' → consider promoting to project rules') END AS issue FROM ("
        f"SELECT path, kind, CASE kind WHEN 'project' THEN {_first(documents.PERSONAL)} WHEN 'local'"
        f" THEN {_first(documents.TEAM)} END AS phrase FROM (SELECT *, CASE WHEN doc_id % 4 = 1 THEN"
        " 'local' WHEN doc_id % 4 = 0 THEN 'project' END AS kind FROM shallow)) WHERE phrase IS NOT"
        " NULL",
        shallow="SELECT doc_id, concat(CASE doc_id % 4 WHEN 1 THEN '/repo/CLAUDE.local.md' WHEN 0"
        " THEN '/repo/.claude/' ELSE '/repo/sub/' END, doc_id) AS path, content FROM docs",
    ),
)
def scopes(spark: SparkSession, sf: str) -> DataFrame:
    path = (
        "concat(CASE doc_id % 4 WHEN 1 THEN '/repo/CLAUDE.local.md' WHEN 0 THEN '/repo/.claude/'"
        " ELSE '/repo/sub/' END, doc_id)"
    )
    return documents.scope_issues(_docs(spark, sf).withColumn("path", F.expr(path)), ROOT)


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """Some of the targets: styles below some documents, notes, and shared files of some sources."""
    docs = table(spark, sf, "documents")
    beside = docs.filter("doc_id % 12 = 0").select(
        F.expr("concat('/repo/', source, '/', doc_id, '/docs/style.md')").alias("path")
    )
    shared = docs.filter("doc_id % 24 = 4").select(
        F.expr("concat('/repo/', source, '/./shared/a-b_c.md')").alias("path")
    )
    home = docs.filter("doc_id = 0").select(F.lit("/home/me/x/../notes.md").alias("path"))
    return beside.unionByName(shared).unionByName(home)


@query(
    "missing_imports",
    _sql(
        "SELECT path, concat('@', import) AS import FROM seeded WHERE NOT ("
        " (import = 'docs/style.md' AND doc_id % 12 = 0) OR import = '~/notes.md' OR (import ="
        " '../shared/./a-b_c.md' AND doc_id % 4 = 0 AND source IN (SELECT source FROM documents"
        " WHERE doc_id % 24 = 4)))",
        found=_IMPORTS,
        seeded="SELECT f.path, f.import, d.doc_id, d.source FROM found f JOIN (SELECT doc_id, source,"
        f" {_PATH.format(S='VARCHAR')} AS path FROM documents) d USING (path)",
    ),
)
def missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.missing_imports(_docs(spark, sf), _known(spark, sf), ROOT, HOME)
    return rows.select("path", "import")


@query(
    "coverage_summary",
    _sql(
        "SELECT topic, name, count(*) FILTER (matches > 0) > 0 AS covered,"
        f" count(*) FILTER (matches > 0) AS sources FROM ({_TOPICS}) GROUP BY topic, name"
    ),
)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return documents.coverage_summary(_docs(spark, sf))


@query(
    "topic_sources",
    _sql(
        "SELECT topic, path, string_split(path, '/')[-1] AS source"
        f" FROM ({_TOPICS}) WHERE matches > 0"
    ),
)
def sources(spark: SparkSession, sf: str) -> DataFrame:
    return documents.topic_sources(_docs(spark, sf))


@query(
    "open_questions",
    _sql(
        "SELECT concat('**', name, '**: ', question) AS question FROM (VALUES "
        + ", ".join(
            f"({_quoted(k)}, {_quoted(n)}, {_quoted(q)})" for k, n, q in documents.TOPICS
        )
        + f") AS t(topic, name, question) WHERE topic NOT IN (SELECT topic FROM ({_TOPICS})"
        " WHERE matches > 0) UNION ALL SELECT concat('**Clarify**: Found ''', found, ''' — ',"
        f" question) FROM (SELECT * FROM ({_VAGUE}) WHERE found <> '' ORDER BY path, phrase_no"
        " LIMIT 3)",
        docs=_DOCS.replace(_CONTENT, _OPEN_CONTENT),
    ),
)
def questions(spark: SparkSession, sf: str) -> DataFrame:
    return documents.open_questions(_docs(spark, sf, _OPEN_CONTENT))


_PLACES = (
    "CASE doc_id % 8 WHEN 0 THEN '/repo/CLAUDE.md' WHEN 1 THEN '/repo/.claude/CLAUDE.md' WHEN 2 THEN"
    " '/repo/CLAUDE.local.md' WHEN 3 THEN '/repo/.claude/rules/r.md' WHEN 4 THEN '/CLAUDE.md'"
    " WHEN 5 THEN '/repo/node_modules/a/CLAUDE.md' WHEN 6 THEN '/home/me/.claude/CLAUDE.md'"
    " ELSE concat('/repo/', source, '/CLAUDE.md') END"
)


@query(
    "document_kind",
    "SELECT path, CASE path WHEN '/repo/CLAUDE.md' THEN 'project' WHEN '/repo/.claude/CLAUDE.md' THEN"
    " 'project' WHEN '/repo/CLAUDE.local.md' THEN 'local' WHEN '/repo/.claude/rules/r.md' THEN 'rule'"
    " WHEN '/CLAUDE.md' THEN 'parent' WHEN '/repo/node_modules/a/CLAUDE.md' THEN NULL WHEN"
    " '/home/me/.claude/CLAUDE.md' THEN 'user' ELSE 'subtree' END AS kind,"
    " CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) AS n FROM"
    f" (SELECT *, {_PLACES} AS path FROM documents) GROUP BY 1, 2",
)
def kinds(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.expr(_PLACES).alias("path"), F.col("text").alias("content")
    )
    return (
        documents.classify_documents(docs, ROOT, HOME)
        .groupBy("path", "kind")
        .agg(F.sum("lines").alias("lines"), F.count("*").alias("n"))
    )
