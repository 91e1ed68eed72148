"""Audit of instruction documents: imports, topics, vague phrases, scope, open questions.

A documents table has ``path`` and ``content``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.functions.text import UNICODE, count_matches, required_literal

# Topics as (key, name, first question) and their patterns on lower-case text.
TOPICS = [
    ("code_style", "Code Style", "What indentation style do you use (tabs/spaces, width)?"),
    ("tone", "Tone & Output Style", "How verbose should responses be (concise vs detailed)?"),
    ("workflows", "Workflows & Commands", "What command builds the project?"),
    ("architecture", "Architecture & Structure", "Can you describe the directory structure?"),
]
TOPIC_PATTERNS = {
    "code_style": [
        r"indent(ation)?[\s:]+\d", r"tabs?\s+(vs|or)\s+spaces?", r"\d+\s*spaces?\s+(indent|tab)",
        r"naming\s*(convention|pattern|style)", r"camel\s*case", r"snake\s*case",
        r"pascal\s*case", r"kebab\s*case", r"import\s*(order|sort|group)",
        r"comment\s*(style|format)", r"docstring", r"jsdoc",
        r"eslint", r"prettier", r"black\b", r"ruff\b", r"biome",
        r"trailing\s*comma", r"semicolon", r"quote\s*(style|single|double)",
    ],
    "tone": [
        r"(be\s+)?concise", r"(be\s+)?verbose", r"(be\s+)?brief", r"(be\s+)?detailed",
        r"response\s*(style|tone|length|format)", r"output\s*(style|format)",
        r"avoid\s*(bullet|list|header)", r"use\s+prose", r"minimal\s+format",
        r"(no|avoid|without)\s*emoji", r"casual\s+tone", r"formal\s+tone",
        r"british\s+english", r"american\s+english",
    ],
    "workflows": [
        r"npm\s+(run\s+)?\w+", r"yarn\s+\w+", r"pnpm\s+\w+",
        r"make\s+\w+", r"cargo\s+(build|test|run|check)",
        r"go\s+(build|test|run)", r"python\s+-m\s+\w+",
        r"pytest\b", r"jest\b", r"vitest\b", r"mocha\b",
        r"docker\s+(build|run|compose)", r"kubectl\s+\w+",
        r"`[^`]*(build|test|lint|deploy|start|dev)[^`]*`",
        r"git\s+(flow|workflow)", r"branch(ing)?\s+(strategy|model)",
        r"commit\s*message\s*(format|convention)",
    ],
    "architecture": [
        r"(src|lib|app|packages?|components?)/\w+",
        r"directory\s*(structure|layout)", r"folder\s*(structure|layout)",
        r"file\s*(structure|organisation|organization)",
        r"(design|architecture)\s*pattern", r"composition\s+over",
        r"state\s*management", r"redux\b", r"zustand\b", r"mobx\b",
        r"api\s*(route|endpoint|convention)", r"rest\s+api", r"graphql\b",
        r"database\s*(schema|model)", r"orm\b", r"prisma\b",
    ],
}
# Vague phrases with the question each raises.
VAGUE = [
    (r"format\s+(code\s+)?properly", "What specific formatting rules?"),
    (r"follow\s+best\s+practices", "Which practices specifically?"),
    (r"be\s+consistent", "Consistent with what standard?"),
    (r"write\s+(good|clean|quality)\s+code", "What makes code 'good' here?"),
    (r"use\s+appropriate\s+names?", "What naming convention?"),
    (r"keep\s+it\s+simple", "Any specific simplicity guidelines?"),
    (r"document\s+(well|properly)", "What documentation style?"),
]
# Phrases that sit in the wrong kind of file, and the report texts.
PERSONAL = ["i prefer", "i like", "my personal", "just for me"]
TEAM = ["team standard", "we use", "our convention", "project-wide"]
PERSONAL_ISSUE = "Personal preference in shared file: '%s' → consider .local.md"
TEAM_ISSUE = "Team standard in local file: '%s' → consider promoting to project rules"
# File and folder names that decide the kind of a document.
LOCAL_FILE, RULES_FOLDER, TOOL_FOLDER = "CLAUDE.local.md", "rules", ".claude"
SKIPPED_FOLDERS = ["node_modules", "venv", "__pycache__", "dist", "build"]
STRONG, WEAK = 3, 1


def imports_of(content: Column) -> Column:
    """``@path`` references outside code, as an array: those with a slash or from home."""
    no_blocks = F.regexp_replace(content, r"```[\s\S]*?```", "")
    clean = F.regexp_replace(no_blocks, "`[^`]+`", "")
    found = F.regexp_extract_all(clean, F.lit(UNICODE + r"@(~?[\w\-\./]+)"), F.lit(1))
    kept = F.filter(found, lambda m: F.contains(m, F.lit("/")) | F.startswith(m, F.lit("~")))
    return F.transform(kept, lambda m: F.concat(F.lit("@"), m))


def extract_imports(docs: DataFrame) -> DataFrame:
    """One row per import, in order of appearance."""
    return docs.select("path", F.posexplode(imports_of(F.col("content"))).alias("position", "import"))


def topic_coverage(docs: DataFrame) -> DataFrame:
    """Matches and strength of each topic per document: strong, weak or none."""
    # Lower-casing and counting are steps of their own, so that each text is lowered once.
    lowered = docs.select("path", F.lower("content").alias("_lower"))
    counted = lowered.select(
        "path", *[count_matches(F.col("_lower"), TOPIC_PATTERNS[k]).alias(k) for k, _, _ in TOPICS]
    )
    topics = F.array(
        *[
            F.struct(
                F.lit(key).alias("topic"), F.lit(name).alias("name"), F.col(key).alias("matches")
            )
            for key, name, _ in TOPICS
        ]
    )
    return counted.select("path", F.explode(topics).alias("t")).select(
        "path",
        "t.*",
        F.when(F.col("t.matches") >= STRONG, "strong")
        .when(F.col("t.matches") >= WEAK, "weak")
        .otherwise("none")
        .alias("strength"),
    )


def vague_phrases(docs: DataFrame) -> DataFrame:
    """First match of every vague phrase with its question, in the order of the phrases."""
    lowered = F.col("_lower")
    hits = F.array(
        *[
            F.struct(
                F.lit(i).alias("phrase_no"),
                F.when(
                    F.contains(lowered, F.lit(required_literal(pattern))),
                    F.regexp_extract(lowered, UNICODE + pattern, 0),
                ).alias("found"),
                F.lit(question).alias("question"),
            )
            for i, (pattern, question) in enumerate(VAGUE)
        ]
    )
    return docs.select("path", F.lower("content").alias("_lower")).select(
        "path", F.explode(F.filter(hits, lambda h: h["found"] != "")).alias("h")
    ).select("path", "h.*")


def scope_issues(docs: DataFrame, root: str) -> DataFrame:
    """The first personal phrase of a project file, or team phrase of a local file."""
    lowered, kind = F.lower("content"), document_kind(F.col("path"), root)

    def first(phrases: list[str]) -> Column:
        listed = F.array(*[F.lit(p) for p in phrases])
        return F.get(F.filter(listed, lambda p: F.contains(lowered, p)), F.lit(0))

    hit = F.when(kind == "project", first(PERSONAL)).when(kind == "local", first(TEAM))
    return (
        docs.select("path", kind.alias("kind"), hit.alias("phrase"))
        .filter(F.col("phrase").isNotNull())
        .withColumn(
            "issue",
            F.when(F.col("kind") == "project", F.format_string(PERSONAL_ISSUE, "phrase")).otherwise(
                F.format_string(TEAM_ISSUE, "phrase")
            ),
        )
    )


def plain_path(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _below(folder: Column, path: Column) -> Column:
    return plain_path(
        F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, F.lit("/"), path))
    )


def missing_imports(docs: DataFrame, known: DataFrame, root: str, home: str) -> DataFrame:
    """Imports that resolve to no known path.

    From home or absolute paths have one candidate; others are looked up beside the document and
    below the root. ``known`` has ``path``.
    """
    target = F.substring("import", 2, 1 << 30)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    candidates = F.when(
        F.startswith(target, F.lit("~")),
        F.array(_below(F.lit(home), F.substring("import", 4, 1 << 30))),
    ).otherwise(F.array(_below(folder, target), _below(F.lit(root), target)))
    imports = extract_imports(docs).withColumn("candidate", F.explode(candidates))
    paths = known.select(plain_path(F.col("path")).alias("candidate")).distinct()
    # A candidate that many documents share is split by adaptive execution.
    tested = imports.join(paths.withColumn("known", F.lit(True)), "candidate", "left")
    return (
        tested.groupBy("path", "position", "import")
        .agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
        .filter(~F.col("known"))
        .select("path", "import", "position")
    )


def topics_table(spark: SparkSession) -> DataFrame:
    """The topics with their first question."""
    return spark.createDataFrame(TOPICS, "topic string, name string, question string")


def coverage_summary(docs: DataFrame) -> DataFrame:
    """Per topic: whether any document covers it, and how many do.

    The covering documents themselves are rows of ``topic_sources``.
    """
    covering = (
        topic_coverage(docs)
        .filter(F.col("matches") > 0)
        .groupBy("topic")
        .agg(F.count("*").alias("sources"))
    )
    return topics_table(docs.sparkSession).join(covering, "topic", "left").select(
        "topic",
        "name",
        F.col("sources").isNotNull().alias("covered"),
        F.coalesce("sources", F.lit(0)).alias("sources"),
    )


def topic_sources(docs: DataFrame) -> DataFrame:
    """Documents that cover a topic, with their file name; one row each."""
    return (
        topic_coverage(docs)
        .filter(F.col("matches") > 0)
        .select("topic", "path", F.substring_index("path", "/", -1).alias("source"))
    )


def open_questions(docs: DataFrame, vague_limit: int = 3) -> DataFrame:
    """The first question of every uncovered topic, then the first vague phrases by document."""
    covered = topic_coverage(docs).filter(F.col("matches") > 0).select("topic").distinct()
    topics = topics_table(docs.sparkSession).join(covered, "topic", "left_anti")
    gaps = topics.select(F.format_string("**%s**: %s", "name", "question").alias("question"))
    vague = vague_phrases(docs).orderBy("path", "phrase_no").limit(vague_limit)
    return gaps.unionByName(
        vague.select(
            F.format_string("**Clarify**: Found '%s' — %s", "found", "question").alias("question")
        )
    )


def document_kind(path: Column, root: str, home: str | None = None) -> Column:
    """local, rule, project, user, subtree or parent by path; null in folders that are skipped."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    between = F.split(F.substring(folder, len(root.rstrip("/")) + 2, 1 << 30), "/")
    skipped = F.exists(
        between, lambda f: F.startswith(f, F.lit(".")) | f.isin(SKIPPED_FOLDERS)
    )
    kind = (
        F.when(F.contains(path, F.lit(LOCAL_FILE)), "local")
        .when(F.substring_index(folder, "/", -1) == RULES_FOLDER, "rule")
        .when(folder.isin(root.rstrip("/"), f"{root.rstrip('/')}/{TOOL_FOLDER}"), "project")
    )
    if home:
        kind = kind.when(folder == f"{home}/{TOOL_FOLDER}", "user")
    return kind.when(inside & skipped, None).when(inside, "subtree").otherwise("parent")


def line_count(content: Column) -> Column:
    """Newlines plus one."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast(
        "bigint"
    )


def classify_documents(docs: DataFrame, root: str, home: str | None = None) -> DataFrame:
    """Kind and number of lines of each document."""
    return docs.select(
        "path",
        document_kind(F.col("path"), root, home).alias("kind"),
        line_count(F.col("content")).alias("lines"),
    )
