"""Contracts between tasks and candidates: what family a task is of, what a candidate is for, and whether it may serve the task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PLATFORM_ALIASES, has_alias

# What words count as in a task; only lower-case runs do.
TASK_TOKEN = "[a-z0-9+#.-]+"
CODING = [
    "code", "coding", "function", "class", "method", "component", "frontend", "backend", "website", "webapp", "landing", "page", "ui", "ux", "design",
    "app", "bug", "debug", "refactor", "repository", "repo", "test", "python", "javascript", "typescript", "java", "rust", "golang", "react", "vue",
    "angular", "nextjs", "fastapi", "django", "flask", "html", "css", "sql", "api", "endpoint",
]
DATA = [
    "spreadsheet", "excel", "csv", "dataset", "analytics", "dashboard", "kpi", "pandas", "polars", "parquet", "jsonl", "dataframe", "etl", "warehouse",
    "dbt", "snowflake", "bigquery", "redshift", "databricks", "database", "databases", "table", "tables", "schema", "schemas",
]
STRONG_CODING = [
    "code", "coding", "function", "class", "method", "component", "refactor", "repository", "repo", "debug", "python", "javascript", "typescript",
    "java", "rust", "golang", "nextjs", "fastapi", "django", "flask", "html", "css", "sql", "react", "vue", "angular", "api", "endpoint",
]
CODE_ENDINGS = [".py", ".js", ".jsx", ".ts", ".tsx", ".rs", ".go", ".java", ".html", ".css"]
RESEARCH = ["research", "competitor", "sources", "citations", "browse", "web"]
DOCUMENTS = ["document", "docx", "pdf", "slides", "presentation", "report"]
FAMILIES = ["coding", "research", "documents", "data", "general"]
ACTIONS = {
    "review": ["review", "audit", "inspect"],
    "debug": ["debug", "bug", "fix", "repair"],
    "test": ["test", "verify", "validate"],
    "refactor": ["refactor", "simplify", "cleanup"],
    "implement": ["build", "create", "implement", "write", "add"],
}
INTEGRATION_REQUESTS = ["integrate", "integration", "connect", "connector", "sync", "webhook", "oauth", "mcp"]
POLICY_MARKERS = ["always-on", "always on", "coding policy", "decision ladder"]
WORKFLOW_MARKERS = ["debug", "review", "testing", "workflow", "migration", "deployment"]
LEAST_POLICY_QUALITY = 70


def task_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TASK_TOKEN), F.lit(0)))


def _any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def _holds(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def task_analysis(query: Column, tokens: Column, requested: Column | None = None) -> Column:
    """struct(family, action, signal) of a task; a supported family that the client asks for comes before what words say."""
    asked = F.lower(F.trim(F.coalesce(requested, F.lit("")))) if requested is not None else F.lit("")

    def found(family, signal: str | None) -> Column:
        return F.struct(family if isinstance(family, Column) else F.lit(family), F.lit(signal).cast("string")).cast("struct<family: string, signal: string>")

    coding = _any(tokens, CODING) | _holds(F.lower(F.coalesce(query, F.lit(""))), CODE_ENDINGS)
    family = (
        F.when(asked.isin(FAMILIES), found(asked, "client-task-family"))
        .when(_any(tokens, DATA) & ~_any(tokens, STRONG_CODING), found("data", "data-artifact"))
        .when(coding, found("coding", "coding-language-or-artifact"))
        .when(_any(tokens, RESEARCH), found("research", "research-intent"))
        .when(_any(tokens, DOCUMENTS), found("documents", "document-artifact"))
        .otherwise(found("general", None))
    )
    action = F.lit("work")
    for name, markers in reversed(ACTIONS.items()):
        action = F.when(_any(tokens, markers), name).otherwise(action)
    return F.struct(family["family"].alias("family"), action.alias("action"), family["signal"].alias("signal"))


def candidate_kind(name: Column, description: Column, category: Column, platforms: Column, policy_names: list[str]) -> Column:
    """policy, integration, workflow or specialist; the first that fits."""
    name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    text = F.concat(name, F.lit(" "), F.lower(F.coalesce(description, F.lit(""))))
    policy = name.isin(policy_names) if policy_names else F.lit(False)
    category = F.coalesce(category, F.lit(""))
    return (
        F.when(policy | (category == "policy") | _holds(text, POLICY_MARKERS), "policy")
        .when((category == "integration") | (F.size(F.coalesce(platforms, F.array().cast("array<string>"))) > 0) | name.contains("integration"), "integration")
        .when(_holds(text, WORKFLOW_MARKERS), "workflow")
        .otherwise("specialist")
    )


def names_platform(query: Column, platforms: Column) -> Column:
    """Whether the query names one of the platforms; one without known aliases goes by its own name."""
    low = F.lower(F.coalesce(query, F.lit("")))
    out = F.lit(False)
    for name, aliases in PLATFORM_ALIASES.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | has_alias(low, alias)
        out = out | (F.array_contains(platforms, name) & hit)
    other = F.filter(platforms, lambda p: ~p.isin(list(PLATFORM_ALIASES)) & (p != ""))
    words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    return out | F.exists(other, lambda p: words.contains(F.concat(F.lit(" "), F.lower(p), F.lit(" "))))


def serves(query: Column, tokens: Column, kind: Column, name: Column, platforms: Column) -> Column:
    """Whether a candidate may serve a task: policies never do, and integrations only where the task asks for one: by the name
    of its platform, or, where it has none, by a word for integrating or by a platform that its own name has."""
    platforms = F.coalesce(platforms, F.array().cast("array<string>"))
    low, named = F.lower(F.coalesce(name, F.lit(""))), F.lit(False)
    asks = F.lower(F.coalesce(query, F.lit("")))
    for aliases in PLATFORM_ALIASES.values():
        own, wanted = F.lit(False), F.lit(False)
        for alias in aliases:
            own, wanted = own | has_alias(low, alias), wanted | has_alias(asks, alias)
        named = named | (own & wanted)
    explicit = F.when(F.size(platforms) > 0, names_platform(query, platforms)).otherwise(_any(tokens, INTEGRATION_REQUESTS) | named)
    return F.when(kind == "policy", False).when(kind == "integration", explicit).otherwise(True)


def may_be_policy(
    family: Column, kind: Column, name: Column, url: Column, status: Column, quality: Column, risk: Column, content_hash: Column, names: list[str], sources: list[str]
) -> Column:
    """Whether a candidate may take the policy slot of a coding task: curated by name and source, active, good and without risk."""
    curated = F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(names) if names else F.lit(False)
    known = _holds(F.lower(F.coalesce(url, F.lit(""))), [s.lower() for s in sources])
    sound = (F.coalesce(status, F.lit("active")) == "active") & (F.coalesce(quality, F.lit(0)) >= LEAST_POLICY_QUALITY) & (F.coalesce(risk, F.lit(0)) == 0)
    return (family == "coding") & (kind == "policy") & curated & known & sound & (F.coalesce(content_hash, F.lit("")) != "")
