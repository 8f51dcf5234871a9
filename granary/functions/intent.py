"""Column functions that compile a task text into a structured intent, and judge a candidate's role for it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bounds and patterns of intents.
MOST_CHARS, MOST_WORDS, MOST_KEYWORDS = 240, 32, 14
TOKEN = r"(?i)[a-z0-9][a-z0-9+#._/-]*"
VERSION = r"(?i)\b(?:v(?:ersion)?\s*)?\d+(?:\.\d+){1,3}\b"
FAILURE = (
    r"(?i)\b(?:error|exception|fail(?:ed|ing|ure)?|bug|crash(?:ed|ing)?|timeout|hang(?:ing)?|broken|invalid|corrupt(?:ed|ion)?|cannot|can't|unable"
    r"|doesn'?t|won'?t|deprecated|removed|incompatible|race condition)\b"
)
STOPWORDS = (
    "a an and are as at be been being by can could do does for from get give have help how i in into is it its make me my of on or our please "
    "should show that the their them then this to turn use using want we what when where which while with would you your"
).split()
TECHNOLOGIES = [
    "active directory", "amazon web services", "android", "ansible", "apache", "asyncio", "aws", "azure", "bash", "c++", "c#", "caffe",
    "chrome", "chromium", "cloudflare", "cobol", "cuda", "cython", "debian", "django", "docker", "elasticsearch", "excel", "fastapi",
    "ffmpeg", "firebase", "flask", "gcp", "git", "github", "gitlab", "go", "golang", "google sheets", "grafana", "grpc", "html", "java",
    "javascript", "jira", "kubernetes", "latex", "linux", "mongodb", "mysql", "next.js", "nginx", "node.js", "notion", "numpy", "ocaml",
    "ollama", "openssl", "oracle", "pandas", "pdf", "php", "playwright", "postgres", "postgresql", "powerpoint", "powershell", "python",
    "prometheus", "puppeteer", "pytorch", "qemu", "r", "react native", "react", "expo", "redis", "ruby", "rust", "salesforce", "sentry",
    "shopify", "slack", "spark", "sqlite", "ssh", "stripe", "supabase", "tensorflow", "terraform", "typescript", "ubuntu", "vue",
    "windows", "wordpress",
]
OPERATIONS = {
    "systematic-debugging": ["systematically", "reproduce", "reproducing", "isolate", "isolating"],
    "debug repair": ["debug", "fix", "repair", "diagnose", "troubleshoot"],
    "build compile": ["build", "compile", "install from source"],
    "create implement build": ["create", "implement", "write", "add", "develop", "build"],
    "convert migrate": ["convert", "migrate", "modernize", "port"],
    "extract parse": ["extract", "parse", "recover", "decode"],
    "configure deploy": ["configure", "deploy", "publish", "provision"],
    "test verify": ["test", "verify", "validate", "check"],
    "analyze optimize": ["analyze", "optimise", "optimize", "tune", "profile"],
    "search retrieve": ["search", "retrieve", "find", "look up"],
    "merge synchronize": ["merge", "sync", "synchronize", "combine"],
    "monitor summarize": ["monitor", "summarize", "track"],
    "review audit": ["review", "audit", "inspect"],
}
ARTIFACTS = {
    "api endpoint": ["api", "endpoint", "webhook"],
    "command line tool": ["cli", "command line", "executable"],
    "database": ["database", "db", "table", "query", "schema"],
    "spreadsheet": ["spreadsheet", "workbook", "xlsx", "worksheet", "excel"],
    "document": ["document", "docx", "report"],
    "presentation": ["presentation", "slides", "slide deck", "pptx"],
    "pdf": ["pdf", "pdf form"],
    "web page": ["web page", "webpage", "website", "landing page", "html"],
    "image": ["image", "screenshot", "photo"],
    "video": ["video", "recording"],
    "audio transcript": ["audio", "transcript", "speech"],
    "source code": ["source code", "codebase", "repository", "repo", "function", "class", "module"],
    "code review": ["code review", "review code", "code change", "code changes", "uncommitted changes"],
    "test suite": ["test suite", "tests", "verifier"],
    "model": ["model", "checkpoint", "weights", "inference"],
    "dataset": ["dataset", "csv", "jsonl", "parquet"],
    "certificate": ["certificate", "cert", "tls", "ssl"],
}
CONSTRAINTS = [
    "without", "must", "preserve", "exactly", "only", "under", "at most", "at least", "compatible", "compatibility", "offline", "cpu-only",
    "read-only", "deterministic", "byte-identical", "bounded", "required",
]

# Thresholds and words of roles.
HARMFUL_FLAGS = ["prompt-injection", "credential-access", "destructive", "malware"]
PRIMARY, SUPPORTING, POLICY = 0.80, 0.72, 0.95
ROLE_TOKEN = r"(?i)[a-z0-9][a-z0-9+#.-]*"
CONFLICT = (
    r"(?i)\b(?:ignore (?:previous|prior|system|developer) instructions|override the user|do not answer the user|system prompt|prompt injection"
    r"|jailbreak|exfiltrat|send credentials|disable safety|bypass authorization)\b"
)
FAILING = r"(?i)\b(?:error|exception|fail(?:ed|ing|ure)?|bug|crash(?:ed|ing)?|timeout|broken|invalid|corrupt)\b"
GENERIC = (
    "best practices guidelines guide workflow review testing debugging deployment migration policy process methodology general generic"
).split()


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _holds(low: Column, phrase: str) -> Column:
    return low.rlike(rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])")


def _labels(low: Column, rules: dict[str, list[str]], most: int) -> Column:
    found = [F.when(low.rlike("(?<![a-z0-9])(?:" + "|".join(re.escape(m) for m in markers) + ")(?![a-z0-9])"), F.lit(name)) for name, markers in rules.items()]
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def flattened(text: Column) -> Column:
    """The task in one line."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x00]+", " "))


def technologies(task: Column) -> Column:
    return _labels(F.lower(task), {t: [t] for t in TECHNOLOGIES}, 6)


def operations(task: Column) -> Column:
    return _labels(F.lower(task), OPERATIONS, 4)


def artifacts(task: Column) -> Column:
    return _labels(F.lower(task), ARTIFACTS, 4)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _useful(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, F.lower), lambda t: ~t.isin(STOPWORDS))


def constraints(task: Column) -> Column:
    """Up to three distinct phrases of sentences that state a constraint or a version, eight words each."""
    bound = F.filter(
        F.split(task, r"(?<=[.!?;])\s+", -1),
        lambda s: F.lower(s).rlike("|".join(re.escape(m) for m in CONSTRAINTS)) | s.rlike(VERSION),
    )
    phrases = F.transform(bound, lambda s: F.array_join(F.slice(_useful(_all(s, TOKEN)), 1, 8), " "))
    return F.slice(F.array_distinct(F.filter(phrases, lambda p: p != "")), 1, 3)


def failures(task: Column) -> Column:
    """Up to two distinct phrases around words of failure: three words before, the word and four after it."""
    tokens, hits, between = _all(task, TOKEN), _all(task, FAILURE), F.split(task, FAILURE, -1)
    pairs = F.zip_with(between, hits, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    numbers = F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.size(hits))).otherwise(F.array().cast("array<int>"))

    def phrase(k: Column) -> Column:
        before = F.concat(F.array_join(F.slice(pairs, F.lit(1), k - 1), ""), F.element_at(between, k))
        n = F.size(_all(before, TOKEN))
        at = F.when(n < F.size(tokens), n).otherwise(0)
        first = F.greatest(F.lit(0), at - 3)
        return F.array_join(_useful(F.slice(tokens, first + 1, at + 5 - first)), " ")

    return F.slice(F.array_distinct(F.filter(F.transform(numbers, phrase), lambda p: p != "")), 1, 2)


def keywords(task: Column) -> Column:
    """The first distinct words of three or more characters that aren't stop words or numbers."""
    bare = F.transform(_all(F.lower(task), TOKEN), lambda t: F.btrim(t, F.lit("./-")))
    kept = F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS) & ~t.rlike(r"^\d+$"))
    return F.slice(F.array_distinct(kept), 1, MOST_KEYWORDS)


def _bounded(parts: Column) -> Column:
    distinct = F.array_distinct(F.filter(F.split(F.array_join(parts, " "), r"\s+"), lambda w: w != ""))
    return F.rtrim(F.substring(F.array_join(F.slice(distinct, 1, MOST_WORDS), " "), 1, MOST_CHARS), F.lit(" ,.;:-"))


def compressed(task: Column) -> Column:
    """The intent as a short query: technology, operation, artifact, constraints, failures, then keywords."""
    out = _bounded(F.concat(technologies(task), operations(task), artifacts(task), constraints(task), failures(task), keywords(task)))
    return F.when(out == "", F.substring(task, 1, MOST_CHARS)).otherwise(out)


def catalogue_query(task: Column) -> Column:
    """A query for an external catalogue: one word of the first operation and a short tail of keywords."""
    technology, artifact, failure = technologies(task), artifacts(task), failures(task)
    operation = F.slice(F.transform(operations(task), lambda o: F.split(o, " ")[0]), 1, 1)
    parts = F.concat(technology, operation, artifact, failure)
    words = F.slice(F.split(task, " "), 1, 12)
    return _bounded(F.when(F.size(parts) == 0, words).otherwise(F.concat(parts, F.slice(keywords(task), 1, 8))))


def role_tokens(text: Column) -> Column:
    """Distinct lower-cased words of three or more characters, and those of five or more without a final s as well."""
    own = F.filter(F.transform(_all(F.coalesce(text, F.lit("")), ROLE_TOKEN), F.lower), lambda t: F.length(t) > 2)
    short = F.transform(F.filter(own, lambda t: (F.length(t) > 4) & t.endswith("s")), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    return F.array_distinct(F.concat(own, short))


def _shared(parts: Column, tokens: Column) -> Column:
    return F.size(F.array_intersect(role_tokens(F.array_join(parts, " ")), tokens))


def role(
    task: Column, text: Column, similarity: Column, quality: Column, provenance: Column, risk: Column, is_policy: Column, has_content: Column, risk_flags: Column | None = None
) -> Column:
    """struct(role, confidence, surfaced, reasons) of a candidate with this text for the flattened task.

    Roles: harmful/conflicting, policy, primary, supporting, irrelevant.
    """
    low = F.lower(text)
    tokens = role_tokens(low)
    technology, operation, artifact, bound = (_shared(p(task), tokens) for p in (technologies, operations, artifacts, constraints))
    failure = F.when((F.size(failures(task)) > 0) & low.rlike(FAILING), 1).otherwise(0)
    direct = _shared(F.array(compressed(task)), tokens)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    near = F.when(similarity.isNotNull(), unit((similarity - 0.72) / 0.28)).otherwise(0.0)
    specific = F.least(F.lit(1.0), technology * 0.35 + operation * 0.30 + artifact * 0.30 + failure * 0.20 + bound * 0.10)
    trust = unit(F.coalesce(provenance, F.lit(0.25)))
    base = near * 0.32 + F.least(F.lit(1.0), direct / 5.0) * 0.18 + specific * 0.32 + unit(F.coalesce(quality, F.lit(0)) / 100.0) * 0.10 + trust * 0.08
    contract = ((operation > 0) & ((artifact > 0) | (technology > 0))) | ((failure > 0) & (technology > 0))
    confidence = F.round(unit(base + F.when(contract, 0.23).otherwise(0.0)), 6)
    generic = F.size(F.array_intersect(tokens, _strings(GENERIC))) > 0
    adjacent = (direct >= 2) & (generic | (operation > 0) | (technology > 0) | (artifact > 0)) & (confidence >= SUPPORTING)
    sound = (risk == 0) & has_content
    flags = F.transform(F.coalesce(risk_flags, F.array().cast("array<string>")), F.lower) if risk_flags is not None else F.array().cast("array<string>")
    harmful = (risk >= 3) | low.rlike(CONFLICT) | F.arrays_overlap(flags, _strings(HARMFUL_FLAGS))
    shares = {"technology-match": technology, "operation-match": operation, "artifact-match": artifact, "failure-mode-match": failure}
    matches = F.array_compact(F.array(*[F.when(n > 0, name) for name, n in shares.items()]))

    def found(name: str, value: Column, shown: Column, reasons: Column) -> Column:
        return F.struct(F.lit(name).alias("role"), value.alias("confidence"), shown.alias("surfaced"), reasons.alias("reasons"))

    def or_else(reason: str) -> Column:
        return F.when(F.size(matches) > 0, matches).otherwise(F.array(F.lit(reason)))

    return (
        F.when(harmful, found("harmful/conflicting", F.lit(1.0), F.lit(False), F.array(F.lit("safety-conflict"))))
        .when(is_policy, found("policy", F.when(sound, 0.98).otherwise(0.60), sound, F.array(F.when(sound, "curated-policy").otherwise("unverified-policy"))))
        .when(contract & (confidence >= PRIMARY), found("primary", confidence, F.lit(True), or_else("specific-match")))
        .when(adjacent, found("supporting", confidence, F.lit(True), or_else("adjacent-match")))
        .otherwise(found("irrelevant", confidence, F.lit(False), or_else("insufficient-task-contract")))
    )


def slots(rows: DataFrame, supporting: int = 2) -> DataFrame:
    """Judged candidates (query_id, doc_id, position, score, similarity, role, confidence) with ``slot``: primary for the best
    primary candidate of a query, supporting for the best supporting ones.

    Among primary candidates the retrieval's score decides, then similarity, and confidence only after them, since it is a gate
    and must not undo a better match; supporting ones go by confidence. The first place decides ties.
    """
    first = F.col("role") == "primary"
    order = [F.desc(F.when(first, F.col("score"))), F.desc(F.when(first, F.coalesce("similarity", F.lit(0.0)))), F.desc("confidence"), "position"]
    place = F.row_number().over(Window.partitionBy("query_id", "role").orderBy(*order))
    slot = F.when(first & (F.col("place") == 1), "primary").when((F.col("role") == "supporting") & (F.col("place") <= supporting), "supporting")
    return rows.withColumn("place", place).withColumn("slot", slot).drop("place")
