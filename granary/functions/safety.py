"""Column functions that judge content: risk, capabilities, reasons for rejection, redaction of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, canonical, path_line_share, strip, token_estimate

# Label, pattern, weight of what makes content risky. "(\\s|$)" stands for a look-ahead, which DuckDB lacks.
RISKS = [
    ("curl-pipe-shell", r"curl\s+[^\n|]*\|\s*(sudo\s+)?(sh|bash|zsh)\b", 3),
    ("wget-pipe-shell", r"wget\s+[^\n|]*\|\s*(sudo\s+)?(sh|bash|zsh)\b", 3),
    ("rm-rf-root", r"rm\s+-rf\s+/(\s|$)", 3),
    ("base64-decode-exec", r"base64\s+(-d|--decode)[^\n]*\|\s*(sh|bash)", 3),
    ("eval-atob", r"eval\s*\(\s*atob\s*\(", 3),
    ("reverse-shell-devtcp", r"/dev/tcp/\d", 3),
    ("reverse-shell-nc", r"\bnc(at)?\s+-e\s", 3),
    ("reverse-shell-bash-i", r"bash\s+-i\s*>&\s*/dev/tcp", 3),
    ("powershell-encoded", r"(?i)powershell[^\n]*-(enc|EncodedCommand)\b", 3),
    ("onion-address", r"\b[a-z2-7]{16,56}\.onion\b", 2),
    ("crypto-miner", r"(?i)stratum\+tcp://|xmrig|minergate", 3),
    ("exfiltration-language", r"(?i)exfiltrat(e|ion)", 2),
    ("credential-to-remote", r"(?i)(api[_ -]?key|secret|credential|\.env)\b[^\n]{0,60}(https?://)", 2),
    ("eval-generic", r"\beval\s*\(", 1),
    ("exec-generic", r"\bexec\s*\(", 1),
    ("os-system", r"os\.system\s*\(", 1),
    ("shell-true", r"shell\s*=\s*True", 1),
    ("dynamic-function-eval", r"new\s+Function\s*\(|Function\s*\(\s*atob", 2),
    ("prompt-injection-ignore", r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+instructions", 3),
    ("prompt-injection-disregard", r"(?i)disregard\s+(all\s+)?(previous|prior|your)\s+instructions", 3),
    ("prompt-injection-secret", r"(?i)(secretly|without (telling|informing) the user|do not (tell|inform) the user)", 3),
]

# Label, pattern of what content says it does.
CAPABILITIES = [
    ("declared-tools", r"(?im)^\s*allowed-tools\s*:"),
    ("bundled-scripts", r"(?i)(?:^|[\s`(])scripts[/\\]"),
    ("declared-dependencies", r"(?im)^\s*dependencies\s*:"),
    ("network-command", r"(?i)\b(?:curl|wget|httpx)\b|\b(?:import\s+requests|from\s+requests\b|requests\s*\.\s*(?:get|post|put|patch|delete|request|session)\b)|\bfetch\s*\("),
    ("dependency-install", r"(?i)\b(?:pip|npm|pnpm|yarn|uv|brew|apt(?:-get)?)\s+(?:install|add)\b"),
    ("elevated-or-destructive", r"(?i)\b(?:sudo|rm\s+-rf|chmod\s+777|powershell\s+-enc)\b"),
    ("unconfirmed-action", r"(?is)\b(?:send|post|publish|delete|remove|drop|write|modify|change|create|execute|run|install|deploy|push)\b.{0,180}\b(?:do\s+not|don't|never|without)\s+(?:ask|request|seek|require)\b.{0,80}\b(?:confirm|approval|permission)\b"),
]

# Lines that are masked, and what a text may make happen.
CREDENTIAL_LINE = (
    r"(?i)(?:\b(?:api[_ -]?key|access[_ -]?token|secret|password|authorization)\b\s*[:=]\s*\S+|\bBearer\s+[A-Za-z0-9._~+/-]{8,}"
    r"|\bAKIA[0-9A-Z]{12,}|\b(?:sk|ghp|github_pat|xox[baprs])[-_][A-Za-z0-9_-]{8,})"
)
CONTROL_LINE = (
    r"(?i)\b(?:ignore (?:all |any )?(?:previous|prior|system|developer) instructions|system prompt|developer message|override (?:the )?user"
    r"|do not answer the user|never reveal|hidden instructions|jailbreak|prompt injection|spawn (?:a |the )?(?:subagent|agent)|use the agent tool"
    r"|stop (?:immediately|now|processing)|wait for (?:the )?user|ask (?:the )?user before (?:continuing|proceeding)"
    r"|read (?:every|all) (?:skill|instruction) file)\b"
)
EXTERNAL = (
    r"(?i)\b(?:send|post|publish|deploy|upload|email|message|purchase|pay|create (?:an )?account|open a pull request|push to|call (?:the )?api"
    r"|network request|download|install)\b"
)
DESTRUCTIVE = (
    r"(?i)\b(?:delete|remove|drop|truncate|overwrite|reset --hard|force push|revoke|purge|destroy|format (?:the )?(?:disk|drive)|rm\s+-rf)\b"
)
PROJECT_PATH = r"\b([A-Z][A-Za-z0-9_]{2,})/(?:[A-Za-z0-9_.\-]+/){0,4}[A-Za-z0-9_.\-]+\.(?:py|json|ya?ml|sh|ps1|pdf|csv|xlsx?|txt|md)\b"
SANDBOX_PATH = r"(?i)(?:/mnt/(?:skills|user-data)/|/home/claude/)"
CREDENTIAL_MARK = "[redacted: credential-like content removed]"
CONTROL_MARK = "[redacted: agent-control/meta-instruction content removed]"
SAME_ROOT = 3
#: Characters up to which content is delivered inline.
INLINE_CHARS = 24_000

LEAST_CHARS, LEAST_WORDS, MOST_PATH_LINES, MOST_CHARS = 180, 35, 0.6, 500_000


_PIECE = re.compile(r"\(\?[a-z]+\)|\\.|\[(?:\\.|[^\]\\])*\]|.", re.S)


def plain(pattern: str) -> str:
    """The pattern with ASCII word boundaries and spaces, lines that end with a line feed alone, and case folding as DuckDB has them.

    Java's boundaries know letters of all scripts, its spaces a vertical tab and its lines other ends. Boundaries of these
    patterns stand before or after a word character, so one side is enough.
    """
    out, last = ["(?d)"], ""
    folded = bool(re.match(r"\(\?[a-z]*i", pattern))
    for own in _PIECE.findall(pattern):
        piece = own
        if piece == r"\b":
            piece = r"(?!\w)" if re.fullmatch(r"\w|\)", last) else r"(?<!\w)"
        elif piece == r"\s":
            piece = r"[\t\n\f\r ]"
        elif piece == r"\S":
            piece = r"[^\t\n\f\r ]"
        elif piece[0] == "[":
            piece = piece.replace(r"\s", r"\t\n\f\r ")
        elif folded and piece in "skSK":
            piece = "[sS\u017f]" if piece in "sS" else "[kK\u212a]"
        out.append(piece)
        last = own
    return "".join(out)


def _hits(text: Column, labelled: list[tuple]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(plain(x[1])), F.lit(x[0])) for x in labelled]))


def risk_flags(text: Column) -> Column:
    return _hits(text, RISKS)


def risk_score(flags: Column) -> Column:
    """Summed weights of the labels in ``flags``."""
    weights = F.create_map(*[F.lit(v) for label, _, w in RISKS for v in (label, w)])
    return F.aggregate(flags, F.lit(0), lambda total, flag: total + F.try_element_at(weights, flag))


def capability_flags(text: Column) -> Column:
    return _hits(text, CAPABILITIES)


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 300))
    return head.rlike(r"^(<!doctype|<html|<\?xml)") | head.contains("<head>") | head.contains("githubassets.com")


def front_matter(text: Column) -> Column:
    """The block between the first two lines of three hyphens, or an empty string."""
    return F.regexp_extract(canonical(text), r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(canonical(text), r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)", "")


def has_front_matter(text: Column) -> Column:
    block = front_matter(text)
    return block.rlike(r"(?m)^name:\s*\S+") & block.rlike(r"(?m)^description:\s*(\S+|[>|])")


def rejection_reasons(text: Column, allow_oversized: Column | None = None) -> Column:
    """What speaks against storing a fetched text, in a fixed order; of a text that is too large that alone."""
    oversized = F.length(text) > MOST_CHARS
    if allow_oversized is not None:
        oversized = oversized & ~allow_oversized
    flat = strip(text)
    body = without_front_matter(flat)
    n_words = F.size(F.regexp_extract_all(body, F.lit(r"[A-Za-z][A-Za-z0-9_-]+"), F.lit(0)))
    structure = body.contains("##") | body.rlike(r"(?m)^\s*[-*]\s+\S+") | flat.rlike(r"(?m)^name:\s*\S+")
    found = F.array_compact(
        F.array(
            F.when(looks_like_html(text), F.lit("html-response")),
            F.when(F.length(flat) < LEAST_CHARS, F.lit("too-short")),
            F.when(path_line_share(flat) >= MOST_PATH_LINES, F.lit("path-or-link-only")),
            F.when(n_words < LEAST_WORDS, F.lit("too-few-body-words")),
            F.when(~structure, F.lit("no-skill-structure")),
        )
    )
    return F.when(oversized, F.array(F.lit("content-too-large"))).otherwise(found)


_CREDENTIAL, _CONTROL, _EXTERNAL, _DESTRUCTIVE = (plain(p) for p in (CREDENTIAL_LINE, CONTROL_LINE, EXTERNAL, DESTRUCTIVE))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _kind(line: Column) -> Column:
    return F.when(line.rlike(_CREDENTIAL), 1).when(line.rlike(_CONTROL), 2).otherwise(0)


def _judged(text: Column) -> Column:
    """struct(s, k) of each line: k is 1 where it holds a credential, 2 where it tries to take control."""
    return F.transform(_split(text), lambda s: F.struct(s.alias("s"), _kind(s).alias("k")))


def _may_mask(text: Column) -> Column:
    """False where no line can be masked: what matches in a line matches in the text."""
    return text.rlike(_CREDENTIAL) | text.rlike(_CONTROL)


def _joined(judged: Column) -> Column:
    mask = lambda x: F.when(x["k"] == 1, CREDENTIAL_MARK).when(x["k"] == 2, CONTROL_MARK).otherwise(x["s"])
    return F.array_join(F.transform(judged, mask), "\n")


def redacted(text: Column) -> Column:
    """The text with every line masked that holds a credential or tries to take control."""
    return F.when(_may_mask(text), bound(_judged(text), _joined)).otherwise(text)


def redacted_lines(text: Column) -> Column:
    """(credentials, controls): how many lines are masked as which."""

    def counts(kinds: Column) -> Column:
        return F.struct(*[F.size(F.filter(kinds, lambda k, n=n: k == n)).alias(c) for n, c in ((1, "credentials"), (2, "controls"))])

    none = F.array().cast("array<int>")
    return bound(F.when(~_may_mask(text), none).otherwise(F.transform(_split(text), _kind)), counts)


def _lines_with(text: Column, pattern: str) -> Column:
    """Whether a line that isn't masked matches; lines are split only where the text matches."""
    return F.when(~text.rlike(pattern), False).otherwise(F.exists(_split(text), lambda s: s.rlike(pattern) & (_kind(s) == 0)))


def destructive_actions(text: Column) -> Column:
    return _lines_with(text, _DESTRUCTIVE)


def external_actions(text: Column) -> Column:
    return _lines_with(text, _EXTERNAL)


def _rooted(left: Column) -> Column:
    """As non_portable, of a redacted text."""
    roots = F.regexp_extract_all(left, F.lit(plain(PROJECT_PATH)), F.lit(1))
    return bound(roots, lambda found: F.exists(F.array_distinct(found), lambda r: F.size(F.filter(found, lambda x: x == r)) >= SAME_ROOT)) | left.rlike(SANDBOX_PATH)


def non_portable(text: Column) -> Column:
    """Several files below the same made-up root folder, or a path of a sandbox, outside masked lines."""
    return bound(redacted(text), _rooted)


def delivery(content: Column) -> Column:
    """struct(delivery, reason, capsule_chars, estimated_tokens): a capsule, the isolated whole, or a hint and what stands against more."""
    full = F.coalesce(content, F.lit(""))

    def told(x: Column) -> Column:
        kind = F.when(x["reason"] == "public-source-isolated-full", "isolation").when(x["reason"] == "public-source-distilled", "capsule").otherwise("hint")
        return F.struct(
            kind.alias("delivery"),
            x["reason"].alias("reason"),
            F.when(kind == "capsule", F.length(x["clean"])).otherwise(0).cast("long").alias("capsule_chars"),
            F.when(kind == "hint", 0).otherwise(token_estimate(x["clean"])).cast("long").alias("estimated_tokens"),
        )

    def reasoned(clean: Column) -> Column:
        reason = (
            F.when(full == "", "content_unavailable")
            .when(clean.isNull(), "invalid_skill_frontmatter")
            .when(F.length(content) > MOST_CHARS, "content_too_large")
            .when(_rooted(clean), "non_portable_project_specific")
            .when(F.length(clean) > INLINE_CHARS, "public-source-isolated-full")
            .otherwise("public-source-distilled")
        )
        return bound(F.struct(reason.alias("reason"), clean.alias("clean")), told)

    # null where front matter is missing; such texts are not redacted
    return bound(F.when((full != "") & has_front_matter(content), redacted(full)), reasoned)
