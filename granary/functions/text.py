"""Column functions on text: normal forms, hashes, tokens, overlaps and estimates. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no subject.
NAME_STOPWORDS = [
    "agent", "agents", "ai", "auto", "automation", "assistant", "code", "claude", "creator", "helper", "mcp", "sales",
    "skill", "skills", "tool", "tools", "writer",
]

# Platforms and the words that name them; a trailing hyphen makes a prefix.
PLATFORM_ALIASES = {
    "airtable": ["airtable"],
    "aws": ["aws", "amazon web services"],
    "github": ["github", "git hub"],
    "google-sheets": ["google sheets", "gsheets", "g sheet"],
    "jira": ["jira", "atlassian"],
    "landingi": ["landingi", "landingi.com"],
    "mongodb": ["mongodb", "mongo db"],
    "notion": ["notion"],
    "postgres": ["postgres", "postgresql", "pgvector"],
    "salesforce": ["salesforce", "sfdc", "apex"],
    "shopify": ["shopify", "liquid theme", "liquid"],
    "slack": ["slack"],
    "stripe": ["stripe"],
    "wordpress": ["wordpress", "wp-"],
}

# Prompts that ask for nothing.
ACKNOWLEDGEMENTS = [
    "ok", "okay", "yes", "no", "thanks", "thank you", "continue", "go on", "do it", "sounds good", "yes please",
    "please do", "go ahead", "continue please", "status", "summarize", "explain this",
]
META_PHRASES = [
    "what did you", "what are you", "what is the current state", "current state", "why did you", "remember th",
    "sounds good", "that worked", "looks good", "what you just",
]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def canonical(text: Column) -> Column:
    """Without byte-order mark, with line feeds only."""
    marked = F.regexp_replace(text, "^﻿", "")
    return F.replace(F.replace(marked, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalised(text: Column) -> Column:
    """Canonical, without lines that state a version or date, lower-cased, white space collapsed."""
    dated = F.regexp_replace(strip(canonical(text)), r"(?im)^(updated_at|version|date):\s*.+$", "")
    return F.lower(strip(collapse(dated)))


def content_hash(text: Column) -> Column:
    """sha256 of the normal form; empty stays empty."""
    flat = normalised(text)
    return F.when(flat == "", F.lit("")).otherwise(F.sha2(F.encode(flat, "UTF-8"), 256))


def content_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def draft_hash(text: Column) -> Column:
    """sha256 of the lower-cased text with white space collapsed."""
    return F.sha2(F.encode(collapse(F.lower(strip(text))), "UTF-8"), 256)


def blob_sha(text: Column) -> Column:
    """The name that git gives a file of this content."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw)), "UTF-8"), F.unhex(F.lit("00")), raw))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def words(text: Column) -> Column:
    """All runs of ASCII letters and digits, lower-cased, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct words of three or more characters that name a subject, sorted."""
    long = F.filter(words(text), lambda t: F.length(t) > 2)
    return F.sort_array(F.array_except(long, F.array(*[F.lit(w) for w in NAME_STOPWORDS])))


def singular(token: Column) -> Column:
    """A plural in -ies or -s without its ending, where enough is left of the word."""
    ies = F.concat(F.regexp_replace(token, "ies$", ""), F.lit("y"))
    plain = token.endswith("s") & ~token.endswith("ss")
    return F.when(token.endswith("ies") & (F.length(token) > 4), ies).when(
        plain & (F.length(token) > 3), F.regexp_replace(token, "s$", "")
    ).otherwise(token)


def index_terms(text: Column) -> Column:
    """Sorted distinct singular words of three or more characters."""
    long = F.filter(F.array_distinct(words(text)), lambda t: F.length(t) >= 3)
    return F.sort_array(F.array_distinct(F.transform(long, singular)))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    return common(a, b) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def lexical_overlap(prompt: Column, name: Column, description: Column) -> Column:
    """Shared tokens, those of the name counted twice."""
    own = tokens(prompt)
    return 2 * common(own, tokens(name)) + common(own, tokens(description))


def has_alias(text: Column, alias: str) -> Column:
    """The alias as a word of the lower-cased text."""
    end = "" if alias.endswith("-") else r"(?![a-z0-9])"
    return F.lower(text).rlike(r"(?<![a-z0-9])" + alias.replace(".", r"\.") + end)


def _any_alias(aliases: list[str]) -> str:
    whole = "|".join(a.replace(".", r"\.") for a in aliases if not a.endswith("-"))
    return r"(?<![a-z0-9])(?:" + "|".join([f"(?:{whole})(?![a-z0-9])", *(a for a in aliases if a.endswith("-"))]) + ")"


def platforms(text: Column) -> Column:
    """Names of the platforms that the text mentions, sorted. Only a text that mentions any is searched for each."""

    def found(low: Column) -> Column:
        named = [F.when(low.rlike(_any_alias(aliases)), F.lit(name)) for name, aliases in sorted(PLATFORM_ALIASES.items())]
        mentions = low.rlike(_any_alias([a for aliases in PLATFORM_ALIASES.values() for a in aliases]))
        return F.when(mentions, F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>"))

    return bound(F.lower(text), found)


def is_non_task(prompt: Column) -> Column:
    """Acknowledgements, commands, very long text and talk about the conversation."""
    text = strip(collapse(F.coalesce(prompt, F.lit(""))))
    low = F.lower(text)
    meta = F.lit(False)
    for phrase in META_PHRASES:
        meta = meta | low.contains(phrase)
    return (
        (text == "")
        | text.startswith("/")
        | text.startswith("!")
        | (F.length(text) > 3000)
        | low.isin(ACKNOWLEDGEMENTS)
        | ((F.length(text) < 180) & meta)
    )


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def length_band(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 80, "short").when(n < 400, "medium").otherwise("long")


def _leading_32_bits(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("long")


def hash_share(key: Column) -> Column:
    """A number from 0 to 1 that is fixed for the key."""
    return _leading_32_bits(key) / F.lit(4294967295.0)


def hash_bucket(key: Column, buckets: int) -> Column:
    return _leading_32_bits(key) % buckets


def clean_markdown(text: Column) -> Column:
    """Prose of a markdown text: front matter, images and tags go, links become their text."""
    out = F.regexp_replace(canonical(text), r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)", "")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return strip(collapse(F.regexp_replace(out, r"<[^>]+>", " ")))


def path_line_share(text: Column) -> Column:
    """Share of the non-empty lines that are a path or a link."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    paths = F.filter(lines, is_path_or_link)
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(paths) / F.size(lines))


def is_path_or_link(line: Column) -> Column:
    value = F.regexp_replace(line, "^[`'\"]+|[`'\"]+$", "")
    slashes = F.length(F.regexp_replace(value, r"[^/\\]", ""))
    few_words = F.size(F.regexp_extract_all(value, F.lit(r"\S+"), F.lit(0))) <= 3
    starts = value.rlike(r"^([a-zA-Z]:[\\/]|https?://|file://|\.\.?/|~/|/)")
    return (value != "") & (starts | ((slashes >= 2) & few_words))
