"""Column functions that judge a catalogue record: prior trust, evidence, meaningfulness, quality status and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .safety import has_front_matter, rejection_reasons
from .text import canonical, content_hash, platforms, strip

# Sources and what their records are trusted by default.
PROVENANCE = {
    "mcp_official_registry": 0.95,
    "smithery_registry": 0.75,
    "glama_registry": 0.75,
    "pulsemcp_registry": 0.75,
    "npm": 0.75,
    "github_skill_file": 0.55,
    "github_repo": 0.45,
}
# Sources whose records count without content, and sources that must bring a complete package.
METADATA_SOURCES = ["mcp_official_registry", "smithery_registry", "glama_registry", "pulsemcp_registry", "npm"]
PACKAGE_SOURCES = ["github", "github_skill_file", "skillsmp", "awesome_list"]
MIRROR = "skills_sh"
# Shares of meaningfulness, and bounds of trust.
QUALITY_SHARE, PROVENANCE_SHARE, PROMINENCE_SHARE, EVIDENCE_SHARE = 0.55, 0.20, 0.15, 0.10
TRUSTED_PROVENANCE, TRUSTED_STARS, TRUSTED_EVIDENCE, TRUSTED_QUALITY = 0.55, 10, 0.8, 0.85
NAME_POINTS, LONG_DESCRIPTION_POINTS, DESCRIPTION_POINTS, LONG_DESCRIPTION = 10, 20, 8, 40
CONTENT_POINTS, USELESS_POINTS, LONG_CONTENT_POINTS, LONG_CONTENT, HEADING_POINTS, METADATA_POINTS = 45, -20, 10, 800, 5, 15
UNFIT = ["entrypoint-truncated", "package-incomplete", "dependency-closure-incomplete"]


def stars(value: Column) -> Column:
    """A count of 0 or more from any text; what isn't a whole number is 0."""
    return F.greatest(F.lit(0), F.coalesce(value.cast("string").try_cast("int"), F.lit(0)))


def prominence(star_count: Column) -> Column:
    return F.when(star_count <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(star_count.cast("double")) / F.log(F.lit(100001.0))))


def provenance(source: Column, registry: Column, source_type: Column, verified: Column) -> Column:
    """Trust in a source from 0 to 1: verified publishers, the mirror, known sources, then what the name says."""
    name = F.lower(strip(F.coalesce(source, F.lit(""))))
    mirrored = (name == MIRROR) | (F.coalesce(registry, F.lit("")) == MIRROR)
    out = F.when(F.coalesce(verified, F.lit(False)), 1.0)
    out = out.when(mirrored, F.when(F.lower(strip(F.coalesce(source_type, F.lit("")))) == "well-known", 0.60).otherwise(0.45))
    for known, value in PROVENANCE.items():
        out = out.when(name == known, value)
    out = out.when(name.contains("official") | name.contains("verified"), 0.9)
    out = out.when(name.contains("github") & name.contains("skill"), 0.55)
    return out.when(name.contains("git"), 0.45).otherwise(0.25)


def evidence(evaluated: Column, feedback: Column) -> Column:
    """Evaluation weighs 0.7 and feedback 0.3, one alone counts whole, none is neutral. Values are cut to 0 to 1."""
    e, f = (F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))) for c in (evaluated, feedback))
    return F.coalesce(0.7 * e + 0.3 * f, e, f, F.lit(0.5))


def meaningfulness(quality: Column, trust: Column, fame: Column, proof: Column) -> Column:
    """quality from 0 to 100, the others from 0 to 1; rounded to 6 places."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(quality, F.lit(0)) / 100.0))
    total = QUALITY_SHARE * share + PROVENANCE_SHARE * trust + PROMINENCE_SHARE * fame + EVIDENCE_SHARE * proof
    return F.round(total, 6)


def trusted(quality: Column, trust: Column, star_count: Column, proof: Column) -> Column:
    """star_count is null where none is stated."""
    unstated = star_count.isNull() & (quality / 100.0 >= TRUSTED_QUALITY)
    return (trust >= TRUSTED_PROVENANCE) | (F.coalesce(star_count, F.lit(0)) >= TRUSTED_STARS) | (proof >= TRUSTED_EVIDENCE) | unstated


def _low(value: Column, default: str = "") -> Column:
    return F.lower(F.coalesce(value, F.lit(default)))


def readiness(
    status: Column, source: Column, registry: Column, truncated: Column, has_content: Column, package: Column, closure: Column, name: Column, description: Column
) -> Column:
    """What may be delivered of a record now: rejected, full-ready, hint-ready or catalog-ready."""
    status, mirrored = _low(status, "pending"), _low(registry) == MIRROR
    needs_package = F.coalesce(source, F.lit("")).isin(PACKAGE_SOURCES) | mirrored
    closed = (_low(closure) == "complete") | (mirrored & (_low(closure) == "resolved"))
    named, described = (strip(F.coalesce(c, F.lit(""))) != "" for c in (name, description))
    return (
        F.when(status.isin("rejected", "duplicate") | F.coalesce(truncated, F.lit(False)), "rejected")
        .when((status == "active") & has_content & (~needs_package | ((_low(package) == "complete") & closed)), "full-ready")
        .when((status == "metadata_only") & named & described, "hint-ready")
        .when(status.isin("active", "metadata_only") & (has_content | described), "hint-ready")
        .otherwise("catalog-ready")
    )


def content_parts(content: Column, name: Column, description: Column, registry: Column) -> dict[str, Column]:
    """What evaluation reads from a content: text, found (reasons to reject it), front (has front matter), hash, and known
    (names a platform)."""
    text = F.when(F.coalesce(content, F.lit("")) != "", canonical(content)).otherwise(F.lit(""))
    found = F.when(text != "", rejection_reasons(text, allow_oversized=_low(registry) == MIRROR)).otherwise(F.array().cast("array<string>"))
    names = F.concat_ws(" ", *[strip(F.coalesce(c, F.lit(""))) for c in (name, description)])
    return {
        "text": text,
        "found": found,
        "front": has_front_matter(text),
        "hash": F.when(text != "", content_hash(text)).otherwise(F.lit("")),
        "known": F.size(platforms(names)) > 0,
    }


def evaluated(rows: DataFrame) -> DataFrame:
    """Records with the columns of ``evaluation``. Each content is read once: canonical text, then what it says, then the rest."""
    c = F.col
    text = F.when(F.coalesce("content", F.lit("")) != "", canonical(c("content"))).otherwise(F.lit(""))
    rows = rows.withColumn("_text", text)
    parts = content_parts(c("_text"), c("name"), c("description"), c("registry"))
    rows = rows.select("*", *[value.alias(f"_{name}") for name, value in parts.items() if name != "text"])
    read = {name: c(f"_{name}") for name in parts}
    found = evaluation(*(c(x) for x in ("content", "name", "description", "source", "registry", "package", "closure", "truncated")), read)
    return rows.select("*", *[value.alias(name) for name, value in found.items()]).drop(*[f"_{name}" for name in parts])


def evaluation(
    content: Column, name: Column, description: Column, source: Column, registry: Column, package: Column, closure: Column, truncated: Column, read: dict[str, Column] | None = None
) -> dict[str, Column]:
    """quality_status, quality_reasons (sorted), quality_score (0 to 100), content_hash and category of a record.

    read: what ``content_parts`` gives, where it is columns already: as expressions it is worked out for each use.
    """
    read = read or content_parts(content, name, description, registry)
    text, found, front = read["text"], read["found"], read["front"]
    name, description = (strip(F.coalesce(c, F.lit(""))) for c in (name, description))
    source, mirrored = F.coalesce(source, F.lit("")), _low(registry) == MIRROR
    filled = text != ""
    good = filled & (F.size(found) == 0)
    metadata = ~filled & source.isin(METADATA_SOURCES) & (name != "") & (F.length(description) >= LONG_DESCRIPTION)
    packaged = filled & ~mirrored & source.isin(PACKAGE_SOURCES)
    whole = F.when(mirrored, F.coalesce(_low(package, "complete") == "complete", F.lit(True))).otherwise(_low(package, "missing") == "complete")
    closed = F.when(mirrored, _low(closure, "complete").isin("complete", "resolved")).otherwise(_low(closure, "missing") == "complete")
    flags = {
        "missing-name": name == "",
        "missing-description": description == "",
        "entrypoint-truncated": mirrored & F.coalesce(truncated, F.lit(False)),
        "package-incomplete": ((filled & mirrored) | packaged) & ~whole,
        "dependency-closure-incomplete": ((filled & mirrored) | packaged) & ~closed,
        "missing-skill-frontmatter": good & ~front,
        "metadata-only": metadata,
        "missing-content": ~filled & ~metadata,
    }
    own = F.array_compact(F.array(*[F.when(hit, F.lit(label)) for label, hit in flags.items()]))
    reasons = F.sort_array(F.array_distinct(F.concat(own, found)))
    points = F.when(name != "", NAME_POINTS).otherwise(0)
    points += F.when(F.length(description) >= LONG_DESCRIPTION, LONG_DESCRIPTION_POINTS).when(description != "", DESCRIPTION_POINTS).otherwise(0)
    useless = F.array_contains(found, "html-response") | F.array_contains(found, "path-or-link-only")
    points += F.when(good, CONTENT_POINTS).when(filled & useless, USELESS_POINTS).otherwise(0)
    oversized = F.array_contains(found, "content-too-large")
    points += F.when(filled & ~oversized & (F.length(text) > LONG_CONTENT), LONG_CONTENT_POINTS).otherwise(0)
    points += F.when(text.contains("##"), HEADING_POINTS).otherwise(0) + F.when(metadata, METADATA_POINTS).otherwise(0)
    unfit = filled & (~good | F.arrays_overlap(own, F.array(*[F.lit(r) for r in UNFIT])))
    status = F.when(unfit | (~filled & ~metadata), "rejected").when((filled & ~front) | metadata, "metadata_only").otherwise("active")
    return {
        "quality_status": status,
        "quality_reasons": reasons,
        "quality_score": F.greatest(F.lit(0), F.least(F.lit(100), points)),
        "content_hash": read["hash"],
        "category": F.when(read["known"], "integration").otherwise("capability"),
    }
