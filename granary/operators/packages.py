"""Packages of files: references between files, and what an entry point reaches through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Links of markdown, paths in backticks, and the ends of host names that are no file names.
LINK = r"""!?\[[^\]]*\]\(([^)\s]+)(?:\s+['"][^'"]*['"])?\)"""
QUOTED_PATH = r"(?i)`((?:\.{1,2}/)?(?:references|scripts|assets|templates|schemas)/[^`\s]+)`"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
HOST_ENDINGS = ["app", "ai", "biz", "co", "com", "dev", "edu", "gov", "io", "me", "net", "org", "sh", "site", "tech", "tv", "uk", "us", "xyz"]


def references(text: Column) -> Column:
    """Distinct relative references that a text names, as written: no anchors, queries, addresses, hosts or placeholders."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), F.regexp_extract_all(text, F.lit(QUOTED_PATH), F.lit(1)))
    bare = F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(v, r"^[ <>\"']+|[ <>\"']+$", ""), r"(?s)[#?].*$", ""))

    def is_local(v: Column) -> Column:
        host = F.lower(F.regexp_extract(v, "^[^/:]*", 0))
        ending = F.regexp_extract(host, r"\.([^.]*)$", 1)
        outside = host.startswith("www.") | ending.isin(HOST_ENDINGS)
        return (v != "") & ~v.rlike(SCHEME) & ~outside & ~v.rlike(r"^(\$\{|\*|\.\.\.)")

    return F.array_distinct(F.filter(bare, is_local))


def resolved(path: Column, reference: Column) -> Column:
    """The package path that a reference in the file at ``path`` leads to, null where it leaves the package, "" where it is
    the root. An absolute reference keeps its slash, so it is no file of a package.
    """
    folder = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    parts = F.when(reference.startswith("/"), F.split(reference, "/")).otherwise(F.concat(folder, F.split(reference, "/")))
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("at"), F.lit(False).alias("outside"))

    def step(state: Column, part: Column) -> Column:
        at = state["at"]
        up = F.struct(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))).alias("at"), (F.size(at) == 0).alias("outside"))
        down = F.struct(F.concat(at, F.array(part)).alias("at"), F.lit(False).alias("outside"))
        return F.when(state["outside"] | (part == "") | (part == "."), state).when(part == "..", up).otherwise(down)

    end = F.aggregate(parts, start, step)
    joined = F.array_join(end["at"], "/")
    return F.when(~end["outside"], F.when(reference.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined))


def package_links(files: DataFrame) -> DataFrame:
    """(package, source, reference, target, kind) of files (package, path, text): kind is file, missing or outside.

    Binary files, whose text is null, name nothing.
    """
    named = files.select("package", F.col("path").alias("source"), F.explode(references(F.col("text"))).alias("reference"))
    named = named.withColumn("target", resolved(F.col("source"), F.col("reference"))).where("target is null or target <> ''")
    paths = files.select("package", F.col("path").alias("target"), F.lit(True).alias("known")).distinct()
    kind = F.when(F.col("target").isNull(), "outside").when(F.col("known"), "file").otherwise("missing")
    return named.join(paths, ["package", "target"], "left").select("package", "source", "reference", "target", kind.alias("kind"))


def package_closure(files: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(package, path, state): what an entry point (package, path) reaches, and what it does not.

    state: reached (by the entry point or a reference of a reached file), unreached (a file that nothing reached names),
    missing (named by a reached file, but no file), outside (the same, leading out of the package; path as written).
    Each round joins the files reached last with the links; rounds end when nothing is new, so cycles are no special case
    and there are as many rounds as the longest chain of links has files.
    """
    links = written(package_links(files))
    inner = links.where("kind = 'file'").select("package", F.col("source").alias("path"), "target").distinct()
    frontier = written(entrypoints.select("package", "path").distinct())
    rounds = [frontier]
    while True:
        seen = reduce(DataFrame.unionByName, rounds)
        found = frontier.join(inner, ["package", "path"]).select("package", F.col("target").alias("path")).distinct()
        frontier = written(found.join(seen, ["package", "path"], "left_anti"))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    reached = seen.withColumn("state", F.lit("reached"))
    own = links.join(seen.withColumnRenamed("path", "source"), ["package", "source"])
    missing = own.where("kind = 'missing'").select("package", F.col("target").alias("path")).distinct()
    outside = own.where("kind = 'outside'").select("package", F.col("reference").alias("path")).distinct()
    unreached = files.select("package", "path").distinct().join(seen, ["package", "path"], "left_anti")
    out = reached
    for rows, state in ((unreached, "unreached"), (missing, "missing"), (outside, "outside")):
        out = out.unionByName(rows.withColumn("state", F.lit(state)))
    return out
