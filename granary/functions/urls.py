"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

TRACKING = r"(?i)^(utm_\w+|ref|ref_src)$"


def normalise_url(url: Column) -> Column:
    """One spelling of a URL: https, lower-case host, lower-case owner and repository on the code host, no ``.git``, no
    trailing slash, no tracking parameters, no parameters without a value, no fragment. Empty stays empty.
    """
    url = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "^http://", "https://")
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(bare, r"^[a-z]+://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    code_host = host.isin("github.com", "www.github.com")
    segments = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    lowered = F.transform(segments, lambda s, i: F.when(i < 2, F.lower(s)).otherwise(s))
    path = F.when(code_host, F.when(segments[0] == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(lowered, "/")))).otherwise(path)
    path = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), "/+$", "")
    kept = F.filter(
        F.split(query, "&"), lambda p: p.contains("=") & ~p.endswith("=") & ~F.substring_index(p, "=", 1).rlike(TRACKING)
    )
    query = F.array_join(kept, "&")
    full = F.concat(
        F.lit("https://"),
        F.when(code_host, F.lit("github.com")).otherwise(host),
        path,
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url == "", F.lit("")).otherwise(full)


def owner_and_repository(url: Column) -> Column:
    """``owner/repository`` of a code-host URL, or an empty string."""
    return F.lower(F.regexp_extract(url, r"github\.com/([^/]+/[^/#?]+)", 1))
