"""Column functions on the files of a package: safe paths, roles, licenses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role, folder that makes it, beginnings or endings of the name that do, in order of precedence.
ROLES = [
    ("reference", "/references/", r"\.(md|mdx|rst)$"),
    ("script", "/scripts/", r"\.(py|js|ts|sh|ps1|rb)$"),
    ("template", "/templates/", r"\.(j2|jinja|tmpl|template)$"),
    ("schema", "/schemas/", r"(\.schema\.json|\.xsd)$"),
    ("config", None, r"\.(json|yaml|yml|toml|ini|cfg)$"),
    ("asset", None, r"\.(png|jpg|jpeg|gif|webp|svg|pdf|mp3|wav)$"),
]


def safe_path(value: Column) -> Column:
    """The path with single slashes and no ``.`` parts; null if it is empty, absolute or leads upwards."""
    path = F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    unsafe = path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~unsafe, F.array_join(parts, "/"))


def file_role(path: Column, entrypoint: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    out = F.when(path == entrypoint, "entrypoint").when(name.rlike("^(license|copying|notice)"), "license").when(name.startswith("readme"), "readme")
    for role, folder, ending in ROLES:
        hit = low.rlike(ending)
        out = out.when(hit | F.concat(F.lit("/"), low).contains(folder) if folder else hit, role)
    return out.otherwise("other")


def license_id(text: Column) -> Column:
    """The SPDX identifier that the text of a license file names; null for others."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("mit license"), "MIT")
        .when(low.contains("apache license") & low.contains("version 2"), "Apache-2.0")
        .when(low.contains("gnu general public license") & low.contains("version 3"), "GPL-3.0")
        .when(low.contains("bsd 3-clause") | (low.contains("redistribution and use") & low.contains("neither the name")), "BSD-3-Clause")
    )


def severity(values: Column) -> Column:
    """The gravest of audit results: fail, warn, pass, and unknown for none of them."""
    low = F.transform(values, F.lower)
    out = None
    for name in ("fail", "warn", "pass"):
        hit = F.array_contains(low, name)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")
