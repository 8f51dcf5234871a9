"""Queries on files of packages: name -> (query, SQL). Parts are the files, parts of one size a package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import package
from ..functions.front_matter import folded_tags, front_matter, items, scalar
from ..operators import packages
from .tables import table

PATHS = [
    "SKILL.md", "./docs//guide.MD", "scripts/run.py", "templates/a.j2", "schemas/x.schema.json", "conf/app.toml", "img/logo.PNG",
    "LICENSE", "README.rst", "../escape.md", "/etc/passwd", "a\\b\\c.sh", "data/references/list", "bin/tool", "", "x/./y/../z",
]
_PATH = "case p_partkey % 16 " + " ".join(f"when {k} then '{p}'" for k, p in enumerate(PATHS)) + " end"
_TEXT = (
    "case p_partkey % 5 when 0 then 'The MIT License' when 1 then 'APACHE LICENSE, Version 2.0' when 2 then 'GNU General Public License version 3' "
    "when 3 then 'Redistribution and use ... neither the name' else p_name end"
)
_AUDITS = "case p_partkey % 4 when 0 then 'Fail,pass' when 1 then 'pass,WARN' when 2 then 'pass' else 'skipped' end"


def package_files(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").selectExpr("p_partkey", f"{_PATH.replace(chr(92), chr(92) * 2)} as given", f"{_TEXT} as text", f"{_AUDITS} as audits")
    rows = parts.withColumn("path", package.safe_path(F.col("given")))
    return rows.select(
        "p_partkey",
        "path",
        package.file_role(F.col("path"), F.lit("SKILL.md")).alias("role"),
        package.license_id(F.col("text")).alias("license"),
        package.severity(F.split("audits", ",")).alias("severity"),
    )


_ROLES = " ".join(
    f"when regexp_matches(lower(path), '{ending}')" + (f" or contains('/' || lower(path), '{folder}')" if folder else "") + f" then '{role}'"
    for role, folder, ending in package.ROLES
)
PACKAGE_FILES = rf"""
with given as (
  select p_partkey, replace({_PATH}, '\', '/') as g, lower({_TEXT}) as t, list_transform(string_split({_AUDITS}, ','), lambda a: lower(a)) as audits from part
), split as (select *, list_filter(string_split(g, '/'), lambda p: p <> '' and p <> '.') as parts from given),
safe as (select *, case when g like '/%' or list_contains(parts, '..') or len(parts) = 0 then null else array_to_string(parts, '/') end as path from split)
select p_partkey, path,
       case when path is null then 'other' when path = 'SKILL.md' then 'entrypoint' when regexp_matches(lower(parts[-1]), '^(license|copying|notice)') then 'license'
            when lower(parts[-1]) like 'readme%' then 'readme' {_ROLES} else 'other' end as role,
       case when contains(t, 'mit license') then 'MIT' when contains(t, 'apache license') and contains(t, 'version 2') then 'Apache-2.0'
            when contains(t, 'gnu general public license') and contains(t, 'version 3') then 'GPL-3.0'
            when contains(t, 'bsd 3-clause') or (contains(t, 'redistribution and use') and contains(t, 'neither the name')) then 'BSD-3-Clause' end as license,
       case when list_contains(audits, 'fail') then 'fail' when list_contains(audits, 'warn') then 'warn' when list_contains(audits, 'pass') then 'pass' else 'unknown' end as severity
from safe
"""

# Parts of one size are a package and form a tree: file r names files 2r and 2r + 1, its parent, and things that are no files.
_PLACE = "case when {0} = 1 then 'SKILL.md' when {0} % 3 = 0 then concat('references/f', {0}, '.md') when {0} % 3 = 1 then concat('scripts/deep/f', {0}, '.py') else concat('f', {0}, '.md') end"
_UP = "case when r = 1 or r % 3 = 2 then '' when r % 3 = 0 then '../' else './../../' end"
_LINKED = (
    f"concat(p_name, ' [next](', {_UP}, {_PLACE.format('(2 * r)')}, case when r % 5 = 0 then '#top' else '?x=1' end, ') ![b](', {_UP}, {_PLACE.format('(2 * r + 1)')}, ' \"t\") "
    f"[up](', {_UP}, {_PLACE.format('(case when r < 2 then 1 else HALF end)')}, ') [out](../../../../o', r % 7, ') `scripts/gone', r % 11, '.sh` `lib/x.py` [w](http://a.b/c) [h](site.io/x) [e](#z) [p](${{q}}) [a](/abs)')"
)


def package_closure(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_size as package", "p_name", "row_number() over (partition by p_size order by p_partkey) as r")
    # every thirteenth file is binary
    text = f"case when r % 13 = 0 then null else {_LINKED.replace('HALF', 'r div 2')} end as text"
    files = rows.selectExpr("package", f"{_PLACE.format('r')} as path", text)
    return packages.package_closure(files, files.select("package").distinct().withColumn("path", F.lit("SKILL.md")))


_ENDINGS = ", ".join(f"'{e}'" for e in packages.HOST_ENDINGS)
_FOLD = """list_reduce(list_prepend('', string_split({}, '/')), lambda a, p: case when a = '!' or p = '' or p = '.' then a when p <> '..' then a || case when a = '' then '' else '/' end || p
       when a = '' then '!' else regexp_replace(a, '/?[^/]*$', '') end)"""
PACKAGE_CLOSURE = rf"""
with recursive parts as (select p_size as package, p_name, row_number() over (partition by p_size order by p_partkey) as r from part),
files as (select package, {_PLACE.format("r")} as path, case when r % 13 = 0 then null else {_LINKED.replace("HALF", "r // 2")} end as text from parts),
named as (
  select package, path, unnest(list_concat(regexp_extract_all(text, '!?\[[^\]]*\]\(([^)\s]+)(?:\s+[''"][^''"]*[''"])?\)', 1), regexp_extract_all(text, '(?i)`((?:\.{{1,2}}/)?(?:references|scripts|assets|templates|schemas)/[^`\s]+)`', 1))) as v
  from files
), bare as (
  select distinct package, path, regexp_replace(trim(v, ' <>"'''), '[#?].*$', '') as v from named
), kept as (
  select *, lower(regexp_extract(v, '^[^/:]*')) as host from bare where v <> '' and not regexp_matches(v, '(?i)^[a-z][a-z0-9+.-]*:') and not regexp_matches(v, '^(\$\{{|\*|\.\.\.)')
), folded as (
  select package, path, v, case when v like '/%' then '/' || {_FOLD.format("v")} else {_FOLD.format("regexp_replace(path, '[^/]*$', '') || v")} end as target
  from kept where host not like 'www.%' and regexp_extract(host, '\.([^.]*)$', 1) not in ({_ENDINGS})
), known as (select *, (package, target) in (select (package, path) from files) as is_file from folded where target <> ''),
seen(package, path) as (
  select distinct package, 'SKILL.md' from files
  union
  select k.package, k.target from seen s join known k on k.package = s.package and k.path = s.path and k.is_file
)
select package, path, 'reached' as state from seen
union all select package, path, 'unreached' from (select distinct package, path from files) f where not exists (select 1 from seen s where s.package = f.package and s.path = f.path)
union all select distinct k.package, target, 'missing' from known k join seen using (package, path) where not is_file and target <> '!'
union all select distinct k.package, v, 'outside' from known k join seen using (package, path) where target = '!'
"""

# Documents get front matter from their columns, in one of four spellings, which must come back as these columns.
_SPELLINGS = [
    """concat('---\\nname: n', doc_id, '\\ndescription: "', source, '"\\ntags: [', lang, ', "', source, '", ]\\nmetadata:\\n  author: "', lang, '"\\n  triggers:\\n    - when ', lang, '\\n    - "', upper(lang), '"\\n---\\n', text)""",
    """concat('---\\r\\nname: "n', doc_id, '"\\r\\ndescription: >-\\r\\n  ', source, '\\r\\n\\r\\n  more\\r\\ntags:\\r\\n- ', lang, '\\r\\n- ', source, '\\r\\nmetadata:\\r\\n  deep:\\r\\n    x: 1\\r\\n  author: ', lang, '\\r\\n  platforms: [', upper(source), ', p', doc_id, ']\\r\\n---\\r\\n', text)""",
    """concat('---  \\n# comment\\nname: first\\nname: n', doc_id, '\\n    orphan: 1\\ndescription:\\nmetadata:\\n\\n---\\n', text)""",
    "text",
]
_SPELLED = "case doc_id % 4 " + " ".join(f"when {k} then {c}" for k, c in enumerate(_SPELLINGS)) + " end as text"


def front_matter_fields(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fields")
    return front_matter(table(spark, d, "documents").selectExpr("doc_id", _SPELLED)).select(
        "doc_id",
        scalar(f, "$.name").alias("name"),
        scalar(f, "$.description").alias("description"),
        scalar(f, "$.metadata.author").alias("author"),
        scalar(f, "$.metadata.deep.x").alias("x"),
        F.array_join(items(f, "$.tags"), "|").alias("tags"),
        F.array_join(folded_tags(f), "|").alias("all_tags"),
        F.length("body").cast("long").alias("body_chars"),
    )


FRONT_MATTER_FIELDS = """
select doc_id, case when doc_id % 4 < 3 then 'n' || doc_id end as name,
       case doc_id % 4 when 0 then source when 1 then source || ' more' end as description,
       case when doc_id % 4 < 2 then lang end as author, case when doc_id % 4 = 1 then '1' end as x,
       case when doc_id % 4 < 2 then lang || '|' || source else '' end as tags,
       case doc_id % 4 when 0 then lang || '|' || source || '|when ' || lang when 1 then lang || '|' || source || '|p' || doc_id else '' end as all_tags,
       length(text)::bigint as body_chars
from documents
"""

QUERIES = {
    "package_files": (package_files, PACKAGE_FILES),
    "package_closure": (package_closure, PACKAGE_CLOSURE),
    "front_matter_fields": (front_matter_fields, FRONT_MATTER_FIELDS),
}
