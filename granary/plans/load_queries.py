"""Queries that load packages and records: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import new_path
from ..sources import validated as V
from ..sources.package_store import PackageStore, activate_records
from .tables import table


def package_store(spark: SparkSession, d: str) -> DataFrame:
    """Each source is a package of its documents; some come again unchanged, as forks of another address."""
    docs = table(spark, d, "documents").selectExpr("coalesce(source, '') as source", "doc_id", "encode(coalesce(text, ''), 'UTF-8') as content")
    docs = docs.withColumn("package_hash", F.sha2(F.concat(F.lit("package "), "source"), 256))
    files = docs.select("package_hash", F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.sha2("content", 256).alias("sha256"), "content")
    packages = docs.groupBy("package_hash", "source").agg(F.concat(F.lit("docs/"), F.min("doc_id"), F.lit(".md")).alias("entrypoint"))
    packages = packages.withColumn("source_url", F.concat(F.lit("https://one.example/"), "source")).withColumn("commit", F.lit(None).cast("string"))
    forks = packages.where("source rlike '[13579]$'").withColumn("source_url", F.concat(F.lit("https://fork.example/"), "source"))
    store = PackageStore(spark, new_path(spark))
    store.put(packages, files)
    store.put(forks, files.join(forks, "package_hash", "left_semi"))
    own = store.table("files").groupBy("package_hash").agg(F.count("*").alias("n_files"), F.countDistinct("sha256").alias("n_contents"), F.sum("bytes").alias("bytes"))
    sources = store.table("sources").groupBy("package_hash").agg(F.count("*").alias("n_sources"), F.max("source_url").alias("last_source"))
    kept = store.table("objects").join(store.table("files").select("sha256", "package_hash").distinct(), "sha256").groupBy("package_hash")
    kept = kept.agg(F.sum(F.octet_length("content")).cast("long").alias("stored_bytes"))
    return store.table("packages").join(own, "package_hash").join(sources, "package_hash").join(kept, "package_hash")


PACKAGE_STORE = """
with docs as (select sha256('package ' || coalesce(source, '')) as package_hash, coalesce(source, '') as source, doc_id, coalesce(text, '') as t from documents),
forked as (select *, regexp_matches(source, '[13579]$') as again from docs)
select package_hash, 'docs/' || min(doc_id) || '.md' as entrypoint, count(*) as n_files, count(distinct t) as n_contents, sum(strlen(t))::bigint as bytes,
       case when any_value(again) then 2 else 1 end::bigint as n_sources,
       'https://one.example/' || any_value(source) as last_source,
       (select sum(strlen(u.t))::bigint from (select distinct t from forked g where g.package_hash = f.package_hash) u) as stored_bytes
from forked f group by package_hash
"""


def retrieval_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of all documents, then new ones of every third, some of which were known."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = docs.select("doc_id", F.sha2(F.concat("doc_id", F.lit(" "), "text"), 256).alias("record_hash"), "text")
    empty = first.withColumn("active", F.lit(False)).where("false")
    new = docs.where("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = new.select("doc_id", F.sha2(F.concat("doc_id", F.lit(" "), "text"), 256).alias("record_hash"), "text")
    out = activate_records(activate_records(empty, first), new)
    return out.select("doc_id", "record_hash", "active", F.octet_length("text").cast("long").alias("bytes"))


RETRIEVAL_RECORDS = """
with docs as (select doc_id, coalesce(text, '') as text from documents),
new as (select doc_id, case when doc_id % 2 = 0 then text || '!' else text end as text from docs where doc_id % 3 = 0)
select doc_id, sha256(doc_id || ' ' || text) as record_hash, doc_id % 3 > 0 as active, strlen(text)::bigint as bytes from docs
where doc_id % 3 > 0 or sha256(doc_id || ' ' || text) not in (select sha256(doc_id || ' ' || text) from new)
union all select doc_id, sha256(doc_id || ' ' || text), true, strlen(text)::bigint from new
"""

# Lines for the loader from documents: the fifteen faults by doc_id, and every sixteenth line in order. {text} and {hash}
# stand for JSON members of the content, which each engine writes itself.
_MEMBERS = {
    "name": "case doc_id % 16 when 2 then '' when 12 then concat('\"name\": \"', repeat('n', 501), '\",') else concat('\"name\": \"n', doc_id, '\",') end",
    "url": "concat('\"url\": \"', case doc_id % 16 when 3 then 'http://127.0.0.1:80/x' when 11 then 'https://twice.example/' when 15 then 'https://a:b@h.example/' else concat('https://h.example/', doc_id) end, '\",')",
    "status": "case doc_id % 16 when 4 then '\"quality_status\": \"rejected\",' else '\"quality_status\": \"active\",' end",
    "more": "case doc_id % 16 when 1 then '\"password\": 1,' when 6 then '\"risk_score\": 20000,' when 7 then '\"quality_score\": \"5\",' when 8 then '\"tags\": \"x\",' "
    "when 13 then '\"prominence_score\": true,' when 14 then concat('\"triggers\": [', repeat('1,', 100), '1],') else '\"risk_score\": -3, \"meaningfulness_score\": 0.5, \"tags\": [\"a\"],' end",
    "source": "concat('\"source\": \"', source, '\"')",
}
_LINE = "case when doc_id % 16 = 10 then '[1]' when doc_id % 16 = 9 then '{{\"name\": ' else concat('{{', " + ", ".join(_MEMBERS.values()) + ", {digest}, {content}, '}}') end"


def validated_load(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("doc_id", "coalesce(source, 'none') as source", "coalesce(text, '') as text")
    hash_ = "concat(', \"content_hash\": \"', sha2(case when doc_id % 16 = 5 then source else text end, 256), '\"')"
    content = "case when doc_id % 16 = 15 then '' else concat(',', regexp_replace(to_json(struct(text as content)), '^.|.$', '')) end"
    lines = docs.selectExpr("doc_id as line_id", _LINE.format(digest=hash_, content=content) + " as value")
    good, rejected = V.load_with_quarantine(lines, new_path(spark))
    return good.unionByName(rejected).select("line_id", "url", F.array_join("reasons", "|").alias("reasons"), F.octet_length(F.get_json_object("record", "$.content")).cast("long").alias("content_bytes"))


def _validated_sql() -> str:
    hash_ = "concat(', \"content_hash\": \"', sha256(case when doc_id % 16 = 5 then source else text end), '\"')"
    content = "case when doc_id % 16 = 15 then '' else concat(', \"content\": ', to_json(text)) end"

    def text(field: str) -> str:
        return f"json_extract_string(r, '$.{field}')"

    def kind(field: str) -> str:
        return f"coalesce(json_type(r, '$.{field}'), 'NULL')"

    fields = ", ".join(f"'{f}'" for f in V.FIELDS)
    rules = [f"case when len(list_filter(json_keys(r), lambda k: k not in ({fields}))) > 0 then 'forbidden fields' end"]
    for field, most in V.TEXTS.items():
        empty = f" or {kind(field)} = 'NULL' or trim({text(field)}) = ''" if field in V.REQUIRED else ""
        rules.append(f"case when {kind(field)} not in ('VARCHAR', 'NULL'){empty} then '{field} is no text' when length({text(field)}) > {most} then '{field} is too long' end")
    rules += [f"case when not regexp_matches({text(f)}, '^[a-f0-9]{{32,128}}$') then '{f} is no digest' end" for f in V.DIGESTS]
    host = f"regexp_replace(regexp_extract({text('url')}, '^https?://([^/?#]*)', 1), ':\\d*$', '')"
    rules.append(f"case when {host} = '' or contains({host}, '@') or regexp_matches({host}, '^(127\\.|10\\.|192\\.168\\.)') or {host} = 'localhost' then 'url is not public' end")
    rules.append(f"case when coalesce({text('quality_status')}, '') not in ('active', 'metadata_only') then 'status may not be shipped' end")
    rules += [f"case when {kind(f)} not in ('NULL', 'BIGINT', 'UBIGINT') or try_cast({text(f)} as bigint) not between -10000 and 10000 then '{f} is out of range' end" for f in V.WHOLE]
    rules += [f"case when {kind(f)} not in ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE') then '{f} is no number' end" for f in V.NUMBERS]
    rules += [f"case when {kind(f)} not in ('NULL', 'ARRAY') then '{f} is no list' when json_array_length(r, '$.{f}') > 100 then '{f} has too many entries' end" for f in V.LISTS]
    rules.append(f"case when coalesce({text('content')}, '') = '' then 'content is missing' when coalesce({text('content_hash')}, '') <> sha256({text('content')}) then 'content has another digest' end")
    return f"""
with docs as (select doc_id, coalesce(source, 'none') as source, coalesce(text, '') as text from documents),
lines as (select doc_id as line_id, {_LINE.format(digest=hash_, content=content)} as value from docs),
parsed as (select line_id, case when json_valid(value) and value like '{{%' then value::json end as r from lines),
judged as (select line_id, r, {text("url")} as url, case when r is null then ['not a JSON object'] else list_filter([{", ".join(rules)}], lambda x: x is not null) end as reasons from parsed),
firsts as (select url, min(line_id) as first from judged where len(reasons) = 0 group by url)
select line_id, url, case when len(reasons) = 0 and line_id > first then 'duplicate url' else array_to_string(reasons, '|') end as reasons, strlen({text("content")})::bigint as content_bytes
from judged left join firsts using (url)
"""


def source_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of each document's whole text and first line against what is there: changed, lost, listed only, or more."""
    docs = table(spark, d, "documents").selectExpr("doc_id as record_id", "coalesce(text, '') as text", "coalesce(lang, 'en') as lang")
    both = docs.selectExpr("record_id", "lang", "explode(array(struct('SKILL.md' as path, text as content), struct('first.md' as path, split_part(text, '\\n', 1) as content))) as f")
    both = both.selectExpr("record_id", "lang", "f.path", "f.content", "sha2(f.content, 256) as sha256", "octet_length(f.content) as bytes")
    case = F.col("record_id") % 7
    kept = both.where((case != 1) | (F.col("path") != "first.md"))
    kept = kept.withColumn("content", F.when(case == 2, F.concat("content", F.lit("!"))).when(case != 3, F.col("content")))
    kept = kept.withColumn("bytes", F.when((case == 4) & (F.col("path") == "SKILL.md"), F.col("bytes") + 1).otherwise(F.col("bytes")))
    more = both.where((case == 5) & (F.col("path") == "first.md")).withColumn("path", F.lit("more.md"))
    records = docs.select("record_id", F.lit("active").alias("status"), F.array("lang").alias("reasons"))
    out = V.source_integrity(records, both, kept.unionByName(more))
    return out.select("record_id", "status", F.array_join("reasons", "|").alias("reasons"), "complete")


SOURCE_INTEGRITY = """
select doc_id as record_id, case when doc_id % 7 in (0, 3, 6) then 'active' else 'metadata_only' end as status,
       case when doc_id % 7 in (0, 3, 6) then coalesce(lang, 'en') else array_to_string(list_sort([coalesce(lang, 'en'), 'source-files-incomplete']), '|') end as reasons,
       doc_id % 7 in (0, 3, 6) as complete
from documents
"""

QUERIES = {
    "package_store": (package_store, PACKAGE_STORE),
    "retrieval_records": (retrieval_records, RETRIEVAL_RECORDS),
    "validated_load": (validated_load, _validated_sql()),
    "source_integrity": (source_integrity, SOURCE_INTEGRITY),
}
