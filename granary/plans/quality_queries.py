"""Queries on catalogue records: name -> (query, SQL). Documents and labels stand in for the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import record, text
from ..operators.common import cut, sized
from ..operators.dedupe import CANONICAL, metadata_key, three_stage_dedupe
from ..operators.retrieval import lexical_topk
from .retrieval_queries import CORPUS, _lexical_sql
from .tables import corpus, prompts, table
from .text_queries import _STRIP, _canonical_sql, _platforms_sql, _sql_list, _tokens_sql, normalised_sql, rejections_sql

_RECORDS = """
select d.doc_id,
       case when d.doc_id % 7 = 0 then '' else substring(text, 1, 12) end as name,
       case d.doc_id % 5 when 0 then '' when 1 then substring(text, 1, 20) else substring(text, 1, 60) end as description,
       case d.doc_id % 9 when 0 then 'github' when 1 then 'github_skill_file' when 2 then 'npm' when 3 then 'mcp_official_registry'
         when 4 then 'skillsmp' when 5 then 'official blog' when 6 then 'gitlab' when 7 then 'my github skill list' else 'other' end as source,
       case when d.doc_id % 11 = 0 then 'skills_sh' else '' end as registry,
       case when d.doc_id % 22 = 0 then 'Well-known ' end as source_type,
       case d.doc_id % 3 when 0 then 'complete' when 1 then 'Partial' end as package,
       case d.doc_id % 4 when 0 then 'complete' when 1 then 'Resolved' when 2 then 'missing' end as closure,
       d.doc_id % 50 = 0 as truncated, d.doc_id % 37 = 0 as verified,
       case when d.doc_id % 13 = 0 then 'many' when d.doc_id % 13 = 1 then null else cast(n_chars % 300 - 20 as string) end as stars,
       case when l.quality is not null then l.quality * 1.5 - 0.25 end as evaluated,
       case when d.doc_id % 2 = 0 then l.toxic * 1.0 end as feedback,
       case when d.doc_id % 6 = 0 then null
            when d.doc_id % 6 in (1, 2) then concat('---', chr(10), 'name: n', cast(d.doc_id as string), chr(10), 'description: about it', chr(10), '---', chr(10), '## Use', chr(10), text)
            when d.doc_id % 6 = 3 then concat('- ', text) else text end as content
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """documents as catalogue records with the gaps that catalogues have."""
    return spark.sql(_RECORDS, documents=table(spark, d, "documents"), labels=table(spark, d, "labels"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = records(spark, d)
    rows = cut(record.evaluated(rows).drop("content"))
    trust = record.provenance(c("source"), c("registry"), c("source_type"), c("verified"))
    proof = record.evidence(c("evaluated"), c("feedback"))
    rows = rows.withColumn("provenance", trust).withColumn("prominence", record.prominence(record.stars(c("stars")))).withColumn("evidence", proof)
    rows = rows.withColumn("meaningfulness", record.meaningfulness(c("quality_score"), c("provenance"), c("prominence"), c("evidence")))
    stated = F.when(c("stars").isNotNull(), record.stars(c("stars")))
    rows = rows.withColumn("trusted", record.trusted(c("quality_score"), c("provenance"), stated, c("evidence")))
    ready = record.readiness(
        c("quality_status"), c("source"), c("registry"), c("truncated"), c("content_hash") != "", c("package"), c("closure"), c("name"), c("description")
    )
    return rows.withColumn("readiness", ready)


def record_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d)
    return rows.select(
        "doc_id",
        "quality_status",
        F.array_join("quality_reasons", ",").alias("reasons"),
        F.col("quality_score").cast("long").alias("quality_score"),
        "category",
        "readiness",
    )


def record_meaning(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d)
    rounded = [F.round(n, 6).alias(n) for n in ("provenance", "prominence", "evidence")]
    return rows.select("doc_id", *rounded, "meaningfulness", "trusted")


_STARS = "greatest(0, coalesce(try_cast(stars as int), 0))"
_KNOWN = " ".join(f"when s = '{k}' then {v}" for k, v in record.PROVENANCE.items())
JUDGED = f"""
with records as ({_RECORDS.format(documents="documents", labels="labels")}),
{rejections_sql("select 'record' as kind, doc_id as id, " + _canonical_sql("content") + " as text, registry = 'skills_sh' as large from records where content <> ''")},
base as (
  select r.*, coalesce(t.text, '') as t, coalesce(x.found, []) as found, regexp_replace(name, {_STRIP}) as n, regexp_replace(description, {_STRIP}) as dd,
         t.text is not null as filled, registry = 'skills_sh' as mirrored, lower(regexp_replace(r.source, {_STRIP})) as s, source in ({_sql_list(record.PACKAGE_SOURCES)}) as needs,
         regexp_extract(coalesce(t.text, ''), '(?s)\\A---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|\\z)', 1) as block
  from records r left join rows t on t.id = r.doc_id left join rejections x on x.id = r.doc_id
), more as (
  select *, filled and len(found) = 0 as good, regexp_matches(block, '(?m)^name:\\s*\\S+') and regexp_matches(block, '(?m)^description:\\s*(\\S+|[>|])') as front,
         not filled and source in ({_sql_list(record.METADATA_SOURCES)}) and n <> '' and length(dd) >= 40 as metadata,
         case when mirrored then coalesce(lower(package), 'complete') = 'complete' else coalesce(lower(package), '') = 'complete' end as whole,
         case when mirrored then coalesce(lower(closure), 'complete') in ('complete', 'resolved') else coalesce(lower(closure), '') = 'complete' end as closed
  from base
), marked as (
  select *, list_filter([case when n = '' then 'missing-name' end, case when dd = '' then 'missing-description' end,
      case when mirrored and truncated then 'entrypoint-truncated' end,
      case when filled and (mirrored or needs) and not whole then 'package-incomplete' end,
      case when filled and (mirrored or needs) and not closed then 'dependency-closure-incomplete' end,
      case when good and not front then 'missing-skill-frontmatter' end, case when metadata then 'metadata-only' end,
      case when not filled and not metadata then 'missing-content' end], lambda v: v is not null) as own
  from more
), judged as (
  select *, list_sort(list_distinct(list_concat(own, found))) as reasons,
    case when (filled and (not good or list_has_any(own, [{_sql_list(record.UNFIT)}]))) or (not filled and not metadata) then 'rejected'
         when (filled and not front) or metadata then 'metadata_only' else 'active' end as quality_status,
    greatest(0, least(100, case when n <> '' then 10 else 0 end + case when length(dd) >= 40 then 20 when dd <> '' then 8 else 0 end
      + case when good then 45 when filled and list_has_any(found, ['html-response', 'path-or-link-only']) then -20 else 0 end
      + case when filled and not list_contains(found, 'content-too-large') and length(t) > 800 then 10 else 0 end
      + case when contains(t, '##') then 5 else 0 end + case when metadata then 15 else 0 end))::bigint as quality_score,
    case when {_platforms_sql("n || chr(32) || dd")} <> '' then 'integration' else 'capability' end as category,
    filled and {normalised_sql("t")} <> '' as has_content,
    case when verified then 1.0 when mirrored or s = 'skills_sh' then case when lower(regexp_replace(coalesce(source_type, ''), {_STRIP})) = 'well-known' then 0.60 else 0.45 end
         {_KNOWN} when contains(s, 'official') or contains(s, 'verified') then 0.9 when contains(s, 'github') and contains(s, 'skill') then 0.55
         when contains(s, 'git') then 0.45 else 0.25 end::double as provenance,
    case when {_STARS} <= 0 then 0.0 else least(1.0, ln(1 + {_STARS}::double) / ln(100001.0::double)) end as prominence,
    coalesce(0.7::double * greatest(0.0, least(1.0, evaluated::double)) + 0.3::double * greatest(0.0, least(1.0, feedback::double)),
             greatest(0.0, least(1.0, evaluated::double)), greatest(0.0, least(1.0, feedback::double)), 0.5)::double as evidence
  from marked
), evidenced as (
  select * exclude (evidence), case when evaluated is null and feedback is null then 0.5 when evaluated is null then greatest(0.0, least(1.0, feedback::double))
    when feedback is null then greatest(0.0, least(1.0, evaluated::double)) else evidence end::double as evidence
  from judged
), meant as (
  select *, round(0.55::double * quality_score / 100.0::double + 0.2::double * provenance + 0.15::double * prominence + 0.1::double * evidence, 6) as meaningfulness
  from evidenced
)"""
RECORD_QUALITY = f"""{JUDGED}
select doc_id, quality_status, array_to_string(reasons, ',') as reasons, quality_score, category,
       case when quality_status = 'rejected' or truncated then 'rejected'
            when quality_status = 'active' and has_content and (not (needs or mirrored) or (coalesce(lower(package), '') = 'complete'
                 and (coalesce(lower(closure), '') = 'complete' or (mirrored and lower(closure) = 'resolved')))) then 'full-ready'
            when quality_status = 'metadata_only' and n <> '' and dd <> '' then 'hint-ready'
            when quality_status in ('active', 'metadata_only') and (has_content or dd <> '') then 'hint-ready' else 'catalog-ready' end as readiness
from meant
"""
RECORD_MEANING = f"""{JUDGED}
select doc_id, round(provenance, 6) as provenance, round(prominence, 6) as prominence, round(evidence, 6) as evidence, meaningfulness,
       provenance >= 0.55 or {_STARS} >= 10 or evidence >= 0.8 or (stars is null and quality_score >= 85) as trusted
from meant
"""

#: Candidates of each prompt: the depth of the lexical lane.
_DEPTH = 60


def _result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each prompt with what collapses them; every fourth document has a neighbour's name and description."""
    found = cut(lexical_topk(prompts(spark, d), table(spark, d, "documents"), _DEPTH))
    docs = corpus(spark, d).join(sized(found.select("doc_id").distinct()), "doc_id", "left_semi")
    name = F.when(F.col("doc_id") % 4 == 0, F.lit("Shared  Name")).otherwise(F.substring("text", 1, 30))
    description = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Used for "), "source")).otherwise(F.substring("text", 31, 90))
    docs = docs.select("doc_id", "content_hash", *CANONICAL, name.alias("name"), description.alias("description"), "source")
    platform = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("slack"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("jira"))).otherwise(F.array().cast("array<string>"))
    rows = found.join(docs.withColumn("platforms", platform), "doc_id")
    both = F.concat_ws(" ", "name", "description")
    return rows.select(
        "query_id",
        "doc_id",
        "position",
        "content_hash",
        *CANONICAL,
        metadata_key(F.col("name"), F.col("description")).alias("metadata_key"),
        "platforms",
        text.tokens(both).alias("tokens"),
        text.tokens(F.col("name")).alias("name_tokens"),
        text.tokens(F.col("description")).alias("description_tokens"),
    )


def result_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return three_stage_dedupe(_result_rows(spark, d), CANONICAL)


_NAME = "case when doc_id % 4 = 0 then 'Shared  Name' else substring(text, 1, 30) end"
_DESCRIPTION = "case when doc_id % 4 = 0 then 'Used for ' || source else substring(text, 31, 90) end"


def _flat(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, {_STRIP}), '\s+', ' ', 'g'))"


def _stage_sql(source: str, key: str) -> str:
    own = f"case when {key} = '' then 'id' || doc_id else 'key' || {key} end"
    return f"""select * exclude (position, place, least_position), least_position as position from (
    select *, row_number() over (partition by query_id, {own} order by meaningfulness desc, quality desc, provenance desc, prominence desc, recency desc, doc_id desc) as place,
           min(position) over (partition by query_id, {own}) as least_position
    from {source}
  ) where place = 1"""


RESULT_DEDUPE = f"""
with recursive {_lexical_sql(_DEPTH)}, {CORPUS},
named as (
  select query_id, doc_id, position, content_hash, meaningfulness, quality, provenance, prominence, recency, {_NAME} as name, {_DESCRIPTION} as description,
         case doc_id % 3 when 0 then ['slack'] when 1 then ['jira'] else [] end as platforms
  from lexical join corpus using (doc_id)
), marked as (
  select *, case when {_flat("name")} = '' or {_flat("description")} = '' then '' else {_flat("name")} || chr(31) || {_flat("description")} end as metadata_key,
         {_tokens_sql("name || chr(32) || description")} as tokens, {_tokens_sql("name")} as nt, {_tokens_sql("description")} as dt
  from named
), by_content as ({_stage_sql("marked", "content_hash")}), by_metadata as ({_stage_sql("by_content", "metadata_key")}),
ordered as (select *, row_number() over (partition by query_id order by position) as place from by_metadata),
met as materialized (
  select b.query_id, a.place as first, b.place, len(list_intersect(a.tokens, b.tokens)) as t, len(list_intersect(a.nt, b.nt)) as n,
         len(list_intersect(a.dt, b.dt)) as d, len(a.tokens) + len(b.tokens) as ts, len(a.dt) + len(b.dt) as ds
  from ordered a join ordered b on a.query_id = b.query_id and a.place < b.place
  where not (len(a.platforms) > 0 and len(b.platforms) > 0 and len(list_intersect(a.platforms, b.platforms)) = 0)
), near as (
  select query_id, place, list(first) as near from met
  where t / greatest(1, ts - t) >= 0.8 or (n >= 2 and d / greatest(1, ds - d) >= 0.5)
  group by all
), steps as materialized (select o.query_id, o.place, coalesce(n.near, []) as near from ordered o left join near n using (query_id, place)),
walk as (
  select distinct query_id, 0::bigint as place, []::bigint[] as leaders, 0::bigint as leader from ordered
  union all
  select w.query_id, s.place, case when len(list_intersect(w.leaders, s.near)) = 0 then list_append(w.leaders, s.place) else w.leaders end,
         coalesce(list_min(list_intersect(w.leaders, s.near)), s.place)
  from walk w join steps s on s.query_id = w.query_id and s.place = w.place + 1
), grouped as (select o.*, w.leader from ordered o join walk w using (query_id, place))
select query_id, arg_max(doc_id, (meaningfulness, quality, provenance, prominence, recency, doc_id)) as doc_id, min(place) as position, count(*) as duplicate_group_size
from grouped group by query_id, leader
"""

QUERIES = {
    "result_dedupe": (result_dedupe, RESULT_DEDUPE),
    "record_quality": (record_quality, RECORD_QUALITY),
    "record_meaning": (record_meaning, RECORD_MEANING),
}
