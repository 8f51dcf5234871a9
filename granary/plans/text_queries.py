"""Queries on text, safety and URLs: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety, text, urls
from ..operators.dedupe import first_by_key
from ..operators.set_join import near_matches
from .tables import table

_STRIP = r"'^\s+|\s+$', '', 'g'"


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _tokens_sql(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
        f"lambda t: length(t) > 2 and t not in ({_sql_list(text.NAME_STOPWORDS)}))))"
    )


def _singular_sql(t: str) -> str:
    return (
        f"case when {t} like '%ies' and length({t}) > 4 then left({t}, length({t}) - 3) || 'y' "
        f"when {t} like '%s' and {t} not like '%ss' and length({t}) > 3 then left({t}, length({t}) - 1) else {t} end"
    )


def index_terms_sql(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
        f"lambda t: length(t) >= 3), lambda t: {_singular_sql('t')})))"
    )


def _canonical_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^' || chr(65279), ''), '\r\n?', chr(10), 'g')"


def normalised_sql(x: str) -> str:
    stripped = f"regexp_replace({_canonical_sql(x)}, {_STRIP})"
    undated = rf"regexp_replace({stripped}, '(?im)^(updated_at|version|date):\s*.+$', '', 'g')"
    return rf"lower(regexp_replace(regexp_replace({undated}, '\s+', ' ', 'g'), {_STRIP}))"


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.content_hash(c).alias("content_hash"),
        text.content_digest(c).alias("digest"),
        text.draft_hash(c).alias("draft_hash"),
        F.sha1(F.encode(c, "UTF-8")).alias("text_sha1"),
        text.blob_sha(c).alias("blob_sha"),
    )


CONTENT_HASHES = rf"""
select doc_id, case when {normalised_sql("text")} = '' then '' else sha256({normalised_sql("text")}) end as content_hash,
       sha256(text) as digest,
       sha256(regexp_replace(lower(regexp_replace(text, {_STRIP})), '\s+', ' ', 'g')) as draft_hash,
       sha1(text) as text_sha1,
       sha1(encode('blob ' || octet_length(encode(text))) || '\x00'::blob || encode(text)) as blob_sha
from documents
"""


def token_measures(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.token_estimate(c).alias("token_estimate"),
        text.length_band(c).alias("band"),
        F.size(text.tokens(c)).alias("n_tokens"),
        F.size(text.index_terms(c)).alias("n_terms"),
        text.slug(F.substring_index(c, "\n", 1)).alias("slug"),
    )


TOKEN_MEASURES = f"""
select doc_id, case when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 4.0))::bigint end as token_estimate,
       case when length(text) < 80 then 'short' when length(text) < 400 then 'medium' else 'long' end as band,
       len({_tokens_sql("text")}) as n_tokens, len({index_terms_sql("text")}) as n_terms,
       regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug
from documents
"""


def risk_scan(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "documents").select("doc_id", safety.risk_flags(F.col("text")).alias("f"))
    return flags.select("doc_id", F.array_join("f", ",").alias("flags"), safety.risk_score(F.col("f")).alias("score"))


def _hits_sql(labelled) -> str:
    cases = ", ".join(f"case when regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') then '{label}' end" for label, p, *_ in labelled)
    return f"array_to_string(list_filter([{cases}], lambda x: x is not null), ',')"


_WEIGHTS = " + ".join(f"case when regexp_matches(text, '{p}') then {w} else 0 end" for _, p, w in safety.RISKS)
RISK_SCAN = f"select doc_id, {_hits_sql(safety.RISKS)} as flags, {_WEIGHTS} as score from documents"


def capability_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(safety.capability_flags(F.col("text")), ",").alias("flags"))


CAPABILITY_FLAGS = f"select doc_id, {_hits_sql(safety.CAPABILITIES)} as flags from documents"


def redact_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", "text", safety.redacted_lines(c).alias("n"))
    return rows.select(
        "doc_id",
        F.col("n.credentials").alias("n_credentials"),
        F.col("n.controls").alias("n_controls"),
        F.sha2(safety.redacted(c), 256).alias("redacted_sha256"),
        safety.destructive_actions(c).alias("destructive"),
        safety.external_actions(c).alias("external"),
        safety.non_portable(c).alias("non_portable"),
    )


_KIND = f"case when regexp_matches(s, '{safety.CREDENTIAL_LINE}') then 1 when regexp_matches(s, '{safety.CONTROL_LINE}') then 2 else 0 end"
REDACT_LINES = f"""
with lines as (
  select doc_id, list_transform(string_split(text, chr(10)), lambda s: {{'s': s, 'k': {_KIND}}}) as ls from documents
), masked as (
  select *, array_to_string(list_transform(ls, lambda x: case x.k when 1 then '{safety.CREDENTIAL_MARK}' when 2 then '{safety.CONTROL_MARK}' else x.s end), chr(10)) as m
  from lines
), rooted as (select *, regexp_extract_all(m, '{safety.PROJECT_PATH}', 1) as roots from masked)
select doc_id, len(list_filter(ls, lambda x: x.k = 1)) as n_credentials, len(list_filter(ls, lambda x: x.k = 2)) as n_controls, sha256(m) as redacted_sha256,
       len(list_filter(ls, lambda x: x.k = 0 and regexp_matches(x.s, '{safety.DESTRUCTIVE}'))) > 0 as destructive,
       len(list_filter(ls, lambda x: x.k = 0 and regexp_matches(x.s, '{safety.EXTERNAL}'))) > 0 as external,
       coalesce(list_max(list_transform(roots, lambda r: len(list_filter(roots, lambda x: x = r)))), 0) >= {safety.SAME_ROOT}
         or regexp_matches(m, '{safety.SANDBOX_PATH}') as non_portable
from rooted
"""


def non_task_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", text.is_non_task(F.col("text")).alias("non_task"))


_META = " or ".join(f"contains(lower(t), '{p}')" for p in text.META_PHRASES)
NON_TASK_PROMPTS = rf"""
select conv_id, turn, t = '' or t like '/%' or t like '!%' or length(t) > 3000 or lower(t) in ({_sql_list(text.ACKNOWLEDGEMENTS)})
       or (length(t) < 180 and ({_META})) as non_task
from (select conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), {_STRIP}) as t
      from conversations where role = 'user')
"""


def platform_mentions(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), "source").alias("text"))
    return both.select("doc_id", F.array_join(text.platforms(F.col("text")), ",").alias("platforms"))


def _platforms_sql(x: str) -> str:
    cases = []
    for name, aliases in sorted(text.PLATFORM_ALIASES.items()):
        hits = " or ".join(
            "regexp_matches(lower({}), '(^|[^a-z0-9]){}{}')".format(x, a.replace(".", r"\."), "" if a.endswith("-") else "([^a-z0-9]|$)") for a in aliases
        )
        cases.append(f"case when {hits} then '{name}' end")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x is not null), ',')"


PLATFORM_MENTIONS = f"select doc_id, {_platforms_sql('text || chr(32) || source')} as platforms from documents"


def page_rejections(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    rows = pages.unionByName(docs)
    return rows.select("kind", "id", F.array_join(safety.rejection_reasons(F.col("text")), ",").alias("reasons"))


_PATH_LINE = r"""regexp_replace(s, '^[`''"]+|[`''"]+$', '', 'g')"""


def rejections_sql(rows: str) -> str:
    """CTEs that end in ``rejections`` (kind, id, found: list of reasons) of ``rows``, a query giving kind, id, text and large."""
    return rf"""
rows as ({rows}), flat as (
  select *, regexp_replace(text, {_STRIP}) as f, lower(left(regexp_replace(text, '^\s+', ''), 300)) as head from rows
), bodies as (
  select *, regexp_replace(regexp_replace(f, '\r\n?', chr(10), 'g'), '(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)', '') as body,
         list_filter(list_transform(string_split(f, chr(10)), lambda s: regexp_replace(s, {_STRIP})), lambda s: s <> '') as ls
  from flat
), shares as (
  select *, case when len(ls) = 0 then 0 else len(list_filter(ls, lambda s: {_PATH_LINE} <> '' and (
      regexp_matches({_PATH_LINE}, '^([a-zA-Z]:[\\/]|https?://|file://|\.\.?/|~/|/)')
      or (length(regexp_replace({_PATH_LINE}, '[^/\\]', '', 'g')) >= 2 and len(regexp_extract_all({_PATH_LINE}, '\S+')) <= 3)))) / len(ls) end as share
  from bodies
), rejections as (
  select kind, id, case when length(text) > {safety.MOST_CHARS} and not large then ['content-too-large'] else list_filter([
    case when regexp_matches(head, '^(<!doctype|<html|<\?xml)') or contains(head, '<head>') or contains(head, 'githubassets.com') then 'html-response' end,
    case when length(f) < {safety.LEAST_CHARS} then 'too-short' end,
    case when share >= {safety.MOST_PATH_LINES} then 'path-or-link-only' end,
    case when len(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_-]+')) < {safety.LEAST_WORDS} then 'too-few-body-words' end,
    case when not (contains(body, '##') or regexp_matches(body, '(?m)^\s*[-*]\s+\S+') or regexp_matches(f, '(?m)^name:\s*\S+')) then 'no-skill-structure' end
  ], lambda x: x is not null) end as found
  from shares
)"""


_PAGES_AND_DOCUMENTS = "select 'page' as kind, page_id as id, html as text, false as large from pages union all select 'document', doc_id, text, false from documents"
PAGE_REJECTIONS = f"with {rejections_sql(_PAGES_AND_DOCUMENTS)} select kind, id, array_to_string(found, ',') as reasons from rejections"


def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.normalise_url(F.col("url")).alias("url"))


_URL = r"""
select page_id, case when u = '' then '' else 'https://' || case when code then 'github.com' else host end
  || regexp_replace(regexp_replace(case when not code then path when regexp_replace(path, '^/+|/+$', '', 'g') = '' then ''
       else '/' || array_to_string(list_transform(string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/'),
            lambda s, i: case when i <= 2 then lower(s) else s end), '/') end, '\.git$', ''), '/+$', '')
  || case when len(kept) = 0 then '' else '?' || array_to_string(kept, '&') end end as url
from (
  select *, host in ('github.com', 'www.github.com') as code,
         list_filter(string_split(query, '&'), lambda p: contains(p, '=') and p not like '%=' and not regexp_matches(string_split(p, '=')[1], '(?i)^(utm_\w+|ref|ref_src)$')) as kept
  from (
    select page_id, u, lower(regexp_extract(rest, '^([^/?]*)', 1)) as host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path, regexp_extract(rest, '\?(.*)$', 1) as query
    from (select page_id, u, regexp_replace(regexp_replace(u, '#.*$', ''), '^[a-z]+://', '') as rest
          from (select page_id, regexp_replace(regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g'), '^http://', 'https://') as u from pages))
  )
)
"""


def url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(
        urls.normalise_url(F.col("url")).alias("url"), (-F.col("page_id")).alias("newest_last"), F.length("html").alias("size"), "page_id"
    )
    return first_by_key(rows, "url", ["size", "newest_last"]).select("url", "page_id", "size")


URL_DEDUPE = f"""
select url, page_id, size from (
  select n.url, page_id, length(html) as size, row_number() over (partition by n.url order by length(html) desc, page_id) as place
  from pages join ({_URL}) n using (page_id)
) where place = 1 or url = ''
"""


def holdout_assignment(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":weekly"))
    return users.select("user_id", F.round(text.hash_share(key), 9).alias("share"), (text.hash_share(key) < 0.1).alias("holdout"))


HOLDOUT_ASSIGNMENT = """
select user_id, round(s, 9) as share, s < 0.1 as holdout
from (select distinct user_id, ('0x' || left(sha256('user:' || user_id || ':weekly'), 8))::bigint / 4294967295.0::double as s from events)
"""


def heldout_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", (text.hash_bucket(F.col("text"), 10) < 4).alias("heldout"))


HELDOUT_SPLIT = "select item_id, ('0x' || left(sha256(text), 8))::bigint % 10 < 4 as heldout from benchmark"

def draft_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document as a draft against all others: rejected where one of them is nearly the same."""
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    drafts = rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "draft_id")
    found = near_matches(drafts, rows.where("doc_id % 100 <> 0").withColumnRenamed("doc_id", "entry_id"))
    return found.withColumn("rejected", F.col("n_matches") > 0)


DRAFT_MATCHES = f"""
with sets as (select doc_id, {_tokens_sql("text")} as ts from documents),
pairs as (
  select a.doc_id as draft_id, b.doc_id as entry_id, len(list_intersect(a.ts, b.ts)) as k, len(a.ts) + len(b.ts) as n
  from sets a, sets b where a.doc_id % 100 = 0 and b.doc_id % 100 <> 0
), found as (select *, k::double / (n - k) as s from pairs where k > 0 and 100 * k >= 80 * (n - k)),
best as (select draft_id, count(*) as n_matches, arg_min(entry_id, (-s, entry_id)) as best_id, max(s) as s from found group by draft_id)
select doc_id as draft_id, coalesce(n_matches, 0) as n_matches, best_id, round(s, 6) as similarity, coalesce(n_matches, 0) > 0 as rejected
from documents left join best on draft_id = doc_id where doc_id % 100 = 0
"""

QUERIES = {
    "draft_matches": (draft_matches, DRAFT_MATCHES),
    "content_hashes": (content_hashes, CONTENT_HASHES),
    "token_measures": (token_measures, TOKEN_MEASURES),
    "risk_scan": (risk_scan, RISK_SCAN),
    "capability_flags": (capability_flags, CAPABILITY_FLAGS),
    "redact_lines": (redact_lines, REDACT_LINES),
    "non_task_prompts": (non_task_prompts, NON_TASK_PROMPTS),
    "platform_mentions": (platform_mentions, PLATFORM_MENTIONS),
    "page_rejections": (page_rejections, PAGE_REJECTIONS),
    "url_normalise": (url_normalise, _URL),
    "url_dedupe": (url_dedupe, URL_DEDUPE),
    "holdout_assignment": (holdout_assignment, HOLDOUT_ASSIGNMENT),
    "heldout_split": (heldout_split, HELDOUT_SPLIT),
}
