"""Queries on tables, sections of documents and streams: name -> (query, SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety, text, urls
from ..functions.text import content_digest
from ..operators.common import shared_folder
from ..operators import sections as sections_operators
from ..operators.sections import capsules, sections
from ..sources import store
from ..streaming import state
from ..streaming.streams import deduplicated_events, run_available, windowed_counts
from .tables import table
from .text_queries import _KIND, _STRIP, _canonical_sql, _tokens_sql


def catalog_browse(spark: SparkSession, d: str) -> DataFrame:
    """Page two of the parts whose name mentions a word, by price, then key."""
    rows = table(spark, d, "part").where(F.lower("p_name").contains("red"))
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return store.scan(rows, ["p_partkey", "p_name", "p_retailprice"], {"p_size": "gt.10", "p_type": "not.in.(SMALL,LARGE)"}, order, 20, 20)


CATALOG = """
select p_partkey, p_name, p_retailprice from part where contains(lower(p_name), 'red') and p_size > 10 and p_type not in ('SMALL', 'LARGE')
order by p_retailprice desc, p_partkey limit 20 offset 20
"""


def _before(spark: SparkSession, d: str) -> DataFrame:
    """An older state of documents: every seventh row is missing, every fifth had another text."""
    docs = table(spark, d, "documents").where("doc_id % 7 <> 0")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    return docs.select("doc_id", content_digest(old).alias("digest"), F.col("source"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", content_digest(F.col("text")).alias("digest"), "source")


_STATES = """
before as (select doc_id, sha256(case when doc_id % 5 = 0 then text || ' old' else text end) as digest, source from documents where doc_id % 7 <> 0),
now_rows as (select doc_id, sha256(text) as digest, source from documents)"""


def delta_plan(spark: SparkSession, d: str) -> DataFrame:
    return store.delta_plan(_before(spark, d), _now(spark, d), "doc_id", ["digest", "source"])


DELTA = f"""
with {_STATES}
select n.doc_id, case when b.doc_id is null then 'insert' when b.digest is not distinct from n.digest and b.source is not distinct from n.source then 'unchanged' else 'update' end as status
from now_rows n left join before b using (doc_id)
"""


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    incoming = _now(spark, d).where("doc_id % 3 <> 1").drop("source")
    return store.upsert(_before(spark, d), incoming, "doc_id")


UPSERT = f"""
with {_STATES}
select coalesce(b.doc_id, n.doc_id) as doc_id, case when n.doc_id is not null then n.digest else b.digest end as digest, b.source
from before b full join (select * from now_rows where doc_id % 3 <> 1) n using (doc_id)
"""


def change_alerts(spark: SparkSession, d: str) -> DataFrame:
    watches = _before(spark, d).select("doc_id", F.col("digest").alias("last_seen"))
    return store.change_alerts(watches, _now(spark, d), "doc_id", "digest").select("doc_id", "digest")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return store.orphans(_now(spark, d), _before(spark, d), "doc_id").select("doc_id")


def routing_filter(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    kept = store.routing_filter(table(spark, d, "documents"), "doc_id", labels.where("toxic = 1"), labels.where("quality = 1"))
    return kept.select("doc_id", "source")


def version_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _before(spark, d).withColumn("seen", F.lit(1)).unionByName(_now(spark, d).withColumn("seen", F.lit(2)))
    return store.versions(rows, "doc_id", "digest", "seen")


def pack_blobs(spark: SparkSession, d: str) -> DataFrame:
    return store.pack_blobs(table(spark, d, "documents"), "doc_id", "text")


def audit_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Documents by what an audit of the stored index finds: missing, mismatch, short, empty or fine."""
    rows = table(spark, d, "documents").select("doc_id", "text", content_digest(F.col("text")).alias("now")).join(
        _before(spark, d).select("doc_id", "digest"), "doc_id", "left"
    )
    n = F.length("text")
    bucket = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("now"), "mismatch").when(n == 0, "empty").when(n < 180, "short").otherwise("fine")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


AUDIT = f"""
with {_STATES}
select case when b.doc_id is null then 'missing' when b.digest <> sha256(text) then 'mismatch' when length(text) = 0 then 'empty' when length(text) < 180 then 'short' else 'fine' end as bucket,
       count(*) as n
from documents left join before b using (doc_id) group by all
"""


def package_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per order (a package) its lines (files): complete if all are there, sized, and numbered without a gap."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("files"),
        F.max("l_linenumber").alias("last"),
        F.bool_and(F.col("l_quantity") > 0).alias("sized"),
        F.countDistinct("l_partkey").alias("parts"),
    )
    out = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = F.when(F.col("files").isNull(), "missing").when(~F.col("sized") | (F.col("parts") < F.col("files")), "doubtful").otherwise("complete")
    return out.groupBy("o_orderstatus", state.alias("state")).agg(F.count("*").alias("packages"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


PACKAGES = """
select o_orderstatus, case when files is null then 'missing' when not sized or parts < files then 'doubtful' else 'complete' end as state,
       count(*) as packages, coalesce(sum(files), 0)::bigint as files
from orders left join (select l_orderkey, count(*) as files, bool_and(l_quantity > 0) as sized, count(distinct l_partkey) as parts from lineitem group by l_orderkey) on l_orderkey = o_orderkey
group by all
"""


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of texts with nested, repeated and empty ones, and with marks that are no headings."""
    n = F.col("doc_id")
    led = (
        F.when(n % 4 == 0, F.concat(F.lit("# One\n"), "text", F.lit("\n### Deep \n\n## One\nagain #not\n####### seven")))
        .when(n % 4 == 1, F.concat("text", F.lit("\n#nospace\n## Last")))
        .when(n % 4 == 2, F.concat(F.lit("\n\n## Only\t\n"), "text"))
        .otherwise(F.concat(F.lit("intro\r\n## Usage\r\n"), "text", F.lit("\n## Notes\nend")))
    )
    return sections(table(spark, d, "documents").select("doc_id", led.alias("text")))


SECTIONS = rf"""
with led as (
  select doc_id, case doc_id % 4
    when 0 then '# One' || chr(10) || text || chr(10) || '### Deep ' || chr(10) || chr(10) || '## One' || chr(10) || 'again #not' || chr(10) || '####### seven'
    when 1 then text || chr(10) || '#nospace' || chr(10) || '## Last' when 2 then chr(10) || chr(10) || '## Only' || chr(9) || chr(10) || text
    else 'intro' || chr(13) || chr(10) || '## Usage' || chr(13) || chr(10) || text || chr(10) || '## Notes' || chr(10) || 'end' end as t
  from documents
), lines as (
  select doc_id, unnest(string_split(c, chr(10))) as line, generate_subscripts(string_split(c, chr(10)), 1) as i
  from (select doc_id, {_canonical_sql("t")} as c from led)
), numbered as (
  select *, sum(case when regexp_matches(line, '^#{{1,6}}[ 	]') then 1 else 0 end) over (partition by doc_id order by i) as place from lines
), parts as (
  select doc_id, place::bigint as place, case when place = 0 then '' else regexp_replace(regexp_extract(first(line order by i), '^#{{1,6}}[ 	]+(.*)$', 1), {_STRIP}) end as heading,
         regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (place = 0 or not regexp_matches(line, '^#{{1,6}}[ 	]')), ''), {_STRIP}) as body
  from numbered group by doc_id, place
)
select * from parts where place > 0 or body <> ''
"""


def document_capsules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("intro\n## Usage\n"), "text", F.lit("\n## Notes\nend")).alias("text"))
    return capsules(docs, 400)


CAPSULES = rf"""
with masked as (
  select doc_id, {_canonical_sql("array_to_string(list_transform(string_split(text, chr(10)), lambda s: case " + _KIND + " when 1 then '" + safety.CREDENTIAL_MARK + "' when 2 then '" + safety.CONTROL_MARK + "' else s end), chr(10))")} as m
  from documents
), bodies as (select doc_id, regexp_replace(m, {_STRIP}) as body, chr(10) || chr(10) as gap from masked),
first as (
  select *, case when body <> '' and length('intro' || gap || '## Usage' || chr(10) || body) <= 400 then 'intro' || gap || '## Usage' || chr(10) || body else 'intro' end as c
  from bodies
), second as (select *, case when length(c || gap || '## Notes' || chr(10) || 'end') <= 400 then c || gap || '## Notes' || chr(10) || 'end' else c end as capsule from first)
select doc_id, capsule, (1 + case when c <> 'intro' then 1 else 0 end + case when capsule <> c then 1 else 0 end)::int as n_sections from second
"""


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = run_available(spark, d, "events", lambda s: windowed_counts(s, "6 hours", "1 hour"), complete=True)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


WINDOWS = """
select time_bucket(interval 6 hours, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all
"""


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = run_available(spark, d, "events", lambda s: deduplicated_events(s.unionByName(s), "1 hour"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def update_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    return store.update(rows, F.col("lang") == "en", {"source": F.lit("changed"), "lang": F.upper("lang")})


def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "toxic")
    return store.delete(rows, F.col("toxic") == 0)


def delta_export(spark: SparkSession, d: str) -> DataFrame:
    """A delta written as gzipped JSON lines and read back with its schema."""
    path = f"{shared_folder(spark)}/delta-{uuid.uuid4().hex}"
    store.export_delta(_now(spark, d), path)
    return store.read_json_cases(spark, path, "doc_id long, digest string, source string")


def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    led = F.concat(F.lit("---\nname: x\n---\n# Title ![badge](http://a/b.svg) see [the page](http://a/b) <b>"), "text", F.lit("</b>"))
    return table(spark, d, "documents").select("doc_id", text.clean_markdown(led).alias("clean"))


_PROSE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_canonical_sql("led")}, '(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)', ''),
  '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g')"""
CLEAN_MARKDOWN = rf"""
select doc_id, regexp_replace(regexp_replace({_PROSE}, '\s+', ' ', 'g'), {_STRIP}) as clean
from (select doc_id, '---' || chr(10) || 'name: x' || chr(10) || '---' || chr(10) || '# Title ![badge](http://a/b.svg) see [the page](http://a/b) <b>'
             || text || '</b>' as led from documents)
"""


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the tokens of each document and the next one."""
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("own"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("own").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", F.round(text.jaccard(F.col("own"), F.col("next")), 9).alias("similarity"))


TOKEN_OVERLAP = f"""
with docs as (select doc_id, {_tokens_sql("text")} as own from documents)
select a.doc_id, round(len(list_intersect(a.own, b.own)) / greatest(1, len(list_distinct(list_concat(a.own, b.own)))), 9) as similarity
from docs a join docs b on b.doc_id = a.doc_id + 1
"""


def repositories(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://github.com/Own-er/Repo"), F.col("page_id"), F.lit("/blob/main/a.md"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.owner_and_repository(at).alias("repository"))


REPOSITORIES = r"""
select page_id, lower(regexp_extract(case when page_id % 3 = 0 then 'https://github.com/Own-er/Repo' || page_id || '/blob/main/a.md' else url end,
  'github\.com/([^/]+/[^/#?]+)', 1)) as repository from pages
"""


def survey_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups stand for answers; prompts up to an hour before the newest event are final."""

    def asked(events: DataFrame) -> DataFrame:
        return state.survey_prompts(events.withColumn("answered", F.col("event_type") == "signup"))

    return run_available(spark, d, "events", asked).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Events before the watermark of an hour, in milliseconds.
_PASSED = "epoch_us(ts) // 1000 < (select max(epoch_us(ts)) // 1000 from events) - 3600000"
SURVEY_CADENCE = f"""
with recursive seen as (
  select user_id, ts, epoch_us(ts) as t, event_type = 'signup' as answered, row_number() over (partition by user_id order by ts, event_id) as place from events
  where {_PASSED}
), walk as (
  select distinct user_id, 0::bigint as place, 0::bigint as n, null::bigint as last, false as due, null::timestamp as ts from seen
  union all
  select w.user_id, s.place, case when s.answered then 0 else w.n + 1 end,
         case when s.answered then null when w.n + 1 >= 12 and (w.last is null or s.t - w.last >= 86400000000) then s.t else w.last end,
         not s.answered and w.n + 1 >= 12 and (w.last is null or s.t - w.last >= 86400000000), s.ts
  from walk w join seen s on s.user_id = w.user_id and s.place = w.place + 1
)
select user_id, ts from walk where due
"""


def session_state(spark: SparkSession, d: str) -> DataFrame:
    """Events of one type are a session of their user, and the items they name its activations."""

    def activated(events: DataFrame) -> DataFrame:
        return state.bounded_sessions(events.withColumn("session", F.col("event_type")).withColumn("name", F.get_json_object("props", "$.k")))

    return run_available(spark, d, "events", activated).withColumn("names", F.array_join("names", "|"))


SESSION_STATE = f"""
with seen as (
  select user_id, event_id, epoch_us(ts) as t, event_type as session, json_extract_string(props, '$.k') as name from events where {_PASSED}
), cut as (
  select *, case when t - lag(t) over (partition by user_id, session order by t, event_id) <= 86400000000 then 0 else 1 end as first from seen
), numbered as (select *, sum(first) over (partition by user_id, session order by t, event_id rows unbounded preceding) as part from cut),
listed as (
  select *, list_reverse(list(name) over (partition by user_id, session, part order by t, event_id rows unbounded preceding)) as back,
         list({{'s': session, 't': t}}) over (partition by user_id order by t, event_id rows unbounded preceding) as all_of
  from numbered
)
select user_id, event_id, session,
       array_to_string(list_reverse(list_filter(back, lambda n, i: list_position(back, n) = i)[1:12]), '|') as names,
       len(list_distinct(list_transform(list_filter(all_of, lambda x: listed.t - x.t <= 86400000000), lambda x: x.s)))::bigint as live
from listed
"""


def stale_visits(spark: SparkSession, d: str) -> DataFrame:
    """A purchase ends what any other event of its user began."""

    def runs(events: DataFrame) -> DataFrame:
        return state.stale_runs(events.withColumn("finished", F.col("event_type") == "purchase"), "user_id")

    out = run_available(spark, d, "events", runs)
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "stale")])


STALE_VISITS = f"""
with recursive seen as (
  select user_id, epoch_us(ts) as t, event_type = 'purchase' as finished, row_number() over (partition by user_id order by ts, event_id) as place from events where {_PASSED}
), walk as (
  select distinct user_id, 0::bigint as place, null::bigint as started, null::bigint as lost from seen
  union all
  select w.user_id, s.place, case when s.finished then null when w.started is null or s.t - w.started > 7200000000 then s.t else w.started end,
         case when s.t - w.started > 7200000000 then w.started end
  from walk w join seen s on s.user_id = w.user_id and s.place = w.place + 1
), ended as (
  select user_id, lost from walk where lost is not null
  union all
  select user_id, started from walk where started is not null and ((select max(epoch_us(ts)) // 1000 from events) - 3600000) * 1000 - 1 - started > 7200000000
  qualify row_number() over (partition by user_id order by place desc) = 1 and place = (select max(s.place) from seen s where s.user_id = walk.user_id)
)
select user_id, make_timestamp(lost) as started, make_timestamp(lost + 7200000000) as stale from ended
"""

#: Characters of the samples of the query, few enough that sections are cut.
_SAMPLE = 400
_SECTIONED = "concat('Opening of ', source, ' <b>by</b> [us](http://x/y).\\n# Background\\n', replace(text, '#', ''), '\\n## When to use it\\nFor ', lang, case when doc_id % 3 = 0 then concat('\\n', replace(text, '#', '')) else '' end, '\\n### Closing notes\\n', replace(text, '#', ''))"


def embedding_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_SECTIONED} as text")
    return sections_operators.embedding_samples(docs, _SAMPLE)


def _sampled(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '<[^>]{{1,200}}>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\s+', ' ', 'g'))"


def _sample_sql() -> str:
    """The three budgets step by step for three sections, of which the second has priority."""
    flat = r"regexp_replace(replace(text, '#', ''), '^\s+|\s+$', '', 'g')"
    out = f"""
select doc_id, {_sampled("'Opening of ' || source || ' <b>by</b> [us](http://x/y).'")} as h, {_sampled(f"'Background. ' || {flat}")} as c0,
       {_sampled(f"'When to use it. ' || trim('For ' || lang || case when doc_id % 3 = 0 then chr(10) || {flat} else '' end)")} as c1,
       {_sampled(f"'Closing notes. ' || {flat}")} as c2
from documents"""
    out = f"select *, rtrim(left(h, 120)) as head, {_SAMPLE} - length(rtrim(left(h, 120))) as l from ({out})"
    out = f"select *, least(l, 80) as kept, l - least(l, 80) as w0 from ({out})"
    for k, name in enumerate(["c1", "c0", "c2"]):
        out = f"select *, case when w{k} > 0 then rtrim(left({name}, w{k})) else '' end as a{k} from ({out})"
        out = f"select *, w{k} - length(a{k}) as w{k + 1} from ({out})"
    out = f"select *, w3 + kept as w4 from ({out})"
    out = f"select *, case when a2 = '' and w4 > 0 then rtrim(left(trim(right(c2, least(w4, length(c2))::bigint)), w4)) else '' end as a3 from ({out})"
    out = f"select *, w4 - length(a3) as w5 from ({out})"
    out = f"select *, case when a1 = '' and w5 > 0 then rtrim(left(c0, w5)) else '' end as a4 from ({out})"
    out = f"select *, w5 - length(a4) as w6 from ({out})"
    out = f"select *, case when a0 = '' and w6 > 0 then rtrim(left(c1, w6)) else '' end as a5 from ({out})"
    parts = "array_to_string(list_filter([head, a0, a1, a2, a3, a4, a5], lambda a: a <> ''), ' ')"
    return rf"select doc_id, left(trim(regexp_replace({parts}, '\s+', ' ', 'g')), {_SAMPLE}) as sample from ({out})"


QUERIES = {
    "embedding_samples": (embedding_samples, _sample_sql()),
    "update_rows": (update_rows, "select doc_id, case when lang = 'en' then 'changed' else source end as source, case when lang = 'en' then 'EN' else lang end as lang from documents"),
    "delete_rows": (delete_rows, "select doc_id, toxic from documents left join labels using (doc_id) where toxic is distinct from 0"),
    "delta_export": (delta_export, "select doc_id, sha256(text) as digest, source from documents"),
    "clean_markdown": (clean_markdown, CLEAN_MARKDOWN),
    "token_overlap": (token_overlap, TOKEN_OVERLAP),
    "repositories": (repositories, REPOSITORIES),
    "survey_cadence": (survey_cadence, SURVEY_CADENCE),
    "session_state": (session_state, SESSION_STATE),
    "stale_visits": (stale_visits, STALE_VISITS),
    "catalog_browse": (catalog_browse, CATALOG),
    "delta_plan": (delta_plan, DELTA),
    "upsert_documents": (upsert_documents, UPSERT),
    "change_alerts": (change_alerts, f"with {_STATES} select n.doc_id, n.digest from before b join now_rows n using (doc_id) where b.digest <> n.digest"),
    "orphans": (orphans, "select doc_id from documents where doc_id % 7 = 0"),
    "routing_filter": (
        routing_filter,
        "select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1) and doc_id in (select doc_id from labels where quality = 1)",
    ),
    "version_history": (
        version_history,
        f"with {_STATES} select doc_id, digest, min(seen) as first_seen from (select doc_id, digest, 1 as seen from before union all select doc_id, digest, 2 from now_rows) group by all",
    ),
    "pack_blobs": (
        pack_blobs,
        "select sha256(text) as digest, count(*) as n_keys, min(doc_id) as first_key, max(octet_length(encode(text)))::bigint as bytes from documents group by all",
    ),
    "audit_buckets": (audit_buckets, AUDIT),
    "package_audit": (package_audit, PACKAGES),
    "document_sections": (document_sections, SECTIONS),
    "document_capsules": (document_capsules, CAPSULES),
    "stream_window_counts": (stream_window_counts, WINDOWS),
    "stream_dedupe": (stream_dedupe, "select event_id, ts, user_id, event_type, value from events"),
}
