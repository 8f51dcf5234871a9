"""Queries on task contracts and retrieval records: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract as C
from ..functions import retrieval_record as RR
from ..functions import text
from ..operators.common import cut, sized, top_per_group
from ..operators.retrieval import lexical_topk
from .intent_queries import TASKS
from .retrieval_queries import _lexical_sql
from .tables import prompts, table
from .text_queries import _STRIP, _sql_list

#: What clients ask for with a task, what candidates are called, and the curated policies.
REQUESTS = ["", " Research ", "cooking", None, ""]
NAMES = ["house-rules", "Slack notifier", "auto-integration", "Debug helper", "postgres tuning", "pasta", "House-Rules "]
POLICY_NAMES, POLICY_SOURCES = ["house-rules"], ["curated.example/rules"]


def _case(column: str, values: list) -> str:
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"case {column} % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(quoted)) + " end"


_CANDIDATE = {
    "name": _case("doc_id", NAMES),
    "category": "case when doc_id % 10 = 3 then 'policy' when doc_id % 10 = 4 then 'integration' else lang end",
    "platforms": "case when doc_id % 7 = 1 then array('slack') when doc_id % 11 = 5 then array('jira', 'acme') end",
    "url": "case when doc_id % 2 = 0 then 'https://Curated.example/Rules/x' else 'https://other.example' end",
    "status": "case when doc_id % 8 < 6 then 'active' end",
    "quality": "doc_id % 3 * 35",
    "risk": "case when doc_id % 5 = 4 then 1 else 0 end",
}


def task_contract(spark: SparkSession, d: str) -> DataFrame:
    """Each prompt's family and action, what its candidates are, which may serve it, and which takes the policy slot."""
    asked = prompts(spark, d).select("query_id", F.concat(F.element_at(F.array(*map(F.lit, TASKS)), (F.col("query_id") % len(TASKS) + 1).cast("int")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("query"), F.expr(_case("query_id", REQUESTS)).alias("requested"))
    asked = asked.withColumn("tokens", C.task_tokens(F.col("query")))
    asked = cut(asked.withColumn("task", C.task_analysis(F.col("query"), F.col("tokens"), F.col("requested"))).select("query_id", "query", "tokens", "task.*"))
    found = cut(lexical_topk(prompts(spark, d), table(spark, d, "documents"), 20, most=None)).select("query_id", "doc_id", "position")
    docs = table(spark, d, "documents").join(sized(found.select("doc_id").distinct()), "doc_id", "left_semi")
    docs = docs.selectExpr("doc_id", "text as description", "sha2(text, 256) as content_hash", *[f"{x} as {n}" for n, x in _CANDIDATE.items()])
    c = F.col
    docs = cut(docs.withColumn("kind", C.candidate_kind(c("name"), c("description"), c("category"), c("platforms"), POLICY_NAMES)).drop("description"))
    rows = found.join(docs, "doc_id").join(asked, "query_id")
    rows = rows.withColumn("allowed", C.serves(c("query"), c("tokens"), c("kind"), c("name"), c("platforms")))
    fits = C.may_be_policy(*(c(x) for x in ("family", "kind", "name", "url", "status", "quality", "risk", "content_hash")), POLICY_NAMES, POLICY_SOURCES)
    rows = cut(rows.withColumn("fits", fits))
    slot = top_per_group(rows.where("fits"), ["query_id"], [c("position").asc()], 1).select("query_id", "doc_id", F.lit(True).alias("policy_slot"))
    out = rows.join(slot, ["query_id", "doc_id"], "left")
    return out.select("query_id", "doc_id", "family", "action", "signal", "kind", "allowed", F.coalesce("policy_slot", F.lit(False)).alias("policy_slot"))


def _has(text_: str, aliases: list[str]) -> str:
    return " or ".join("regexp_matches({}, '(^|[^a-z0-9]){}{}')".format(text_, a.replace(".", r"\."), "" if a.endswith("-") else "([^a-z0-9]|$)") for a in aliases)


_NAMED = " or ".join(f"(list_contains(platforms, '{p}') and ({_has('low', a)}))" for p, a in text.PLATFORM_ALIASES.items())
_BOTH = " or ".join(f"(({_has('lower(name)', a)}) and ({_has('low', a)}))" for a in text.PLATFORM_ALIASES.values())


def _hits(tokens: str, words: list[str]) -> str:
    return f"list_has_any({tokens}, [{_sql_list(words)}])"


def _parts(x: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in parts) + ")"


TASK_CONTRACT = f"""
with {_lexical_sql(20, None)}, asked as (
  select item_id as query_id, {_case("item_id", TASKS)} || chr(10) || coalesce(text, '') as query, lower(trim(coalesce({_case("item_id", REQUESTS)}, ''))) as requested from benchmark
), spelled as (select *, lower(query) as low, regexp_extract_all(query, '{C.TASK_TOKEN}') as ts from asked),
tasks as (
  select *, case when requested in ({_sql_list(C.FAMILIES)}) then [requested, 'client-task-family'] when {_hits("ts", C.DATA)} and not {_hits("ts", C.STRONG_CODING)} then ['data', 'data-artifact']
      when {_hits("ts", C.CODING)} or {_parts("low", C.CODE_ENDINGS)} then ['coding', 'coding-language-or-artifact'] when {_hits("ts", C.RESEARCH)} then ['research', 'research-intent']
      when {_hits("ts", C.DOCUMENTS)} then ['documents', 'document-artifact'] else ['general', null] end as f,
    case {" ".join(f"when {_hits('ts', m)} then '{a}'" for a, m in C.ACTIONS.items())} else 'work' end as action
  from spelled
), candidates as (select doc_id, text as description, {", ".join(f"{x} as {n}" for n, x in _CANDIDATE.items()).replace("array(", "list_value(")} from documents),
kinds as (
  select *, case when lower(trim(name)) in ({_sql_list(POLICY_NAMES)}) or category = 'policy' or {_parts("lower(trim(name)) || ' ' || lower(description)", C.POLICY_MARKERS)} then 'policy'
      when category = 'integration' or len(platforms) > 0 or contains(lower(name), 'integration') then 'integration'
      when {_parts("lower(trim(name)) || ' ' || lower(description)", C.WORKFLOW_MARKERS)} then 'workflow' else 'specialist' end as kind
  from candidates
), rows as (select *, l.position as place from lexical l join kinds using (doc_id) join tasks using (query_id)),
judged as (
  select *, case kind when 'policy' then false when 'integration' then case when len(platforms) > 0 then {_NAMED} or (list_contains(platforms, 'acme') and regexp_matches(low, '(^|[^a-z0-9])acme([^a-z0-9]|$)'))
      else {_hits("ts", C.INTEGRATION_REQUESTS)} or {_BOTH} end else true end as allowed,
    f[1] = 'coding' and kind = 'policy' and lower(trim(name)) in ({_sql_list(POLICY_NAMES)}) and {_parts("lower(url)", POLICY_SOURCES)} and coalesce(status, 'active') = 'active' and quality >= 70 and risk = 0 as fits
  from rows
)
select query_id, doc_id, f[1] as family, action, f[2] as signal, kind, allowed,
       fits and place = min(place) filter (fits) over (partition by query_id) as policy_slot
from judged
"""

# Documents as skills: a package for most, and contents with front matter and a code fence. {text} is the document's text.
_RECORD_COLUMNS = {
    "name": "concat(' ', split_part(text, '\\n', 1))",
    "description": "case when doc_id % 4 = 0 then null else source end",
    "tags": "case when doc_id % 3 = 0 then null else array(lang, source) end",
    "summary": "case when doc_id % 5 = 0 then concat('Does ', lang) end",
    "content": "concat('---\\nname: x\\n---\\n![b](u) [see](v) <i>it</i>\\n```py\\n', replace(text, '`', ''), '\\n```\\n> *after* #1 ', replace(text, '`', ''))",
    "package_hash": "case when doc_id % 6 > 0 then sha2(source, 256) end",
    "entrypoint": "case when doc_id % 7 > 0 then 'SKILL.md' end",
}


def retrieval_record(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").selectExpr("doc_id", *[f"{x} as {n}" for n, x in _RECORD_COLUMNS.items()])
    c = F.col
    record = RR.retrieval_record(*(c(x) for x in ("name", "description", "tags", "summary", "content", "package_hash", "entrypoint")))
    flat = RR.retrieval_text(c("name"), c("description"), c("content")).alias("flat_text")
    return rows.select("doc_id", record.alias("r"), flat).select("doc_id", "r.*", "flat_text")


def _record_sql() -> str:
    columns = ", ".join(f"{x} as {n}" for n, x in _RECORD_COLUMNS.items())
    columns = columns.replace("'\\n'", "chr(10)").replace("\\n", "' || chr(10) || '").replace("array(", "list_value(").replace("sha2(source, 256)", "sha256(source)")
    front = r"regexp_replace(content, '\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|\z)', ' ')"
    body = rf"regexp_replace(regexp_replace(regexp_replace({front}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '<[^>]{{1,300}}>', ' ', 'g')"
    body = rf"trim(regexp_replace(regexp_replace({body}, '```[^\n]*\n([^`]{{0,300}})[^`]*```', ' \1 ', 'g'), '\s+', ' ', 'g'))"
    flat = rf"trim(regexp_replace(translate({front}, '`*_>#', '     '), '\s+', ' ', 'g'))"
    return rf"""
with skills as (select doc_id, {columns} from documents where text is not null),
parts as (
  select *, [regexp_replace(coalesce(name, ''), {_STRIP}), regexp_replace(coalesce(description, ''), {_STRIP}), coalesce(array_to_string(tags, ' '), ''), coalesce(summary, ''), {body}] as ps, {flat} as flat from skills
), texts as (
  select *, rtrim(left(trim(regexp_replace(array_to_string(list_filter(ps, lambda p: p <> ''), '. '), '\s+', ' ', 'g')), {RR.MOST_CHARS})) as t from parts
)
select doc_id, t as text, sha256(t) as text_hash,
       sha256('{{"entrypoint":' || coalesce('"' || entrypoint || '"', 'null') || ',"package_hash":' || coalesce('"' || package_hash || '"', 'null') || ',"text_hash":"' || sha256(t) || '","version":"{RR.VERSION}"}}') as record_hash,
       left(regexp_replace(array_to_string(list_filter([coalesce(name, ''), coalesce(description, ''), flat], lambda p: p <> ''), ' '), {_STRIP}), {RR.MOST_CHARS}) as flat_text
from texts
"""


def embedding_parity(spark: SparkSession, d: str) -> DataFrame:
    """Stored text hashes of every row, of which some are old, some are missing, and some rows have no text."""
    docs = table(spark, d, "documents")
    stored = F.when(F.col("doc_id") % 9 == 0, F.sha1(F.encode("source", "UTF-8"))).when(F.col("doc_id") % 11 > 0, F.sha1(F.encode("text", "UTF-8")))
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 > 0, F.col("text")).alias("text"), stored.alias("stored"), "lang")
    return RR.embedding_parity(rows, "lang")


EMBEDDING_PARITY = """
with rows as (
  select lang, doc_id, case when doc_id % 13 > 0 then text end as t, case when doc_id % 9 = 0 then sha1(source) when doc_id % 11 > 0 then sha1(text) end as stored from documents
), judged as (select *, case when coalesce(t, '') = '' or coalesce(stored, '') = '' then 'missing' when sha1(t) = stored then 'matched' else 'mismatched' end as j from rows)
select lang, count(*) as total, count(*) filter (j = 'matched') as matched, count(*) filter (j = 'mismatched') as mismatched, count(*) filter (j = 'missing') as missing,
       count(*) filter (j = 'matched') = count(*) as parity, min(doc_id) filter (j = 'mismatched') as first_mismatch
from judged group by lang
"""

QUERIES = {
    "task_contract": (task_contract, TASK_CONTRACT),
    "retrieval_record": (retrieval_record, _record_sql()),
    "embedding_parity": (embedding_parity, EMBEDDING_PARITY),
}
