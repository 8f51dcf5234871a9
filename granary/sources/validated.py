"""Loading records only if they are valid: every rule is a column, and one write gives the good rows and the rejected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a record, limits of text fields in characters (a star marks those that must not be empty),
# whole numbers, numbers, lists, digests, and the statuses that may be shipped.
TEXTS = {
    "name": 500, "source": 200, "url": 2048, "description": 20_000, "capability_summary": 2_000, "discovered_at": 100, "scanned_at": 100,
    "embedded_at": 100, "content_hash": 128, "embedding_text_hash": 128, "canonical_id": 2048, "category": 200,
}
REQUIRED = ["name", "source", "url"]
WHOLE, NUMBERS = ["risk_score", "quality_score"], ["prominence_score", "provenance_score", "meaningfulness_score"]
LISTS = ["tags", "risk_flags", "quality_reasons", "platforms", "triggers"]
DIGESTS = ["content_hash", "embedding_text_hash"]
STATUSES = ["active", "metadata_only"]
MOST_WHOLE, MOST_ITEMS = 10_000, 100
FIELDS = [*TEXTS, *WHOLE, *NUMBERS, *LISTS, "quality_status", "content"]
#: Hosts that are not public: names, and the address blocks of private, loopback, link-local and unspecified hosts.
_LOCAL_NAME = r"(?i)^(localhost|.*\.localhost|.*\.local)\.?$"
_LOCAL_ADDRESS = r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|22[4-9]\.|2[34]\d\.|25[0-5]\.)"


def public_url(url: Column) -> Column:
    """Whether an address is http or https, names a public host and carries no login."""
    authority = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":\d*$", "")
    local = host.rlike(_LOCAL_NAME) | (host.rlike(r"^\d+(\.\d+){3}$") & host.rlike(_LOCAL_ADDRESS)) | host.rlike(r"(?i)^\[(::1?|f[cd].*|fe[89ab].*)\]$")
    return F.coalesce((host != "") & ~authority.contains("@") & ~local, F.lit(False))


def parsed_records(lines: DataFrame) -> DataFrame:
    """Lines (line_id, value) as (line_id, record): a VARIANT, null for what is no JSON object. Empty lines are left out."""
    value = F.try_parse_json("value")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return lines.where(F.trim("value") != "").select("line_id", F.when(is_object, value).alias("record"))


def _text(field: str) -> Column:
    return F.col(f"text_{field}")


def _kind(field: str) -> Column:
    return F.col(f"kind_{field}")


def _with_fields(parsed: DataFrame) -> DataFrame:
    """parsed with a column text_<field> and kind_<field> per field: its text, and its type, which is VOID for null and for a
    field that is not there. Each is read from the record once."""
    known = {f: F.try_variant_get("record", f"$.{f}", "variant") for f in [*FIELDS]}
    out = parsed.select("*", *[v.alias(f"value_{f}") for f, v in known.items()])
    kinds = [F.coalesce(F.schema_of_variant(f"value_{f}"), F.lit("VOID")).alias(f"kind_{f}") for f in FIELDS]
    texts = [F.try_variant_get(f"value_{f}", "$", "string").alias(f"text_{f}") for f in [*TEXTS, "quality_status", "content"]]
    return out.select(*parsed.columns, *[f"value_{f}" for f in (*WHOLE, *LISTS)], *kinds, *texts)


def _faults() -> list[Column]:
    """A column per rule: its reason where a record breaks it, else null."""
    found = [F.when(F.col("record").isNull(), "not a JSON object")]
    keys = F.map_keys(F.try_variant_get("record", "$", "map<string, variant>"))
    found.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "forbidden fields"))
    for field, most in TEXTS.items():
        text, kind = _text(field), _kind(field)
        empty = (F.trim(text) == "") | (kind == "VOID") if field in REQUIRED else F.lit(False)
        no_text = ~kind.isin("STRING", "VOID") | empty
        found.append(F.when(no_text, f"{field} is no text").when(F.length(text) > most, f"{field} is too long").when(text.contains("\0"), f"{field} has a NUL"))
    for field in DIGESTS:
        found.append(F.when(~_text(field).rlike("^[a-f0-9]{32,128}$"), f"{field} is no digest"))
    found.append(F.when((_kind("url") == "STRING") & ~public_url(_text("url")), "url is not public"))
    found.append(F.when(~F.coalesce(_text("quality_status").isin(STATUSES), F.lit(False)), "status may not be shipped"))
    for field in WHOLE:
        value = F.try_variant_get(f"value_{field}", "$", "long")
        found.append(F.when((_kind(field) != "VOID") & ((_kind(field) != "BIGINT") | (F.abs(value) > MOST_WHOLE)), f"{field} is out of range"))
    for field in NUMBERS:
        found.append(F.when(~_kind(field).rlike("^(VOID|BIGINT|DOUBLE|DECIMAL.*)$"), f"{field} is no number"))
    for field in LISTS:
        size = F.size(F.try_variant_get(f"value_{field}", "$", "array<variant>"))
        found.append(F.when((_kind(field) != "VOID") & ~_kind(field).startswith("ARRAY"), f"{field} is no list").when(size > MOST_ITEMS, f"{field} has too many entries"))
    digest = F.sha2(_text("content"), 256)
    found.append(F.when(F.coalesce(_text("content"), F.lit("")) == "", "content is missing").when(~digest.eqNullSafe(_text("content_hash")), "content has another digest"))
    return found


def validated(lines: DataFrame) -> DataFrame:
    """(line_id, url, record, reasons) of lines (line_id, value): every rule that a record breaks, in the order of the rules.

    An address that occurs again makes all its records but the one with the smallest line_id a duplicate; only records that
    are otherwise valid count. Good rows have no reasons. Rows are joined with the first line of their address.
    """
    judged = _with_fields(parsed_records(lines)).withColumn("url", _text("url"))
    judged = judged.withColumn("reasons", F.when(F.col("record").isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.array_compact(F.array(*_faults()[1:]))))
    judged = judged.withColumn("good", F.size("reasons") == 0)
    # conditions stand in the aggregates: a filter on the reasons would be planned for seconds
    first = judged.groupBy("url").agg(F.min(F.when(F.col("good"), F.col("line_id"))).alias("first"))
    again = judged.join(first, "url", "left")
    late = F.col("good") & (F.col("line_id") > F.col("first"))
    return again.select("line_id", "url", "record", F.when(late, F.array(F.lit("duplicate url"))).otherwise(F.col("reasons")).alias("reasons"))


def load_with_quarantine(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes validated lines once, as ``accepted=true`` and ``accepted=false`` under path, and returns both parts."""
    rows = validated(lines).select("line_id", "url", F.to_json("record").alias("record"), "reasons", (F.size("reasons") == 0).alias("accepted"))
    rows.write.partitionBy("accepted").parquet(path)
    read = lines.sparkSession.read.schema(rows.schema).parquet(path)
    return read.where("accepted").drop("accepted"), read.where("not accepted").drop("accepted")


def source_integrity(records: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """records (record_id, status, reasons) with ``complete``, and demoted where a captured file is not retained as it was.

    expected and files: (record_id, path, sha256, bytes) of the manifest and of what is there; files also has ``content``
    (null where only the listing is kept), which must have the digest and size that its row says. A record without manifest
    is incomplete. Demoted records become metadata_only, with one more reason, sorted.
    """
    own = F.col("content").isNull() | ((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("bytes")))
    there = files.select("record_id", "path", F.struct("sha256", "bytes").alias("is"), own.alias("intact"))
    wanted = expected.select("record_id", "path", F.struct("sha256", "bytes").alias("should"))
    fits = F.coalesce(F.col("is").eqNullSafe(F.col("should")) & F.col("intact"), F.lit(False))
    both = wanted.join(there, ["record_id", "path"], "full").groupBy("record_id").agg(F.min(fits & F.col("should").isNotNull()).alias("complete"))
    out = records.join(both, "record_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    reasons = F.array_sort(F.array_union("reasons", F.array(F.lit("source-files-incomplete"))))
    return out.select(
        "record_id",
        F.when(F.col("complete"), F.col("status")).otherwise("metadata_only").alias("status"),
        F.when(F.col("complete"), F.col("reasons")).otherwise(reasons).alias("reasons"),
        "complete",
    )
