"""Sections of markdown documents, and capsules: the most useful sections within a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safety import redacted
from ..functions.text import canonical, strip

# Headings of what a reader needs first, most needed first.
PRIORITIES = ["when to use", "workflow", "steps", "instructions", "constraints", "output", "verification", "examples"]


def priority(heading: Column) -> Column:
    """The place of the first of PRIORITIES that the heading contains, and beyond the last for others."""
    low, out = F.lower(heading), F.lit(len(PRIORITIES) + 1)
    for rank, phrase in reversed(list(enumerate(PRIORITIES))):
        out = F.when(low.contains(phrase), rank).otherwise(out)
    return out


def _parts(text: Column) -> Column:
    """array of (place, heading, body); the text before the first heading has an empty one."""
    pieces = F.split(F.concat(F.lit("\n"), canonical(text)), r"\n(?=#{1,6}[ \t])", -1)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            i.cast("long").alias("place"),
            F.when(i == 0, F.lit("")).otherwise(strip(F.regexp_extract(p, r"^#{1,6}[ \t]+([^\n]*)", 1))).alias("heading"),
            F.when(i == 0, strip(p)).otherwise(strip(F.regexp_replace(p, r"^#{1,6}[ \t]+[^\n]*", ""))).alias("body"),
        ),
    )


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, place, heading, body) of documents (doc_id, text), without an empty preamble."""
    rows = docs.select("doc_id", F.explode(_parts(F.col("text"))).alias("s")).select("doc_id", "s.*")
    return rows.where("place > 0 or body <> ''")


def capsules(docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, capsule, n_sections): sections by priority while they fit the budget, masked lines replaced.

    A section that doesn't fit is left out and later ones are still tried, as an ordered fold over the array.
    """
    parts = F.transform(
        F.filter(_parts(redacted(F.col("text"))), lambda s: s["body"] != ""),
        lambda s: F.struct(
            priority(s["heading"]).alias("rank"),
            s["place"].alias("place"),
            F.when(s["heading"] == "", s["body"]).otherwise(F.concat(F.lit("## "), s["heading"], F.lit("\n"), s["body"])).alias("text"),
        ),
    )
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(state["n"] == 0, part["text"]).otherwise(F.concat(state["text"], F.lit("\n\n"), part["text"]))
        fits = F.length(joined) <= budget
        return F.struct(F.when(fits, joined).otherwise(state["text"]).alias("text"), F.when(fits, state["n"] + 1).otherwise(state["n"]).alias("n"))

    folded = docs.select("doc_id", F.aggregate(F.array_sort(parts), start, add).alias("c"))
    return folded.select("doc_id", F.col("c.text").alias("capsule"), F.col("c.n").alias("n_sections"))

# Characters of a document's sample, the share of head and tail and their least size.
SAMPLE_CHARS, HEAD_SHARE, LEAST_HEAD, TAIL_SHARE, LEAST_TAIL = 1800, 4, 120, 5, 80


def sample_prose(text: Column) -> Column:
    """A markdown text on one line: front matter, images and tags of up to 200 characters go, links become their text."""
    out = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]{1,200}>", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "^ | $", "")


def embedding_samples(docs: DataFrame, budget: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, sample): what a document (doc_id, text) says, in at most ``budget`` characters.

    The text before the first heading gets a quarter of the budget; then come the sections that readers need first, the
    end of the last section from what is kept back for it, and other sections in order while there is room. The three
    budgets are one ordered fold over the sections. Without headings the beginning is taken; null texts give an empty sample.
    """
    bare = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"(?s)\A---\n.*?\n---\n", "")
    rows = docs.select("doc_id", F.split(F.concat(F.lit("\n"), strip(bare)), r"\n(?=[ ]{0,3}#{1,6}[ \t]+\S)", -1).alias("pieces"))
    heading = r"^[ ]{0,3}#{1,6}[ \t]+([^\n]*)"

    def section(piece: Column, place: Column) -> Column:
        title = F.regexp_replace(strip(F.regexp_extract(piece, heading, 1)), r"\s+", " ")
        body = strip(F.regexp_replace(piece, heading, ""))
        return F.struct(priority(title).alias("rank"), place.alias("place"), sample_prose(F.concat(title, F.lit(". "), body)).alias("clean"))

    rows = rows.select(
        "doc_id",
        sample_prose(strip(F.get("pieces", F.lit(0)))).alias("head"),
        F.transform(F.slice("pieces", F.lit(2), F.size("pieces") - 1), section).alias("sections"),
    )
    least_head = min(budget, max(LEAST_HEAD, budget // HEAD_SHARE)) if budget >= LEAST_HEAD else budget
    tail = max(LEAST_TAIL, budget // TAIL_SHARE)
    none = F.array().cast("array<string>")

    def added(state: Column, clean: Column, place: Column) -> Column:
        """state with as much of ``clean`` as its budget allows."""
        own = F.when(F.length(clean) > state["left"], F.rtrim(F.substr(clean, F.lit(1), state["left"]))).otherwise(clean)
        fits = (state["left"] > 0) & (own != "")
        return F.when(
            fits,
            F.struct(
                F.concat(state["parts"], F.array(own)).alias("parts"),
                (state["left"] - F.length(own)).alias("left"),
                F.concat(state["used"], F.array(place)).alias("used"),
            ),
        ).otherwise(state)

    def state(parts, left, used=None) -> Column:
        used = F.array().cast("array<int>") if used is None else used
        return F.struct(parts.alias("parts"), left.cast("int").alias("left"), used.alias("used"))

    rows = rows.withColumn("own", F.rtrim(F.substr("head", F.lit(1), F.lit(least_head))))
    left = F.lit(budget) - F.length("own")
    kept = F.when((left >= LEAST_TAIL) & (F.size("sections") > 1), F.least(left, F.lit(tail))).otherwise(0)
    rows = rows.withColumn("kept", kept).withColumn("start", state(F.when(F.col("own") != "", F.array("own")).otherwise(none), left - F.col("kept")))
    step = lambda s, x: added(s, x["clean"], x["place"])
    rows = rows.withColumn("first", F.aggregate(F.array_sort("sections"), F.col("start"), step))
    # what is left of both budgets goes to the end of the last section
    last = F.try_element_at("sections", F.lit(-1))
    rows = rows.withColumn("again", state(F.col("first.parts"), F.col("first.left") + F.col("kept"), F.col("first.used")))
    end = strip(F.when(F.length(last["clean"]) > F.col("again.left"), F.expr("substr(try_element_at(sections, -1).clean, length(try_element_at(sections, -1).clean) - again.left + 1)")).otherwise(last["clean"]))
    unused = ~F.array_contains("again.used", last["place"]) & (F.col("again.left") > 0)
    rows = rows.withColumn("second", F.when(unused, added(F.col("again"), end, last["place"])).otherwise(F.col("again")))
    rest = F.filter("sections", lambda x: ~F.array_contains("second.used", x["place"]) & (x["place"] != F.when(unused, last["place"]).otherwise(-1)))
    rows = rows.withColumn("third", F.aggregate(rest, F.col("second"), step))
    joined = strip(F.regexp_replace(F.array_join("third.parts", " "), r"\s+", " "))
    sample = F.when(F.size("sections") == 0, F.substr("head", F.lit(1), F.lit(budget))).otherwise(F.substr(joined, F.lit(1), F.lit(budget)))
    return rows.select("doc_id", sample.alias("sample"))
