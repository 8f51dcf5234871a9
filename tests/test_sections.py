"""Samples of documents for embeddings against a plain reading of the three budgets."""

import random
import re

import pytest

from granary.operators.sections import PRIORITIES, embedding_samples


def prose(text):
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"<[^>]{1,200}>", " ", text))
    return re.sub(r"\s+", " ", text).strip()


def brute(text, budget):
    body = re.sub(r"\A---\n.*?\n---\n", "", text or "", count=1, flags=re.S).strip()
    head, *rest = re.split(r"\n(?=[ ]{0,3}#{1,6}[ \t]+\S)", "\n" + body)
    if not rest:
        return prose(head)[:budget]
    titles = [re.match(r"[ ]{0,3}#{1,6}[ \t]+([^\n]*)", x) for x in rest]
    cleans = [prose(m[1].strip() + ". " + x[m.end() :].strip()) for m, x in zip(titles, rest, strict=True)]
    ranks = [next((k for k, p in enumerate(PRIORITIES) if p in m[1].lower()), 99) for m in titles]
    parts, used = [], set()

    def add(clean, left):
        own = clean if len(clean) <= left else clean[: max(left, 0)].rstrip()
        if own:
            parts.append(own)
        return left - len(own)

    first = min(budget, max(120, budget // 4)) if budget >= 120 else budget
    left = budget - first + add(prose(head), first)
    kept = min(left, max(80, budget // 5)) if left >= 80 and len(rest) > 1 else 0
    work = left - kept
    for k in sorted(range(len(rest)), key=lambda k: (ranks[k], k)):
        before, work = work, add(cleans[k], work) if work > 0 else work
        used |= {k} if work < before else set()
    left = work + kept
    last = len(rest) - 1
    if left > 0 and last not in used:
        left = add(cleans[last][-left:].strip(), left)
        used.add(last)
    for k in range(len(rest)):
        if k not in used and left > 0:
            left = add(cleans[k], left)
    return re.sub(r"\s+", " ", " ".join(parts)).strip()[:budget]


@pytest.mark.parametrize("budget", [40, 150, 1800])
def test_samples(spark, budget):
    rng = random.Random(budget)
    titles = ["Usage", "When to use this", "Workflow", "Output format", "Notes", "Verification steps", "License"]

    def words(n):
        return " ".join(rng.choice(["lamp", "[oil](u)", "glow<br>", "wick\n", "![i](p)", "a"]) for _ in range(n))

    texts = [None, "", "no heading at all " * 300, "# Only", "#no heading\n## \nstill none", "---\nname: x\n---\nhead\n# A\nb", "x" * 5000 + "\n# Usage\n" + "y" * 5000]
    for _ in range(60):
        text = rng.choice(["", "---\na: b\n---\n"]) + words(rng.randrange(60))
        for _ in range(rng.randrange(7)):
            text += f"\n{' ' * rng.randrange(4)}{'#' * rng.randrange(1, 7)} {rng.choice(titles)}\n{words(rng.choice([0, 5, 80, 600]))}"
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["sample"] for r in embedding_samples(df, budget).collect()}
    for k, text in enumerate(texts):
        assert got[k] == brute(text, budget), text
