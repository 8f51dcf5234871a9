"""The audit against all orders applied one by one."""

import random
import re
from collections import defaultdict
from itertools import permutations

from granary.llm.common import Scratch
from granary.llm.filter_audit import FILTERS, failure_masks, filter_audit

from .fixtures import awkward, documents, empty, rows

LABELS = "doc_id long, quality int, toxic int"
VALUES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails_brute(docs):
    least = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (doc_id is not None and doc_id > least[text])
        out.append((doc_id, source or "", fails))
    return out


def audit_brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    judged = fails_brute(docs)
    out = {(part, "".join(o), k): [0] * 7 for _, part, _ in judged for o in permutations(FILTERS) for k in range(1, 6)}
    shapley = defaultdict(int)
    for doc_id, part, fails in judged:
        for order in permutations(FILTERS):
            gone = False
            for k, x in enumerate(order, 1):
                own = out[part, "".join(order), k]
                own[3] += fails == x
                if x in fails and gone:
                    own[2] += 1
                elif x in fails:
                    gone = True
                    own[1] += 1
                    own[4] += doc_id in good
                    own[5] += doc_id in toxic
                    shapley[part, x] += 1
                own[0] += not gone
    for (part, order, k), own in out.items():
        own[6] = shapley[part, order[k - 1]]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[v] for v in VALUES) for r in df.collect()}


def noisy(seed):
    """Texts of all masks: short and long, repetitive, capitals, marks, copies; a third of the rows one text."""
    rng = random.Random(seed)
    texts = ["HOT | text"] + [
        rng.choice([str.lower, str.upper])(" ".join(f"w{rng.randrange(rng.choice([5, 900]))}" for _ in range(rng.choice([20, 199, 200, 300])))) + rng.choice(["", "*", "é\n"])
        for _ in range(40)
    ]
    docs = [(k, texts[0] if rng.random() < 0.33 else rng.choice(texts), "en", rng.choice(["a", "a", "b", "", None]), 0) for k in range(300)]
    labels = [(k, rng.randrange(2), int(rng.random() < 0.2)) for k in range(300) if rng.random() < 0.5]
    return docs, labels


def test_against_all_orders(spark):
    docs, labels = noisy(1)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(filter_audit(df, spark.createDataFrame(labels, LABELS))) == audit_brute(docs, labels)


def test_copies_across_tasks(spark):
    """One text over all tasks, and repeated and null doc_ids among its copies."""
    docs = [(k, "copy", "en", "s", 4) for k in range(400)] + [(0, "copy", "en", "s", 4), (7, "copy", "en", "s", 4), (None, "copy", "en", "s", 4)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
        got = failure_masks(df, Scratch(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(docs)
    for r in got:
        assert bool(r["mask"] & 16) == (r["doc_id"] is not None and r["doc_id"] > 0), r


def test_masks_of_whole_texts(spark):
    docs = rows()
    got = sorted((r["doc_id"], r["part"], "".join(x for k, x in enumerate(FILTERS) if r["mask"] >> k & 1)) for r in failure_masks(documents(spark), Scratch(spark)).collect())
    assert got == sorted(fails_brute(docs))


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, None, 1), (None, 1, 1)], LABELS)
    assert filter_audit(empty(spark), labels).count() == 0
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in awkward(spark).collect()]
    assert found(filter_audit(awkward(spark), labels)) == audit_brute(docs, [(1, 1, 1)])
