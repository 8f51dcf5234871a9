"""Small documents tables: prose, copies, near copies, nulls, empty and long texts."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


_LETTERS = str.maketrans("0123456789", "abcdefghij")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}".translate(_LETTERS) + ("." if rng.random() < 0.1 else "") for _ in range(words))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \t\n", "one", "one two three", "One  two\tthree", "a b c d e"]
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(25)]
    out += base
    for text in base[:12]:  # near copies of varying closeness, in chains
        for changes in (1, 2, 4):
            words = text.split(" ")
            for _ in range(changes):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(50))
            text = " ".join(words)
            out.append(text)
    out += [base[0]] * 4 + [base[1].replace(" ", "\n"), " " + base[1] + "\r\n"]
    out.append(prose(rng, 6000))
    out.append("é" * 5000 + "\n" + "\U0001f600 " * 300)
    return out


def rows(seed: int = 1) -> list[tuple]:
    found = texts(seed)
    order = list(range(len(found)))
    random.Random(seed + 1).shuffle(order)
    sources = ["a"] * 6 + ["b", "c", None]
    return [(3 * k, found[i], "en", sources[i % len(sources)], len(found[i] or "")) for k, i in enumerate(order)]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def awkward(spark):
    """Repeated rows, a null doc_id, and extra columns that are named like results."""
    found = [(1, "same words in every row", "en", "a", 1)] * 2 + [(None, "same words in every row", None, None, None)]
    found += [(2, None, None, None, None), (3, "", None, "b", 0)]
    df = spark.createDataFrame(found, DOCS)
    for name in ("score", "kept", "keep_id", "slot", "block", "name", "row", "s", "a", "b", "n", "words", "spans", "label", "found"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df
