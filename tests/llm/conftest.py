import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stop="."):
    words = ["".join(rng.choice(["th", "an", "er", "ou", "é", "ing", "st", "La", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (stop if rng.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, one very long text, copies, near copies, repeated rows, all kinds of characters."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    near = base[7:12]
    for k, t in enumerate(near):
        words = (t + " " + prose(rng, 120)).split(" ")
        for j in range(6):
            copy = list(words)
            copy[rng.randrange(len(copy))] = f"edit{j}"
            rows.append((100 + 10 * k + j, " ".join(copy)))
    rows += [(200, base[3]), (201, base[3]), (202, base[3].upper()), (203, None), (204, ""), (205, " \n\t "), (206, prose(rng, 20_000)), (207, "one"), (208, "one"), (209, "a b c")]
    rows += [(None, base[5]), (None, None), (5, base[5]), (5, base[5]), (210, "x<|endoftext|> <|ENDOFTEXT|> ñ ﬁ 한글 😀 \x00\x1c ▁ é İ ΑΣ"), (211, "l1\nl2\nl1\n \nl1"), (-4, base[6])]
    return [(i, t, "en" if k % 3 else None, f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with other columns, named as what the operators make."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(f"own {c}") for c in ("kept", "score", "n_words", "c", "key", "hash", "group", "piece", "stratum", "m", "shard", "size", "digest", "n_tokens", "root", "a b", "__key", "__hash", "__score", "__m", "__of", "__cut", "__kept", "of", "cut", "salt", "file", "path", "place", "begin", "base_failed", "row", "hot")})


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(i, int(k % 4 > 0), int(k % 5 == 0)) for k, (i, *_) in enumerate(odd_rows)] + [(None, 1, 1), (1, None, None), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def mixed_rows():
    """Clean prose, junk, toxic texts, short ones, copies and near copies, enough of them for every verdict."""
    rng = random.Random(12)
    rows = []
    for i in range(1100):
        words = prose(rng, rng.randint(60, 90)).split(" ")
        if i % 9 == 0:
            words = [w + "***" for w in words]
        if i % 7 == 0:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["zounds", "zoundsy", "blackguard", "knavish"])
        if i % 50 == 3:
            words = words[:20]
        rows.append((i, " ".join(words), ("en", "en", "de", None)[i % 4], "s", 0))
    for i in range(40):
        text = rows[5 * i + 1][1]
        rows.append((2000 + i, text if i % 3 else text + " more", rows[5 * i + 1][2], "s", 0))
    return rows


@pytest.fixture(scope="session")
def mixed_labels():
    return [(i, int(i % 9 > 0), int(i % 7 == 0)) for i in range(1100) if i % 10]
