import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "shore", "wind", "harbour", "été", "größe", "and,", "in", "a", "lantern.", "stone", "river", "quiet"]) + ("" if rng.random() < 0.8 else rng.choice(["s", "ing", "ed"])) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, repeats, ties, and columns whose names clash with those used inside."""
    rng = random.Random(1)
    rows = [(i, prose(rng, 60 + i), "en", f"s{i % 3}", 5) for i in range(12)]
    rows += [(12, None, None, None, None), (13, "", "", "", 0), (14, "  \n\t ", None, "s1", 3), (3, rows[3][1], "en", "s0", 5), (15, rows[4][1], "en", None, 5), (None, rows[5][1], "fr", "s2", 5), (None, None, None, None, None), (16, prose(rng, 60_000), "en", "s0", 1), (17, "word", "en", "s0", 4)]
    full = [(*r, r[0], "k", 7, "x", 1) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row int, mark string, size int").repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
