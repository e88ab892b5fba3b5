from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=tuple("the of and to in a is that for it was on with as by house river light stone garden winter paper".split())):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared lines, junk, blanks, nothing, and one very long."""
    rng = random.Random(3)
    own = [prose(rng, rng.randint(1, 160)) + "\n" + prose(rng, 30) for _ in range(60)]
    own += [own[3], own[3], own[4].replace("river", "stone", 1), own[5] + " more"]
    own += [f"{prose(rng, 60)}\nAll rights reserved by nobody at all.\n{prose(rng, 20)}" for _ in range(24)]
    own += ["", " \n\t ", "x", "*** $$$ ### " * 90, "SHOUT!! LOUD!! " * 80, "same words here\n" * 40, "▁   ﬁ é\n\n  two  blanks ", prose(rng, 30_000)]
    return own


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], f"site{i % 13}", len(t)) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, "no id", "en", None, 5), (7, texts[7], "fr", "site7", len(texts[7])), (7, texts[7], "fr", "site7", len(texts[7]))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
