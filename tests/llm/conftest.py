from __future__ import annotations

import random

import pytest

SYLLABLES = ["tha", "ing", "re", "on", "st", "er", "an", "ble", "ou", "ti"]


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def messy_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, odd, very long and repeated texts."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 60)), "en", "a") for i in range(30)]
    rows += [
        (100, None, None, None),
        (101, "", "en", "a"),
        (102, " \n\t ", "de", "a"),
        (103, sentence(rng, 30_000), "en", "b"),
        (104, "x" * 50_000, "en", "b"),
        (105, "12 34 !! ## 中文 😀 é́   l0s3r s c u m", "fr", "b"),
        (3, rows[3][1], "en", "a"),
        (3, rows[3][1], "en", "a"),
        (106, rows[3][1], "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with extra columns whose names operators use inside."""
    kinds = "doc_id long, text string, lang string, source string, id long, ids int, score double, "
    kinds += "node long, label int, row long, bucket long, part long, training boolean"
    extra = (7, 7, 7.0, 7, 7, 7, 7, 7, True)
    return spark.createDataFrame([(*r, *extra) for r in messy_rows], kinds)


@pytest.fixture(scope="session")
def no_rows(messy):
    return messy.where("doc_id < 0")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(100, None, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
