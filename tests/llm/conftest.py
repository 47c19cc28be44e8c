import pytest

pytest.importorskip("rangeloom.llm")

LONG = "wort " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, copies, a repeated row and clashing extra columns."""
    rows = [
        (1, "Hello a@b.com the call is +1 (974) 555-3436.", "en", "s", 5),
        (1, "Hello a@b.com the call is +1 (974) 555-3436.", "en", "s", 5),
        (2, "", "en", "s", 0),
        (3, None, "en", "s", None),
        (4, LONG, "de", "s", len(LONG)),
        (None, "the text without an id", "en", "s", 3),
        (5, "the text without an id", None, None, 3),
        (6, "123 456 !!!", "en", "s", 3),
        (7, " \n\t ", "fr", "s", 3),
        (8, "日本語 😀 İstanbul Σσς", "en", "s", 3),
        (9, "x" * 30_000, "en", "s", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("component_id", "fp", "term", "row", "slot", "score", "label"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def prose(seed: int, n: int) -> str:
    """Invented words."""
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ri", "to", "lem", "sun", "ke", "dor", "vi")) for _ in range(rng.randrange(1, 5))) for _ in range(n))
