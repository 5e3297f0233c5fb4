import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hits string, spans string, score string, component_id string, sequence_id string, c string, h string, root string"


def odd_texts() -> list[str | None]:
    """Texts at the edges: null, empty, blank, tiny, repeated, with odd characters, very long."""
    draw = random.Random(3)
    words = ["the", "Thing", "of", "idéal", "x.y@z.com", "10.0.0.1", "—", "naïve", "😀", "+1 (555) 123-4567", "4111 1111 1111 1111", "|", "a"]
    long = " ".join(draw.choice(words) for _ in range(60_000))
    return [None, "", " \n\t ", "one", "two words", "same text here again and again", "same text here again and again", "ZW‍J \x00 \x01 \x1c   end", "<|endoftext|> | ||", "é é", long, "x" * 50_000, long + " tail"]


def frame(spark, texts):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "s", None, "a", "b", "c", "d", "e", "f", "g", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts under clashing column names; a row repeats, and one has no doc_id."""
    texts = odd_texts()
    base = frame(spark, texts)
    extra = base.where("doc_id = 5").union(base.where("doc_id = 3").selectExpr("cast(null as bigint)", *base.columns[1:]))
    return base.union(extra)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, []).limit(0)
