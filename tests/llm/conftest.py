import random

import pytest

SYLLABLES = "an be con der en for ing lo mer non op per qui re sta tion un ver".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


SCHEMA = "doc_id long, text string, kept string, score string, TEXT string, n_chars long"

ODD_TEXTS = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(2, 80) + " " + prose(1, 60)),
    (4, None), (5, ""), (6, "  \n\t "), (7, "De."), (7, "De."), (None, prose(1, 120)),
    (None, None), (8, "x" * 30_000), (9, "of " * 400), (10, "é😀中 ſ K\x85a\x1fb"),
    (11, prose(3, 3000)), (12, "the 4111111111111111 a@b.co"),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as documents with columns whose names clash with made ones."""
    def build(rows):
        full = [(i, t, "kept", "score", "TEXT", len(t) if t else None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    return docs_of(ODD_TEXTS)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest given documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
