import random

import pytest

WORDS = "the of lantern gravel orchid pewter saffron thimble quarry meadow anvil bramble cobalt drizzle ember fathom girder harbor".split()


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing extra columns."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = text(120)
    rows = [
        (0, base, "en", "b", 1),
        (1, base.upper(), "en", "b", 1),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \n\t ", "en", None, 3),
        (5, text(30_000), "en", None, 9),
        (6, base + " extra", "de", "é", 1),
        (None, text(60), "en", "a", 1),
        (None, None, None, None, None),
        (8, "Mail a.b+c@x-y.example.org or 10.0.0.255, 300.1.1.1; 4111 1111 1111 1111 call +1 (415) 555-2671!", "en", "z", 1),
        (9, "a" * 50_000 + "@" + "b.c" * 5_000 + " " + "7" * 20_000 + " " + "1-" * 20_000, "en", "z", 1),
        (10, "tail\n\n  line<|endoftext|>s İß x\x1cy ﬁ é", "fr", "z", 1),
        (11, text(80), "en", "a", 1),
        (11, text(80), "en", "a", 1),
    ]
    return rows + [rows[0], rows[11]]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Size long, digest string, rank int, `shard` int, row long"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in edge_rows], schema)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
