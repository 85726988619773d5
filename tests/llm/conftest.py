import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, sig long, token long, score double, a long, b long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows of (doc_id, text), DataFrame): copies, near copies, shared passages, nulls, empty and long texts,
    repeated rows, ids missing, and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    rows = [(k, words(rng, rng.choice([3, 40, 80, 200]))) for k in range(60)]
    for k in range(60, 90):  # near copies
        base = rows[rng.randrange(60)][1].split(" ")
        for _ in range(rng.choice([0, 1, 3, 20])):
            base[rng.randrange(len(base))] = f"edit{rng.randrange(10**6)}"
        rows.append((k, " ".join(base)))
    hub = words(rng, 120).split(" ")
    for k in range(90, 130):  # a large group of near copies
        own = list(hub)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"hub{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    passage = words(rng, 64)
    rows += [(k, words(rng, 30) + "\n" + passage + "\t" + words(rng, 20)) for k in range(130, 140)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, words(rng, 30_000)), (144, "One two"), (145, "one TWO"), (146, "É é x  y"), (None, words(rng, 70))]
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 0.5, 3, 4) for i, t in rows], KINDS)
    return rows, frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
