import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeats, shared
    passages and columns of clashing names."""
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, base = line(90), line(120)
    rows = [(k, line(rng.randrange(1, 160)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for k in range(60)]
    rows += [(60 + k, f"{line(30)} {shared} {line(25)}", "en", "a") for k in range(6)]
    near = base.split()
    for k in range(8):
        near = near.copy()
        near[rng.randrange(len(near))] = f"x{k}"
        rows.append((70 + k, " ".join(near), "en", "b"))
    rows += [(80 + k, base, "de", "b") for k in range(4)] + [(84, base.upper(), "de", "b")]
    rows += [(90, None, "en", "a"), (91, "", None, None), (92, "  \n ", "en", "a"), (93, "one", "en", "a"), (94, "12 34 !!", "en", "a"), (95, "é" * 700, "en", "z"), (96, line(6000), "de", "é"), (97, "a b c\td", "en", "a")]
    rows += [(98, shared, "en", "a"), (98, shared, "en", "a"), (None, line(50), "en", "a"), (99, line(40) + "\x1c " + line(3), "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "h") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int, h string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
