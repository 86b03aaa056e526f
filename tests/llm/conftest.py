import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORD = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, white space, nulls and long texts."""
    import random
    rng = random.Random(5)

    def prose(n):
        return " ".join(rng.choice(WORD) + str(rng.randrange(60)) for _ in range(n))

    base, passage = prose(120), prose(40)
    rows = [(3, base), (1, base), (7, base + " tail"), (2, None), (4, ""), (5, " \t\n "), (6, "one two"), (9, "ONE\x0btwo"),
            (8, passage + "\n" + prose(30)), (10, prose(30) + " " + passage), (11, "é" * 50 + " " + passage + "\n\nλ"),
            (12, "same " * 90), (13, "x" * 300), (14, prose(3000) + " " + passage)]
    for i in range(20, 60):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng.randrange(1, 60))) for i in range(60, 90)]
    lines = [prose(3) for _ in range(8)]
    rows += [(90, "\n".join(lines)), (91, "\n".join(lines[2:7])), (92, "\n".join([lines[0], "new", *lines[3:]])),
             (93, "\n\n\n\n"), (94, "a\nb\nc\na\nb\nc\na\nb\nc"), (95, "\n\n\n")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, texts):
    """The documents with null ids, repeated rows and columns named like those inside the operators."""
    rows = texts + [(None, "no id at all but some words"), (None, None), texts[0], texts[-2]]
    return spark.createDataFrame(
        [(i, t, "en", 1, 2, 3, b"k", "d", 5) for i, t in rows],
        "doc_id long, text string, lang string, part int, id int, bucket int, keys binary, doc string, at int").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
