import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string, n string, rid string, key string, target string, kept string, h string, recipe string"


def frame(spark, rows):
    """documents with columns whose names clash with what operators make; rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), (r[3] if len(r) > 3 else "s"), len(r[1] or ""), *["x"] * 10) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, white space alone, ties, repeated rows and ids, no spaces, other scripts."""
    r = random.Random(11)
    long = " ".join(f"w{r.randint(0, 400)}" for _ in range(30_000))
    prose = " ".join(f"v{r.randint(0, 90)}" for _ in range(300))
    return [
        (1, prose), (2, prose.replace(" ", "\n\t ")), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long), (7, long), (8, prose + " tail"),
        (None, prose), (None, "alone text here"), (9, "x" * 60_000), (10, "日本語のテキスト です"), (11, "One"), (12, "one"), (13, "a b c"), (14, "A B C"), (14, "another text of the same id"),
    ]
