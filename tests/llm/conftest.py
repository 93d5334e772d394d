import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the", "of", "Alpha", "beta", "gamma", "delta", "Été", "straße", "niño", "x1", "and", "lo")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents as a frame; n_chars and an extra column with a clashing name go along."""

    def make(texts, extra=False):
        items = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, "en", "s", len(t or "")) for i, t in items]
        frame = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "cell", "place", "key", "token", "class", "n_lines", "hits"):
                frame = frame.withColumn(name, F.lit("own"))
        return frame

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages and odd cases."""
    rng = random.Random(7)

    def prose(n):
        return " ".join(rng.choice(WORDS) + rng.choice(("", "", ".", ",", "\n")) + (
            str(rng.randrange(60)) if rng.random() < 0.8 else "") for _ in range(n))

    texts = {i: prose(rng.choice((3, 9, 30, 80, 200))) for i in range(60)}
    passage = prose(40)
    for i in range(60, 75):
        texts[i] = prose(20) + " " + passage + " " + prose(20)
    base = texts[20] = prose(120)
    for i in range(75, 90):
        words = base.split(" ")
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = "edited"
        texts[i] = " ".join(words)
    texts |= {90: base, 91: base, 92: None, 93: "", 94: "   \n\t ", 95: "one", 96: "one",
              97: prose(3000), 98: passage, 99: "\n\n\n"}
    return texts
