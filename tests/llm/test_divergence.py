import random
import re
from collections import Counter, defaultdict

import pytest

from stocklens.llm import divergence

from .conftest import DOCUMENTS
from .helpers import LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    """Every term of every pair, one by one."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}

    def shares(lang, count):
        total = sum(count[t] for t in kept[lang])
        v = len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept[lang]}

    p = {g: shares(g[0], c) for g, c in counts.items()}
    q = {lang: shares(lang, sum((c for g, c in counts.items() if g[0] == lang), Counter()))
         for lang in docs}
    out = []
    for lang, source in counts:
        pairs = [(sum(abs(p[lang, source][t] - p[lang, other][t]) for t in kept[lang]), other)
                 for of, other in counts if of == lang and other != source]
        own = p[lang, source]
        terms = [(own[t] - q[lang][t], t) for t in kept[lang]
                 if counts[lang, source][t] and own[t] > q[lang][t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            for rank, (value, item) in enumerate(found, 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = [w + str(i) * 0 + "abcdefghij"[i % 10] * (i // 10) for i in range(60)
             for w in ("é", "Zo", "straße", "x", "𝄞")]
    rows = []
    for i in range(400):
        lang = rng.choice(("en", "fr", None, "de"))
        source = f"s{rng.randrange(9)}" if rng.random() < 0.6 else "hot"
        some = rng.sample(words, 40) if lang != "de" else [f"once{'a' * i}"]
        text = " ".join(rng.choice(some) + rng.choice((" ", "1", "-", "\n"))
                        for _ in range(rng.randrange(120)))
        rows.append((text, lang, source))
    rows += [(None, "en", "silent"), ("", "en", None), ("123 ...", "it", "only"), rows[5], rows[5],
             ("Zo " * 100_000, "fr", "s1")]
    return rows


@pytest.mark.parametrize("block,band", [(512, 64), (16, 3), (7, 1)])
def test_against_brute_force(spark, block, band):
    """Blocks and tiles of any size; nulls, ties, repeated rows, long texts, sources without terms."""
    rows = corpus()
    frame = spark.createDataFrame(
        [(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], DOCUMENTS).repartition(5)
    for name in ("term", "n", "p", "block", "number", "part", "rank"):
        frame = frame.selectExpr("*", f"'own' AS {name}")
    found = divergence.audit(frame, least_docs=4, top_terms=6, block=block, band=band)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, 6)


def test_languages_without_kept_terms(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    frame = spark.createDataFrame([(0, *r, 0) for r in rows], DOCUMENTS)
    found = sorted(map(tuple, divergence.audit(frame).collect()))
    assert found == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_empty_table(spark, documents):
    assert divergence.audit(documents([])).count() == 0


def test_large_counts_stay_exact(spark):
    """The product of a count and the unit is beyond 64 bits."""
    frame = spark.createDataFrame([(10**12, 3 * 10**12, 7)], "n long, total long, v long")
    share = divergence._share(frame.n, frame.total, frame.v)
    expected = 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 35)
    assert frame.select(share).first()[0] == expected
