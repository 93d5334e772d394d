"""Operator 6: document fingerprints from spot signatures.

A spot is a common word; its signature is the word and the chain of the next
content words, other common words left out. Common words are spread evenly
over running text and rare in lists and menus, so the set of signatures
follows the prose of a document. Two documents are as alike as the Jaccard
similarity of their sets.

Sets whose lengths are too different cannot be alike: documents are
partitioned by set length, only neighbouring partitions meet, and within them
only sets that share one of their first signatures are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.cuts import cut_points

# Common words of English, French, German and Spanish: fixed values.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of",
    "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "dans", "de", "des", "du", "est", "et", "la", "le", "les", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "als", "auf", "auch", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist",
    "mit", "nicht", "sich", "und", "von", "zu",
    "al", "con", "del", "el", "en", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)

#: Content words of a chain, and stretches between spots that it may reach over.
CHAIN, REACH = 2, 4
#: Similarity of near copies.
ALIKE = 0.8
#: Rows of a cell of neighbouring ids, and cells at most.
CELL_ROWS, MOST_CELLS = 500, 2048

_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPOT = " (" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + ")(?= )"


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def signatures(text: Column) -> Column:
    """The sorted set of a text's spot signatures, as 32-bit hashes.

    A text without spots has one signature, of all its words. So the set is
    never empty, and equal texts have equal sets.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _OTHER, " "), F.lit(" "))

    def chains(words: Column) -> Column:
        found = F.struct(
            F.regexp_extract_all(words, F.lit(_SPOT), F.lit(1)).alias("spots"),
            F.split(words, _SPOT, -1).alias("stretches"))
        return _let(found, lambda f: F.transform(f["spots"], lambda spot, i: F.hash(
            spot, F.substring_index(F.trim(F.array_join(
                F.slice(f["stretches"], i + 2, F.lit(REACH)), "")), " ", CHAIN))))

    def spotted(words: Column) -> Column:
        return _let(chains(words), lambda hashes: F.when(
            F.size(hashes) > 0, F.array_sort(F.array_distinct(hashes))
        ).otherwise(F.array(F.hash(F.trim(words)))))

    return _let(plain, spotted)


def fingerprint(hashes: Column) -> Column:
    """A set of signatures as a string: eight hexadecimal digits for each."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(
        h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets."""
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def length_partition(size: Column, alike: float = ALIKE) -> Column:
    """Partition of a set's length; alike sets are in one or in neighbouring partitions."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / alike) + F.lit(1e-9)).cast("int")


def near_pairs(sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Pairs (left, right, likeness) of different sets that are at least ``alike``.

    ``sets`` has doc_id and signatures. Equal sets count once, by their smallest
    id, so copies add no pairs. The first signatures by hash order of a set
    of ``n`` are ``n - ceil(alike * n) + 1``; alike sets share one of them.
    """
    classes = sets.groupBy("signatures").agg(F.min("doc_id").alias("doc_id"))
    n = F.size("signatures")
    first = n - F.ceil(n * alike - 1e-9).cast("int") + 1
    keyed = classes.select(
        "doc_id", "signatures", length_partition(n, alike).alias("partition"),
        F.explode(F.slice("signatures", F.lit(1), first)).alias("signature"))
    left = keyed.select(F.col("doc_id").alias("left"), F.col("signatures").alias("left_set"),
                        "partition", "signature")
    right = keyed.select(
        F.col("doc_id").alias("right"), F.col("signatures").alias("right_set"), "signature",
        F.explode(F.array(F.col("partition"), F.col("partition") - 1)).alias("partition"))
    small, large = F.size("left_set"), F.size("right_set")
    in_reach = (small < large) | ((small == large) & (F.col("left") < F.col("right")))
    met = left.join(right, ["partition", "signature"]).where(
        in_reach & (small >= large * alike - 1e-9))
    # Only at the first signature that both have among their first ones.
    shared = F.array_min(F.array_intersect("left_set", "right_set")) == F.col("signature")
    return met.where(shared).select(
        "left", "right", likeness(F.col("left_set"), F.col("right_set")).alias("likeness")
    ).where(F.col("likeness") >= alike)


def _cells(docs: DataFrame) -> Column:
    """Cell of an id: cells hold neighbouring ids and about equally many rows."""
    wanted = min(MOST_CELLS, max(1, docs.count() // CELL_ROWS))
    cuts = cut_points(docs, "doc_id", wanted)
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, signatures, and next_text and next_signatures of the next smaller id.

    After the smallest id comes the largest. Rows with equal ids follow each
    other by text, null ids are the smallest. Rows are put in order within
    cells of neighbouring ids; each cell also gets the first row of the next
    one, of which there is one per cell.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.withColumn("cell", _cells(texts)).withColumn("signatures", signatures(F.col("text")))
    firsts = dict(rows.groupBy("cell").agg(F.max("doc_id")).collect())  # one row per cell
    before = {}  # cell -> the one that it follows
    order = sorted(firsts, reverse=True)
    for cell, after in zip(order, [*order[1:], *order[:1]]):
        before[after] = cell
    ids = [i for i in firsts.values() if i is not None]
    is_first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if None in firsts.values():
        is_first = is_first | F.col("doc_id").isNull()
    heads = rows.where(is_first).groupBy("doc_id", "cell").agg(
        F.min("text").alias("text"))
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else (
        F.create_map().cast("map<int,int>"))
    ghosts = heads.withColumn("signatures", signatures(F.col("text"))).withColumn(
        "cell", F.try_element_at(place, F.col("cell")))
    every = rows.withColumn("ghost", F.lit(False)).unionByName(
        ghosts.withColumn("ghost", F.lit(True)))
    order_in = Window.partitionBy("cell").orderBy(
        "ghost", F.col("doc_id").desc_nulls_last(), "text")
    return every.select(
        "doc_id", "text", "signatures", "ghost",
        F.lead("text").over(order_in).alias("next_text"),
        F.lead("signatures").over(order_in).alias("next_signatures"),
    ).where(~F.col("ghost")).drop("ghost")


def edited(text: Column, following: Column) -> Column:
    """The text with its second half replaced by the start of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Null texts are empty. A text without words is like others without words.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_signatures", signatures(F.col("edited")))
    own, other = F.col("signatures"), F.col("edited_signatures")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, F.col("next_signatures")).alias("near_next"),
    )
