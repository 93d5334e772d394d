"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _op1(rounds: int = 20, cut_rounds: int = 12, budget: float = 0.8) -> str:
    flatten = {"source": 0.7, "lang": 0.8, "topic": 0.9}
    parts = ["""
docs AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
           CASE WHEN contains(coalesce(text, ''), 'icensed under') THEN 'legal'
                WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
                WHEN contains(coalesce(text, ''), '!!') THEN 'shouting' ELSE 'prose' END AS topic,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
    FROM documents
), cells AS MATERIALIZED (
    SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM docs GROUP BY ALL
), total AS MATERIALIZED (SELECT sum(n) AS n FROM cells)"""]
    for m, power in flatten.items():
        parts.append(f"""
t_{m} AS MATERIALIZED (
    SELECT {m}, p / sum(p) OVER () AS share
    FROM (SELECT {m}, pow(sum(n), {power}) AS p FROM cells GROUP BY {m}))""")
    parts.append("""
w0 AS MATERIALIZED (SELECT cells.*, cells.n / total.n AS w FROM cells, total)""")
    last = "w0"
    for i in range(rounds):
        for m in flatten:
            new = f"w{i}_{m}"
            parts.append(f"""
{new} AS MATERIALIZED (
    SELECT a.* REPLACE (w * coalesce(share / nullif(sum(w) OVER (PARTITION BY a.{m}), 0), 1) AS w)
    FROM {last} a JOIN t_{m} USING ({m}))""")
            last = new
    parts.append(f"""
f AS MATERIALIZED (
    SELECT a.*, coalesce(w * total.n / nullif(a.n, 0), 1) AS factor FROM {last} a, total),
c0 AS MATERIALIZED (SELECT {budget}::DOUBLE AS c)""")
    for i in range(cut_rounds):
        parts.append(f"""
c{i + 1} AS MATERIALIZED (
    SELECT greatest(c, coalesce(({budget} * sum(n) - coalesce(sum(n) FILTER (factor * c >= 1), 0))
           / nullif(sum(n * factor) FILTER (factor * c < 1), 0), c)) AS c
    FROM f, c{i} GROUP BY c)""")
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(factor, 6) AS factor,
       round(least(factor * c, 1), 6) AS probability,
       ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT
           / 281474976710656.0 < least(factor * c, 1) AS sampled
FROM docs JOIN f USING (source, lang, topic), c{cut_rounds}
"""


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTER_WORDS = f"regexp_extract_all({_lower("coalesce(text, '')")}, '{_LETTERS}')"

_OP2 = f"""
WITH items AS MATERIALIZED (
    SELECT item_id::VARCHAR AS item_id, {_LETTER_WORDS} AS words FROM benchmark
), wanted AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(words), 10) AS n,
           array_to_string(words[place:place + least(len(words), 10) - 1], ' ') AS span
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS place FROM items
          WHERE len(words) > 0)
), docs AS MATERIALIZED (SELECT doc_id, {_LETTER_WORDS} AS words FROM documents),
spans AS (
    SELECT doc_id, n, place, array_to_string(words[place:place + n - 1], ' ') AS span
    FROM (SELECT docs.*, n, unnest(range(1, len(words) - n + 2)) AS place
          FROM docs, (SELECT DISTINCT n FROM wanted) WHERE len(words) >= n)
), found AS MATERIALIZED (SELECT doc_id, n, place, item_id FROM spans JOIN wanted USING (n, span)),
hits AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(place, place + n)) AS word FROM found) GROUP BY doc_id
), names AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""

_OP3 = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, {_lower("trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))")} AS key
    FROM lines
), often AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT keyed.*, holder IS NOT NULL AND doc_id <> holder AS dropped
    FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP10 = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
placed AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM docs
), windows AS MATERIALIZED (
    SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS phrase FROM placed
), held AS (SELECT phrase, min(doc_id) AS holder FROM windows GROUP BY phrase),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place
    FROM windows JOIN held USING (phrase) WHERE holder < doc_id
), words AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs
), judged AS (
    SELECT words.*, gone.place IS NOT NULL AS dropped FROM words LEFT JOIN gone USING (doc_id, place)
), counted AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE dropped) AS n_removed,
           string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT dropped) AS kept
    FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (doc_id)
"""

_OP9 = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')
        AS words FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(words[place:place + 3], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 2, 2))) AS place FROM docs
          WHERE len(words) > 0)
), sets AS MATERIALIZED (
    SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS key
    FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
        FROM shingles x JOIN shingles y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION SELECT doc_id, b FROM reach JOIN links ON a = other
)
SELECT doc_id, coalesce(n, 0) AS n_shingles,
       CASE WHEN key IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY key) END AS class_id,
       component_id
FROM docs LEFT JOIN sets USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_OP13 = rf"""
WITH docs AS MATERIALIZED (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           row_number() OVER () AS row,
           regexp_extract_all({_lower("coalesce(text, '')")},
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), occurrences AS (SELECT lang, source, row, unnest(terms) AS term FROM docs),
counts AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs
    FROM occurrences GROUP BY ALL
), kept AS MATERIALIZED (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30
), groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
shares AS MATERIALIZED (
    SELECT lang, source, term, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5))
               // (sum(coalesce(c.n, 0)::HUGEINT) OVER g + 5 * count(*) OVER g) AS p
    FROM groups JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)
    WINDOW g AS (PARTITION BY lang, source)
), of_lang AS (
    SELECT lang, term,
           1 + (1000000000 * (n + 5)) // (sum(n) OVER l + 5 * count(*) OVER l) AS q
    FROM kept WINDOW l AS (PARTITION BY lang)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), ranked AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares JOIN of_lang USING (lang, term)
    WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (
          PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50
"""

ORACLE: dict[str, str] = {
    "op1_mixing": _op1(),
    "op2_decontamination": _OP2,
    "op3_line_dedup": _OP3,
    "op9_ngram_join": _OP9,
    "op10_substring_dedup": _OP10,
    "op13_source_divergence": _OP13,
}
