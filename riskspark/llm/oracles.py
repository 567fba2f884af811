"""DuckDB SQL for the queries that SQL can express over whole tables, written apart from the operators."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"

#: A number in [0, 1) from the first 48 bits of an MD5.
DRAW = "(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"

#: CRC-32 of the bytes of t, bit by bit over the table of single bytes.
OP2 = f"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
hashed AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents CROSS JOIN bits),
drawn AS (SELECT *, {DRAW.format(text="'42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32")} AS draw,
    {DRAW.format(text="'42:' || coalesce('source:' || source, 'null')")} AS phase FROM hashed),
placed AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size, text_crc32) - 1 + phase)
    / count(*) OVER (PARTITION BY source) AS place FROM drawn),
ordered AS (SELECT *, row_number() OVER (ORDER BY place, source NULLS FIRST, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos,
    count(*) OVER () AS total FROM placed),
cut AS (SELECT *, pos * 40 // total AS shard FROM ordered)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM cut"""

OP6 = f"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)"""

OP9 = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    {DRAW.format(text="'42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS draw FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM sources),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM ranked),
filled AS (SELECT *, source_size * 2.0::DOUBLE / w AS brim, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aimed AS (SELECT *, least(source_size * 2.0::DOUBLE,
    coalesce((SELECT level FROM filled WHERE brim > level ORDER BY brim, k LIMIT 1) * w, 'inf'::DOUBLE)) AS target FROM filled),
seats AS (SELECT source, target / (2 * unnest(range(CAST(round((SELECT sum(target) FROM aimed) / 32) AS BIGINT))) + 1) AS q, k
  FROM aimed),
placed AS (SELECT source, row_number() OVER (ORDER BY q DESC, k) AS place FROM seats),
houses AS (SELECT house, floor((SELECT round(sum(target) / 32) FROM aimed) * house / 8) AS seats FROM range(1, 9) t(house)),
ends AS (SELECT a.source, house, least(32 * (SELECT count(*) FROM placed p WHERE p.source IS NOT DISTINCT FROM a.source
    AND place <= seats), source_size * 2) AS upto FROM aimed a CROSS JOIN houses),
runs AS (SELECT source, house - 1 AS shard, lag(upto, 1, 0) OVER (PARTITION BY source ORDER BY house) AS first, upto FROM ends),
ordered AS (SELECT *, row_number() OVER () AS row, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size
    ROWS UNBOUNDED PRECEDING) - size AS before FROM sized),
cut AS (SELECT row, shard, again, greatest(first - again * source_size - before, 0) AS start,
    least(upto - again * source_size - before, size) AS until FROM ordered o
  JOIN aimed a ON o.source IS NOT DISTINCT FROM a.source JOIN runs r ON o.source IS NOT DISTINCT FROM r.source
  CROSS JOIN range(3) t(again)),
taken AS (SELECT row, sum(until - start) AS taken, string_agg(shard || ':' || CAST(start AS BIGINT) || '+'
    || CAST(until - start AS BIGINT), ',' ORDER BY shard, again) AS stretches FROM cut WHERE until > start GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
  coalesce(stretches, '') AS stretches
FROM ordered o JOIN aimed a ON o.source IS NOT DISTINCT FROM a.source LEFT JOIN taken USING (row)"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all({LOWER.format(text='text')}, '{TERM}')) AS term
  FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format(text='text')}, '{TERM}')) AS term FROM benchmark),
sized AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM docs GROUP BY row),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
held AS (SELECT row, term, count(*) AS tf FROM docs WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, total GROUP BY term, n_docs),
scored AS (SELECT item_id, row, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term) JOIN sized USING (row), total GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10"""

ORACLES = {"op2_interleave": OP2, "op6_exact_dedup": OP6, "op9_mixing": OP9, "op12_lexical_search": OP12}
