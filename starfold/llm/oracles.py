"""DuckDB SQL for those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

#: CRC32 of a text's bytes, in SQL: its table by the polynomial's rule, then one step a byte.
_CRC32 = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
 sized AS (SELECT doc_id, source, octet_length(b) + 16 AS size,
   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)),
     lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32
   FROM (SELECT doc_id, source, encode(coalesce(text, '')) AS b FROM documents), crc_table)"""

OP13_SHARDING = f"""WITH {_CRC32},
 keyed AS (SELECT *, coalesce('=' || source, '') AS stratum,
   ('0x' || substr(md5(concat_ws('|', '13', doc_id::VARCHAR, size::VARCHAR, text_crc32::VARCHAR)), 1, 15))::BIGINT AS h FROM sized),
 ranked AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 0.5::DOUBLE)
   / count(*) OVER (PARTITION BY stratum) AS share FROM keyed),
 placed AS (SELECT *, row_number() OVER (ORDER BY share, stratum) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (place * 40 // total)::INTEGER AS shard,
 (place - ((place * 40 // total) * total + 39) // 40)::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""

#: All anchors against all rows.
OP11_HARD_NEGATIVES = """WITH good AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
   list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS score FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 met AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
   row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
   FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score FROM met WHERE rank <= 5"""

#: Containment by comparing each candidate with all longer ones, as text between spaces.
OP12_COLLOCATIONS = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
 totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
 grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))) AS phrase
   FROM words, range(1, 5) t(m) WHERE len(w) >= m),
 f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
 cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
   FROM f, range(1, 4) t(k) WHERE k < m),
 scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f)::HUGEINT AS score, k
   FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
 lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = c.lang AND g.m > len(string_split(c.phrase, ' '))
   AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * g.f >= 80 * c.a)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11_HARD_NEGATIVES, "op12_collocations": OP12_COLLOCATIONS, "op13_sharding": OP13_SHARDING}
