"""DuckDB SQL for those of the numbered operators' queries that SQL can express.

The others (trained models, approximate search, tokenizer, license and
disguise rules, the similarity join whose SQL is quadratic) are held against
brute-force versions and held-out labels in ``tests/llm``.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {}

ORACLES["op3_mixing_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')) AS key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), level AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM per
), steps AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)
             - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM level
), target AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT max(lvl) FROM steps WHERE lvl <= full_at), cap)) AS target FROM steps
), ruled AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM target
), placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, floor(r.target)::BIGINT - r.whole * r.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN ruled r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (whole * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM placed
"""

ORACLES["op4_benchmark_decontamination"] = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), items AS (
  SELECT item_id, w, least(13, len(w)) AS m, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS pos0 FROM iw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[pos0 + 1:pos0 + m], ' ') AS words FROM items
), lengths AS (
  SELECT DISTINCT m FROM windows
), places AS (
  SELECT doc_id, m, pos0, array_to_string(w[pos0 + 1:pos0 + m], ' ') AS words
  FROM (SELECT doc_id, w, m, unnest(range(0, greatest(0, len(w) - m + 1))) AS pos0 FROM dw, lengths)
), found AS (
  SELECT p.doc_id, p.pos0, p.m, i.item_id FROM places p JOIN windows i ON p.m = i.m AND p.words = i.words
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos0, pos0 + m)) AS pos FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       coalesce(n.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN names n USING (doc_id)
"""

# CRC-32 by bytes: hexadecimal digits of the feature, a table of 256 remainders worked out by the rule.
ORACLES["op11_importance_resampling"] = rf"""
WITH shifts AS (
  SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)
), texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'b', NULL, -row_number() OVER (), text FROM benchmark
), words AS (
  SELECT side, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM texts
), runs AS (
  SELECT side, row, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), per AS (
  SELECT side, row, f, count(*) AS n FROM runs GROUP BY 1, 2, 3
), coded AS (
  SELECT f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT f FROM per)
), hashed AS (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM coded, shifts
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM per JOIN hashed USING (f) GROUP BY 1
), sums AS (
  SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, sums
), weighed AS (
  SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM per JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE side = 'd'
), placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS many FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= many * 25 // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN placed USING (row)
"""
