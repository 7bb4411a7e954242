"""DuckDB SQL for the rows of the numbered queries, where SQL can express them."""

from granary.llm.quality import BOILERPLATE

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_FILTER = rf"""
WITH rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), fits AS (
  SELECT p.r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY p.r
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN fits USING (r)
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS.format("text")}), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), c AS (
  SELECT *, 3e0 * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM w
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS j FROM c
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, j) FROM l WHERE level <= cap / weight)) AS target FROM l
), b AS (
  SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t
)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - upto, 0), size))::BIGINT AS taken
FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS upto FROM d) AS d
JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

_PHRASES = " OR ".join("contains(lower(line), '{}')".format(x.replace("'", "''")) for x in BOILERPLATE)
QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT r, {WORDS.format("text")} AS x FROM d)
), t AS (
  SELECT *, lead(w) OVER (PARTITION BY r ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w2 FROM w
), f AS (
  SELECT r, i, w, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS f FROM t
), g AS (
  SELECT r, w, f OR coalesce(lag(f) OVER (PARTITION BY r ORDER BY i), false) OR coalesce(lag(f, 2) OVER (PARTITION BY r ORDER BY i), false) AS again FROM f
), by_words AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (again) AS n_repeat_words FROM g GROUP BY r
), l AS (
  SELECT r, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT r, string_split(text, chr(10)) AS x FROM d)
), m AS (
  SELECT r, line, {WORDS.format("line")} AS x, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS seen FROM l
), n AS (
  SELECT *, len(x) AS nw, len(list_filter(x, lambda v: v IN ('|', '»', '›', '•', '·', '>', '/'))) AS marks, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals
  FROM m WHERE len(x) > 0
), j AS (
  SELECT r, line, x, seen, marks >= 3 AND marks * 3 >= nw - marks OR nw >= 3 AND 100 * symbols >= 25 * nw OR nw >= 5 AND letters > 0 AND 100 * capitals >= 80 * letters OR seen
    OR nw <= 20 AND ({_PHRASES})
    OR nw > 12 AND NOT regexp_matches(line, '[.!?…:;,。！？।؟]["''”’»)\]}}*_]*\s*$') AND NOT regexp_matches(line, '[.!?…]') AS fails
  FROM n
), by_lines AS (
  SELECT r, count(*) FILTER (seen) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE length(array_to_string(x, '')) END) AS kept_chars FROM j GROUP BY r
), a AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM d LEFT JOIN by_words USING (r) LEFT JOIN by_lines USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kept_chars >= 50 * word_chars AS kept, kept_chars FROM v
"""

MINHASH = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), h AS (
  SELECT s.doc_id, n, g FROM s JOIN n USING (doc_id)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM h AS a JOIN h AS b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), c(id, reached) AS (
  SELECT DISTINCT a, a FROM p UNION SELECT c.id, p.b FROM c JOIN p ON c.reached = p.a
), m AS (
  SELECT id, min(reached) AS component_id FROM c GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_prepend(0e0, list_transform(list_zip(q.x, v.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda s, t: s + t)) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY rank <= 10
"""

_FOLDED = f"regexp_extract_all(translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The checksum's table of 256 by its rule, then a step for each byte, taken from the hexadecimal form.
RESAMPLING = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_FOLDED.format("text")} AS w FROM documents
), sw AS (
  SELECT r, unnest(w) AS g FROM d
), tw AS (
  SELECT unnest({_FOLDED.format("text")}) AS g FROM benchmark
), rule AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) AS t(i)
), crc AS (
  SELECT g, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))) % 10000 AS b
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM sw UNION SELECT g FROM tw)), rule
), s AS (
  SELECT b, count(*) AS n FROM sw JOIN crc USING (g) GROUP BY b
), t AS (
  SELECT b, count(*) AS n FROM tw JOIN crc USING (g) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (b)
), weighed AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM sw JOIN crc USING (g) JOIN gain USING (b) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 5e-1) / 4294967296e0)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), p AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e AS a JOIN e AS b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0
), near AS (
  SELECT r, o, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, o) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, near.o ORDER BY score DESC, vec_id, p.o)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN p USING (r) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES = {"op1_url_filter": URL_FILTER, "op2_mixing": MIXING, "op6_quality": QUALITY, "op8_minhash": MINHASH, "op10_nearest": NEAREST, "op11_resampling": RESAMPLING, "op13_hard_negatives": HARD_NEGATIVES}
