"""DuckDB SQL of the queries that SQL can express."""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAYLOAD = "encode(coalesce(html, ''))"

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, count(*) AS docs, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sources
), ordered AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio,
         1.5 * sum(source_size) OVER () AS wanted, sum(weight) OVER () AS all_weight
  FROM weighed
), filled AS (
  SELECT *, wanted - coalesce(sum(cap) OVER below, 0) AS rest_words,
         all_weight - coalesce(sum(weight) OVER below, 0) AS rest_weight
  FROM ordered
  WINDOW below AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest_words, rest_weight FROM filled WHERE cap * rest_weight > weight * rest_words
  ORDER BY ratio, encode(source) NULLS LAST LIMIT 1
), targets AS (
  SELECT source, docs, source_size, CASE WHEN source_size = 0 THEN 0.0
         ELSE least(cap, coalesce(weight * rest_words / rest_weight, cap)) END AS target
  FROM ordered LEFT JOIN level ON true
), placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         least(floor(s.key::DOUBLE / 1152921504606846976.0::DOUBLE * ceil(t.docs / 8192)), ceil(t.docs / 8192) - 1) AS bucket
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), units AS (
  SELECT source, bucket, key, size, rate, count(*) AS n FROM placed GROUP BY ALL
), run AS (
  SELECT *, sum(size * n) OVER (PARTITION BY source, bucket ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS upto,
         floor(sum(size * n) OVER (PARTITION BY source, bucket) * (rate - floor(rate)) + 0.5) AS quota
  FROM units
), chosen AS (
  SELECT source, bucket, key, size,
         CASE WHEN upto <= quota THEN size WHEN upto - size * n < quota THEN floor((quota - (upto - size * n)) / n) ELSE 0 END AS extra
  FROM run
)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target::DOUBLE AS target,
       (floor(p.rate) * p.size + c.extra)::BIGINT AS taken
FROM placed p JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source AND p.bucket = c.bucket AND p.key = c.key AND p.size = c.size
"""

_LETTERS = " || ".join(
    f"substr('{BASE32}', (((('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT >> {s}) & 31) + 1)::INT, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
OP3 = f"""
WITH hashed AS (SELECT page_id, octet_length({PAYLOAD})::BIGINT AS payload_bytes, sha1({PAYLOAD}) AS hex FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest FROM hashed)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN latest IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest IS DISTINCT FROM page_id THEN latest END AS refers_to
FROM grouped
"""

# Links are followed to every row that they reach, so this is for small tables.
REACH = """, reach AS (
  SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id
), lowest AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

OP6 = f"""
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), both_ways AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
){REACH}, counted AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(w.component_id, e.vec_id) AS component_id,
       coalesce(w.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN lowest w ON w.id = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

OP10 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT id, list_distinct(CASE WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), nodes AS (SELECT id, len(s) AS n FROM sets), shingles AS (SELECT id, unnest(s) AS e FROM sets),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.e = y.e AND x.id < y.id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links){REACH}
SELECT n.id AS doc_id, n.n::BIGINT AS n_shingles, w.component_id, n.id = w.component_id AS kept
FROM nodes n JOIN lowest w ON w.id = n.id
"""

OP13 = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         length(coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'k': k, 'p': p} ORDER BY turn NULLS FIRST, k, p) AS turns FROM turns GROUP BY conv_id
), shared AS (
  SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM own o, crc
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM shared c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d AS depth, d = len(turns) AS ends, coalesce(turns[d].p, 0) AS p,
         md5(array_to_string(list_transform(turns[1:d], lambda x: x.k), '') || d) AS node,
         md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), '') || (d - 1)) AS parent
  FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)
), nodes AS (
  SELECT node, min(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(p) AS weight,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM nodes n
  LEFT JOIN nodes p ON p.node = n.parent AND n.depth > 0
  LEFT JOIN (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent) c ON c.parent = n.node
), sums AS (
  SELECT a.node, sum(v.weight) AS saved_tokens, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM counted v JOIN prefixes a ON a.conv_id = v.conv_id AND a.depth <= v.depth
  GROUP BY a.node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (node)
"""

ORACLES: dict[str, str] = {"op2_mixing": OP2, "op3_warc": OP3, "op6_gridjoin": OP6, "op10_superminhash": OP10, "op13_prefixtrie": OP13}
