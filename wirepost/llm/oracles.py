"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

#: bare base32 of a SHA-1: eight groups of twenty bits, four digits each
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {1 + 5 * g}, 5) AS BIGINT) >> {15 - 5 * d}) & 31 AS INT), 1)"
    for g in range(8) for d in range(4))



def crc32(text: str) -> str:
    """SQL of the unsigned crc32 of the UTF-8 bytes of `text`, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_transform(range(1, 1 + strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)))"""


ORACLES: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS response FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM h""",
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)""",
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, 1 + greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT w.doc_id, CAST(count(s.doc_id) AS BIGINT) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT n.doc_id, n_shingles, min(root) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1, 2""",
    "op8_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS span
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY span) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM r),
kept AS (SELECT doc_id, list(word ORDER BY pos) AS words FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w)
         ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(len(kept.words), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept.words, ' '), '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op4_url_reputation": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id, CASE WHEN min(quality) = max(quality) THEN 1 - max(quality) END AS bad FROM labels GROUP BY 1),
p AS (SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad FROM u LEFT JOIN o ON page_id = doc_id GROUP BY 1),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM p),
t AS (SELECT *, string_split(bare, '.') AS q, NOT contains(bare, '.') OR regexp_full_match(bare, '[0-9.]+') AS alone FROM b),
d AS (SELECT *, array_to_string(q[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') AS two FROM t),
h AS (SELECT host, n, bad, CASE WHEN alone THEN bare WHEN two THEN array_to_string(q[-3:], '.') ELSE array_to_string(q[-2:], '.') END AS domain,
  CASE WHEN alone THEN '' WHEN two THEN array_to_string(q[-2:], '.') ELSE q[-1] END AS suffix FROM d),
g AS (SELECT sum(bad) AS bad, sum(n) AS n FROM h),
s0 AS (SELECT q.*, (g.bad - q.bad + 0.5) / (g.n - q.n + 1) AS above FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1) q, g),
ks AS (SELECT 1 / least(greatest((sum(n * pow(bad / n - above, 2) / greatest(above * (1 - above), 1e-9)) - count(*)) / greatest(sum(n - 1), 1), 0.005), 0.5) - 1 AS k FROM s0 WHERE n > 0),
s1 AS (SELECT *, coalesce(k, 199) AS strength FROM s0, ks),
d0 AS (SELECT q.*, (s1.strength * s1.above + s1.bad - q.bad) / (s1.strength + s1.n - q.n) AS above FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2) q JOIN s1 ON q.suffix = s1.suffix),
kd AS (SELECT 1 / least(greatest((sum(n * pow(bad / n - above, 2) / greatest(above * (1 - above), 1e-9)) - count(*)) / greatest(sum(n - 1), 1), 0.005), 0.5) - 1 AS k FROM d0 WHERE n > 0),
d1 AS (SELECT *, coalesce(k, 199) AS strength FROM d0, kd),
h0 AS (SELECT h.*, (d1.strength * d1.above + d1.bad - h.bad) / (d1.strength + d1.n - h.n) AS above FROM h JOIN d1 ON h.domain = d1.domain),
kh AS (SELECT 1 / least(greatest((sum(n * pow(bad / n - above, 2) / greatest(above * (1 - above), 1e-9)) - count(*)) / greatest(sum(n - 1), 1), 0.005), 0.5) - 1 AS k FROM h0 WHERE n > 0),
h1 AS (SELECT host, n, k, (k * above + bad) / (k + n) AS mean FROM (SELECT h0.host, h0.n, h0.bad, h0.above, coalesce(kh.k, 199) AS k FROM h0, kh)),
h2 AS (SELECT host, mean, CASE WHEN (SELECT n FROM g) = 0 THEN 0.0 ELSE mean - 2 * sqrt(mean * (1 - mean) / (k + n + 1)) END AS bound FROM h1),
r AS (SELECT u.*, mean, bound, CASE
  WHEN (u.host = 'example.net' OR ends_with(u.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (u.host = 'example.com' OR ends_with(u.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (u.host = 'net' OR ends_with(u.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u JOIN h2 ON u.host = h2.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, mean, bound FROM r""",
    "op11_spelling": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT run, doc_id || ':' || run AS named, count(*) AS c FROM r GROUP BY ALL),
e AS (SELECT run, c, {crc32("named")} AS h FROM d WHERE length(run) >= 6),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
        SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM e)
      WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
k AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM k a JOIN k b ON a.hole = b.hole AND a.word <> b.word
      UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON k.rest = v.word
      UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON k.rest = v.word),
q AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN best END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
      FROM v LEFT JOIN q ON v.word = q.word),
t(word, root) AS (SELECT word, word FROM f UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word JOIN f g ON t.root = g.word WHERE g.form IS NULL""",
    "op12_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words ELSE words[i:i + 1] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, 1 + greatest(len(words) - 1, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT w.doc_id, CAST(count(s.doc_id) AS BIGINT) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
z AS (SELECT shingle, row_number() OVER (ORDER BY count(*), shingle) AS token FROM s GROUP BY 1),
h AS (SELECT s.doc_id, token, n_shingles AS n, row_number() OVER (PARTITION BY s.doc_id ORDER BY token) AS at
      FROM s JOIN n ON s.doc_id = n.doc_id JOIN z ON s.shingle = z.shingle),
o AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS x, b.n AS y FROM h a JOIN h b ON a.token = b.token AND a.doc_id < b.doc_id
      WHERE a.at <= a.n - ceil(a.n * 80 / 100.0) + 1 AND b.at <= b.n - ceil(b.n * 80 / 100.0) + 1 AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
p AS (SELECT o.a, o.b, x, y, count(*) AS c FROM o JOIN h i ON o.a = i.doc_id JOIN h j ON o.b = j.doc_id AND i.token = j.token GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (x + y - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT m.b, r.root FROM r JOIN m ON r.doc_id = m.a)
SELECT n.doc_id, n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1, 2""",
    "op13_conversation_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= h
      UNION ALL SELECT c.conv_id, h + t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h),
g AS (SELECT c.conv_id, coalesce(p, []) AS p FROM c LEFT JOIN (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS p FROM b GROUP BY 1) q
      ON c.conv_id = q.conv_id),
x AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM g),
n AS (SELECT p[:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = d), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
k AS (SELECT node[:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.node[d].text) ELSE 0 END AS saved FROM n LEFT JOIN k ON n.node = k.node),
u AS (SELECT node[:e] AS node, sum(saved) AS saved, count_if(n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, parent.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u ON f.node = u.node LEFT JOIN n parent ON f.d > 0 AND parent.node = f.node[:f.d - 1]""",
}
