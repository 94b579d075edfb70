"""The corpus queries in DuckDB's SQL, for those that SQL can say."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w
  FROM d GROUP BY source),
t AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_from FROM t),
l AS (SELECT (total - full_before) / open_from AS level FROM o WHERE (total - full_before) / open_from * w < cap ORDER BY cap / w, source LIMIT 1),
g AS (SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM l), 'infinity'::DOUBLE)) AS target FROM t),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

SUFFIX_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
g AS (SELECT rid, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT rid) > 1),
c AS (SELECT DISTINCT rid, doc_id, i - 1 AS a, i + 49 AS b FROM g WHERE h IN (SELECT h FROM s)),
f AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY rid ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM c),
r AS (SELECT *, count_if(fresh) OVER (PARTITION BY rid ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f)
SELECT doc_id, CAST(min(a) AS BIGINT) AS start_word, CAST(max(b) - min(a) AS BIGINT) AS n_words FROM r GROUP BY rid, doc_id, run
"""

#: The CRC-32 remainders of four bits.
CRC_NIBBLES = (0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C)


def _crc32(text: str) -> str:
    table = "[" + ", ".join(f"{v}::BIGINT" for v in CRC_NIBBLES) + "]"
    four = lambda c: f"xor({table}[({c} & 15) + 1], {c} >> 4)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: {four(four('xor(c, b)'))}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _draw(name: str, weight: float = 1.0) -> str:
    return f"-ln((('0x' || substr(md5({name} || '|' || k), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {weight}::DOUBLE"


def _least(children: dict[str, str]) -> str:
    """The name of the child of the least draw; names and draws in SQL."""
    listed = ", ".join(f"{{'d': {d}, 'n': {n}}}" for n, d in children.items())
    return f"list_sort([{listed}])[1].n"


_REGIONS = {f"'g{i}'": _draw(f"'/g{i}'", 4.0) for i in range(4)}
HASH_TREE_SHARDS = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, k, CAST(strlen(t) + 1 AS BIGINT) AS size, {_crc32("t")} AS crc, {_least(_REGIONS)} AS region, {_least(_REGIONS | {"'g+16'": _draw("'/g+16'", 1.0)})} AS grown FROM d),
r AS (SELECT *, {_least({f"'r{i}'": _draw(f"'/' || region || '/r{i}'", 2.0) for i in range(2)})} AS rack FROM c),
o AS (SELECT *, 4 * substr(region, 2)::INTEGER + 2 * substr(rack, 2)::INTEGER AS first FROM r),
s AS (SELECT *, CAST({_least({f"first + {i}": _draw(f"'/' || region || '/' || rack || '/' || (first + {i})", 1.0) for i in range(2)})} AS INTEGER) AS shard FROM o),
b AS (SELECT *, ('0x' || substr(md5('slot|' || k || '|' || crc), 1, 8))::BIGINT % (SELECT greatest(8, count(*) // 320000 + 1) FROM documents) AS bucket FROM s)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, crc) - 1 AS slot,
       CASE WHEN grown = 'g+16' THEN 16 ELSE shard END AS grown_shard
FROM b
"""

BACKOFF_SCORES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{WORDS}') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (
  SELECT rid, i, 1 AS m, w[i] AS gram FROM p UNION ALL SELECT rid, i, 2, array_to_string(w[i - 1 : i], ' ') FROM p WHERE i >= 2
  UNION ALL SELECT rid, i, 3, array_to_string(w[i - 2 : i], ' ') FROM p WHERE i >= 3),
o AS (SELECT m, gram, rid, count(*) AS n FROM g GROUP BY ALL),
x AS (SELECT m, gram, rid, sum(n) OVER (PARTITION BY m, gram) - n AS others FROM o),
c AS (
  SELECT g.rid, g.i, max(others) FILTER (WHERE g.m = 1) AS n1, max(others) FILTER (WHERE g.m = 2) AS n2, max(others) FILTER (WHERE g.m = 3) AS n3
  FROM g JOIN x USING (m, gram, rid) GROUP BY g.rid, g.i),
b AS (SELECT *, lag(n1) OVER (PARTITION BY rid ORDER BY i) AS b1, lag(n2) OVER (PARTITION BY rid ORDER BY i) AS b2 FROM c),
z AS (SELECT rid, len(w) AS n_words, greatest((SELECT count(*) FROM p) - len(w), 1) AS rest FROM d),
s1 AS (SELECT *, CASE WHEN n1 > 0 THEN n1::DOUBLE ELSE 0.4::DOUBLE END / rest AS a FROM b JOIN z USING (rid)),
s2 AS (SELECT *, CASE WHEN n2 > 0 THEN n2::DOUBLE / greatest(b1, 1) WHEN n2 = 0 THEN 0.4::DOUBLE * a ELSE a END AS e FROM s1),
s3 AS (SELECT rid, CASE WHEN n3 > 0 THEN n3::DOUBLE / greatest(b2, 1) WHEN n3 = 0 THEN 0.4::DOUBLE * e ELSE e END AS s FROM s2),
t AS (SELECT rid, sum(ln(s)) AS total FROM s3 GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, round(coalesce(total, 0.0::DOUBLE), 3) AS log_score, CASE WHEN n_words > 0 THEN round(total / n_words, 6) END AS mean_log_score
FROM d JOIN z USING (rid) LEFT JOIN t USING (rid)
"""

NGRAM_JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, m.least) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i : i + m - 1] AS g, count(*) AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) AS o(m)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE len(g) = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE a >= 30),
c AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
s AS (
  SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, a, len(g) AS size, g, m, unnest(range(1, len(g) - m + 2)) AS i FROM b, range(2, 4) AS o(m) WHERE len(g) > m),
v AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS longer FROM i GROUP BY ALL),
k AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN v ON v.lang = b.lang AND v.g = b.g WHERE v.longer IS NULL OR 100 * v.longer < 80 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(w, 1, a), '') AS prefix, array_to_string(list_slice(w, a + 1, b), '') AS middle,
         array_to_string(list_slice(w, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""

SQL = {
    "op1_source_mix": SOURCE_MIX,
    "op2_suffix_dedup": SUFFIX_DEDUP,
    "op4_hash_tree_shards": HASH_TREE_SHARDS,
    "op7_backoff_scores": BACKOFF_SCORES,
    "op8_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op9_exact_dedup": EXACT_DEDUP,
    "op11_collocations": COLLOCATIONS,
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
