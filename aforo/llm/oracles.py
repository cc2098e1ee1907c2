"""DuckDB SQL for the training-data queries that SQL can express.

The others rest on a tokenizer library, on learning, on iteration or on dynamic programming: their tests compare them with
brute force, with the library itself or by an exact round trip."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase FROM i, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k) x WHERE len(w) > 0),
dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM d, (SELECT DISTINCT n FROM iw) l, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k) x),
hits AS (SELECT r, k, dw.n, item FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.n = iw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
x AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM d), c AS (SELECT term, count(*) AS n FROM x GROUP BY term),
it AS (SELECT DISTINCT item, unnest(w) AS term FROM i), ch AS (SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY n, encode(term)) AS rnk FROM it JOIN c USING (term) QUALIFY rnk <= 5),
m AS (SELECT item, count(*) AS m FROM ch GROUP BY item HAVING count(*) > 1),
nr AS (SELECT p.r, count(DISTINCT p.item) AS n_near FROM (SELECT x.r, x.k, ch.item, m.m FROM x JOIN ch ON x.term = ch.term AND ch.rnk = 1 JOIN m ON m.item = ch.item) p WHERE
  (SELECT count(DISTINCT o.rnk) FROM ch o JOIN x y ON y.term = o.term WHERE o.item = p.item AND o.rnk > 1 AND y.r = p.r AND y.k BETWEEN p.k - 32 AND p.k + 32) = p.m - 1 GROUP BY p.r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN nr USING (r)"""

OP9 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents), x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT r, k, a, lag(a) OVER s AS b, lag(a, 2) OVER s AS c FROM x WINDOW s AS (PARTITION BY r ORDER BY k)), u AS (SELECT a, count(*) AS n FROM t GROUP BY a), v AS (SELECT b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, a),
z AS (SELECT c, b, a, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c, b, a), total AS (SELECT count(*) AS n FROM t),
e AS (SELECT t.r, CASE WHEN z.n >= 2 THEN ln(z.n) - ln(vc.n) WHEN v.n >= 2 THEN ln(v.n) - ln(uc.n) + CASE WHEN t.c IS NOT NULL THEN ln(0.4) ELSE 0 END
    ELSE ln(u.n) - ln(total.n) + CASE WHEN t.c IS NOT NULL THEN 2 * ln(0.4) WHEN t.b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS s, CASE WHEN t.c IS NOT NULL THEN coalesce(z.n, 0) < 2 WHEN t.b IS NOT NULL THEN coalesce(v.n, 0) < 2 ELSE false END AS bo
  FROM t CROSS JOIN total JOIN u ON u.a = t.a LEFT JOIN v ON v.b = t.b AND v.a = t.a LEFT JOIN z ON z.c = t.c AND z.b = t.b AND z.a = t.a LEFT JOIN u uc ON uc.a = t.b LEFT JOIN v vc ON vc.b = t.c AND vc.a = t.b)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(f.nb, 0) AS n_backoff, coalesce(f.s, 0.0) AS log_score FROM d LEFT JOIN (SELECT r, count(*) FILTER (WHERE bo) AS nb, round(sum(s), 4) AS s FROM e GROUP BY r) f USING (r)"""

OP11 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS MATERIALIZED (SELECT r, vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT a, a AS b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a), m AS (SELECT c.a, min(v.vec_id) AS least FROM c JOIN v ON v.r = c.b GROUP BY c.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(least, vec_id) AS kept FROM v LEFT JOIN m ON m.a = v.r LEFT JOIN n ON n.a = v.r"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END".format
_LEAF = f"sha256({_FIELD('doc_id')} || {_FIELD('source')} || {_FIELD('lang')} || {{}} || {_FIELD('text')})"
#: the CRC of a number's decimal digits, a bit at a time
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: list_concat([CAST(ascii(d) AS BIGINT)], [CAST(-1 AS BIGINT) for k in range(8)])))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
_LEVEL = "[sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) for k in range((len(nodes) + 1) // 2)]"
OP12 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(_FIELD('n_chars'))} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_LEAF.format(_FIELD('(n_chars + 1)'))} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT tree, 0 AS h, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY tree UNION ALL SELECT tree, h + 1, {_LEVEL} FROM t WHERE len(nodes) > 1),
s AS (SELECT tree, nodes[1] AS subroot, h AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS h, list(subroot ORDER BY place) AS nodes FROM s UNION ALL SELECT h + 1, {_LEVEL} FROM u WHERE len(nodes) > 1),
w AS (SELECT max(h) AS levels, max(CASE WHEN len(nodes) = 1 THEN nodes[1] END) AS root FROM u),
q AS (SELECT p.*, subroot, root, height, place, coalesce(tampered, leaf) AS given, height + levels AS steps, row_number() OVER () AS r FROM p JOIN s USING (tree) CROSS JOIN w),
b AS (SELECT r, h, pos // CAST(pow(2, h) AS BIGINT) AS i, nodes FROM q JOIN t USING (tree) WHERE h < height UNION ALL SELECT r, height + h, place // CAST(pow(2, h) AS BIGINT), nodes FROM q CROSS JOIN u WHERE h < steps - height),
x AS (SELECT r, h, i % 2 AS odd, coalesce(nodes[CASE WHEN i % 2 = 1 THEN i ELSE i + 2 END], '') AS sibling FROM b),
f AS (SELECT r, 0 AS h, given AS got FROM q UNION ALL SELECT f.r, f.h + 1, sha256(CASE WHEN odd = 1 THEN sibling || got ELSE got || sibling END) FROM f JOIN x ON x.r = f.r AND x.h = f.h),
y AS (SELECT r, sha256(string_agg(sibling, '' ORDER BY h)) AS proof FROM x GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, got AS folded_root, got = root AS verified FROM q JOIN f ON f.r = q.r AND f.h = q.steps LEFT JOIN y ON y.r = q.r"""

SQL: dict[str, str] = {"op1_decontamination": OP1, "op9_lm_scores": OP9, "op11_vector_links": OP11, "op12_merkle_manifest": OP12}
