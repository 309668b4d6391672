"""DuckDB SQL for the queries that SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT a, a FROM both_ UNION SELECT both_.b, r.other FROM r JOIN both_ ON r.doc_id = both_.a),
m AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 20"""

#: Base32 from the digest's hex digits, five of them at a time.
CAPTURES = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, url, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substring(h, 1 + i // 4 * 5, 5) AS INTEGER) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest FROM p),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM b GROUP BY ALL),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT page_id, CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(rest, '^[^/?#]*')), '^www[.]', ''), '.')), ',') || ')' || regexp_replace(rest, '^[^/?#]*', '') END AS url_key, TIMESTAMP '2024-01-01' + to_seconds(page_id % 2147483648) AS captured FROM u),
o AS (SELECT page_id, row_number() OVER (ORDER BY url_key, captured, page_id) AS history_rank FROM k)
SELECT b.page_id, b.payload_bytes, b.payload_digest, CASE WHEN f.first = b.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f.first <> b.page_id THEN f.first END AS refers_to, o.history_rank FROM b JOIN f USING (payload_digest, payload_bytes) JOIN o ON o.page_id = b.page_id"""


#: Documents are counted by part and failures first; each order's step then sums what fails its filter and none before.
FILTER_AUDIT = r"""
WITH l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS filter, '[' || filter_order[1:step] || ']' AS upto, CASE WHEN step > 1 THEN '[' || filter_order[1:step - 1] || ']' ELSE '[.]{9}' END AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
  CAST(sum(CASE WHEN NOT regexp_matches(fails, upto) THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN contains(fails, filter) AND NOT regexp_matches(fails, before) THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN contains(fails, filter) AND regexp_matches(fails, before) THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN contains(fails, filter) AND NOT regexp_matches(fails, before) THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN contains(fails, filter) AND NOT regexp_matches(fails, before) THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""


#: Levels that the SQL has for a source's tree and for the tree of sources: 16**6 leaves and 16**3 sources.
HEIGHTS = (6, 3)


def _tree(name: str, leaves: str, height: int) -> str:
    """Tables name_0, ... of (key, index, h, n), a level each; a level of one node stays as it is."""
    up = "SELECT key, index // 16 AS index, sha256(string_agg(h, '' ORDER BY index)) AS h, (n + 15) // 16 AS n FROM {0} WHERE n > 1 GROUP BY key, index // 16, n UNION ALL SELECT key, index, h, n FROM {0} WHERE n = 1"
    return ",\n".join([f"{name}_0 AS ({leaves})", *(f"{name}_{k} AS ({up.format(f'{name}_{k - 1}')})" for k in range(1, height + 1))])


def manifest() -> str:
    """Every level of both trees as a table of its own; a row meets its run in each by its index."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {1} END"
    fields = [field.format(c, c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = f"sha256({' || '.join([*fields, field.format('text', 'text')])})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    altered = f"sha256({' || '.join([*fields, field.format('text', low)])})"
    rows, over = HEIGHTS
    key = "CASE WHEN source IS NULL THEN '' ELSE '=' || source END"
    steps, proof, last = [], [], "d"
    for tree, height, at in (("t", rows, "index"), ("u", over, "source_index")):
        for k in range(height):
            run = f"(SELECT list(h ORDER BY index) FROM {tree}_{k} x WHERE x.key = {'p.key' if tree == 't' else chr(39) * 2} AND x.n > 1 AND x.index // 16 = p.{at} // {16 ** (k + 1)})"
            place = f"{at} // {16**k} % 16"
            steps.append(f"{tree}{k} AS (SELECT * EXCLUDE (run), CASE WHEN run IS NULL THEN folded ELSE sha256(array_to_string(run[:{place}] || [folded] || run[{place} + 2:], '')) END AS folded_, CASE WHEN run IS NULL THEN '' ELSE array_to_string(run[:{place}] || run[{place} + 2:], '') END AS proof_{tree}{k} FROM (SELECT p.*, {run} AS run FROM {last} p))")
            steps.append(f"{tree}{k}b AS (SELECT * EXCLUDE (folded, folded_), folded_ AS folded FROM {tree}{k})")
            proof.append(f"proof_{tree}{k}")
            last = f"{tree}{k}b"
    return f"""
WITH l AS (SELECT doc_id, {key} AS key, {leaf} AS leaf, {altered} AS altered FROM documents),
c(crc) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)))),
h AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]), CAST(4294967295 AS BIGINT))) % 5 END AS crc5 FROM l, c),
o AS (SELECT doc_id, key, leaf, CASE WHEN crc5 = 0 THEN altered ELSE leaf END AS shown, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS index FROM h),
{_tree("t", "SELECT key, index, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM o", rows)},
s AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS index FROM t_{rows}),
{_tree("u", "SELECT '' AS key, index, subroot AS h, count(*) OVER () AS n FROM s", over)},
d AS (SELECT o.doc_id, o.key, o.leaf, o.index, o.shown AS folded, s.subroot, s.index AS source_index, u_{over}.h AS root FROM o JOIN s USING (key), u_{over}),
{("," + chr(10)).join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(proof)}) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"""
