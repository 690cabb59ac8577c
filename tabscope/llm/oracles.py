"""DuckDB SQL for the operators that SQL can express."""

_SAID = r"\### Assistant: </turn> ok"


def _escaped(text: str) -> str:
    return rf"replace(replace(replace({text}, '\', '\b'), '#', '\h'), '<', '\l')"


_ORDER = "ORDER BY turn NULLS FIRST, role, text"

OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}')
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(replace({_escaped('role')}, ':', '\\c')) + length(': ')
       + length({_escaped('text')}) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_UPPER = "".join(map(chr, range(65, 91)))

OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY 1, 2),
link AS (SELECT a, b FROM both_of JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT sym.a, reach.r FROM reach JOIN sym ON sym.b = reach.doc_id)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id, min(r) = w.doc_id AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id"""

# every item has five words or more in the bundled tables
OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p,
              unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS x FROM d),
i5 AS (SELECT item_id, len(w) AS m, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')))
       AS x FROM i),
isn AS (SELECT item_id, m, x, COUNT(*) AS c FROM i5 GROUP BY ALL),
hit AS (SELECT doc_id, item_id, n, m, least(n, m) AS size, p, x, c FROM ds JOIN isn USING (x)),
win AS (SELECT DISTINCT doc_id, item_id, m, size,
          unnest(range(greatest(0, p - (size - 5)), least(p, n - size) + 1)) AS start FROM hit),
found AS (SELECT doc_id, item_id, m, size, start, x, least(COUNT(*), max(c)) AS k FROM win JOIN hit
          USING (doc_id, item_id, m, size) WHERE p BETWEEN start AND start + size - 5 GROUP BY 1, 2, 3, 4, 5, 6),
likeness AS (SELECT doc_id, item_id, start, size, CAST(sum(k) AS BIGINT) AS k,
          CAST((size - 4) + (m - 4) - sum(k) AS BIGINT) AS every FROM found GROUP BY doc_id, item_id, m, size, start)
SELECT doc_id, item_id, start, size AS n_words, k / every AS similarity FROM likeness WHERE 100 * k >= 80 * every
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k / every DESC, start) = 1"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text of digits: one step per bit, the byte joins at its first bit."""
    steps = (f"flatten(list_transform(range(1, length({text}) + 1), "
             f"lambda j: [CAST(ascii({text}[j]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))")
    step = "xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))"
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), "
            f"lambda c, v: {step}), CAST(4294967295 AS BIGINT))")


OP12 = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, w, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
s AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h], []), h.w[h + 1:]) AS w
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, w, len(w) AS n, unnest(range(0, len(w) + 1)) AS depth FROM s),
k AS (SELECT conv_id, n, depth, CAST(w[1:depth] AS VARCHAR) AS name, CAST(w[1:depth - 1] AS VARCHAR) AS above,
             CASE WHEN depth > 0 THEN strlen(w[depth].t) ELSE 0 END AS size FROM p),
g AS (SELECT name, depth, min(above) AS above, min(conv_id) AS conv_id, COUNT(*) AS n_convs, min(size) AS size,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), ''))
               AS ends_sha256, max(n) = depth AS leaf FROM k GROUP BY name, depth),
up AS (SELECT DISTINCT g.name, g.depth, a.name AS top, a.depth AS top_depth, g.leaf, (g.n_convs - 1) * g.size AS saved
       FROM g JOIN k ON k.name = g.name AND k.depth = g.depth AND k.conv_id = g.conv_id
       JOIN k a ON a.conv_id = k.conv_id AND a.depth <= k.depth),
sums AS (SELECT top, top_depth, COUNT(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens,
                COUNT(*) FILTER (WHERE depth = top_depth + 1) AS n_children FROM up GROUP BY ALL)
SELECT g.conv_id, g.depth, a.conv_id AS parent_conv_id, g.n_convs, n_children, n_leaves, saved_tokens, g.ends_sha256
FROM g JOIN sums ON top = g.name AND top_depth = g.depth
LEFT JOIN g a ON a.name = g.above AND a.depth = g.depth - 1"""

ORACLES: dict[str, str] = {"op12_prefix_trie": OP12, "op7_chat_format": OP7, "op8_minhash_dedup": OP8, "op10_decontamination": OP10}
