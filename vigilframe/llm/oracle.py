"""The queries of this package as DuckDB SQL, where SQL can express them."""

ORACLE: dict[str, str] = {}

_CONTROL = r"([<\[])(\\*)(\|(?:turn|body|end|part|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"
_ESCAPED = "regexp_replace({}, '" + _CONTROL + r"', '\1\\\2\3', 'g')"

ORACLE["op9_chat"] = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       sum(length('<|turn|><|body|><|end|>') + length({_ESCAPED.format("role")})
           + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE["op1_vector_dedup"] = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e = b.e AS same, a.e AS x, b.e AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
links AS (
    SELECT a, b, same FROM pairs
    WHERE list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) >= 0.95
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
own AS (SELECT a, count(*) AS n, min(b) FILTER (same) AS twin FROM links GROUP BY a)
SELECT e.vec_id, coalesce(own.n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept,
       CASE WHEN v.vec_id IS NOT NULL THEN least(e.vec_id, coalesce(twin, e.vec_id)) END AS class_id
FROM embeddings e LEFT JOIN v ON v.vec_id = e.vec_id LEFT JOIN own ON own.a = e.vec_id LEFT JOIN least_of ON least_of.a = e.vec_id
"""

ORACLE["op2_shingle_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sh AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b, c = na.n AND c = nb.n AS same FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * c >= 90 * (na.n + nb.n - c)
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
twins AS (SELECT a, min(b) AS twin FROM links WHERE same GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       CASE WHEN n.n > 0 THEN least(w.doc_id, coalesce(twin, w.doc_id)) END AS class_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_of ON least_of.a = w.doc_id LEFT JOIN twins ON twins.a = w.doc_id
"""

ORACLE["op6_top_k"] = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_GOOD} AND vec_id IS NOT NULL
),
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """(SELECT xor(list_reduce(list_prepend(4294967295, [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda crc, byte: xor(crc >> 8, t[1 + (xor(crc, byte) & 255)])), 4294967295) FROM crc)"""
# every step turns the runs of eight into their parents, up to one node per group; the groups' tops are one more group
_GROW = """
    SELECT g, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
    FROM {0} WHERE n > 1 GROUP BY g, level, i // 8
"""

ORACLE["op11_merkle"] = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
leaves AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS g, {_LEAF.format("text")} AS leaf,
           CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(_LOWERED)} ELSE {_LEAF.format("text")} END AS shown
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
           count(*) OVER (PARTITION BY g) AS n FROM leaves
),
nodes(g, level, i, h, n) AS (SELECT g, 0, i, leaf, n FROM placed UNION ALL {_GROW.format("nodes")}),
names AS (SELECT g, level AS height, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
above(g, level, i, h, n) AS (SELECT '', 0, i, h, n FROM names UNION ALL {_GROW.format("above")}),
ways AS (  -- own place and siblings, from the leaf to the root
    SELECT p.g, p.i AS leaf_i, s.level, (p.i // pow(8, s.level)::BIGINT) % 8 AS own,
           string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> p.i // pow(8, s.level)::BIGINT) AS rest
    FROM placed p JOIN nodes s ON s.g = p.g AND s.n > 1 AND s.i // 8 = p.i // pow(8, s.level + 1)::BIGINT
    GROUP BY p.g, p.i, s.level
    UNION ALL
    SELECT p.g, p.i, 1000 + w.level, w.own, w.rest
    FROM placed p JOIN (
        SELECT m.g, s.level, (m.i // pow(8, s.level)::BIGINT) % 8 AS own,
               string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> m.i // pow(8, s.level)::BIGINT) AS rest
        FROM names m JOIN above s ON s.n > 1 AND s.i // 8 = m.i // pow(8, s.level + 1)::BIGINT GROUP BY m.g, m.i, s.level
    ) w ON w.g = p.g
),
paths AS (
    SELECT g, leaf_i, list(struct_pack(own := own, rest := coalesce(rest, '')) ORDER BY level) AS steps,
           sha256(string_agg(coalesce(rest, ''), '' ORDER BY level)) AS proof_sha256 FROM ways GROUP BY g, leaf_i
),
folded AS (
    SELECT p.*, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
           list_reduce(list_prepend(struct_pack(own := 0::BIGINT, rest := shown), coalesce(steps, [])), lambda a, s: struct_pack(
               own := 0::BIGINT, rest := sha256(left(s.rest, 64 * s.own) || a.rest || substr(s.rest, 64 * s.own + 1)))).rest AS folded_root
    FROM placed p LEFT JOIN paths q ON q.g = p.g AND q.leaf_i = p.i
)
SELECT doc_id, leaf, names.h AS subroot, top.h AS root, proof_sha256, folded_root, folded_root = top.h AS verified
FROM folded JOIN names ON names.g = folded.g, (SELECT h FROM above WHERE n = 1) AS top
"""

ORACLE["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w, (SELECT unnest(range(1, 5)) AS k)
    ) GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
inner_ AS (
    SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT lang, k, w, a, size, unnest(range(1, k - size + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS size) WHERE size < k)
    GROUP BY ALL
),
cuts AS (
    SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, c.cut, ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
    SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM worst LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
