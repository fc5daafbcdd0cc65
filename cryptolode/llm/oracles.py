"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import string

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_dedup"] = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

#: A turn: <turn>role, line end, text, line end, </turn>, line end; backslashes doubled and the marks escaped inside.
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '</turn>', '\</turn>'), '<turn>', '\<turn>')"

ORACLES["op10_chat"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 16 + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + length({_ESCAPED.format("text")}) AS chars FROM c)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op7_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM s),
r AS (
  SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
covered AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM r),
kept AS (
  SELECT w.doc_id, count(*) FILTER (covered.i IS NOT NULL) AS n_removed,
         string_agg(w.word, ' ' ORDER BY w.i) FILTER (covered.i IS NULL) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) w
  LEFT JOIN covered ON covered.doc_id = w.doc_id AND covered.i = w.i
  GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op5_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reached),
k AS (SELECT doc_id, min(reached) AS class_id FROM r GROUP BY doc_id)
SELECT k.doc_id, class_id, (SELECT count(*) FROM p WHERE p.a = k.doc_id) AS n_links FROM k
"""


def _hilbert_sql(bits: int = 4, n: int = 4) -> str:
    """CTEs from g (x0 .. x3, the levels) to p (with place)."""
    out, last, step = [], "g", 0
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            hit, flip = f"(x{i} & {1 << b}) <> 0", f"(xor(x0, x{i}) & {(1 << b) - 1})"
            new = [f"CASE WHEN {hit} THEN xor(x0, {(1 << b) - 1}) ELSE xor(x0, {flip}) END AS x0"]
            new += [f"CASE WHEN {hit} THEN x{i} ELSE xor(x{i}, {flip}) END AS x{i}"] if i else []
            out.append(f"t{step} AS (SELECT * REPLACE ({', '.join(new)}) FROM {last})")
            last, step = f"t{step}", step + 1
    for i in range(1, n):
        out.append(f"t{step} AS (SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM {last})")
        last, step = f"t{step}", step + 1
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN (x{n - 1} & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    out.append(f"f AS (SELECT *, {flip} AS flip FROM {last})")
    place = "0"
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = f"({place} * 2 + ((xor(x{i}, flip) >> {b}) & 1))"
    out.append(f"p AS (SELECT *, {place} AS place FROM f)")
    return ",\n".join(out)


#: CRC-32 takes a table of 256 values, made here from its rule.
_CRCS = """
bits AS (SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY byte) AS crcs FROM bits WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8, where the column crcs holds the table."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, crcs[xor(a & 255, b) + 1]), 4294967295), 4294967295)"


ORACLES["op13_hilbert_sharding"] = f"""
WITH RECURSIVE {_CRCS},
d AS (SELECT doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_crc_sql("coalesce(text, '')")} AS crc FROM documents, crcs),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT source FROM d)),
l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT lang FROM d)),
w AS (SELECT min(doc_id) AS id_low, max(doc_id) AS id_high, min(length(bin(size))) AS low, max(length(bin(size))) AS high FROM d),
g AS (
  SELECT d.*, s.r * 16 // s.c AS x0, l.r * 16 // l.c AS x1, (length(bin(size)) - low) * 16 // (high - low + 1) AS x2,
         coalesce((doc_id - id_low) * 16 // (id_high - id_low + 1), 0) AS x3
  FROM d, w, s, l WHERE s.source IS NOT DISTINCT FROM d.source AND l.lang IS NOT DISTINCT FROM d.lang),
{_hilbert_sql()},
o AS (
  SELECT *, sum(size) OVER (ORDER BY place, doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM p),
c AS (SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM c
"""


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _levels_sql(name: str, leaves: str) -> str:
    """A tree per g over leaves (g, i, h): its nodes (g, l, i, h, m), where m is how many the level has."""
    return f"""{name} AS (
  SELECT g, 0 AS l, i, h, count(*) OVER (PARTITION BY g) AS m FROM {leaves}
  UNION ALL SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM {name} WHERE m > 1 GROUP BY g, l, i // 2)"""


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE {_CRCS},
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS changed,
         {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL AS tampered
  FROM documents, crcs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d),
{_levels_sql("low", "leaves")},
sub AS (SELECT g AS tree, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM low WHERE m = 1),
{_levels_sql("high", "sub")},
nodes AS (SELECT g, l, i, h, m FROM low UNION ALL SELECT '^', l, i, h, m FROM high),
top AS (SELECT h AS root FROM high WHERE m = 1),
-- from each leaf up: the node, what was met, and what it folds to
walk AS (
  SELECT doc_id, leaf, g, g AS tree, 0 AS l, i, '' AS met, CASE WHEN tampered THEN changed ELSE leaf END AS folded FROM leaves
  UNION ALL
  SELECT doc_id, leaf, CASE WHEN n.m = 1 THEN '^' ELSE w.g END, w.tree, CASE WHEN n.m = 1 THEN 0 ELSE w.l + 1 END,
         CASE WHEN n.m = 1 THEN sub.i ELSE w.i // 2 END, met || coalesce(s.h, ''),
         CASE WHEN n.m = 1 THEN folded WHEN s.h IS NULL THEN sha256(folded) WHEN w.i % 2 = 1 THEN sha256(s.h || folded) ELSE sha256(folded || s.h) END
  FROM walk w JOIN nodes n ON n.g = w.g AND n.l = w.l AND n.i = w.i JOIN sub ON sub.tree = w.tree
       LEFT JOIN nodes s ON n.m > 1 AND s.g = w.g AND s.l = w.l AND s.i = xor(w.i, 1)
  WHERE n.m > 1 OR w.g <> '^')
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(met) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk w JOIN sub ON sub.tree = w.tree JOIN nodes n ON n.g = w.g AND n.l = w.l AND n.i = w.i, top
WHERE w.g = '^' AND n.m = 1
"""

ORACLES["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '@UPPER', '@LOWER'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
inner_ AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS s FROM f WHERE k > 2)))
  GROUP BY ALL),
c AS (SELECT f.lang, f.k, f.phrase, f.f AS a, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN inner_ USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR 100 * longer < 100 * f.f)),
cuts AS (SELECT *, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, k), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (
  SELECT cuts.lang, cuts.phrase, a, h.f AS l, t.f AS r, n, cut, CAST((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o WHERE rank <= 2000
""".replace("@UPPER", string.ascii_uppercase).replace("@LOWER", string.ascii_lowercase)
