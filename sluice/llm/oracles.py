"""DuckDB SQL for the numbered queries it can express, written from their contracts.

Fingerprints, projections, language models, segmentations and seeded hashes are not SQL; tests hold those queries
against brute force.
"""

from __future__ import annotations

from sluice.llm.licenses import TEMPLATES, THRESHOLD
from sluice.llm.secrets import KINDS, REACH

WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses() -> str:
    """Dots between digits are set aside, what is no letter or digit becomes a blank, then bigrams are compared."""
    templates = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in sorted(TEMPLATES.items()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    dotted = r"regexp_replace({x}, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g')"
    inner = dotted.format(x=dotted.format(x=f"translate(part, '{upper}', '{lower}')"))
    plain = f"replace(regexp_replace({inner}, '[^\\p{{L}}\\p{{N}}' || chr(57344) || ']+', ' ', 'g'), chr(57344), '.')"
    words = f"list_filter(string_split({plain}, ' '), lambda w: w <> '')"
    return f"""
    WITH docs AS (SELECT DISTINCT doc_id, text, coalesce(text, '') AS t FROM documents),
    lines AS (
      SELECT doc_id, text, 'line' AS unit, generate_subscripts(p, 1) AS nth, unnest(p) AS part
      FROM (SELECT doc_id, text, string_split(t, chr(10)) AS p FROM docs)
    ),
    paragraphs AS (
      SELECT doc_id, text, 'paragraph' AS unit, generate_subscripts(p, 1) AS nth, unnest(p) AS part
      FROM (SELECT doc_id, text, string_split_regex(t, '\\n(?:[ \\t\\r]*\\n)+') AS p FROM docs)
    ),
    units AS (
      SELECT * FROM lines UNION ALL SELECT * FROM paragraphs WHERE contains(trim(part, chr(10)), chr(10))
      UNION ALL SELECT NULL, license, 'template', 1, part FROM (VALUES {templates}) v(license, part)
    ),
    worded AS (SELECT doc_id, text, unit, nth, {words} AS w FROM units),
    grams AS (
      SELECT doc_id, text, unit, nth, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
      FROM worded WHERE len(w) > 0
    ),
    own AS (SELECT doc_id, text, unit, nth, len(g) AS n, unnest(g) AS gram FROM grams WHERE unit <> 'template'),
    tem AS (SELECT text AS license, len(g) AS size, unnest(g) AS gram FROM grams WHERE unit = 'template'),
    dice AS (
      SELECT doc_id, text, unit, nth, license, 2.0 * count(*) / (n + size) AS dice
      FROM own JOIN tem USING (gram) GROUP BY doc_id, text, unit, nth, n, license, size
    )
    SELECT doc_id, unit, CAST(nth AS INTEGER) AS nth, license, CAST(dice AS DOUBLE) AS dice FROM dice WHERE dice >= {THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id, text, unit, nth ORDER BY dice DESC, license) = 1
    """


def jaccard() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents
    ),
    g AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
      FROM w
    ),
    s AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM g),
    pairs AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ),
    edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
    SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id
    FROM g JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
    """


def secrets() -> str:
    kinds = ", ".join(
        f"({_text(k.name)}, {i}, {_text(k.role)}, {str(k.weak).upper()}, {_text(k.pattern)}, [{', '.join(map(_text, k.keep))}])"
        for i, k in enumerate(KINDS)
    )
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""
    WITH kinds AS (SELECT * FROM (VALUES {kinds}) v(kind, rank, role, weak, pattern, keep)),
    cut AS (
      SELECT doc_id, kinds.*, string_split_regex(coalesce(text, ''), pattern) AS gaps,
             regexp_extract_all(coalesce(text, ''), pattern) AS hits
      FROM documents, kinds
    ),
    pair AS (
      SELECT doc_id, kind, rank, role, weak, keep, unnest(hits) AS h, unnest(gaps[1:len(hits)]) AS g,
             generate_subscripts(hits, 1) AS i
      FROM cut
    ),
    hit AS (
      SELECT doc_id, kind, rank, role, weak, keep, h, CAST(sum(length(g) + length(h))
             OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(h) AS s
      FROM pair
    ),
    part AS (
      SELECT doc_id, kind, rank, role, weak, s, s + length(h) AS e
      FROM hit WHERE len(list_filter(keep, lambda k: NOT regexp_matches(h, k))) = 0
    ),
    linked AS (
      SELECT DISTINCT p.doc_id, p.kind, p.rank, p.s, p.e FROM part p JOIN part q ON p.doc_id = q.doc_id
      WHERE p.weak AND (
        (p.kind IN ('ident', 'endpoint') AND q.role = 'secret') OR (p.kind = 'blob' AND q.role IN ('identity', 'place'))
      ) AND (((q.s, q.rank) < (p.s, p.rank) AND p.s - q.e <= {REACH}) OR ((q.s, q.rank) > (p.s, p.rank) AND q.s - p.e <= {REACH}))
      AND NOT EXISTS (SELECT 1 FROM part b WHERE b.doc_id = p.doc_id AND NOT b.weak AND
        (((b.s, b.rank) < (p.s, p.rank) AND b.e > p.s) OR ((b.s, b.rank) > (p.s, p.rank) AND b.s < p.e)))
    ),
    span AS (SELECT doc_id, kind, rank, s, e, TRUE AS base FROM part WHERE NOT weak UNION ALL SELECT doc_id, kind, rank, s, e, FALSE FROM linked)
    SELECT documents.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex, sha256({listed} FILTER (base), '')) AS base_sha256, {listed}, '') AS spans
    FROM documents LEFT JOIN span USING (doc_id) GROUP BY documents.doc_id
    """


def substrings() -> str:
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    win AS (
      SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50)
    ),
    late AS (
      SELECT doc_id, s FROM win JOIN (SELECT win, min(doc_id) AS first FROM win GROUP BY win) USING (win) WHERE first < doc_id
    ),
    gone AS (SELECT DISTINCT doc_id, s + k AS place FROM late, range(0, 50) t(k)),
    word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
      FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """


def negatives() -> str:
    return """
    WITH good AS (
      SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    pairs AS (
      SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
      FROM good a JOIN good b ON a.id <> b.id WHERE a.id % 100 = 0
    ),
    pos AS (SELECT a, b, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
    SELECT pos.a AS anchor_id, pos.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id,
           pos.score AS positive_score, n.score AS negative_score
    FROM pos JOIN pairs n ON n.a = pos.a AND NOT n.same AND 80 * pos.score <= 100 * n.score AND n.score <= pos.score
    WINDOW w AS (PARTITION BY pos.a, pos.b ORDER BY n.score DESC, n.b)
    QUALIFY row_number() OVER w <= 5
    """


def prefixes() -> str:
    """A node is the string of its turns' hashes; the CRC is taken bit by bit from its polynomial."""
    key = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    bits = "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    bytes_of = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_of}), lambda crc, byte: {bits}), 4294967295)"
    return f"""
    WITH own AS (
      SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {key}) AS i, {key} AS k,
             strlen(coalesce(text, '')) AS b
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    size AS (SELECT c, max(i) AS n FROM own GROUP BY c),
    plan AS (
      SELECT s.c, s.c - s.c % 5 AS base, {crc.replace("(c AS", "(s.c AS")} % 9 AS h, coalesce(d.n, 0) AS given
      FROM size s LEFT JOIN size d ON d.c = s.c - s.c % 5
    ),
    turn AS (
      SELECT c, i - h + least(h, given) AS pos, k, b FROM own JOIN plan USING (c) WHERE i > h
      UNION ALL SELECT plan.c, i, k, b FROM plan JOIN own ON own.c = plan.base WHERE i <= h
    ),
    path AS (
      SELECT c, pos AS depth, string_agg(k, '') OVER (PARTITION BY c ORDER BY pos) AS p, b FROM turn
      UNION ALL SELECT c, 0, '', 0 FROM plan
    ),
    full_length AS (SELECT c, max(depth) AS last FROM path GROUP BY c),
    node AS (
      SELECT p, any_value(depth) AS depth, min(c) AS conv, count(*) AS n, any_value(b) AS b,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = last), '')) AS ends
      FROM path JOIN full_length USING (c) GROUP BY p
    ),
    kid AS (SELECT left(p, 32 * (depth - 1)) AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
    tree AS (
      SELECT node.p, count(*) FILTER (kid.n IS NULL) AS leaves, sum((x.n - 1) * x.b) AS saved
      FROM node JOIN node x ON x.depth >= node.depth AND left(x.p, 32 * node.depth) = node.p LEFT JOIN kid ON kid.p = x.p GROUP BY node.p
    )
    SELECT CAST(node.conv AS BIGINT) AS conv_id, CAST(node.depth AS BIGINT) AS depth, CAST(up.conv AS BIGINT) AS parent_conv_id,
           CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kid.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
    FROM node JOIN tree USING (p) LEFT JOIN kid USING (p)
    LEFT JOIN node up ON node.depth > 0 AND up.depth = node.depth - 1 AND up.p = left(node.p, 32 * (node.depth - 1))
    """
