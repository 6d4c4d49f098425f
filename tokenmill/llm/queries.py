"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from tokenmill.llm import (
    ball_tree,
    best_fit,
    chat_format,
    decontaminate,
    embedding_dedup,
    html_text,
    language_id,
    line_chunks,
    near_dedup,
    packing,
    secrets,
    suffix_dedup,
    whitening,
)

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_language_id": language_id.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_packing": packing.query,
    "op7_secrets": secrets.query,
    "op8_near_dedup": near_dedup.query,
    "op9_line_chunks": line_chunks.query,
    "op10_html_text": html_text.query,
    "op11_ball_tree": ball_tree.query,
    "op12_whitening": whitening.query,
    "op13_best_fit": best_fit.query,
}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
     bw AS (SELECT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT m FROM bw),
     dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= m)),
     hits AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
             FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
             FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _duck_spans(rule: secrets.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, s, s + length(m[k]) AS e FROM (
    SELECT doc_id, m, g, k, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
             string_split_regex(t, '{pattern}') AS p FROM t)))
  WHERE length(g[k]) >= {rule.least}"""


_SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_duck_spans(r, k) for k, r in enumerate(secrets.RULES))})
SELECT t.doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank)
              FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank), '') AS spans
FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
"""

_LINE_CHUNKS = f"""
WITH l AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls
           FROM documents),
     x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM l),
     h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM x),
     r AS (SELECT *, ((coalesce(lag(h) OVER w, 0) % {line_chunks.MODULUS}) * {line_chunks.FACTOR} + h)
                     % {line_chunks.MODULUS} % {line_chunks.SPREAD} = 0 OR i = n OR length(line) >= {line_chunks.WIDE}
                     OR length(lead(line) OVER w) >= {line_chunks.WIDE} AS cut
           FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
     c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM r),
     k AS (SELECT doc_id, no, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, no),
     o AS (SELECT *, m >= {line_chunks.MIN_LINES} OR length(body) >= {line_chunks.WIDE} AS multi FROM k),
     f AS (SELECT *, multi AND row_number() OVER (PARTITION BY body, multi ORDER BY doc_id, no) > 1 AS gone FROM o),
     s AS (SELECT doc_id, sum(m) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
                  coalesce(sum(m) FILTER (gone), 0) AS n_lines_removed,
                  coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept
           FROM f GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM l LEFT JOIN s USING (doc_id)
"""

_BALL_TREE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
     b AS (SELECT DISTINCT item_id, unnest({_WORDS.format("coalesce(text, '')")}) AS t FROM benchmark),
     dn AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
     s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM dn),
     tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN b USING (t) GROUP BY r, t),
     wt AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf CROSS JOIN s GROUP BY t, docs),
     x AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS x
           FROM tf JOIN dn USING (r) JOIN wt USING (t) CROSS JOIN s),
     sc AS (SELECT item_id, r, doc_id, sum(x)::BIGINT AS score FROM b JOIN x USING (t) GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE = {
    "op11_ball_tree": _BALL_TREE,
    "op3_decontaminate": _DECONTAMINATE,
    "op7_secrets": _SECRETS,
    "op9_line_chunks": _LINE_CHUNKS,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
