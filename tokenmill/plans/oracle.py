"""DuckDB oracles: for each query key the same result in plain SQL over the
pre-registered driver tables. Fixture CTEs mirror ``fixtures.py``.
"""

from __future__ import annotations

# Fixed values mirrored from fixtures.py: seq 1024 (+1 = 1025), pad 3, bos 1,
# eos 2, unk 0, seed 42, batch 32, 10 epochs, 8 workers, max_gen 20, top_p 0.95.

_NORM = r"""CASE WHEN trim(regexp_replace({t}, '\s+', ' ', 'g')) = '' THEN ''
     ELSE '▁' || replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' ', '▁') END"""


def _norm(t: str) -> str:
    return _NORM.format(t=t)


NORM_DOCS = f"""norm_docs AS (SELECT doc_id, text, {_norm('text')} AS norm FROM documents)"""

CHARVOCAB = """charvocab AS (
  SELECT * FROM (VALUES (0, '<unk>', 0.0::DOUBLE, 'unk'), (1, '<s>', 0.0::DOUBLE, 'bos'),
                        (2, '</s>', 0.0::DOUBLE, 'eos'), (3, '<pad>', 0.0::DOUBLE, 'pad')) t(id, piece, score, kind)
  UNION ALL
  SELECT CAST(3 + row_number() OVER (ORDER BY piece) AS INTEGER), piece, 0.0::DOUBLE, 'normal'
  FROM (SELECT DISTINCT unnest(string_split(norm, '')) AS piece FROM norm_docs WHERE norm <> '') WHERE piece <> '')"""

IDS = """ids AS (SELECT doc_id, text, list_concat([1],
    CASE WHEN text = '' THEN []::INTEGER[] ELSE list_transform(string_split(text, ''), lambda c: unicode(c) + 4) END,
    [2]) AS ids FROM documents)"""

TRIPLES = """turns AS (SELECT *, max(CASE WHEN turn = 0 AND role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys,
    arg_min(turn, turn) FILTER (role IN ('user', 'assistant')) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM conversations),
triples AS (SELECT t.conv_id || '-' || t.turn AS id, t.conv_id, coalesce(t.sys, '') AS system_prompt, t.text AS question,
    CASE WHEN n.role = 'assistant' THEN n.text ELSE '' END AS response
  FROM turns t LEFT JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.nt WHERE t.role = 'user')"""

PROMPTS = """prompts AS (SELECT conv_id || '-' || turn AS prompt_id, replace(text, chr(10), ' ') AS text, conv_id // 4 AS batch_id
  FROM conversations WHERE role = 'user')"""

WORDS = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM benchmark)"""

STOP = r"""stop AS (SELECT word FROM (SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents WHERE lang = 'en')
  GROUP BY word) ORDER BY n DESC, word LIMIT 50)"""

LOGITS = """lg AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l, label AS target, vec_id // 32 AS batch_id,
    list_max(CAST(embedding AS DOUBLE[])) AS mx FROM embeddings)"""

RUNLOG = """runlog AS (SELECT user_id AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
    avg(value) AS val_loss FROM events GROUP BY ALL)"""


def _rank(key: str = "doc_id", seed: int = 42, table: str = "documents", extra: str = "") -> str:
    return (f"SELECT {key}{extra}, row_number() OVER (ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key}) - 1 AS idx,"
            f" count(*) OVER () AS n FROM {table}")


SPLITS = f"""ranked AS ({_rank()}),
sized AS (SELECT *, CASE WHEN n > 0 THEN ceil(0.15::DOUBLE * n) ELSE 0 END AS n_hold FROM ranked),
splits AS (SELECT doc_id, CASE WHEN idx < n - n_hold THEN 'train'
    WHEN idx < n - n_hold + (n_hold - CASE WHEN n_hold > 0 THEN ceil(0.25::DOUBLE * n_hold) ELSE 0 END) THEN 'val'
    ELSE 'test' END AS split FROM sized)"""

SHUFFLED = """sh AS (SELECT CAST(e AS INTEGER) AS epoch, doc_id, row_number() OVER (PARTITION BY e
    ORDER BY md5('42:' || CAST(e AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos
  FROM documents, range(10) t(e))"""


def enc(name: str, src: str, key: str, txt: str, bos: bool = True, eos: bool = True) -> str:
    """Encode ``src.txt`` with the character vocabulary (unknown runs merged)."""
    head = "[1]" if bos else "[]::INTEGER[]"
    tail = "[2]" if eos else "[]::INTEGER[]"
    return f"""{name}_n AS (SELECT {key} AS k, {_norm(txt)} AS norm FROM {src}),
{name}_c AS (SELECT k, unnest(string_split(norm, '')) AS ch, generate_subscripts(string_split(norm, ''), 1) AS pos
  FROM {name}_n WHERE norm <> ''),
{name}_m AS (SELECT c.k, c.pos, coalesce(v.id, 0) AS id FROM {name}_c c
  LEFT JOIN charvocab v ON v.piece = c.ch AND v.kind = 'normal'),
{name}_l AS (SELECT k, list(id ORDER BY pos) AS cl FROM {name}_m GROUP BY k),
{name} AS (SELECT n.k AS {key}, list_concat({head},
    coalesce(list_filter(l.cl, lambda x, i: NOT (x = 0 AND i > 1 AND l.cl[i - 1] = 0)), []::INTEGER[]), {tail}) AS ids
  FROM {name}_n n LEFT JOIN {name}_l l ON l.k = n.k)"""


def dec(name: str, src: str, key: str, ids: str, vocab: str = "charvocab") -> str:
    """Decode ``src.ids`` with a vocabulary."""
    return f"""{name}_e AS (SELECT {key} AS k, unnest({ids}) AS id, generate_subscripts({ids}, 1) AS pos FROM {src}),
{name}_s AS (SELECT e.k, e.pos, e.id, CASE WHEN e.id = 0 THEN ' ⁇ ' ELSE replace(v.piece, '▁', ' ') END AS surf
  FROM {name}_e e LEFT JOIN {vocab} v ON v.id = e.id WHERE e.id NOT IN (1, 2, 3)),
{name}_j AS (SELECT k, string_agg(surf, '' ORDER BY pos) AS j, arg_min(id, pos) AS first_id FROM {name}_s GROUP BY k),
{name} AS (SELECT s.{key} AS {key}, CASE WHEN j.k IS NULL THEN ''
    WHEN j.first_id <> 0 AND starts_with(j.j, ' ') THEN substr(j.j, 2) ELSE j.j END AS text
  FROM {src} s LEFT JOIN {name}_j j ON j.k = s.{key})"""


SEEDS = (NORM_DOCS, """wc AS (SELECT '▁' || w AS word, count(*) AS freq
  FROM (SELECT unnest(string_split(norm, '▁')) AS w FROM norm_docs) WHERE w <> '' GROUP BY w)""",
         "st AS (SELECT word, freq, unnest(generate_series(1, length(word))) AS s FROM wc)",
         """sub AS (SELECT word, s, n, substr(word, s, n) AS piece, freq FROM (
    SELECT word, freq, s, unnest(generate_series(1, least(16, length(word) - s + 1))) AS n FROM st))""",
         "agg AS (SELECT piece, CAST(sum(freq) AS BIGINT) AS freq, CAST(min(n) AS BIGINT) AS n_chars FROM sub GROUP BY piece)",
         "agg2 AS (SELECT piece, freq, n_chars, freq * n_chars AS score FROM agg WHERE n_chars = 1 OR freq >= 2)")


def _seeds(top_k: int) -> str:
    return f"""SELECT * FROM agg2 WHERE n_chars = 1
UNION ALL (SELECT * FROM agg2 WHERE n_chars > 1 ORDER BY score DESC, piece LIMIT {top_k})"""


# Characters and the best 2,000 longer pieces; per word type the best segmentation, position by position: ``bw`` holds the
# best sums of the last 16 positions; between equal sums the longer last piece wins. Then the pieces from the word's end back.
PIECES = (*SEEDS, f"pv0 AS ({_seeds(2000)})",
          """pv AS MATERIALIZED (SELECT CAST(3 + row_number() OVER (ORDER BY s DESC, piece) AS INTEGER) AS id, piece, s
  FROM (SELECT piece, round(ln(freq / (SELECT CAST(sum(freq) AS DOUBLE) FROM pv0)), 6) AS s FROM pv0))""",
          """ed AS MATERIALIZED (SELECT word, sub.s + n - 1 AS e, list({'n': n, 's': pv.s, 'id': pv.id} ORDER BY n DESC) AS es
  FROM sub JOIN pv USING (piece) GROUP BY word, e)""",
          """vit AS (SELECT word, CAST(0 AS BIGINT) AS j, [0.0::DOUBLE] AS bw, CAST(0 AS BIGINT) AS n, 0 AS id FROM wc
  UNION ALL
  SELECT word, j + 1, list_append(bw, list_max(cs))[-16:], es[list_position(cs, list_max(cs))].n,
         es[list_position(cs, list_max(cs))].id
  FROM (SELECT v.word, v.j, v.bw, ed.es, list_transform(ed.es, lambda x: v.bw[-x.n] + x.s) AS cs
        FROM vit v JOIN ed ON ed.word = v.word AND ed.e = v.j + 1))""",
          """bt AS (SELECT word, CAST(length(word) AS BIGINT) AS cur, []::INTEGER[] AS ids FROM wc
  UNION ALL
  SELECT b.word, b.cur - v.n, list_prepend(v.id, b.ids) FROM bt b JOIN vit v ON v.word = b.word AND v.j = b.cur WHERE b.cur > 0)""",
          """dw AS (SELECT doc_id, '▁' || w AS word, pos FROM (SELECT doc_id, unnest(string_split(norm, '▁')) AS w,
    generate_subscripts(string_split(norm, '▁'), 1) AS pos FROM norm_docs) WHERE w <> '')""",
          "di AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM dw JOIN bt USING (word) WHERE cur = 0 GROUP BY doc_id)",
          """ep AS (SELECT doc_id, list_concat([1], coalesce(di.ids, []::INTEGER[]), [2]) AS ids
  FROM documents LEFT JOIN di USING (doc_id))""")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_LENS = "lens AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS len FROM ids WHERE len(ids) BETWEEN 0 AND 2000)"
_PAD = "list_resize(ids[1:1025], 1025, 3)"
_COMPLETED = f"""comp AS (SELECT q.id AS prompt_id, CAST(split_part(q.id, '-', 1) AS BIGINT) // 4 AS batch_id,
    CAST(len(q.ids) AS BIGINT) AS n_input, list_concat(q.ids, r.ids, [2]) AS tokens
  FROM enc_q q JOIN enc_r r USING (id))"""
_COMP_CTES = (NORM_DOCS, CHARVOCAB, TRIPLES, enc("enc_q", "triples", "id", "question", True, False),
              enc("enc_r", "triples", "id", "response", False, False), _COMPLETED)
_KEPT = """pr AS (SELECT vec_id, list_transform(l, lambda v: exp((v - mx) / 1.0::DOUBLE)
      / list_reduce(list_transform(l, lambda v: exp((v - mx) / 1.0::DOUBLE)), lambda a, b: a + b)) AS probs FROM lg),
ex AS (SELECT vec_id, unnest(probs) AS p0, generate_subscripts(probs, 1) - 1 AS token_id FROM pr),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p0 DESC, token_id) AS rank,
    sum(p0) OVER (PARTITION BY vec_id ORDER BY p0 DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM ex),
kept AS (SELECT vec_id, token_id, rank, p0 / sum(p0) OVER (PARTITION BY vec_id) AS p FROM w WHERE cum - p0 <= 0.95)"""
_ENC_PROMPTS = f"""ep AS (SELECT e.prompt_id, p.batch_id, e.ids, CAST(len(e.ids) AS BIGINT) AS n_input FROM enc_p e JOIN prompts p USING (prompt_id)),
ep2 AS (SELECT *, min(n_input) OVER (PARTITION BY batch_id) AS min_len, max(n_input) OVER (PARTITION BY batch_id) AS max_len,
    CAST(least(1024, 20 + max(n_input) OVER (PARTITION BY batch_id)) AS BIGINT) AS total_len FROM ep),
pm AS (SELECT *, list_resize(ids[1:total_len], total_len, 3) AS tokens FROM ep2)"""
_PROMPT_CTES = (NORM_DOCS, CHARVOCAB, PROMPTS, enc("enc_p", "prompts", "prompt_id", "text", True, False), _ENC_PROMPTS)
_FLAG = r"""ex AS (SELECT DISTINCT prompt_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM prompts),
miss AS (SELECT prompt_id, list_sort(list(word)) AS missing FROM ex WHERE word NOT IN (SELECT word FROM words) GROUP BY prompt_id)"""
_TRIM = """tr AS (SELECT prompt_id, n_input, list_transform(tokens, lambda x: CASE WHEN x = 3 THEN 2 ELSE x END)[1:n_input + 20] AS t FROM comp),
tr2 AS (SELECT *, coalesce(list_position(t, 2), 0) AS e FROM tr),
trimmed AS (SELECT prompt_id, n_input, CAST(CASE WHEN e > 0 THEN e - 1 - n_input ELSE 20 END AS BIGINT) AS n_generated,
    CASE WHEN e > 0 THEN t[1:e - 1] ELSE t END AS trimmed FROM tr2)"""
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS rank FROM runlog)
  WHERE rank <= 3)"""

ORACLE: dict[str, str] = {
    "csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "read_parquet": "SELECT doc_id, lang, source, n_chars FROM documents",
    "prompt_lines": _with(PROMPTS) + "SELECT text || chr(10) AS line, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM prompts",
    "word_list": r"""WITH occ AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word,
    generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS pos FROM benchmark)
SELECT word, arg_max(CAST(item_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR), item_id * 1000000 + pos) AS attrs
FROM occ GROUP BY word""",
    "load_splits": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split
FROM documents""",
    "write_splits": _with(IDS, SPLITS) + "SELECT s.doc_id, s.split, CAST(len(i.ids) AS BIGINT) AS n_ids FROM splits s JOIN ids i USING (doc_id)",
    "write_splits_csv": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split,
    md5(text) AS text_md5 FROM documents""",
    "saved_split_pairs": _with(IDS, SPLITS) + f"""SELECT doc_id, md5(array_to_string(p[1:1024], ',')) AS x_digest,
    md5(array_to_string(p[2:1025], ',')) AS y_digest
FROM (SELECT doc_id, {_PAD} AS p FROM ids JOIN splits USING (doc_id) WHERE split = 'train')""",
    "land_if_absent": "SELECT doc_id, lang FROM documents",
    "prediction_log": _with(NORM_DOCS, CHARVOCAB,
                            """tp AS (SELECT vec_id, vec_id // 32 AS batch_id,
    CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top1 FROM embeddings)""",
                            "preds AS (SELECT batch_id, list(top1 ORDER BY vec_id) AS preds FROM tp GROUP BY batch_id)",
                            dec("dp", "preds", "batch_id", "preds")) + "SELECT '0: ' || text AS line FROM dp",
    "export_vocab": _with(NORM_DOCS, CHARVOCAB) + "SELECT CAST(id AS VARCHAR) || chr(9) || piece AS line FROM charvocab",
    "drop_id": _with(TRIPLES) + "SELECT system_prompt, question, response FROM triples",
    "assemble_prompt": _with(TRIPLES) + "SELECT id, system_prompt || '<SEP>' || question || '<SEP>' || response AS prompt FROM triples",
    "length_filter": _with(IDS) + "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids FROM ids WHERE len(ids) BETWEEN 0 AND 2000",
    "remap_token": _with(IDS) + """SELECT doc_id, md5(array_to_string(r, ',')) AS digest,
    CAST(len(list_filter(r, lambda x: x = 32000)) AS BIGINT) AS n_remapped
FROM (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x = 105 THEN 32000 ELSE x END) AS r FROM ids)""",
    "head_examples": _with(IDS) + f"""SELECT idx, doc_id, md5(array_to_string(p[1:1024], ',')) AS x_digest,
    md5(array_to_string(p[2:1025], ',')) AS y_digest
FROM (SELECT row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx, doc_id, {_PAD} AS p
      FROM ids) WHERE idx < 201""",
    "union_corpora": """SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS source, md5(text) AS text_md5 FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, CAST(NULL AS VARCHAR), source, md5(text) FROM documents WHERE doc_id % 2 = 1""",
    "combine_export": """SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS lang,
    CASE WHEN doc_id % 2 = 1 THEN source ELSE '' END AS source FROM documents""",
    "row_count": "SELECT count(*) AS n_rows FROM documents",
    "split_counts": _with(SPLITS) + "SELECT split, count(*) AS n_rows FROM splits GROUP BY split UNION ALL SELECT 'all', count(*) FROM splits",
    "corpus_footprint": _with(IDS) + """SELECT count(*) AS n_rows, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS text_bytes,
    CAST(coalesce(sum(4 * len(ids)), 0) AS BIGINT) AS id_bytes,
    CAST(trunc(coalesce(sum(strlen(text)), 0) / 1073741824.0) AS BIGINT) AS text_gib,
    CAST(trunc(coalesce(sum(4 * len(ids)), 0) / 1073741824.0) AS BIGINT) AS id_gib FROM ids""",
    "length_summary": _with(IDS, _LENS, """st AS (SELECT count(*) AS n, max(len) - min(len) AS range,
    CAST(round_even(avg(len), 0) AS DOUBLE) AS mean, CAST(quantile_cont(len, 0.5) AS DOUBLE) AS median,
    CAST(round_even(stddev_samp(len), 0) AS DOUBLE) AS std, CAST(quantile_cont(len, 0.25) AS DOUBLE) AS q1,
    CAST(quantile_cont(len, 0.75) AS DOUBLE) AS q3 FROM lens)""") + """SELECT n, range, mean, median, std, q1, q3, q3 - q1 AS iqr,
    (SELECT count(*) FROM lens WHERE len < st.q1 - 1.5 * (st.q3 - st.q1) OR len > st.q3 + 1.5 * (st.q3 - st.q1)) AS n_outliers,
    mean - std AS band_lo1, mean + std AS band_hi1, mean - 2 * std AS band_lo2, mean + 2 * std AS band_hi2 FROM st""",
    "length_outliers": _with(IDS, _LENS, """q AS (SELECT quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.75) AS q3 FROM lens)""")
    + "SELECT doc_id, len FROM lens, q WHERE len < q1 - 1.5 * (q3 - q1) OR len > q3 + 1.5 * (q3 - q1)",
    "length_outliers_all": _with(IDS, "lens AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS len FROM ids)",
                                 "q AS (SELECT quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.75) AS q3 FROM lens)")
    + "SELECT doc_id, len FROM lens, q WHERE len < q1 - 1.5 * (q3 - q1) OR len > q3 + 1.5 * (q3 - q1)",
    "length_histogram": _with(IDS, _LENS,
                              "mm AS (SELECT CAST(min(len) AS DOUBLE) AS mn, CAST(max(len) AS DOUBLE) AS mx FROM lens)",
                              """b AS (SELECT CAST(CASE WHEN mx = mn THEN 50 ELSE least(floor((len - mn) * 100.0::DOUBLE / (mx - mn)), 99) END AS BIGINT) AS bin
  FROM lens, mm)""", "c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)") + """SELECT g.bin,
    round(CASE WHEN mx = mn THEN mn - 0.5 + g.bin / 100.0::DOUBLE ELSE mn + g.bin * (mx - mn) / 100.0::DOUBLE END, 6) AS lo,
    round(CASE WHEN mx = mn THEN mn - 0.5 + (g.bin + 1) / 100.0::DOUBLE ELSE mn + (g.bin + 1) * (mx - mn) / 100.0::DOUBLE END, 6) AS hi,
    coalesce(c.n, 0) AS n
FROM (SELECT range AS bin FROM range(100)) g CROSS JOIN mm LEFT JOIN c ON c.bin = g.bin WHERE mm.mn IS NOT NULL""",
    "epoch_metrics": """SELECT user_id AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
    round(avg(value), 6) AS val_loss, round(avg(value / 1.0::DOUBLE), 6) AS train_loss_scaled, count(*) AS n_steps
FROM events GROUP BY ALL""",
    "epoch_metrics_weighted": """SELECT user_id AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
    round(sum(value * w) / sum(w), 6) AS val_loss, round(sum(exp(value / 100) * w) / sum(w), 6) AS val_perplexity,
    round(sum(value / 3 * w) / sum(w), 6) AS train_loss_scaled, count(*) AS n_steps
FROM (SELECT *, CAST(event_id % 3 + 1 AS DOUBLE) AS w FROM events) GROUP BY ALL""",
    "global_index": "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx FROM documents",
    "exact_split": _with(SPLITS) + "SELECT doc_id, split FROM splits",
    "epoch_shuffle": _with(SHUFFLED) + "SELECT epoch, doc_id, pos FROM sh",
    "epoch_order_val": """SELECT CAST(e AS INTEGER) AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY doc_id) - 1 AS pos
FROM documents, range(10) t(e)""",
    "assign_batches": _with(SHUFFLED) + "SELECT epoch, doc_id, pos // 32 AS batch_id, pos % 32 AS slot FROM sh",
    "rank_shards": f"""WITH g AS ({_rank()}),
p AS (SELECT doc_id, idx + k * n AS global_pos, CAST(ceil(n / 8.0::DOUBLE) * 8 AS BIGINT) AS total FROM g, range(0, 8) t(k))
SELECT doc_id, global_pos, CAST(global_pos % 8 AS INTEGER) AS rank, global_pos // 8 AS rank_pos FROM p WHERE global_pos < total""",
    "rank_shards_wrap": f"""WITH g AS ({_rank()}),
p AS (SELECT doc_id, idx + k * n AS global_pos, CAST(ceil(n / 7.0::DOUBLE) * 7 AS BIGINT) AS total FROM g, range(0, 7) t(k))
SELECT doc_id, global_pos, CAST(global_pos % 7 AS INTEGER) AS rank, global_pos // 7 AS rank_pos FROM p WHERE global_pos < total""",
    "sample_sentences": """WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents),
f AS (SELECT * FROM s WHERE trim(line) <> ''),
r AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)),
    doc_id, line_no) - 1 AS idx FROM f)
SELECT * FROM r WHERE idx < 1000000""",
    "normalise_text": _with(NORM_DOCS) + "SELECT doc_id, md5(norm) AS norm_md5, CAST(length(norm) AS BIGINT) AS n_chars FROM norm_docs",
    "word_counts": _with(NORM_DOCS) + """SELECT '▁' || w AS word, count(*) AS freq
FROM (SELECT unnest(string_split(norm, '▁')) AS w FROM norm_docs) WHERE w <> '' GROUP BY w""",
    "seed_pieces": _with(NORM_DOCS, """wc AS (SELECT '▁' || w AS word, count(*) AS freq
  FROM (SELECT unnest(string_split(norm, '▁')) AS w FROM norm_docs) WHERE w <> '' GROUP BY w)""",
                         "st AS (SELECT word, freq, unnest(generate_series(1, length(word))) AS s FROM wc)",
                         """sub AS (SELECT substr(word, s, n) AS piece, freq, n FROM (
    SELECT word, freq, s, unnest(generate_series(1, least(16, length(word) - s + 1))) AS n FROM st))""",
                         "flt AS (SELECT * FROM sub WHERE n = 1 OR position('▁' IN substr(piece, 2)) = 0)",
                         """agg AS (SELECT piece, CAST(sum(freq) AS BIGINT) AS freq, CAST(min(n) AS BIGINT) AS n_chars FROM flt GROUP BY piece)""",
                         "agg2 AS (SELECT piece, freq, n_chars, freq * n_chars AS score FROM agg WHERE n_chars = 1 OR freq >= 2)")
    + """SELECT * FROM agg2 WHERE n_chars = 1
UNION ALL (SELECT * FROM agg2 WHERE n_chars > 1 ORDER BY score DESC, piece LIMIT 1000000)""",
    "seed_pieces_top": _with(*SEEDS) + _seeds(5000),
    "encode_pieces": _with(*PIECES).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS digest FROM ep",
    "decode_pieces": _with(*PIECES, dec("dd", "ep", "doc_id", "ids", "pv")).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM dd",
    # log-sums of the paths to (fw) and from (bw) each position, kept for the last 16 positions
    "estep_counts": _with(*PIECES[:-1], """sd AS MATERIALIZED (SELECT word, sub.s AS b, list({'n': n, 's': pv.s}) AS es
  FROM sub JOIN pv USING (piece) GROUP BY word, b)""",
                          """fw AS (SELECT word, CAST(0 AS BIGINT) AS j, [0.0::DOUBLE] AS al FROM wc
  UNION ALL
  SELECT word, j + 1, list_append(al, list_max(cs) + ln(list_sum(list_transform(cs, lambda c: exp(c - list_max(cs))))))[-16:]
  FROM (SELECT f.word, f.j, f.al, list_transform(ed.es, lambda x: f.al[-x.n] + x.s) AS cs
        FROM fw f JOIN ed ON ed.word = f.word AND ed.e = f.j + 1))""",
                          """bw AS (SELECT word, CAST(length(word) AS BIGINT) AS j, [0.0::DOUBLE] AS be FROM wc
  UNION ALL
  SELECT word, j - 1, list_append(be, list_max(cs) + ln(list_sum(list_transform(cs, lambda c: exp(c - list_max(cs))))))[-16:]
  FROM (SELECT b.word, b.j, b.be, list_transform(sd.es, lambda x: b.be[-x.n] + x.s) AS cs
        FROM bw b JOIN sd ON sd.word = b.word AND sd.b = b.j))""").replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT piece, round(sum(freq * exp(f.al[-1] + pv.s + b.be[-1] - z.al[-1])), 3) AS expected
FROM sub JOIN pv USING (piece) JOIN fw f ON f.word = sub.word AND f.j = sub.s - 1
JOIN bw b ON b.word = sub.word AND b.j = sub.s - 1 + sub.n JOIN fw z ON z.word = sub.word AND z.j = length(sub.word)
GROUP BY piece""",
    "train_vocab_report": _with(NORM_DOCS, CHARVOCAB) + """SELECT true AS dense, true AS fits,
    count(*) FILTER (kind = 'normal') AS n_chars, 0::BIGINT AS n_missing FROM charvocab""",
    "train_vocab_full": _with(NORM_DOCS, CHARVOCAB) + """SELECT true AS dense, true AS fits,
    count(*) FILTER (kind = 'normal') AS n_chars, 0::BIGINT AS n_missing FROM charvocab""",
    "layout_vocab": _with(NORM_DOCS, CHARVOCAB) + "SELECT id, piece, score, kind FROM charvocab",
    "tokenizer_info": _with(NORM_DOCS, CHARVOCAB) + """SELECT count(*) AS vocab_size,
    CAST(coalesce(max(CASE WHEN kind = 'unk' THEN id END), -1) AS INTEGER) AS unk_id,
    CAST(coalesce(max(CASE WHEN kind = 'bos' THEN id END), -1) AS INTEGER) AS bos_id,
    CAST(coalesce(max(CASE WHEN kind = 'eos' THEN id END), -1) AS INTEGER) AS eos_id,
    CAST(coalesce(max(CASE WHEN kind = 'pad' THEN id END), -1) AS INTEGER) AS pad_id,
    min(id) = 0 AND max(id) = count(*) - 1 AND count(DISTINCT id) = count(*) AS consistent FROM charvocab""",
    "add_tokens": _with(NORM_DOCS, CHARVOCAB,
                        "req(ord, piece) AS (VALUES (0, '<SEP>'), (1, '<pad>'), (2, '▁the'), (3, '<SEP>'))",
                        "fresh AS (SELECT piece, min(ord) AS ord FROM req WHERE piece NOT IN (SELECT piece FROM charvocab) GROUP BY piece)")
    + """SELECT id, piece, score, kind FROM charvocab
UNION ALL SELECT CAST((SELECT max(id) FROM charvocab) + row_number() OVER (ORDER BY ord) AS INTEGER), piece, 0.0::DOUBLE, 'user' FROM fresh""",
    "check_added": _with(NORM_DOCS, CHARVOCAB,
                         "req(ord, piece) AS (VALUES (0, '<SEP>'), (1, '<pad>'), (2, '▁the'), (3, '<SEP>'))",
                         "fresh AS (SELECT piece, min(ord) AS ord FROM req WHERE piece NOT IN (SELECT piece FROM charvocab) GROUP BY piece)",
                         """newv AS (SELECT id, piece FROM charvocab UNION ALL
  SELECT CAST((SELECT max(id) FROM charvocab) + row_number() OVER (ORDER BY ord) AS INTEGER), piece FROM fresh)""")
    + """SELECT CAST(r.ord AS BIGINT) AS ord, r.piece, CAST(coalesce(v.id, -1) AS INTEGER) AS id,
    (SELECT count(*) FROM charvocab) AS old_size, (SELECT count(*) FROM newv) AS new_size, (SELECT count(*) FROM fresh) AS n_added,
    (SELECT count(*) FROM newv) = (SELECT count(*) FROM charvocab) + (SELECT count(*) FROM fresh) AS size_ok
FROM req r LEFT JOIN newv v ON v.piece = r.piece""",
    "encode_text": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"))
    + "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS digest FROM ed",
    "decode_ids": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"), dec("dd", "ed", "doc_id", "ids"))
    + "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM dd",
    "round_trip": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"), dec("dd", "ed", "doc_id", "ids"))
    + r"""SELECT d.doc_id, dd.text = trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS ok, CAST(len(ed.ids) AS BIGINT) AS n_tokens
FROM documents d JOIN ed USING (doc_id) JOIN dd USING (doc_id)""",
    "lookup_piece": _with(NORM_DOCS, CHARVOCAB) + """SELECT c.piece, CAST(coalesce(v.id, 0) AS INTEGER) AS id
FROM (SELECT DISTINCT unnest(string_split(text, '')) AS piece FROM benchmark) c
LEFT JOIN charvocab v ON v.piece = c.piece AND v.kind NOT IN ('unk', 'bos', 'eos', 'pad') WHERE c.piece <> ''""",
    "lookup_id": _with(NORM_DOCS, CHARVOCAB) + """SELECT vec_id, t.id, piece
FROM (SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS id FROM embeddings) t
LEFT JOIN charvocab v ON v.id = t.id""",
    "tokenize_text": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"))
    + "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS digest FROM ed",
    "tokenize_triples": _with(NORM_DOCS, CHARVOCAB, TRIPLES,
                              "tp AS (SELECT id, system_prompt || '<SEP>' || question || '<SEP>' || response AS prompt FROM triples)",
                              enc("et", "tp", "id", "prompt"))
    + "SELECT id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS digest FROM et",
    "tokenize_and_split": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"), SPLITS)
    + "SELECT split, count(*) AS n_rows, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM splits JOIN ed USING (doc_id) GROUP BY split",
    "tokenize_presplit": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"))
    + """SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split,
    count(*) AS n_rows, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM ed GROUP BY 1""",
    "pad_or_cut": _with(IDS) + """SELECT doc_id, CAST(len(p) AS BIGINT) AS n_padded, md5(array_to_string(p, ',')) AS digest,
    CAST(len(list_filter(p, lambda x: x = 3)) AS BIGINT) AS n_pad FROM (SELECT doc_id, list_resize(ids[1:1025], 1025, 3) AS p FROM ids)""",
    "shift_pair": _with(NORM_DOCS, CHARVOCAB, enc("ed", "documents", "doc_id", "text"))
    + f"""SELECT doc_id, md5(array_to_string(p[1:1024], ',')) AS x_digest, md5(array_to_string(p[2:1025], ',')) AS y_digest
FROM (SELECT doc_id, {_PAD} AS p FROM ed)""",
    "loss_tokens": _with(IDS) + f"""SELECT doc_id, n_targets, round((1024 - n_targets) / 1024.0::DOUBLE, 6) AS pad_share, n_cut FROM (
  SELECT doc_id, CAST(len(list_filter(({_PAD})[2:1025], lambda t: t <> 3)) AS BIGINT) AS n_targets,
    CAST(greatest(0, len(ids) - 1025) AS BIGINT) AS n_cut FROM ids)""",
    "check_examples": _with(IDS) + f"""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE len(x) <> 1024 OR len(y) <> 1024) AS n_bad,
    count(*) FILTER (WHERE x[2:1024] <> y[1:1023]) AS n_misaligned
FROM (SELECT p[1:1024] AS x, p[2:1025] AS y FROM (SELECT {_PAD} AS p FROM ids))""",
    "build_batches": _with(IDS, SHUFFLED) + f"""SELECT epoch, batch_id, count(*) AS n_pairs,
    string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY slot) AS doc_ids,
    md5(array_to_string(flatten(list(p[1:1024] ORDER BY slot)), ',')) AS x_digest,
    md5(array_to_string(flatten(list(p[2:1025] ORDER BY slot)), ',')) AS y_digest
FROM (SELECT sh.epoch, sh.pos // 32 AS batch_id, sh.pos % 32 AS slot, sh.doc_id, {_PAD} AS p FROM sh JOIN ids USING (doc_id))
GROUP BY epoch, batch_id""",
    "softmax": _with(LOGITS, """z AS (SELECT *, list_reduce(list_transform(l, lambda v: exp((v - mx) / 0.7::DOUBLE)), lambda a, b: a + b) AS z FROM lg)""",
                     "p AS (SELECT vec_id, target, list_transform(l, lambda v: exp((v - mx) / 0.7::DOUBLE) / z) AS probs FROM z)")
    + """SELECT vec_id, round(list_max(probs), 6) AS p_max, round(probs[target + 1], 6) AS p_target,
    round(list_reduce(probs, lambda a, b: a + b), 6) AS p_sum FROM p""",
    "cross_entropy": _with(LOGITS, """r AS (SELECT batch_id, CASE WHEN target <> 3 THEN
    mx + ln(list_reduce(list_transform(l, lambda v: exp(v - mx)), lambda a, b: a + b)) - l[target + 1] END AS loss FROM lg)""")
    + "SELECT batch_id, round(coalesce(avg(loss), 'NaN'::DOUBLE), 6) AS loss, count(loss) AS n_targets FROM r GROUP BY batch_id",
    "perplexity": _with(LOGITS, """r AS (SELECT batch_id, CASE WHEN target <> 3 THEN
    mx + ln(list_reduce(list_transform(l, lambda v: exp(v - mx)), lambda a, b: a + b)) - l[target + 1] END AS loss FROM lg)""",
                        "b AS (SELECT batch_id, coalesce(avg(loss), 'NaN'::DOUBLE) AS loss FROM r GROUP BY batch_id)")
    + "SELECT count(*) AS n_batches, round(avg(loss), 6) AS val_loss, round(avg(exp(loss)), 6) AS val_perplexity FROM b",
    "top1": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top1 FROM embeddings",
    "encode_prompts": _with(*_PROMPT_CTES) + """SELECT prompt_id, batch_id, n_input, min_len, max_len, total_len,
    md5(array_to_string(ids, ',')) AS digest FROM ep2""",
    "prompt_matrix": _with(*_PROMPT_CTES) + """SELECT prompt_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ',')) AS digest,
    CAST(len(list_filter(tokens, lambda x: x <> 3)) AS BIGINT) AS n_prompt FROM pm""",
    "batch_guard": _with(PROMPTS) + "SELECT batch_id, count(*) AS n_prompts, count(*) <= 32 AS ok FROM prompts GROUP BY batch_id",
    "repetition_penalty": _with(LOGITS, """q AS (SELECT vec_id, target, list_transform(l, lambda v, i: CASE
    WHEN list_contains([vec_id % 64, target, (vec_id * 7) % 64], i - 1) THEN CASE WHEN v < 0 THEN v * 9.0::DOUBLE ELSE v / 9.0::DOUBLE END
    ELSE v END) AS pen FROM lg)""") + """SELECT vec_id, round(list_reduce(pen, lambda a, b: a + b), 6) AS pen_sum,
    CAST(list_position(pen, list_max(pen)) - 1 AS INTEGER) AS pen_top1, round(pen[target + 1], 6) AS pen_target FROM q""",
    "nucleus_filter": _with(LOGITS, _KEPT) + "SELECT vec_id, CAST(token_id AS INTEGER) AS token_id, round(p, 6) AS p, CAST(rank AS BIGINT) AS rank FROM kept",
    "sample_token": _with(LOGITS, _KEPT, """c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    CAST(('0x' || substr(md5('42:0:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM kept)""")
    + """SELECT vec_id, CAST(coalesce(arg_min(token_id, rank) FILTER (WHERE cum > u), arg_max(token_id, rank)) AS INTEGER) AS token
FROM c GROUP BY vec_id""",
    "force_prompt": _with(*_PROMPT_CTES, *_COMP_CTES[2:]) + """SELECT pm.prompt_id, pm.min_len AS cur_pos,
    CAST(CASE WHEN pm.tokens[min_len + 1] <> 3 THEN pm.tokens[min_len + 1] ELSE comp.tokens[min_len + 1] END AS INTEGER) AS token,
    pm.tokens[min_len + 1] <> 3 AS forced
FROM pm LEFT JOIN comp USING (prompt_id)""",
    "stop_ids": _with(*_COMP_CTES) + """SELECT batch_id, bool_and(coalesce(list_has_any(tokens[n_input + 1:],
    (SELECT list(id) FROM charvocab WHERE kind = 'normal' AND piece IN ('.', '!'))), false)) AS stop, count(*) AS n_rows
FROM comp GROUP BY batch_id""",
    "stop_words": _with(*_COMP_CTES, """g AS (SELECT prompt_id, batch_id,
    list_transform(tokens[n_input + 1:], lambda x: CASE WHEN x = 3 THEN 2 ELSE x END) AS gen FROM comp)""",
                        dec("dg", "g", "prompt_id", "gen"))
    + """SELECT g.batch_id, bool_and(contains(dg.text, 'the')) AS stop, count(*) AS n_rows FROM g JOIN dg USING (prompt_id)
GROUP BY g.batch_id""",
    "trim_and_count": _with(*_COMP_CTES, _TRIM) + """SELECT prompt_id, n_generated, md5(array_to_string(trimmed, ',')) AS digest FROM trimmed""",
    "generation_report": _with(*_COMP_CTES, _TRIM) + """SELECT prompt_id, n_input AS num_input_tokens, n_generated AS num_generated_tokens FROM trimmed""",
    "split_words": _with(PROMPTS) + r"""SELECT prompt_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT prompt_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM prompts)""",
    "out_of_vocab": _with(PROMPTS, WORDS, _FLAG) + "SELECT prompt_id, array_to_string(missing, ' ') AS missing FROM miss",
    "flag_prompts": _with(PROMPTS, WORDS, _FLAG) + """SELECT p.prompt_id, CASE WHEN m.missing IS NULL THEN 'clear' ELSE 'flagged' END AS status,
    CAST(coalesce(len(m.missing), 0) AS BIGINT) AS n_missing FROM prompts p LEFT JOIN miss m USING (prompt_id)""",
    "stopword_coverage": _with(WORDS, STOP) + """SELECT (SELECT count(*) FROM stop) AS n_stop, count(*) AS n_missing,
    coalesce(array_to_string(list_sort(list(word)), ' '), '') AS missing FROM stop WHERE word NOT IN (SELECT word FROM words)""",
    "list_size": _with(WORDS) + "SELECT count(DISTINCT word) AS n_words FROM words",
    "lr_schedule": _with(RUNLOG) + "SELECT DISTINCT epoch, round(1e-4::DOUBLE * pow(0.85::DOUBLE, epoch), 12) AS lr FROM runlog",
    "best_checkpoints": _with(RUNLOG, _BEST) + "SELECT run, epoch, round(val_loss, 6) AS val_loss, CAST(rank AS BIGINT) AS rank FROM best",
    "early_stop": _with(RUNLOG, """c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS chk,
    min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM runlog)""",
                        """l AS (SELECT *, max(CASE WHEN prev_best IS NULL OR val_loss < prev_best THEN chk END)
    OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM c)""")
    + "SELECT run, min(CASE WHEN chk - last_imp >= 5 THEN epoch END) AS stop_epoch, count(*) AS n_checks FROM l GROUP BY run",
    "checkpoint_name": _with(RUNLOG, _BEST) + "SELECT run, epoch, printf('model-epoch=%d-val_loss=%.2f', epoch, val_loss) AS ckpt_name FROM best",
    "checkpoint_path": _with(RUNLOG, _BEST) + "SELECT run, epoch, 'checkpoints-model/model-' || epoch || '.pt' AS ckpt_path FROM best",
    "run_stamp": "SELECT event_id, strftime(ts, '%Y-%m-%d-%I:%M:%S_%p') AS stamp FROM events",
}
ORACLE["flag_stream"] = ORACLE["flag_prompts"]
ORACLE["normalise_wide"] = ORACLE["normalise_text"]
_MARKED = "text"
for _old, _new in (("'e '", "'e' || chr(8203) || ' ' || chr(65279)"), ("', '", "chr(1) || ',' || chr(127) || chr(8232)"),
                   ("'th'", "'t' || chr(8204) || 'h'"), ("'o'", "'o' || chr(11)"), ("'.'", "'.' || chr(65374)")):
    _MARKED = f"replace({_MARKED}, {_old}, {_new})"
# control characters go; special blanks are blanks; the full-width tilde stays
_RULED = rf"regexp_replace(regexp_replace({_MARKED}, '[\x01-\x08\x0B\x0E-\x1F\x7F\x{{8F}}\x{{9F}}]', '', 'g'), " \
    rf"'[\t\n\f\r\x{{61C}}\x{{1680}}\x{{200B}}\x{{200C}}\x{{200E}}\x{{200F}}\x{{2028}}\x{{2029}}\x{{2581}}\x{{FEFF}}\x{{FFFD}}]', ' ', 'g')"
ORACLE["normalise_trainer"] = f"""SELECT doc_id, md5(norm) AS norm_md5, CAST(length(norm) AS BIGINT) AS n_chars
FROM (SELECT doc_id, {_norm(_RULED)} AS norm FROM documents)"""
ORACLE["sample_sentences_cut"] = ORACLE["sample_sentences"].replace("idx < 1000000", "idx < 2000")
ORACLE["flag_stream_progress"] = f"""WITH f AS ({ORACLE["flag_prompts"]}),
c AS (SELECT status, count(*) AS n FROM f GROUP BY status),
p AS (SELECT status, n, unnest(range(0, (n + 31) // 32)) AS progress FROM c)
SELECT status, progress, least(32, n - 32 * progress) AS n_prompts, n - 32 * progress >= 32 AS full FROM p"""
# the separator stands as one private character of the vocabulary
ORACLE["encode_added"] = _with(
    NORM_DOCS, CHARVOCAB, TRIPLES,
    """with_sep AS (SELECT id, piece, kind FROM charvocab
  UNION ALL SELECT CAST(max(id) + 1 AS INTEGER), chr(57344), 'normal' FROM charvocab)""",
    "joined AS (SELECT id, replace(question || '<SEP>' || response, '<SEP>', chr(57344)) AS text FROM triples)",
    enc("enc_s", "joined", "id", "text").replace("JOIN charvocab v", "JOIN with_sep v")) + """SELECT id, CAST(len(ids) AS BIGINT) AS n,
    CAST(len(list_filter(ids, lambda x: x = sep)) AS BIGINT) AS n_sep,
    md5(array_to_string(ids, ',')) AS digest FROM enc_s, (SELECT max(id) AS sep FROM with_sep)"""
