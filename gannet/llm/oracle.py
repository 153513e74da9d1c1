"""DuckDB SQL for the queries that SQL can express, by the plain definition of each result."""

from __future__ import annotations

from gannet.llm import embedding_dedup, license_scan, lm_scoring, near_dedup, quality_rules

_WORDS = r"'[^\x20\x09-\x0D]+'"
_CLASSES = """
, walk(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, w.root FROM walk w JOIN edges e ON e.a = w.id AND w.root < e.b), label AS (SELECT id, min(root) AS root FROM walk GROUP BY id)"""


def _quality() -> str:
    tests = []
    grams = []
    for n, limit in quality_rules.NGRAM_LIMITS.items():
        text = " || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n))
        grams.append(f"g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS later, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM (SELECT doc_id, i, {text} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL)")
        grams.append(
            f"c{n} AS (SELECT doc_id, CAST(coalesce(sum(length(w)) FILTER (WHERE later), 0) AS BIGINT) AS chars, count(*) FILTER (WHERE twice) AS n FROM (SELECT w.doc_id, w.w, coalesce(bool_or(g.later) OVER b, false) AS later, coalesce(bool_or(g.twice) OVER b, false) AS twice "
            f"FROM words w LEFT JOIN g{n} g ON g.doc_id = w.doc_id AND g.i = w.i WINDOW b AS (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) GROUP BY doc_id)"
        )
        tests.append(f"coalesce(c{n}.chars, 0) <= {limit} * word_chars")
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = b.doc_id" for n in quality_rules.NGRAM_LIMITS)
    base = quality_rules.BASE_N
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
    lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs) WHERE regexp_matches(line, {_WORDS})),
    dup AS (SELECT doc_id, count(*) AS n, CAST(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS BIGINT) AS chars FROM lines WHERE again GROUP BY doc_id),
    {", ".join(grams)},
    b AS (SELECT d.doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.chars, 0) AS dup_line_chars FROM docs d LEFT JOIN dup USING (doc_id))
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c{base}.n, 0) AS n_repeat_words, n_words < {quality_rules.MIN_WORDS} OR 100 * coalesce(c{base}.n, 0) > {quality_rules.BASE_PERCENT} * n_words AS base_failed,
      NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * coalesce(c{base}.n, 0) > {quality_rules.BASE_PERCENT} * n_words) AND dup_line_chars <= {quality_rules.LINE_CHAR_LIMIT} * word_chars AND {" AND ".join(tests)} AS kept, dup_line_chars
    FROM b {joins}"""


def _near() -> str:
    n = near_dedup.SHINGLE
    text = " || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n))
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {text} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND {n - 1}),
    size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    edges AS (SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE shared >= {near_dedup.SIMILARITY} * (p.n + q.n - shared)),
    nodes AS (SELECT DISTINCT doc_id AS id FROM documents){_CLASSES}
    SELECT id AS doc_id, root AS class_id, id = root AS kept FROM label"""


def _base() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH d AS (SELECT doc_id, crc32_of % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), {_WORDS}), chr(10)) AS ws FROM (SELECT *, {_crc('doc_id')} AS crc32_of FROM documents)),
    t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT CAST(sum(c) AS BIGINT) AS tokens, count(*) AS kinds FROM c)
    SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(tokens) AS train_tokens, round(sum(log10((coalesce(c, 0) + {lm_scoring.ALPHA}) / (tokens + {lm_scoring.ALPHA} * (kinds + 1)))), 6) AS base_score
    FROM t LEFT JOIN c USING (w), n GROUP BY doc_id"""


def _crc(column: str) -> str:
    """crc32 of a number's decimal text, a bit at a time over its characters' codes."""
    step = "list_reduce([acc, 1, 2, 3, 4, 5, 6, 7, 8], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    over = step.replace("acc", "xor(a, b)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {over}), 4294967295)"


def _embedding() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e, len(e) AS n FROM v WHERE label IS NOT NULL AND list_inner_product(e, e) > 0),
    edges AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.label = y.label AND x.n = y.n AND x.id <> y.id WHERE list_inner_product(x.e, y.e) >= {embedding_dedup.COSINE}),
    nodes AS (SELECT id FROM v), direct AS (SELECT a, count(*) AS n FROM edges GROUP BY a){_CLASSES}
    SELECT l.id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, l.id = root AS kept FROM label l LEFT JOIN direct ON a = l.id"""


def _chat() -> str:
    added = "length(t) - length(replace(t, '~', '')) + 2 * len(regexp_extract_all(t, '<\\||</?s>|\\[/?INST\\]')) + CASE WHEN regexp_matches(t, '(</?s?|\\[/?I?N?S?T?)$') THEN 2 ELSE 0 END"
    return f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
      CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length('<|turn|>') + length(role) + 1 + length(t) + {added} + length('<|end|>') + 1) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def _licences() -> str:
    n = license_scan.SHINGLE
    given = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())
    split = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    grams = f"list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i : i + {n - 1}], ' '))"
    return f"""WITH t AS (SELECT template, {grams} AS gs, CAST(pow(2, ceil(log2(len(ws) - {n - 1}))) AS BIGINT) AS s FROM (SELECT template, {split} AS ws FROM (VALUES {given}) v(template, text))),
    tg AS (SELECT DISTINCT template, s, unnest(gs) AS g FROM t), many AS (SELECT template, count(*) AS n FROM tg GROUP BY 1),
    d AS (SELECT doc_id, {grams} AS gs FROM (SELECT doc_id, {split} AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) >= {n}),
    dg AS (SELECT doc_id, len(gs) AS size, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS i FROM d),
    hits AS (SELECT doc_id, size, template, s, g, unnest([(i // s) * s, (i // s - 1) * s]) AS at_ FROM dg JOIN tg USING (g)),
    w AS (SELECT doc_id, template, at_, size, s, count(DISTINCT g) AS k FROM hits WHERE at_ >= 0 GROUP BY ALL),
    r AS (SELECT *, k / n AS share, row_number() OVER (PARTITION BY doc_id, template ORDER BY k DESC, at_) AS rn FROM w JOIN many USING (template) WHERE k >= {license_scan.CONTAINMENT} * n)
    SELECT doc_id, template, CAST(share AS DOUBLE) AS containment, CAST(at_ AS INTEGER) AS first_word, CAST(least(2 * s, size - at_) + {n - 1} AS INTEGER) AS n_words FROM r WHERE rn = 1"""


ORACLE = {
    "op2_license_scans": _licences(),
    "lm_base": _base(),
    "op4_embedding_near_dedup": _embedding(),
    "op5_minhash_near_dedup": _near(),
    "op6_chat_formatting": _chat(),
    "op10_quality_rules": _quality(),
}
