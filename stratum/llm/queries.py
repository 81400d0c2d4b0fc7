"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, bpe, chat, fim, fingerprints, html, media, packing, pieces, pii, simhash_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_simhash": simhash_dedup.op1_simhash,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_fim": fim.op11_fim,
    "op12_alignment": align.op12_alignment,
    "op13_pieces": pieces.op13_pieces,
    "op2_chat": chat.op2_chat,
    "op3_media": media.op3_media,
    "op4_pii": pii.op4_pii,
    "op5_suffix": suffix_dedup.op5_suffix,
    "op6_html": html.op6_html,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_packing": packing.op9_packing,
}

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '##', '#\#'), '##', '#\#'), '</', '<\/')"
ORACLES: dict[str, str] = {
    "op2_chat": rf"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, role AS r0, text AS t0 FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
k AS (SELECT *, coalesce(r0, '') AS role, coalesce(t0, '') AS text FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(replace({_ESCAPED.format('role')}, chr(10), '\' || chr(10))) + 1 + length({_ESCAPED.format('text')}) + length(chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM k GROUP BY conv_id
""",
    "op11_fim": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""",
    # bytes as hexadecimal digits; the last pattern keeps pairs of digits aligned where a character is incomplete
    "op5_suffix": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, h, unnest(range(0, (length(h) // 2 - 400) // 512 + 1)) AS b FROM d WHERE length(h) >= 800), z AS (SELECT r, b, substr(h, 1024 * b + 1, 1024 + 798) AS z FROM b),
k AS (SELECT r, 512 * b + unnest(range(0, length(z) // 2 - 399)) AS p, unnest(list_transform(range(0, length(z) // 2 - 399), lambda p: md5_number(substr(z, 2 * p + 1, 800)))) AS k FROM z),
m AS (SELECT r, p FROM k SEMI JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
n AS (SELECT r, p, (p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -401) + 400)::INT AS new FROM m),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM n), s AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY r, g),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM s),
c AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head FROM q JOIN d USING (r) GROUP BY r),
e AS (SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END AS kept FROM d LEFT JOIN c USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256,
  decode(unhex(array_to_string(regexp_extract_all(kept, '([0-7].|(?:C[2-9A-F]|D.)[89AB].|E.[89AB].[89AB].|F[0-4][89AB].[89AB].[89AB].)|..', 1), ''))) AS text FROM e
""",
}
