"""Checking SQL for the operators that SQL can express, over whole tables, by plain means."""

from __future__ import annotations

_EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
), counted AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(s.b, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(s.b, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN smallest s ON s.a = e.vec_id
"""

_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINE_DEDUP = f"""
WITH split_up AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split_up
), keyed AS (
    SELECT doc_id, pos, line, {_KEY} AS key FROM lines
), common AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_ESCAPED = "replace({x}, '\\', '\\\\')"
for _mark in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|"):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

_CHAT_FORMAT = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shaped AS (
    SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS shape, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}) + 19) AS chars
    FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
       CASE shape WHEN 'user,assistant' THEN 'prompt-response' WHEN 'system,user,assistant' THEN 'instruction-input-output'
            ELSE 'messages' END AS layout
FROM shaped
"""

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
))
#: Twelve rounds, each a step of both rankings from the one before.
_ROUNDS = ", ".join(
    f"""s{k} AS MATERIALIZED (
        SELECT kind, host, sum(score) AS score FROM (
            SELECT * FROM s0 UNION ALL
            SELECT e.kind, e.dst, s.score * e.part * 0.85 FROM s{k - 1} s JOIN edges e ON e.kind = s.kind AND e.src = s.host) GROUP BY ALL)"""
    for k in range(1, 13)
)

_URL_FILTERS = f"""
WITH RECURSIVE cut AS (
    SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
    SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_ASCII}), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), rules(domain, prefix, verdict) AS (VALUES {_RULES}),
fits AS (
    SELECT page_id, domain || prefix AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(domain || prefix) DESC) AS n
    FROM parts JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
), ruled AS (
    SELECT p.page_id, host, path, rule, verdict AS said FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
), found AS (
    SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?[a-z][a-z0-9+.-]*://([^/?#"''\\s>]+)', 1)) AS link FROM parts WHERE host <> ''
), climb(host) AS (
    SELECT host FROM parts WHERE host <> '' UNION SELECT translate(link, {_ASCII}) FROM found
    UNION SELECT substr(host, strpos(host, '.') + 1) FROM climb WHERE len(string_split(host, '.')) > 2
), kin AS (
    SELECT DISTINCT host AS a, substr(host, strpos(host, '.') + 1) AS b FROM climb WHERE len(string_split(host, '.')) > 2
), links AS (
    SELECT src, dst, count(*) AS n FROM (
        SELECT src, translate(link, {_ASCII}) AS dst FROM found UNION ALL SELECT a, b FROM kin UNION ALL SELECT b, a FROM kin)
    WHERE src <> dst GROUP BY ALL
), edges AS MATERIALIZED (
    SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS part FROM links
    UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links
), s0 AS MATERIALIZED (
    SELECT kind, host, 0.15 * n / sum(n) OVER (PARTITION BY kind) AS score
    FROM (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE said IS NOT NULL GROUP BY ALL)
), {_ROUNDS}, scores AS (
    SELECT host, round(sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END), 12) > round(sum(CASE kind WHEN 'trust' THEN score ELSE 0 END), 12) AS bad
    FROM s12 GROUP BY host
)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON s.host = r.host
"""

#: CRC-32 of the UTF-8 bytes of a text, by the table of the polynomial 0xEDB88320; ``crc`` has that table as a list.
_CRC_TABLE = """crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
               lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS tab
)"""


def _crc32(text: str) -> str:
    digits = f"hex(encode({text}))"
    digit = "(strpos('0123456789ABCDEF', substr({d}, {at}, 1)) - 1)"
    octets = f"list_transform(range(1, length({digits}) + 1, 2), lambda k: {digit.format(d=digits, at='k')} * 16 + {digit.format(d=digits, at='k + 1')})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda a, b: xor(tab[1 + (xor(a, b) & 255)], a >> 8)), 4294967295::BIGINT)"


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Row by row from the left: the cheapest way to each state, insertions added after every row (n: rows done; q: the state).
_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE}, spoilt AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage
    FROM conversations, crc
), rows AS (
    SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
           CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) FROM spoilt WHERE damage <> 0)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n, substr(role, 1, 1) AS initial,
           trim(text, {_WHITE}) AS bare
    FROM rows
), judged AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS earlier
    FROM placed
), steps(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserts(p, q, cost, audit) AS (
    VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
           (2, 3, 3, 'I'), (2, 2, 6, 'II'), (3, 2, 3, 'I'), (3, 3, 6, 'II')
), moves AS (
    SELECT conv_id, n, q.p, q.p AS q, 4 AS cost, 'D' AS letter, NULL AS made FROM judged, (SELECT unnest(range(4)) AS p) q
    UNION ALL SELECT conv_id, n, p, q, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', role || ':' || text
              FROM judged j JOIN steps s ON s.initial = j.initial WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, n, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
              FROM judged j JOIN steps s ON s.initial IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')
), ways AS (
    SELECT conv_id, n, m.p, i.q, m.cost + i.cost AS cost, letter || i.audit AS audit, m.q AS mid, made
    FROM moves m JOIN inserts i ON i.p = m.q
), best(conv_id, n, q, cost, audit, made) AS (
    SELECT c.conv_id, 0::BIGINT, q, cost::BIGINT, audit, CASE q WHEN 2 THEN ['user:'] WHEN 3 THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END
    FROM (SELECT DISTINCT conv_id FROM judged) c, inserts WHERE p = 0
    UNION ALL
    SELECT conv_id, n, q, w.cost, w.audit, w.made FROM (
        SELECT b.conv_id, w.n, w.q, min(struct_pack(cost := b.cost + w.cost, audit := b.audit || w.audit, made := list_concat(b.made,
            CASE WHEN w.made IS NULL THEN []::VARCHAR[] ELSE [w.made] END,
            CASE WHEN length(w.audit) = 1 THEN []::VARCHAR[] WHEN length(w.audit) = 2 THEN [CASE w.mid WHEN 2 THEN 'assistant:' ELSE 'user:' END]
                 ELSE [CASE w.mid WHEN 2 THEN 'assistant:' ELSE 'user:' END, CASE w.mid WHEN 2 THEN 'user:' ELSE 'assistant:' END] END))) AS w
        FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.n = b.n + 1 AND w.p = b.q
        GROUP BY b.conv_id, w.n, w.q)
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE n > 1 AND (earlier || initial) NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
    FROM judged GROUP BY conv_id
), ended AS (
    SELECT f.*, (SELECT min(struct_pack(cost := cost, audit := audit, made := made)) FROM best b
                 WHERE b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.n = f.n AND b.q IN (0, 3)) AS w
    FROM facts f
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_EXACT_DEDUP = r"""
WITH normal AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY text)::BIGINT AS group_size,
       row_number() OVER same = 1 AS kept, sha256(text) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
"""

#: Near words meet in the texts that one deletion leaves of both (equal lengths: at the same place) or of the longer one.
_SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS MATERIALIZED (
    SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {_ASCII}) AS word FROM documents)
    WHERE length(word) >= 5 GROUP BY ALL
), hashed AS MATERIALIZED (
    SELECT word, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || word")} AS h FROM runs, crc
), cut AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS MATERIALIZED (
    SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS MATERIALIZED (
    SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest
), ranked AS (
    SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
           row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place
    FROM near p JOIN words o ON o.word = p.other
), judged AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
           CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), climb(word, root, further) AS (
    SELECT word, word, form FROM judged
    UNION ALL SELECT c.word, c.further, j.form FROM climb c JOIN judged j ON j.word = c.further
)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN climb c ON c.word = j.word AND c.further IS NULL
"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": _EMBEDDING_NEAR_DEDUP,
    "op4_line_dedup": _LINE_DEDUP,
    "op5_chat_format": _CHAT_FORMAT,
    "op10_url_filters": _URL_FILTERS,
    "op11_conversation_repair": _REPAIR,
    "op12_exact_dedup": _EXACT_DEDUP,
    "op13_spelling_variants": _SPELLING_VARIANTS,
}
