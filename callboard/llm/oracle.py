"""SQL for the queries that SQL can express, over whole tables, written apart from the Spark code."""

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_RUNS = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
    SELECT doc_id, i, string_split(t, chr(10))[i] AS line
    FROM texts, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
full_lines AS (
    SELECT doc_id, i, line, len(regexp_extract_all(line, '{_WORD}')) AS words,
           row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
    FROM lines WHERE regexp_matches(line, '{_WORD}')),
starts AS (
    SELECT doc_id, n, [i, lead(i, 1) OVER w, lead(i, 2) OVER w] AS covers,
           line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS content, 3 AS size
    FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
    UNION ALL
    SELECT doc_id, n, [i], line, 1 FROM full_lines WHERE words >= 50
    UNION ALL
    SELECT doc_id, n, covers, content, 2 FROM (
        SELECT doc_id, n, words, [i, lead(i) OVER w] AS covers, line || chr(10) || lead(line) OVER w AS content,
               words + lead(words) OVER w AS words2
        FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n))
    WHERE words < 50 AND words2 >= 50),
placed AS (
    SELECT *, first_value((doc_id, n)) OVER (PARTITION BY size, content ORDER BY doc_id, n) AS first
    FROM starts WHERE content IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(covers) AS i FROM placed WHERE first <> (doc_id, n))
SELECT t.doc_id, CASE WHEN t.t = '' THEN 0 ELSE len(string_split(t.t, chr(10))) END AS n_lines,
       count(g.i) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM texts t JOIN lines l USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY t.doc_id, t.t
"""

QUALITY = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS found
    FROM texts, unnest(range(1, len(w) - 3)) AS u(i)),
repeated AS (
    SELECT doc_id, count(DISTINCT i + j) AS n
    FROM windows, unnest(range(5)) AS u(j) WHERE found > 1 GROUP BY doc_id),
lines AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line) AS copy, regexp_matches(line, '{_WORD}') AS has_word
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)),
line_counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (has_word AND copy > 1) AS later FROM lines GROUP BY doc_id),
measures AS (
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, l.n AS n_lines, l.later AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words
    FROM texts JOIN line_counts l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
judged AS (
    SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
         + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
         + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
    FROM measures)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM judged
"""

BENCHMARK = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
strings AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS s
    FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM strings),
places AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
    FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (SELECT doc_id, p.size, i, item_id FROM places p JOIN strings USING (size, s)),
inside AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, unnest(range(size)) AS u(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(inside.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(inside.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN inside USING (doc_id) LEFT JOIN found USING (doc_id)
"""

WARC = """
WITH digests AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex) AS least,
           array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111',
               4 * (instr('0123456789abcdef', c) - 1) + 1, 4) for c in string_split(hex, '')], '') AS bits
    FROM digests)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 5 * i + 1, 5))::INT, 1)
           for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM named
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')
           || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

# CRC-32 of the decimal doc_id: eight shifts after each character.
_CRC32 = """xor(list_reduce(
        [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
            lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END),
    4294967295::BIGINT)"""

RUN_DETECTION = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC32} AS h
    FROM documents),
shapes AS (
    SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a
    FROM texts),
words AS MATERIALIZED (
    SELECT doc, i, w[1 + CASE WHEN chosen AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END] AS word
    FROM shapes, unnest(range(n)) AS u(i)),
equal AS (
    SELECT x.doc, y.i - x.i AS p, x.i, x.i - row_number() OVER (PARTITION BY x.doc, y.i - x.i ORDER BY x.i) AS island
    FROM words x JOIN words y ON x.doc = y.doc AND x.word = y.word AND x.i < y.i),
stretches AS (
    SELECT doc, p, min(i) AS s, max(i) + 1 + p AS e FROM equal GROUP BY doc, p, island
    HAVING count(*) + p >= greatest(12, 2 * p)),
runs AS MATERIALIZED (SELECT doc, s, e - s AS l, min(p) AS p FROM stretches GROUP BY doc, s, e),
listed AS (
    SELECT doc, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p)) AS digest,
           first((s, l, p) ORDER BY l DESC, s, p) AS best
    FROM runs GROUP BY doc),
gone AS (SELECT DISTINCT doc, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (
    SELECT doc, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM words ANTI JOIN gone USING (doc, i) GROUP BY doc)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
       1000 * best[2] // best[3] AS exponent_milli, coalesce(r.digest, sha256('')) AS runs_sha256,
       coalesce(k.digest, sha256('')) AS collapsed_sha256
FROM texts t LEFT JOIN listed r USING (doc) LEFT JOIN kept k USING (doc)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM docs),
postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS weight
    FROM postings, corpus GROUP BY term, n),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term
          FROM benchmark) GROUP BY ALL),
scored AS (
    SELECT item_id, doc, doc_id,
           sum(times * weight * (1000000000 * tf // (1000 * tf + 8 * (100 - 75 + 75 * len(w) * n // l))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (doc), corpus GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE = {
    "op4_line_dedup": LINE_RUNS,
    "op5_quality_ledger": QUALITY,
    "op7_decontamination": BENCHMARK,
    "op9_warc": WARC,
    "op10_chat_format": CHAT,
    "op11_run_detection": RUN_DETECTION,
    "op13_lexical_search": LEXICAL_SEARCH,
}
