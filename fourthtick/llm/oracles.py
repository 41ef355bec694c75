"""DuckDB statements for the queries that SQL can express.

Models, tokenizers, hash sketches and random draws cannot be written in SQL; those
queries are tested against brute force in tests/llm.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_window AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i
          FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc JOIN lengths ON len(w) >= n)
), found AS (
    SELECT doc_id, i, n, item_id FROM doc_window JOIN item_window USING (n, phrase)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# A window is near where its rarest word stands and all its words are at most 2 from their places.
PROXIMITY = rf"""
WITH exact AS ({DECONTAMINATION}),
doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), place AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
frequency AS (SELECT word, count(*) AS df FROM place GROUP BY word),
item AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_window AS (
    SELECT row_number() OVER () AS v, item_id, words
    FROM (SELECT DISTINCT item_id, w[i:i + 9] AS words
          FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i
                FROM item WHERE len(w) > 0))
), part AS (
    SELECT v, i, word, df
    FROM (SELECT v, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM item_window)
    LEFT JOIN frequency USING (word)
), rarest AS (
    SELECT v, min({{'df': df, 'word': word, 'i': i}}) AS first, count(*) AS n
    FROM part GROUP BY v HAVING count(df) = count(*)
), anchor AS (
    SELECT v, r, p, first.i AS k, n FROM rarest JOIN place ON word = first.word
), near AS (
    SELECT DISTINCT v, r FROM (
        SELECT anchor.v, anchor.r, anchor.p
        FROM anchor JOIN part ON part.v = anchor.v
        JOIN place ON place.r = anchor.r AND place.word = part.word
                  AND abs(place.p - (anchor.p + part.i - anchor.k)) <= 2
        GROUP BY anchor.v, anchor.r, anchor.p, n HAVING count(DISTINCT part.i) = n)
), named AS (
    SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM near JOIN item_window USING (v))
    WHERE name IS NOT NULL GROUP BY r
)
SELECT exact.*, coalesce(n, 0) AS n_near_items, sha256(coalesce(names, '')) AS near_items_sha256
FROM doc JOIN exact USING (doc_id) LEFT JOIN named USING (r)
"""

SUBSTRINGS = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i
          FROM doc WHERE length(h) >= 100)
), first_seen AS (SELECT g, min(doc_id) AS least_id FROM piece GROUP BY g),
hit AS (
    SELECT doc_id, i FROM piece JOIN first_seen USING (g) WHERE doc_id > least_id
), marked AS (
    SELECT doc_id, i,
           CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens
    FROM hit
), numbered AS (
    SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), run AS (
    SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM numbered GROUP BY doc_id, run
), placed AS (
    SELECT doc_id, lo, hi,
           coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before
    FROM run
), cut AS (
    SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last_hi,
           string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
    FROM placed JOIN doc USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h
                         ELSE kept || substr(h, 2 * last_hi + 1) END)) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0B\f\r]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i
          FROM doc WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), link AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM doc
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, min(reach.b) AS component_id
FROM doc LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = doc.doc_id
GROUP BY doc.doc_id, n
"""

LEXICAL = rf"""
WITH item AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark
), doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w
    FROM documents
), corpus AS (SELECT count(*) AS nn, sum(len(w)) AS ll FROM doc WHERE len(w) > 0),
posting AS (
    SELECT r, doc_id, n, term, count(*) AS tf
    FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM doc)
    WHERE term IN (SELECT term FROM item) GROUP BY r, doc_id, n, term
), weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM posting, corpus GROUP BY term
), scored AS (
    SELECT item_id, r, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS score
    FROM posting JOIN weight USING (term) JOIN item USING (term), corpus
    GROUP BY item_id, r, doc_id
), ranked AS (
    SELECT item_id, doc_id, score,
           row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM ranked WHERE k <= 50
"""

# crc32 bit by bit; the edits by a table over the four states, one row of each conversation a step.
CONVERSATIONS = r"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), dealt AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(
        list_prepend(4294967295::BIGINT,
                     list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
        lambda c, b: list_reduce(
            list_prepend(xor(c, b), range(8)),
            lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
        ), 4294967295) % 20 AS kind
    FROM named
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM dealt WHERE kind <> 0
), placed AS (
    SELECT conv_id, turn, role, text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k
    FROM damaged
), told AS (
    SELECT conv_id, turn, role, text, k,
           lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated'
                ELSE 'fine' END AS fault
    FROM placed
), added(from_state, into_state, edits, lines) AS (VALUES
    (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []),
    (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
    (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])
), own(from_state, into_state, edit, initial, price) AS (VALUES
    (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3),
    (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (2, 3, 'R', '', 2), (3, 2, 'R', '', 2),
    (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (3, 2, 'K', 'u', 0)
), path AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state,
           {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best
    FROM placed
    UNION ALL
    SELECT p.conv_id, t.k, o.into_state, min({
        'cost': p.best.cost + 2 * length(a.edits) + o.price
                + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END,
        'audit': p.best.audit || a.edits || edit,
        'lines': p.best.lines || a.lines || CASE edit
            WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
            ELSE [CASE WHEN o.into_state = 2 THEN 'user:' ELSE 'assistant:' END || text] END})
    FROM path p JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k + 1
    JOIN added a ON a.from_state = p.state
    JOIN own o ON o.from_state = a.into_state AND (edit = 'D' OR fault IN ('fine', 'truncated'))
                  AND (edit <> 'K' OR initial = role[1])
    GROUP BY p.conv_id, t.k, o.into_state
), figures AS (
    SELECT conv_id, max(k) AS k, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (k > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM told GROUP BY conv_id
), ended AS (
    SELECT p.conv_id, min({'cost': p.best.cost + 2 * length(a.edits), 'audit': p.best.audit || a.edits,
                           'lines': p.best.lines || a.lines}) AS best
    FROM path p JOIN figures f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k
    JOIN added a ON a.from_state = p.state AND a.into_state IN (0, 3)
    GROUP BY p.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES: dict[str, str] = {
    "op5_decontamination": DECONTAMINATION,
    "op5_proximity_matches": PROXIMITY,
    "op7_suffix_array_dedup": SUBSTRINGS,
    "op10_ngram_jaccard_join": JACCARD,
    "op12_lexical_search": LEXICAL,
    "op13_conversation_repair": CONVERSATIONS,
}
