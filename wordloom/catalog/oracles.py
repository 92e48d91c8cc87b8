"""SQL for DuckDB that gives the rows of each query by other means."""

from __future__ import annotations

from wordloom.catalog.inputs import CUE, HEAD, KEYS_PER_FILE, TAIL
from wordloom.catalog.queries import MAX_BYTES, MAX_LINES, REQUESTS_PER_BATCH, WORDS_PER_REQUEST
from wordloom.schemas import DEFAULT_MAX_TOKENS, DEFAULT_MODEL, DEFAULT_USER_PREFIX

# The characters of the Spark side's white space class, for RE2.
_WHITE = (
    r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
_NOT_WORD = rf"[^\p{{L}}\p{{M}}{_WHITE}\-]"


def _text(value: str) -> str:
    """A SQL expression for a text with line ends."""
    quoted = ["'" + part.replace("'", "''") + "'" for part in value.split("\n")]
    return "(" + " || chr(10) || ".join(quoted) + ")"


def _subtitle(text: str, note: str) -> str:
    return (
        f"{_text(HEAD)} || replace({text}, chr(10), {_text(CUE)}) || {_text(TAIL)} || {note} "
        "|| ']' || chr(10)"
    )


def _split(keys: str, source: str, text: str, pattern: str, value: str, place: str) -> str:
    """Rows of (keys, value, place from 0) of a text cut at a pattern."""
    return (
        f"SELECT {keys}, unnest(parts) AS {value}, "
        f"unnest(range(len(parts))) AS {place} "
        f"FROM (SELECT {keys}, string_split_regex({text}, '{pattern}') AS parts FROM {source})"
    )


def _subtitle_tokens(keys: str, source: str) -> str:
    """CTEs from ``subs(keys, text)`` to ``tokens(keys, pos, token)``, line by line."""
    return f"""
subs AS ({source}),
cut AS (SELECT {keys}, string_split(text, chr(10)) AS parts FROM subs),
lines AS (SELECT {keys}, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM cut),
seen AS (SELECT *, lag(line) OVER (PARTITION BY {keys} ORDER BY i) AS before FROM lines),
kept AS (
    SELECT {keys}, i, regexp_replace(line, '<[^>]*>', '', 'g') AS line FROM seen
    WHERE NOT contains(line, '-->') AND NOT regexp_full_match(coalesce(before, ''), '[0-9]+')
),
joined AS (
    SELECT {keys}, string_agg(line, ' ' ORDER BY i) AS text FROM kept
    WHERE regexp_matches(line, '[^{_WHITE}]') GROUP BY {keys}
),
cleaned AS (SELECT {keys}, regexp_replace(text, '{_NOT_WORD}', '', 'g') AS text FROM joined),
tokens AS ({_split(keys, "cleaned", "text", f"[{_WHITE}]+", "token", "pos")})"""


# Letters beyond ASCII as one byte each, so that distances in bytes are distances in letters.
_OTHER_LETTERS = "àáâäçèéêëìíîïñòóôöùúûüýßæœ"
_PLAIN_LETTERS = f"translate(word, '{_OTHER_LETTERS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


_KNOWN = f"""
known_cut AS (
    SELECT string_split_regex(regexp_replace(text, '{_NOT_WORD}', '', 'g'), '[{_WHITE}]+') AS parts
    FROM benchmark
),
known AS (
    SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(parts) AS w FROM known_cut) WHERE w <> ''
)"""

_DOCUMENT_TOKENS = f"""
stripped AS (
    SELECT doc_id, lang, regexp_replace(text, '{_NOT_WORD}', '', 'g') AS text FROM documents
),
tokens AS ({_split("doc_id, lang", "stripped", "text", f"[{_WHITE}]+", "token", "pos")})"""

_LANGUAGE_WORDS = f"""{_DOCUMENT_TOKENS},
language_words AS (SELECT DISTINCT lang, lower(token) AS word FROM tokens WHERE token <> '')"""


def _capitalised(word: str) -> str:
    """Upper-case first letter; a sharp s becomes SS."""
    return f"(upper(replace(substr({word}, 1, 1), 'ß', 'ss')) || substr({word}, 2))"


_PACKED = f"""{_LANGUAGE_WORDS},
numbered AS (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS pos
    FROM language_words
),
placed AS (
    SELECT lang, word, pos, (pos // {WORDS_PER_REQUEST}) // {REQUESTS_PER_BATCH} AS batch_id,
        (pos // {WORDS_PER_REQUEST}) % {REQUESTS_PER_BATCH} AS request_id FROM numbered
)"""

_BODY = (
    f'"method":"POST","url":"/v1/chat/completions","body":{{"model":"{DEFAULT_MODEL}",'
    '"messages":[{"role":"system","content":"sys"},{"role":"user","content":"'
)
_FORMAT = (
    ',"response_format":{"type":"json_schema","json_schema":{"name":"response","strict":true,'
    '"schema":{"type":"object"}}}'
)

_REQUEST_LINES = f"""{_PACKED},
lists AS (
    SELECT lang, batch_id, request_id, string_agg(word, ', ' ORDER BY pos) AS commas,
        string_agg(word, ' ' ORDER BY pos) AS blanks
    FROM placed GROUP BY lang, batch_id, request_id
),
named AS (
    SELECT 'plain' AS mode, lang, batch_id, request_id,
        'request-' || (request_id + 1) AS custom_id,
        '{DEFAULT_USER_PREFIX}' || commas AS user_message, '' AS tail FROM lists
    UNION ALL
    SELECT 'structured', lang, batch_id, request_id, 'request-' || request_id,
        '{DEFAULT_USER_PREFIX}' || blanks, '{_FORMAT}' FROM lists
),
request_lines AS (
    SELECT mode, lang, batch_id, request_id, custom_id, user_message,
        '{{"custom_id":"' || custom_id || '",{_BODY}' || user_message
        || '"}}],"max_tokens":{DEFAULT_MAX_TOKENS}' || tail || '}}}}' AS line
    FROM named
)"""

_PART_ENTRIES = """
entries AS (
    SELECT p_partkey, p_brand AS source_batch, p_name, p_brand, p_size, lower(p_type) AS kind,
        CASE WHEN p_size % 4 = 0 THEN lower(p_type) ELSE p_name END AS word,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos
    FROM part
),
translated AS (
    SELECT p_partkey, source_batch, pos, word, 'noun' AS type, kind AS translation, 0 AS at
    FROM entries WHERE p_size % 5 <> 0
    UNION ALL
    SELECT p_partkey, source_batch, pos, word, 'adjective', p_brand, 1
    FROM entries WHERE p_size % 7 = 0
    UNION ALL
    SELECT p_partkey, source_batch, pos, word, 'adjective', p_name, 2
    FROM entries WHERE p_size % 7 = 0
),
kept AS (
    SELECT * FROM entries
    WHERE p_partkey IN (SELECT p_partkey FROM translated WHERE translation <> word)
)"""

_CATEGORIES = """
categories AS (SELECT DISTINCT p_partkey, type, CASE type WHEN 'noun' THEN 0 ELSE 1 END AS place
    FROM translated)"""

_SIMILAR = f"""{_PART_ENTRIES},{_CATEGORIES},
meanings AS (
    SELECT p_partkey, list(lower(translation)) AS list FROM translated GROUP BY p_partkey
),
spelled AS (
    SELECT e.source_batch, e.pos, e.word, lower(e.word) AS lower, coalesce(m.list, []) AS list
    FROM entries e LEFT JOIN meanings m ON e.p_partkey = m.p_partkey
),
near AS (
    SELECT k.p_partkey, k.source_batch, k.pos, b.pos AS other_pos, b.word AS other_word
    FROM kept k
    JOIN spelled a ON a.source_batch = k.source_batch AND a.pos = k.pos
    JOIN spelled b ON b.source_batch = a.source_batch AND b.pos BETWEEN a.pos - 50 AND a.pos + 50
        AND b.pos <> a.pos
    WHERE levenshtein(a.lower, b.lower) <= 3
        OR len(list_filter(a.list, lambda x: len(list_filter(b.list,
            lambda y: levenshtein(x, y) <= 3)) > 0)) > 0
)"""

_IDS = f"""{_SIMILAR},
stored AS (
    SELECT word, row_number() OVER (ORDER BY word) AS id
    FROM (SELECT DISTINCT lower(p_type) AS word FROM part)
),
added AS (
    SELECT word, row_number() OVER (ORDER BY word) + (SELECT max(id) FROM stored) AS id
    FROM (SELECT DISTINCT word FROM kept WHERE word NOT IN (SELECT word FROM stored))
),
ids AS (SELECT word, id AS word_id FROM stored UNION ALL SELECT word, id FROM added)"""

_PAYLOAD = """
pieces AS (
    SELECT p_partkey, p_brand, p_type, p_name, unnest(string_split(p_name, ' ')) AS word,
        unnest(range(len(string_split(p_name, ' ')))) AS item
    FROM part
),
payload AS (
    SELECT p_partkey, p_brand, p_type, p_name, word, item,
        '{"noun":["' || p_type || '","' || lower(p_type) || '"],"verb":[],"adjective":["'
        || p_name || '"]}' AS translations
    FROM pieces
)"""

# The result line around an answer, as the inputs write it.
_RESULT_LINES = """
answers AS (
    SELECT doc_id, source, text, doc_id % 10 AS kind,
        '{"response":[{"word":' || to_json(text)::VARCHAR || ',"translations":{"noun":["' || lang
        || '"]}}]}' AS fine
    FROM documents
),
messages AS (
    SELECT *, CASE kind WHEN 4 THEN '{' || text WHEN 5 THEN NULL WHEN 9 THEN '{"answer":[]}'
        ELSE fine END AS content
    FROM answers
),
result_lines AS (
    SELECT doc_id, source, text, kind, content,
        '{"custom_id":"request-' || doc_id || '","response":{"status_code":200,"body":'
        || '{"object":"chat.completion","choices":[{"index":0,"message":{"role":"assistant",'
        || '"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"refusal":'
        || CASE WHEN kind IN (1, 7) THEN to_json(text)::VARCHAR ELSE 'null' END
        || '}}]}},"error":'
        || CASE WHEN kind IN (0, 7) THEN to_json(text)::VARCHAR WHEN kind = 8 THEN '""'
            ELSE 'null' END
        || '}' AS line
    FROM messages
)"""

ORACLES: dict[str, str] = {
    "deck_words": f"""
WITH {_subtitle_tokens("doc_id", f"SELECT doc_id, {_subtitle('text', 'lang')} AS text FROM documents")},
{_KNOWN},
firsts AS (
    SELECT doc_id, lower(token) AS word, min(pos) AS pos FROM tokens WHERE token <> ''
    GROUP BY doc_id, lower(token)
),
ranked AS (
    SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS rank
    FROM firsts
)
SELECT doc_id, rank::INTEGER AS rank, {_capitalised("word")} AS word FROM ranked
WHERE word NOT IN (SELECT word FROM known)""",
    "subtitle_tokens": f"""
WITH {_subtitle_tokens("conv_id, turn", f"SELECT conv_id, turn, {_subtitle('text', 'role')} AS text FROM conversations")}
SELECT conv_id, turn, pos::INTEGER AS pos, token FROM tokens""",
    "subtitle_files": f"""
WITH {_subtitle_tokens("item_id", f"SELECT item_id, {_subtitle('text', _text('note'))} || chr(10) AS text FROM benchmark")}
SELECT pos::INTEGER AS pos, token, count(*) AS n_files FROM tokens GROUP BY pos, token""",
    "conversation_words": f"""
WITH {_subtitle_tokens("conv_id, turn", f"SELECT conv_id, turn, {_subtitle('text', 'role')} AS text FROM conversations")},
ranked AS (
    SELECT conv_id, turn, pos, lower(token) AS word,
        row_number() OVER (PARTITION BY conv_id, lower(token) ORDER BY turn, pos) AS n
    FROM tokens WHERE token <> ''
)
SELECT conv_id, {_capitalised("word")} AS word, turn, pos::INTEGER AS pos FROM ranked WHERE n = 1""",
    "corpus_vocabulary": f"""
WITH {_DOCUMENT_TOKENS},
firsts AS (
    SELECT doc_id, lower(token) AS word, min(pos) AS pos FROM tokens WHERE token <> ''
    GROUP BY doc_id, lower(token)
),
ranked AS (
    SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS rank,
        row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n
    FROM firsts
)
SELECT {_capitalised("word")} AS word, doc_id, rank::INTEGER AS rank FROM ranked WHERE n = 1""",
    "request_packing": f"""
WITH {_PACKED}
SELECT lang, batch_id, request_id, string_agg(word, '|' ORDER BY pos) AS words
FROM placed GROUP BY lang, batch_id, request_id""",
    "chunk_list": """
WITH numbered AS (
    SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders
)
SELECT o_custkey, pos // 4 AS chunk_id, string_agg(o_orderkey, ',' ORDER BY pos) AS items
FROM numbered GROUP BY o_custkey, pos // 4""",
    "request_lines": f"WITH {_REQUEST_LINES} SELECT * FROM request_lines",
    "request_limits": f"""
WITH {_REQUEST_LINES},
sizes AS (
    SELECT mode, lang, batch_id, count(*) AS n_lines, sum(strlen(line || chr(10)))::BIGINT AS n_bytes
    FROM request_lines GROUP BY mode, lang, batch_id
)
SELECT *, n_lines > {MAX_LINES} OR n_bytes > {MAX_BYTES} AS too_large FROM sizes""",
    "request_files": f"""
WITH {_REQUEST_LINES}
SELECT lang, batch_id, line FROM request_lines WHERE mode = 'structured'""",
    "wordlist_validation": f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
),
words AS (
    SELECT doc_id, unnest(string_split_regex(line, '[.,]')) AS word FROM lines
),
judged AS (
    SELECT doc_id, bool_and(regexp_matches(word, '[^{_WHITE}]')) AS valid FROM words GROUP BY doc_id
)
SELECT doc_id, n_lists, valid
FROM judged JOIN (SELECT doc_id, count(*) AS n_lists FROM lines GROUP BY doc_id) USING (doc_id)""",
    "word_list_files": f"""
WITH numbered AS (
    SELECT p_brand, p_partkey // {KEYS_PER_FILE} AS file_no, p_name, row_number() OVER (
        PARTITION BY p_brand, p_partkey // {KEYS_PER_FILE} ORDER BY p_partkey) - 1 AS pos
    FROM part
),
requests AS (
    SELECT (pos // 5) // 3 AS batch_id, (pos // 5) % 3 AS request_id,
        '{DEFAULT_USER_PREFIX}' || string_agg(p_name, ', ' ORDER BY pos) AS user_message
    FROM numbered GROUP BY p_brand, file_no, pos // 5
)
SELECT batch_id, request_id, user_message, count(*) AS n_requests
FROM requests GROUP BY ALL""",
    "result_routing": """
SELECT doc_id,
    CASE WHEN doc_id % 10 IN (0, 7) THEN 'error' WHEN doc_id % 10 = 1 THEN 'refusal'
        WHEN doc_id % 10 IN (2, 4, 5, 6, 9) THEN 'quarantine' ELSE 'word' END AS route,
    CASE WHEN doc_id % 10 NOT IN (2, 6) THEN 'request-' || doc_id END AS custom_id,
    CASE doc_id % 10 WHEN 2 THEN 'malformed line' WHEN 6 THEN 'malformed line'
        WHEN 4 THEN 'malformed content' WHEN 5 THEN 'no content'
        WHEN 9 THEN 'no list of entries' END AS reason,
    CASE WHEN doc_id % 10 IN (0, 1, 7, 8) THEN md5(text) END AS told
FROM documents WHERE doc_id % 10 <> 3""",
    "result_errors": """
SELECT source AS source_batch, 'request-' || doc_id AS custom_id,
    CASE WHEN doc_id % 10 = 1 THEN 'refusal' ELSE 'error' END AS type, md5(text) AS told
FROM documents WHERE doc_id % 10 IN (0, 1, 7)""",
    "quarantine": f"""
WITH {_RESULT_LINES},
aside AS (
    SELECT source, kind, CASE kind WHEN 2 THEN '{{' || text WHEN 5 THEN line
        WHEN 6 THEN line || ' x' ELSE content END AS raw
    FROM result_lines WHERE kind IN (2, 4, 5, 6, 9)
)
SELECT source AS source_batch,
    CASE WHEN kind IN (4, 9) THEN 'content' ELSE 'result' END AS stage,
    CASE WHEN kind IN (2, 6) THEN 'malformed line' WHEN kind = 4 THEN 'malformed content'
        WHEN kind = 5 THEN 'no content' ELSE 'no list of entries' END AS reason,
    regexp_replace(raw, '[\\n\\t\\r\\x0B\\f ]', '', 'g') AS line
FROM aside""",
    "payload_words": f"""
WITH {_PAYLOAD}
SELECT p_brand AS source_batch,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, item) - 1 AS pos, word, translations
FROM payload""",
    "result_documents": f"""
WITH {_PAYLOAD},
numbered AS (
    SELECT row_number() OVER (PARTITION BY p_brand, p_partkey // {KEYS_PER_FILE}
        ORDER BY p_partkey, item) - 1 AS pos, word, translations
    FROM payload
),
files AS (SELECT DISTINCT p_brand, p_partkey // {KEYS_PER_FILE} AS file_no FROM part)
SELECT pos, word, translations, count(*) AS n_documents FROM numbered GROUP BY ALL
UNION ALL
SELECT 0, NULL, '7', count(*) FROM files
UNION ALL
SELECT 1, 'e' || file_no, '{{"custom_id":"e' || file_no || '"}}', count(*) FROM files GROUP BY file_no""",
    "error_files": """
WITH lines AS (
    SELECT event_type, 'request-' || event_id AS custom_id,
        '{"custom_id":"request-' || event_id || '","error":{"event_type":"' || event_type || '"}}'
        AS line
    FROM events
)
SELECT CASE WHEN event_type <> 'signup' THEN custom_id END AS custom_id,
    CASE WHEN event_type = 'signup' THEN 'malformed line' ELSE 'error' END AS type,
    CASE WHEN event_type = 'signup' THEN line[:-2] ELSE line END AS line
FROM lines""",
    "untranslated_drop": f"WITH {_PART_ENTRIES} SELECT p_partkey, word FROM kept",
    "grammar_categories": f"""
WITH {_PART_ENTRIES},{_CATEGORIES}
SELECT p_partkey, coalesce(string_agg(type, ',' ORDER BY place), '') AS categories
FROM entries LEFT JOIN categories USING (p_partkey) GROUP BY p_partkey""",
    "similar_words": f"""
WITH {_SIMILAR},
lists AS (
    SELECT p_partkey, string_agg(other_word, ',' ORDER BY other_pos) AS similar_words
    FROM near GROUP BY p_partkey
),
labels_of AS (
    SELECT p_partkey, string_agg(type, ',' ORDER BY place) AS grammar_categories
    FROM categories GROUP BY p_partkey
)
SELECT source_batch, pos, word, coalesce(similar_words, '') AS similar_words,
    coalesce(grammar_categories, '') AS grammar_categories
FROM kept LEFT JOIN lists USING (p_partkey) LEFT JOIN labels_of USING (p_partkey)""",
    "similar_words_in_texts": f"""
WITH letters AS (
    SELECT doc_id, lang, regexp_replace(lower(text), '[^\\p{{L}}\\s]', '', 'g') AS text FROM documents
),
tokens AS ({_split("doc_id, lang", "letters", "text", "[ \\t\\n\\x0B\\f\\r]+", "word", "place")}),
numbered AS (
    SELECT lang, word, {_PLAIN_LETTERS} AS plain,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id, place) - 1 AS pos FROM tokens
),
steps AS (SELECT unnest(range(-50, 51)) AS step),
near AS (
    SELECT a.lang, a.pos, a.word, b.pos AS other_pos, b.word AS other
    FROM (SELECT *, pos + step AS there FROM numbered, steps WHERE step <> 0 AND word <> reverse(word)) a
    JOIN numbered b ON a.lang = b.lang AND a.there = b.pos
    WHERE abs(length(a.plain) - length(b.plain)) <= 3 AND levenshtein(a.plain, b.plain) <= 3
)
SELECT lang, pos, word, count(*) AS n_similar, md5(string_agg(other, ',' ORDER BY other_pos)) AS similar_words
FROM near GROUP BY lang, pos, word""",
    "dictionary_new_words": f"""
WITH {_LANGUAGE_WORDS},
{_KNOWN},
missing AS (
    SELECT lang, word FROM language_words EXCEPT SELECT 'en' AS lang, word FROM known
)
SELECT row_number() OVER (ORDER BY lang, word) + (SELECT count(*) FROM known) AS id, lang, word
FROM missing""",
    "dictionary_translations": f"""
WITH {_IDS}
SELECT row_number() OVER (ORDER BY t.source_batch, t.pos, t.at) AS id, word_id, type, translation,
    12 AS primary_language, 1 AS secondary_language, t.source_batch
FROM translated t JOIN kept USING (p_partkey) JOIN ids ON ids.word = t.word""",
    "dictionary_similar": f"""
WITH {_IDS}
SELECT row_number() OVER (ORDER BY n.source_batch, n.pos, n.other_pos) AS id, word_id,
    n.other_word AS similar_word, 12 AS primary_language, n.source_batch
FROM near n JOIN kept USING (p_partkey) JOIN ids ON ids.word = kept.word""",
    "dictionary_categories": f"""
WITH {_IDS}
SELECT row_number() OVER (ORDER BY kept.source_batch, kept.pos, c.place) AS id, word_id,
    c.type AS category, 12 AS primary_language, 1 AS secondary_language, kept.source_batch
FROM categories c JOIN kept USING (p_partkey) JOIN ids ON ids.word = kept.word""",
    "dictionary_save": f"""
WITH {_SIMILAR},
totals AS (
    SELECT 'word' AS table_name, source_batch < 'Brand#2' AS is_first, count(DISTINCT word) AS n FROM kept GROUP BY ALL
    UNION ALL
    SELECT 'translation', t.source_batch < 'Brand#2', count(*) FROM translated t JOIN kept USING (p_partkey) GROUP BY ALL
    UNION ALL
    SELECT 'similar_word', source_batch < 'Brand#2', count(*) FROM near GROUP BY ALL
    UNION ALL
    SELECT 'grammar_category', source_batch < 'Brand#2', count(*) FROM categories JOIN kept USING (p_partkey) GROUP BY ALL
)
SELECT table_name, n AS expected, n AS stored, CASE WHEN is_first THEN 'first' ELSE 'second' END AS half FROM totals""",
    "dictionary_check": """
WITH planted AS (SELECT n_nationkey AS n, n_nationkey - 1000 AS id FROM nation)
SELECT 'word' AS table_name, 'orphan' AS problem, 'primary_language' AS "column", (n + 30)::VARCHAR AS value, 1::BIGINT AS n_rows
FROM planted WHERE n + 30 > 44
UNION ALL
SELECT 'translation', 'orphan', 'word_id', (id * 10)::VARCHAR, 1 FROM planted WHERE id > -990
UNION ALL
SELECT 'translation', 'orphan', 'secondary_language', '99', count(*) FROM planted
UNION ALL
SELECT 'translation', 'label', 'type', 'oddity', count(*) FROM planted WHERE n % 2 = 0""",
    "dictionary_differences": f"""
WITH {_PART_ENTRIES},
stored AS (
    SELECT DISTINCT p_name AS word FROM part
    UNION SELECT DISTINCT lower(c_mktsegment) FROM customer
)
SELECT word, 'duplicate' AS problem FROM kept GROUP BY word HAVING count(*) > 1
UNION ALL
SELECT DISTINCT word, 'missing' FROM kept WHERE word NOT IN (SELECT word FROM stored)
UNION ALL
SELECT word, 'extra' FROM stored WHERE word NOT IN (SELECT word FROM kept)""",
    "language_seed": """
WITH firsts AS (
    SELECT lang, min(doc_id) AS place, count(*) AS n_rows FROM documents GROUP BY lang
),
numbered AS (
    SELECT lang, 12 + row_number() OVER (ORDER BY place) AS id FROM firsts
    WHERE lang NOT IN ('en', 'de')
    UNION ALL SELECT 'en', 1 UNION ALL SELECT 'de', 12
)
SELECT id::BIGINT AS id, lang AS name, n_rows FROM numbered JOIN firsts USING (lang)""",
    "language_file": "SELECT n_nationkey::BIGINT + 1 AS id, n_name AS name FROM nation",
    "ingest_tables": """
SELECT 'word' AS table_name, NULL AS source_batch, NULL AS kind, count(DISTINCT text) AS n_rows
FROM documents WHERE doc_id % 10 = 8
UNION ALL
SELECT t, source, 'noun', count(*)
FROM documents, (SELECT unnest(['translation', 'grammar_category']) AS t)
WHERE doc_id % 10 = 8 GROUP BY t, source
UNION ALL
SELECT 'error', source, CASE WHEN doc_id % 10 = 1 THEN 'refusal' ELSE 'error' END AS k, count(*)
FROM documents WHERE doc_id % 10 IN (0, 1, 7) GROUP BY source, k
UNION ALL
SELECT 'quarantine', source, CASE doc_id % 10 WHEN 4 THEN 'malformed content'
    WHEN 5 THEN 'no content' WHEN 9 THEN 'no list of entries' ELSE 'malformed line' END AS k,
    count(*)
FROM documents WHERE doc_id % 10 IN (2, 4, 5, 6, 9) GROUP BY source, k
UNION ALL
SELECT 'similar_word', a.source, NULL, count(*)
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents WHERE doc_id % 10 = 8) a
JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents WHERE doc_id % 10 = 8) b
    ON a.source = b.source AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 50
WHERE CASE WHEN levenshtein(a.lang, b.lang) <= 3 THEN true WHEN abs(length(a.text) - length(b.text)) > 3 THEN false
    ELSE levenshtein(lower(a.text), lower(b.text)) <= 3 END
GROUP BY a.source""",
    "category_check": """
WITH labelled AS (
    SELECT CASE event_type WHEN 'view' THEN 'noun' WHEN 'click' THEN 'modal_verb'
        WHEN 'error' THEN NULL ELSE event_type END AS label
    FROM events
)
SELECT label, count(*) AS n_rows, coalesce(label IN ('noun', 'modal_verb'), false) AS known
FROM labelled GROUP BY label""",
    "point_lookup": """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 321""",
    "stream_status": """
WITH last AS (
    SELECT user_id, arg_max(event_type, (ts, place, event_type)) AS kind,
        arg_max(event_id, (ts, place, event_type)) AS event_id
    FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 7 WHEN 'error' THEN 9 ELSE 0 END AS place FROM events)
    GROUP BY user_id
)
SELECT user_id::VARCHAR AS id,
    CASE kind WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'expired' ELSE kind END AS status,
    event_id,
    CASE WHEN kind IN ('signup', 'error') THEN 'failed' WHEN kind = 'purchase' THEN 'done'
        ELSE 'running' END AS outcome
FROM last""",
    "unique_check": """
SELECT p_name, p_brand, count(*) AS n_rows FROM part GROUP BY p_name, p_brand HAVING count(*) > 1""",
    "orphan_check": """
SELECT 'orders.o_custkey' AS foreign_key, o_custkey AS value, count(*) AS n_rows FROM orders
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey) GROUP BY o_custkey
UNION ALL
SELECT 'lineitem.l_orderkey', l_orderkey, count(*) FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey""",
    "domain_check": """
SELECT 'null' AS problem, 'category' AS value, count(*) AS n_rows FROM events
WHERE event_type = 'view'
UNION ALL
SELECT 'domain', event_type, count(*) FROM events
WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type""",
    "paged_read": """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'
ORDER BY c_name DESC LIMIT 30 OFFSET 20""",
    "keyset_page": """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 700
ORDER BY o_orderkey LIMIT 50""",
    "batch_status": """
WITH last AS (
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind,
        arg_max(event_id, (ts, event_id)) AS event_id
    FROM events GROUP BY user_id
)
SELECT user_id,
    CASE kind WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'validating'
        WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'cancelled' ELSE 'error' END AS status,
    event_id,
    CASE WHEN kind IN ('signup', 'error') THEN 'failed' WHEN kind = 'purchase' THEN 'done'
        ELSE 'running' END AS outcome
FROM last""",
    "stream_ingest": f"""
WITH {_PAYLOAD},
numbered AS (
    SELECT p_brand, p_type, p_name, lower(p_type) AS kind, lower(p_name) AS name, p_partkey // {KEYS_PER_FILE} AS file_no, word,
        p_partkey % 11 = 9 AS strange,
        row_number() OVER (PARTITION BY p_brand, p_partkey // {KEYS_PER_FILE}
            ORDER BY p_partkey, item) - 1 AS pos
    FROM payload WHERE p_partkey % 11 NOT IN (3, 5)
),
kept AS (SELECT * FROM numbered WHERE NOT strange),
near AS (
    SELECT a.word, b.word AS other_word
    FROM kept a JOIN numbered b ON a.p_brand = b.p_brand AND a.file_no = b.file_no
        AND b.pos BETWEEN a.pos - 50 AND a.pos + 50 AND b.pos <> a.pos
    WHERE levenshtein(lower(a.word), lower(b.word)) <= 3 OR levenshtein(a.kind, b.kind) <= 3
        OR levenshtein(a.kind, b.name) <= 3 OR levenshtein(a.name, b.kind) <= 3 OR levenshtein(a.name, b.name) <= 3
)
SELECT 'translation' AS table_name, word, 'noun' AS kind, p_type AS value, count(*) AS n_rows
FROM kept GROUP BY word, p_type
UNION ALL
SELECT 'translation', word, 'noun', kind, count(*) FROM kept GROUP BY word, kind
UNION ALL
SELECT 'translation', word, 'adjective', p_name, count(*) FROM kept GROUP BY word, p_name
UNION ALL
SELECT 'similar_word', word, NULL, other_word, count(*) FROM near GROUP BY word, other_word
UNION ALL
SELECT 'grammar_category', word, NULL, category, count(*)
FROM kept, (SELECT unnest(['noun', 'adjective']) AS category) GROUP BY word, category
UNION ALL
SELECT 'error', NULL, 'error', NULL, count(*) FROM part WHERE p_partkey % 11 = 5
UNION ALL
SELECT 'quarantine', NULL, 'malformed line', NULL, count(*) FROM part WHERE p_partkey % 11 = 3
UNION ALL
SELECT 'quarantine', NULL, 'unknown category', NULL, count(*) FROM numbered WHERE strange""",
    "document_ingest": f"""
WITH entries AS (
    SELECT p_name, p_brand, p_partkey % 10 AS digit, p_partkey // {KEYS_PER_FILE} AS file_no,
        (substr(p_brand, 7)::INTEGER + p_partkey // {KEYS_PER_FILE}) % 10 AS kind
    FROM part
),
files AS (SELECT DISTINCT p_brand, file_no, kind FROM entries),
good AS (SELECT * FROM entries WHERE kind NOT IN (1, 2, 3))
SELECT 'word' AS table_name, NULL AS kind, count(DISTINCT p_name) AS n_rows FROM entries WHERE digit NOT IN (4, 6)
UNION ALL
SELECT t, 'noun', count(*) FROM good, (SELECT unnest(['translation', 'grammar_category']) AS t) WHERE digit NOT IN (4, 6) GROUP BY t
UNION ALL
SELECT 'error', 'error result', count(*) FROM good WHERE digit = 6 HAVING count(*) > 0
UNION ALL
SELECT 'error', 'error error', sum(CASE kind WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 2 END)::BIGINT FROM files
UNION ALL
SELECT 'quarantine', 'entry, mistyped entry', count(*) FROM good WHERE digit = 4 HAVING count(*) > 0
UNION ALL
SELECT 'quarantine', 'document, ' || CASE kind WHEN 1 THEN 'malformed document' WHEN 2 THEN 'results are no list' ELSE 'no document' END AS k,
    count(*) FROM files WHERE kind IN (1, 2, 3) GROUP BY k""",
    "nested_requests": f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS request_id FROM documents
),
words AS (SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM lines),
judged AS (SELECT doc_id, bool_and(regexp_matches(word, '[^{_WHITE}]')) AS valid FROM words GROUP BY doc_id)
SELECT doc_id, request_id, md5('{{"custom_id":"request-' || request_id || '",{_BODY[:-1]}'
    || to_json('{DEFAULT_USER_PREFIX}' || line)::VARCHAR || '}}],"max_tokens":{DEFAULT_MAX_TOKENS}{_FORMAT}}}}}') AS line
FROM lines JOIN judged USING (doc_id) WHERE valid
UNION ALL
SELECT doc_id, -1, NULL FROM judged WHERE NOT valid""",
    "skipped_rows": """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 1000""",
    "deep_page": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
ORDER BY ALL LIMIT 50 OFFSET (SELECT count(*) // 2 FROM lineitem)""",
}

_KEPT_TOKENS = f"""
WITH {_DOCUMENT_TOKENS},
{_KNOWN}
SELECT doc_id, pos::INTEGER AS pos, token FROM tokens
WHERE lower(token) NOT IN (SELECT word FROM known)"""
ORACLES["stopword_filter"] = _KEPT_TOKENS
ORACLES["stopword_filter_shuffled"] = _KEPT_TOKENS
