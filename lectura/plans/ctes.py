"""The stand-in tables once more, as SQL for the checking engine."""

from __future__ import annotations

from lectura import constants as K
from lectura.plans.registry import CTES
from lectura.plans.stand_ins import ACTION_OF, GRADE_OF, NOW, RANKED_LEMMAS


def values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


CLOSED = "(" + ",".join(f"'{p}'" for p in K.CLOSED_CLASS_POS) + ")"
_FORMS = [(w, p) for p, ws in K.CLOSED_CLASS_FORMS.items() for w in ws.split()]

CTES.update({
    "forms": f"SELECT * FROM ({values(_FORMS)}) t(form, pos)",
    "paras": """
        SELECT source AS book_id, doc_id AS chapter_index, (i - 1)::INTEGER AS paragraph_index, line AS text
        FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        WHERE line <> ''""",
    "words": r"""
        SELECT book_id, chapter_index, paragraph_index, (i - 1)::INTEGER AS word_index, s
        FROM (SELECT book_id, chapter_index, paragraph_index,
                     unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*')) AS s,
                     generate_subscripts(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*'), 1) AS i FROM paras)""",
    "ann": r"""
        SELECT w.*, lower(s) AS l, coalesce(f.pos, CASE WHEN regexp_matches(s, '^\p{Lu}') AND word_index > 0
               THEN 'PROPN' ELSE 'NOUN' END) AS p
        FROM words w LEFT JOIN forms f ON lower(s) = f.form""",
    "toks": r"""
        SELECT book_id, chapter_index, paragraph_index, (i - 1)::INTEGER AS token_index, s,
               CASE WHEN regexp_matches(s, '^\p{L}') THEN 'word' WHEN regexp_matches(s, '^\p{N}') THEN 'number'
                    WHEN regexp_matches(s, '^[\t-\r\x1c-\x20\x85\p{Z}]') THEN 'space' ELSE 'mark' END AS kind
        FROM (SELECT book_id, chapter_index, paragraph_index, unnest(a) AS s, generate_subscripts(a, 1) AS i
              FROM (SELECT *, regexp_extract_all(text, '(?s)\p{L}[\p{L}\p{M}]*|\p{N}+|[\t-\r\x1c-\x20\x85\p{Z}]+|.') AS a FROM paras))""",
    "anntoks": r"""
        SELECT t.* EXCLUDE (fw), coalesce(token_index = fw, false) AS first_word,
               CASE kind WHEN 'word' THEN lower(s) END AS l,
               CASE kind WHEN 'word' THEN coalesce(f.pos, CASE WHEN regexp_matches(s, '^\p{Lu}') AND token_index <> fw
                         THEN 'PROPN' ELSE 'NOUN' END) WHEN 'number' THEN 'NUM' WHEN 'mark' THEN 'PUNCT' END AS p
        FROM (SELECT *, min(CASE WHEN kind = 'word' THEN token_index END)
                        OVER (PARTITION BY book_id, chapter_index, paragraph_index) AS fw FROM toks) t
        LEFT JOIN forms f ON t.kind = 'word' AND lower(t.s) = f.form""",
    "counts": """
        SELECT book_id, chapter_index, l AS lemma, p AS pos, count(*) AS n FROM ann GROUP BY ALL""",
    "totals": """
        SELECT book_id, chapter_index, sum(n)::BIGINT AS token_count,
               coalesce(sum(n) FILTER (pos = 'PROPN'), 0)::BIGINT AS propn_tokens FROM counts GROUP BY ALL""",
    "lex0": """
        SELECT book_id, lemma, pos, sum(n)::BIGINT AS book_count, min(chapter_index) AS first_chapter
        FROM counts WHERE pos <> 'PROPN' GROUP BY ALL""",
    "lexk": """
        SELECT * EXCLUDE (rk), 'm' || lpad(rk::VARCHAR, greatest(4, length(rk::VARCHAR))::INTEGER, '0') AS key
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY lemma, pos) - 1 AS rk FROM lex0)""",
    "zipfs": """
        SELECT lemma, round(log10(1e9::DOUBLE * sum(book_count) / (SELECT sum(book_count) FROM lex0)), 2) AS zipf
        FROM lex0 GROUP BY lemma""",
    "lex": """
        SELECT x.*, zipf,
               CASE WHEN length(lemma) > 1 AND length(lemma) % 5 <> 0 THEN 'de:' || lemma END AS de,
               CASE WHEN length(lemma) > 1 AND length(lemma) % 3 <> 0 THEN 'en:' || lemma END AS en,
               CASE WHEN length(lemma) > 1 AND (unicode(lemma) + length(lemma)) % 7 = 0 THEN 'note ' || lemma END AS region_note,
               length(lemma) > 1 AND (unicode(lemma) + length(lemma)) % 7 = 0 AS mexicanism,
               CASE WHEN length(lemma) > 1 AND length(lemma) % 5 <> 0
                    THEN CASE WHEN length(lemma) % 2 = 0 THEN 'model' ELSE 'dictionary' END END AS de_source,
               CASE WHEN length(lemma) > 1 AND length(lemma) % 3 <> 0
                    THEN CASE WHEN length(lemma) % 2 = 0 THEN 'dictionary' ELSE 'model' END END AS en_source,
               CASE WHEN length(lemma) > 1 AND length(lemma) % 4 = 0 THEN 'example of ' || lemma END AS example
        FROM lexk x JOIN zipfs USING (lemma)""",
    "reasoned": f"""
        SELECT *, CASE WHEN pos IN {CLOSED} OR pos = 'PROPN' THEN NULL WHEN book_count >= {K.MIN_BOOK_COUNT} THEN 'bookCount'
                       WHEN zipf >= {K.ZIPF_THRESHOLD} THEN 'zipf'
                       WHEN mexicanism AND book_count >= {K.REGIONAL_MIN_BOOK_COUNT} THEN 'mexicanism' END AS reason,
               trim(lower(lemma)) AS lemma_id
        FROM lex""",
    "vocab": """
        SELECT book_id, chapter_index, key, n FROM counts JOIN lexk USING (book_id, lemma, pos)""",
    "ranked": f"""
        SELECT row_number() OVER (ORDER BY uses DESC, lemma) - 1 AS k, lemma AS lemma_id
        FROM (SELECT lemma, sum(book_count) AS uses FROM lex0 GROUP BY lemma ORDER BY uses DESC, lemma LIMIT {RANKED_LEMMAS})""",
    "ev": r"""
        SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS BIGINT) AS k FROM events""",
    "evk": "SELECT *, 'k' || k AS lemma_id FROM ev",
    "evw": "SELECT * FROM ev JOIN ranked USING (k)",
    "readings": """
        SELECT e.user_id, d.source AS book_id, d.doc_id AS chapter_index, e.ts, e.event_id, e.k,
               length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS paragraph_count
        FROM ev e JOIN documents d ON d.doc_id = e.event_id // 10 WHERE e.event_type = 'view'""",
    "opened": """
        SELECT * FROM (SELECT DISTINCT user_id, book_id, chapter_index FROM readings) JOIN totals USING (book_id, chapter_index)""",
    "positions": """
        SELECT event_id AS id, user_id, book_id, chapter_index, 'c' || chapter_index || 'p' || k AS paragraph_id,
               CASE WHEN paragraph_count <= 1 THEN 1.0::DOUBLE
                    ELSE round(least(greatest(k, 0), paragraph_count - 1)::DOUBLE / (paragraph_count - 1), 6) END AS fraction,
               ts AS updated_at FROM readings""",
})

_MARKS = """
    SELECT user_id, lemma_id, arg_max(ts, event_id) AS marked_at,
           arg_max(CASE WHEN value < 10 THEN 'seed' WHEN value < 30 THEN 'manual' ELSE 'null' END, event_id) AS src
    FROM {events} WHERE event_type = 'signup' GROUP BY ALL"""
_CARDS = """
    SELECT *, CASE WHEN reps = 1 AND stability < 5 THEN 0 WHEN reps = 1 THEN 1 WHEN last_type = 'error' THEN 3 ELSE 2 END AS state,
           last_review + to_days(floor(stability / 10)::INTEGER) AS due,
           CASE WHEN stability > 3 AND length(lemma_id) % 3 <> 0 THEN 'de' || chr(9) || lemma_id END AS de,
           CASE WHEN stability > 3 AND length(lemma_id) % 2 = 0 THEN 'en ' || lemma_id END AS en,
           CASE WHEN stability > 3 AND reps > 1 THEN 'line one' || chr(10) || 'of ' || lemma_id END AS example,
           CASE WHEN stability > 3 AND lapses > 1 THEN 'note ' || lemma_id END AS region_note
    FROM (SELECT user_id, lemma_id, count(*)::INTEGER AS reps, (count(*) FILTER (event_type = 'error'))::INTEGER AS lapses,
                 sum(value::DECIMAL(12,2))::DOUBLE AS stability, arg_max(event_type, event_id) AS last_type,
                 min(ts) AS created_at, max(ts) AS last_review
          FROM {events} WHERE event_type <> 'signup' GROUP BY ALL)"""
for suffix, source in (("k", "evk"), ("w", "evw")):
    CTES[f"marks{suffix}"] = (
        "SELECT user_id, lemma_id, marked_at, nullif(src, 'null') AS source FROM (" + _MARKS.format(events=source) + ")"
    )
    CTES[f"cards{suffix}"] = _CARDS.format(events=source)
    CTES[f"known{suffix}"] = f"""
        SELECT user_id, lemma_id FROM marks{suffix}
        UNION SELECT user_id, lemma_id FROM cards{suffix} WHERE state = 2 AND stability > 21"""

_READER_ROWS = """
        SELECT o.user_id, v.book_id, v.chapter_index, v.key, v.n, x.lemma_id, x.book_count, x.pos, x.reason,
               kw.lemma_id IS NOT NULL AS is_known, cw.lemma_id IS NOT NULL AS is_carded,
               CASE WHEN kw.lemma_id IS NOT NULL THEN NULL WHEN x.reason IS NULL THEN 'gloss_only'
                    WHEN cw.lemma_id IS NULL THEN 'teach' END AS part
        FROM {chapters} o JOIN vocab v USING (book_id, chapter_index) JOIN reasoned x USING (book_id, key)
        LEFT JOIN knownw kw ON kw.user_id = o.user_id AND kw.lemma_id = x.lemma_id
        LEFT JOIN cardsw cw ON cw.user_id = o.user_id AND cw.lemma_id = x.lemma_id"""
_READER_STUDY = """
        SELECT o.user_id, o.book_id, o.chapter_index, o.token_count,
               (o.propn_tokens + coalesce(kn, 0))::BIGINT AS covered, (o.propn_tokens + coalesce(an, 0))::BIGINT AS covered_after,
               coalesce(cards, 0)::BIGINT AS cards
        FROM {chapters} o LEFT JOIN (
            SELECT user_id, book_id, chapter_index, sum(n) FILTER (k) AS kn, sum(n) FILTER (k OR t) AS an, sum(c) AS cards
            FROM (SELECT user_id, book_id, chapter_index, lemma_id, sum(n) AS n, bool_or(is_known) AS k,
                         bool_or(coalesce(part = 'teach', false)) AS t, count(*) FILTER (part = 'teach') AS c
                  FROM {rows} GROUP BY ALL) GROUP BY ALL) USING (user_id, book_id, chapter_index)"""
# Opened chapters, and all chapters of the books in which a reader has opened one.
CTES["study_rows"] = _READER_ROWS.format(chapters="opened")
CTES["study"] = _READER_STUDY.format(chapters="opened", rows="study_rows")
CTES["listed"] = """
    SELECT u.user_id, u.book_id, d.doc_id AS chapter_index, coalesce(token_count, 0)::BIGINT AS token_count, coalesce(propn_tokens, 0)::BIGINT AS propn_tokens
    FROM (SELECT DISTINCT user_id, book_id FROM readings) u JOIN documents d ON d.source = u.book_id
    LEFT JOIN totals t ON t.book_id = d.source AND t.chapter_index = d.doc_id"""
CTES["listed_rows"] = _READER_ROWS.format(chapters="listed")
CTES["listed_study"] = _READER_STUDY.format(chapters="listed", rows="listed_rows")

CTES.update({
    "pg": r"""
        SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS book_id, page_id AS doc_ord,
               regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 1) || '-' ||
               regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 2) || '.xhtml' AS doc_name,
               CASE WHEN contains(url, '://m.') THEN 'application/x-dtbncx+xml' WHEN url LIKE 'https:%' THEN 'application/xhtml+xml'
                    ELSE 'text/html' END AS media_type,
               CASE WHEN contains(url, '#top') THEN 'nav' WHEN url LIKE 'https:%' THEN 'document' ELSE 'unknown' END AS item_type,
               html FROM pages""",
    "toc": r"""
        SELECT book_id, doc_ord * 1000 + i - 1 AS ord,
               CASE i WHEN 1 THEN 'text/' || doc_name WHEN 2 THEN doc_name || '#' || substr(link, 2) ELSE link END AS href,
               substr(link, 2) AS title
        FROM (SELECT book_id, doc_ord, doc_name, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS link,
                     generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) AS i FROM pg)""",
    "plays": f"""
        SELECT user_id, event_id AS seq, 'Ártist ' || (k % 7) AS artist,
               'Canción ' || k || CASE event_type WHEN 'view' THEN ' (Remastered)' WHEN 'purchase' THEN ' feat. X' ELSE '' END AS title,
               CASE WHEN k % 10 = 0 THEN 'mb' || k ELSE 'artist ' || (k % 7) || chr(1) || 'cancion ' || k END AS track_key,
               CASE WHEN value < 60 THEN ts END AS ts FROM ev""",
    "lyrics": """
        SELECT track_id, stanza_index, (i - 1)::INTEGER AS line_index, text
        FROM (SELECT conv_id AS track_id, turn AS stanza_index, unnest(string_split(text, chr(10))) AS text,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
        WHERE trim(text) <> ''""",
})
TIME = f"TIMESTAMP '{NOW}'"
