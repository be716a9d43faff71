"""Queries on documents, tokens and vocabulary (groups P, T and V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions import text as X
from lectura.operators import documents as D
from lectura.operators import shapes as H
from lectura.operators import tokens as T
from lectura.operators import vocab as V
from lectura.plans import stand_ins as S
from lectura.plans.ctes import CLOSED
from lectura.plans.registry import CTES, query
from lectura.session import stored

# Markup removal as SQL; one definition for all page queries.
CTES["prose"] = r"""
    SELECT book_id, doc_ord, doc_name, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
           '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
           '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?is)<title\b[^>]*>.*?</title\s*>', '', 'g'),
           '(?is)<sup\b[^>]*>.*?</sup\s*>', '', 'g') AS body FROM pg"""
_ENTITIES = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SPACE = r"trim(regexp_replace({0}, '[\t-\r\x1c-\x20\x85\p{{Z}}]+', ' ', 'g'))"


def _text_sql(html: str, gap: str = "''") -> str:
    return _SPACE.format(_ENTITIES.format(f"regexp_replace({html}, '(?s)<[^>]*>', {gap}, 'g')"))


def _paragraphs_sql(source: str, columns: str, body: str) -> str:
    """Non-empty paragraph texts of ``source`` with their 0-based index."""
    marked = (
        rf"regexp_replace(regexp_replace({body}, '(?i)<p(?:\s[^>]*)?>', chr(1), 'g'), '(?i)</p\s*>', chr(2), 'g')"
    )
    found = rf"regexp_extract_all({marked}, '\x01([^\x01\x02]*)', 1)"
    return f"""
        SELECT {columns}, (i - 1)::INTEGER AS paragraph_index, text FROM (
          SELECT {columns}, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM (
            SELECT {columns}, CASE WHEN len(a) > 0 THEN a ELSE b END AS ps FROM (
              SELECT {columns}, list_filter(list_transform({found}, lambda x: {_text_sql('x')}), lambda x: x <> '') AS a,
                list_filter(list_transform(string_split(regexp_replace({body}, '(?s)<[^>]*>', chr(10), 'g'), chr(10)),
                            lambda x: {_SPACE.format(_ENTITIES.format('x'))}), lambda x: x <> '') AS b FROM {source})))"""


CTES["page_paras"] = _paragraphs_sql("prose", "book_id, doc_ord, doc_name", "body")
_HEADING = r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>"


# The texts with some letters taken apart: Latin and, at the end, Cyrillic and kana.
_APART = "replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)) || ' ' || chr(1080) || chr(774) || chr(12363) || chr(12441)"


@query("p1_normalize_text", rf"""
    SELECT doc_id, trim(regexp_replace(replace(nfc_normalize({_APART}), chr(173), ''), '[\t-\r\x1c-\x20\x85\p{{Z}}]+', ' ', 'g')) AS clean FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    latin = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ñ"), F.lit("n\u0303"))
    apart = F.concat(latin, F.lit(" \u0438\u0306\u304b\u3099"))
    return S.documents(spark, sf).select("doc_id", X.normalize_text(apart, full_nfc=True).alias("clean"))


@query("p2_html_to_paragraphs", "SELECT doc_ord, paragraph_index, text FROM page_paras")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.html_to_paragraphs(S.pages(spark, sf)).select("doc_ord", "paragraph_index", "text")


@query("p3_html_title", f"SELECT doc_ord, nullif({_text_sql(f'''regexp_extract(html, '{_HEADING}', 1)''')}, '') AS title FROM pg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.pages(spark, sf).select("doc_ord", X.html_title(F.col("html")).alias("title"))


CTES["sections"] = rf"""
    SELECT book_id, doc_ord, doc_name, (row_number() OVER (PARTITION BY doc_ord ORDER BY i) - 1)::INTEGER AS section_ord,
           CASE WHEN i > 1 THEN nullif({_text_sql(f"regexp_extract(piece, '{_HEADING}', 1)")}, '') END AS title,
           CASE WHEN i > 1 THEN regexp_replace(piece, '(?is)^<h[1-6][^>]*>.*?</h[1-6]\s*>', '') ELSE piece END AS html
    FROM (SELECT book_id, doc_ord, doc_name, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
          FROM (SELECT *, string_split(regexp_replace(html, '(?i)(<h[1-6][\s>])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM pg))
    WHERE trim(CASE WHEN i > 1 THEN regexp_replace(piece, '(?is)^<h[1-6][^>]*>.*?</h[1-6]\s*>', '') ELSE piece END) <> ''"""


@query("p4_split_on_headings", "SELECT doc_ord, section_ord, title, length(html) AS html_length FROM sections")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_on_headings(S.pages(spark, sf)).select(
        "doc_ord", "section_ord", "title", F.length("html").cast("long").alias("html_length")
    )


# Markers stand in front of the shortest and behind the longest document of some sources.
CTES["marked"] = """
    SELECT book_id, chapter_index, paragraph_index,
           CASE WHEN paragraph_index = 0 AND book_id LIKE '%5' AND nc = lo THEN '*** START OF THIS PROJECT GUTENBERG EBOOK ***'
                WHEN paragraph_index = 0 AND book_id LIKE '%6' AND nc = hi THEN '*** END OF THE PROJECT GUTENBERG EBOOK ***'
                WHEN paragraph_index = 0 AND book_id LIKE '%7' AND chapter_index = first_id THEN '*** START OF THE PROJECT GUTENBERG EBOOK ***'
                WHEN paragraph_index = 0 AND book_id LIKE '%7' AND chapter_index = last_id THEN '*** END OF THE PROJECT GUTENBERG EBOOK ***'
                ELSE text END AS text
    FROM paras JOIN (SELECT doc_id AS chapter_index, n_chars AS nc FROM documents) USING (chapter_index)
    JOIN (SELECT source AS book_id, min(n_chars) AS lo, max(n_chars) AS hi, min(doc_id) AS first_id, max(doc_id) AS last_id
          FROM documents GROUP BY 1) USING (book_id)"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents")
    ends = docs.groupBy(F.col("source").alias("book_id")).agg(
        F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
    )
    size = docs.select(F.col("doc_id").alias("chapter_index"), F.col("n_chars").alias("nc"))
    start, end = "*** START OF {} PROJECT GUTENBERG EBOOK ***", "*** END OF THE PROJECT GUTENBERG EBOOK ***"
    is_book = lambda digit: F.endswith("book_id", F.lit(digit))
    marker = (
        F.when(is_book("5") & (F.col("nc") == F.col("lo")), start.format("THIS"))
        .when(is_book("6") & (F.col("nc") == F.col("hi")), end)
        .when(is_book("7") & (F.col("chapter_index") == F.col("first_id")), start.format("THE"))
        .when(is_book("7") & (F.col("chapter_index") == F.col("last_id")), end)
    )
    return S.paragraphs(spark, sf).join(size, "chapter_index").join(ends, "book_id").select(
        "book_id", "chapter_index", "paragraph_index",
        F.coalesce(F.when(F.col("paragraph_index") == 0, marker), "text").alias("text"),
    )


@query("p5_strip_boilerplate", r"""
    WITH m AS (SELECT *, regexp_matches(text, '(?i)\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG') AS st,
                      regexp_matches(text, '(?i)\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG') AS en FROM marked),
    r AS (SELECT *, bool_or(st) OVER (PARTITION BY book_id) AS has_start,
                 coalesce(bool_or(st) OVER w, false) AS started, coalesce(bool_or(en) OVER w, false) AS ended
          FROM m WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index, paragraph_index))
    SELECT book_id, chapter_index, paragraph_index, text FROM r
    WHERE NOT st AND NOT en AND NOT ended AND (started OR NOT has_start)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.strip_boilerplate(_marked(spark, sf))


_INCLUDE, _EXCLUDE = ("en-*", "fr-*"), ("*-1*.xhtml", "fr-2??.xhtml")


@query("p6_select_documents", """
    WITH v AS (SELECT *, doc_name LIKE 'en-%' OR doc_name LIKE 'fr-%' AS inc,
                      doc_name LIKE '%-1%.xhtml' OR doc_name LIKE 'fr-2__.xhtml' AS exc FROM pg),
    b AS (SELECT book_id, bool_or(inc) AS i, bool_or(inc AND NOT exc) AS k FROM v GROUP BY 1)
    SELECT book_id, doc_name, NULL AS error FROM v WHERE inc AND NOT exc
    UNION ALL SELECT book_id, NULL, CASE WHEN NOT i THEN 'include matched nothing' ELSE 'exclude removed every document' END
    FROM b WHERE NOT i OR NOT k""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept, errors = D.select_documents(S.pages(spark, sf), _INCLUDE, _EXCLUDE)
    none = F.lit(None).cast("string")
    return kept.select("book_id", "doc_name", none.alias("error")).union(
        errors.select("book_id", none.alias("doc_name"), "error")
    )


@query("p7_content_documents", """
    SELECT book_id, doc_ord, doc_name FROM pg
    WHERE (item_type = 'document' OR media_type IN ('application/xhtml+xml', 'text/html')) AND item_type NOT IN ('nav', 'cover')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.content_documents(S.pages(spark, sf)).select("book_id", "doc_ord", "doc_name")


CTES["toc_map"] = r"""
    SELECT book_id, target, arg_min(title, ord) AS title FROM (
      SELECT book_id, ord, title, string_split(split_part(href, '#', 1), '/')[-1] AS name,
             CASE WHEN contains(href, '#') AND split_part(href, '#', 2) <> '' THEN string_split(split_part(href, '#', 1), '/')[-1] || '#' || substr(href, instr(href, '#') + 1)
                  ELSE string_split(split_part(href, '#', 1), '/')[-1] END AS target FROM toc)
    WHERE name <> '' AND title <> '' GROUP BY ALL"""


@query("p8_toc_titles", "SELECT book_id, target, title FROM toc_map")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.toc_titles(S.toc(spark, sf))


CTES["section_prose"] = r"""
    SELECT book_id, doc_ord, doc_name, section_ord, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
           '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
           '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?is)<title\b[^>]*>.*?</title\s*>', '', 'g'),
           '(?is)<sup\b[^>]*>.*?</sup\s*>', '', 'g') AS body FROM sections"""
CTES["section_paras"] = _paragraphs_sql("section_prose", "book_id, doc_ord, doc_name, section_ord, title", "body")


@query("p9_assemble_chapters", """
    WITH live AS (SELECT DISTINCT book_id, doc_ord, doc_name, section_ord, title FROM section_paras),
    num AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_ord, section_ord) - 1 AS chapter_index FROM live)
    SELECT n.book_id, chapter_index, coalesce(n.title, m.title, 'Capítulo ' || (chapter_index + 1)) AS title,
           count(*) AS paragraphs, sum(length(text))::BIGINT AS characters
    FROM num n JOIN section_paras p ON n.doc_ord = p.doc_ord AND n.section_ord = p.section_ord
    LEFT JOIN toc_map m ON m.book_id = n.book_id AND m.target = n.doc_name GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sections = D.split_on_headings(S.pages(spark, sf))
    chapters = D.assemble_chapters(sections, D.toc_titles(S.toc(spark, sf)))
    return chapters.groupBy("book_id", "chapter_index", "title").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("characters")
    )


_SLUG = (
    r"trim(regexp_replace(lower(regexp_replace(replace(strip_accents({0}), 'ß', ''), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"
)


@query("p10_make_book_id", f"""
    SELECT part_id, coalesce(nullif(concat_ws('-', nullif(a, ''), nullif(t, '')), ''), 'libro') AS book_id
    FROM (SELECT doc_ord AS part_id, {_SLUG.format("string_split(trim(title), ' ')[-1]")} AS a, {_SLUG.format("title")} AS t
          FROM (SELECT doc_ord, coalesce(nullif({_text_sql(f'''regexp_extract(html, '{_HEADING}', 1)''')}, ''), '') AS title FROM pg))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    title = F.coalesce(X.html_title(F.col("html")), F.lit(""))
    return S.pages(spark, sf).select(F.col("doc_ord").alias("part_id"), X.make_book_id(title, title).alias("book_id"))


@query("p11_resolve_metadata", f"""
    SELECT doc_ord AS id, coalesce(nullif(h, ''), replace(doc_name, '.xhtml', '')) AS title,
           CASE WHEN lang = 'en' THEN 'Ann Author' ELSE 'Desconocido' END AS author
    FROM (SELECT doc_ord, doc_name, substr(doc_name, 1, 2) AS lang, {_text_sql(f'''regexp_extract(html, '{_HEADING}', 1)''')} AS h FROM pg)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = S.pages(spark, sf)
    books = pages.select(
        F.col("doc_ord").alias("id"), F.concat(F.lit("/in/"), "doc_name").alias("path"),
        X.html_title(F.col("html")).alias("title"), F.lit(" ").alias("author"),
    )
    overrides = books.filter(F.startswith("path", F.lit("/in/en-"))).select(
        "path", F.lit(None).cast("string").alias("title"), F.lit("Ann  Author").alias("author")
    ).distinct()
    return D.resolve_metadata(books, overrides).select("id", "title", "author")


# --- tokens ------------------------------------------------------------------------------------

@query("t1_tokenize", "SELECT book_id, chapter_index, paragraph_index, token_index, s, kind FROM toks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.tokenize(S.paragraphs(spark, sf))


@query("t2_annotate", "SELECT book_id, chapter_index, paragraph_index, token_index, s, l, p FROM anntoks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.full_tokens(spark, sf).select("book_id", "chapter_index", "paragraph_index", "token_index", "s", "l", "p")


CTES["shaped"] = """
    SELECT a.book_id, chapter_index, paragraph_index, token_index, s, CASE WHEN kind = 'space' THEN true END AS ws, l,
           CASE WHEN kind <> 'space' THEN p END AS p, CASE WHEN kind = 'word' AND p <> 'PROPN' THEN x.key END AS t
    FROM anntoks a LEFT JOIN lexk x ON a.book_id = x.book_id AND a.l = x.lemma AND a.p = x.pos"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, int, DataFrame]:
    """(texts in parts, how many, the lexicon with the parts that use an entry)."""
    dealt, parts = H.parted(S.paragraphs(spark, sf))
    return dealt, parts, H.part_entries(H.part_counts(dealt, parts, S.listed_forms()))


def _keyed_parts(spark: SparkSession, sf: str) -> DataFrame:
    dealt, parts, entries = _parts(spark, sf)
    return H.part_rows(dealt, parts, H.in_parts(entries.select("book_id", "lemma", "pos", "key", "places")))


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    return H.shape_parts(_keyed_parts(spark, sf), S.listed_forms())


@query("t3_shape_tokens", "SELECT * REPLACE (coalesce(ws, false) AS ws) FROM shaped")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf).withColumn("ws", F.coalesce("ws", F.lit(False)))


@query("t4_is_tappable", """
    SELECT book_id, chapter_index, count(*) FILTER (t IS NOT NULL) AS tappable, count(*) AS tokens FROM shaped GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf).groupBy("book_id", "chapter_index").agg(
        F.count_if(T.is_tappable()).alias("tappable"), F.count(F.lit(1)).alias("tokens")
    )


CTES["lists"] = f"""
    SELECT book_id, first_chapter AS chapter_index, key, CASE WHEN reason IS NULL THEN 'gloss_only' ELSE 'teach' END AS part,
           book_count FROM reasoned WHERE pos NOT IN {CLOSED}"""


@query("t5_merge_runs", """
    WITH f AS (SELECT *, t IS NOT NULL AS tap, coalesce(lag(t IS NOT NULL) OVER w, true) AS before FROM shaped
               WINDOW w AS (PARTITION BY book_id, chapter_index, paragraph_index ORDER BY token_index)),
    g AS (SELECT *, (sum((tap OR before)::INTEGER) OVER (PARTITION BY book_id, chapter_index, paragraph_index ORDER BY token_index) - 1)::INTEGER AS run_index FROM f),
    r AS (SELECT book_id, chapter_index, paragraph_index, run_index, string_agg(s, '' ORDER BY token_index) AS text, max(t) AS key FROM g GROUP BY ALL)
    SELECT r.book_id, r.chapter_index, paragraph_index, run_index, CASE WHEN r.key IS NULL THEN 'text' ELSE 'word' END AS kind, text, r.key,
           l.key IS NOT NULL AS marked, CASE WHEN l.key IS NOT NULL THEN x.de END AS reveal
    FROM r LEFT JOIN (SELECT * FROM lists WHERE part = 'gloss_only') l ON l.book_id = r.book_id AND l.chapter_index = r.chapter_index AND l.key = r.key
    LEFT JOIN lex x ON x.book_id = r.book_id AND x.key = r.key""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from lectura.operators.teach import is_teachable

    dealt, parts, found = _parts(spark, sf)
    listed = ~is_teachable() & ~F.col("pos").isin(*K.CLOSED_CLASS_POS)
    words = H.in_parts(S.with_threshold(found).select(
        "book_id", "lemma", "pos", "key", F.when(listed, F.col("first_chapter")).alias("listed"), F.when(listed, F.col("de")).alias("de"), "places"))
    return H.runs_of_parts(H.part_rows(dealt, parts, words, ("listed", "de")), S.listed_forms())


@query("t6_chapter_keys", """
    SELECT book_id, chapter_index, t AS key FROM shaped WHERE t IS NOT NULL
    UNION SELECT book_id, chapter_index, key FROM lists WHERE part = 'gloss_only'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return H.keys_of_parts(_keyed_parts(spark, sf), S.listed_forms())


@query("t7_lexicon_slice", """
    WITH o AS (SELECT DISTINCT book_id, chapter_index FROM readings), k AS (SELECT DISTINCT book_id, key FROM vocab JOIN o USING (book_id, chapter_index))
    SELECT book_id, key, lemma, pos FROM lexk JOIN k USING (book_id, key)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    counted = S.counts(spark, sf)
    opened = stored(S.readings(spark, sf).select("book_id", "chapter_index").distinct(), "opened")
    keys = V.in_chapters(V.entries(counted)).join(opened, ["book_id", "chapter_index"], "left_semi")
    return keys.select("book_id", "key", "lemma", "pos").distinct()


# --- vocabulary --------------------------------------------------------------------------------

@query("v1_chapter_vocabulary", """
    SELECT book_id, chapter_index, key, n FROM vocab
    UNION ALL SELECT book_id, chapter_index, '(names)', propn_tokens FROM totals
    UNION ALL SELECT book_id, chapter_index, '(words)', token_count FROM totals""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    counted = S.counts(spark, sf)
    totals = V.chapter_totals(counted)
    return V.in_chapters(V.entries(counted)).select("book_id", "chapter_index", "key", "n").union(
        totals.select("book_id", "chapter_index", F.lit("(names)"), "propn_tokens")
    ).union(totals.select("book_id", "chapter_index", F.lit("(words)"), "token_count"))


@query("v2_build_lexicon", "SELECT book_id, key, lemma, pos, book_count, first_chapter FROM lexk")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.build_lexicon(S.counts(spark, sf)).select("book_id", "key", "lemma", "pos", "book_count", "first_chapter")


@query("v3_proper_nouns", "SELECT DISTINCT book_id, lemma FROM counts WHERE pos = 'PROPN'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.proper_nouns(S.counts_once(spark, sf))


@query("v4_zipf", "SELECT book_id, lemma, pos, zipf FROM lex0 JOIN zipfs USING (lemma)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.with_zipf(V.lexicon_counts(S.counts(spark, sf))).select("book_id", "lemma", "pos", "zipf")


_POINT, _END = (p.replace("'", "''") for p in (K.SENTENCE_POINT, K.SENTENCE_END))
_SPACES = "'" + K.SENTENCE_SPACE + "', ' ', 'g'"
# The words of every sentence, numbered through the paragraph, so that its first word is known.
CTES["sentence_words"] = rf"""
    SELECT book_id, chapter_index, paragraph_index, si, sentence, s, row_number() OVER (PARTITION BY chapter_index, paragraph_index ORDER BY si, wi) AS nr
    FROM (SELECT *, unnest(regexp_extract_all(sentence, '\p{{L}}[\p{{L}}\p{{M}}]*')) AS s, generate_subscripts(regexp_extract_all(sentence, '\p{{L}}[\p{{L}}\p{{M}}]*'), 1) AS wi
          FROM (SELECT book_id, chapter_index, paragraph_index, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS si FROM (
            SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '{_POINT}', '\1\2' || chr(2), 'g'), '{_POINT}', '\1\2' || chr(2), 'g'),
                     '{_END}', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(regexp_replace(replace(x, chr(2), '.'), {_SPACES}))), lambda x: x <> '') AS a FROM paras)))"""


@query("v5_example_sentences", r"""
    WITH w AS (SELECT s.*, lower(s) AS l, coalesce(f.pos, CASE WHEN regexp_matches(s, '^\p{Lu}') AND nr > 1 THEN 'PROPN' ELSE 'NOUN' END) AS p
               FROM sentence_words s LEFT JOIN forms f ON lower(s) = f.form),
    first AS (SELECT book_id, l AS lemma, p AS pos, arg_min(sentence, (chapter_index, paragraph_index, nr)) AS es, min(chapter_index) AS chapter_index FROM w GROUP BY ALL)
    SELECT f.book_id, x.key, f.chapter_index, f.es FROM first f JOIN reasoned x USING (book_id, lemma, pos) WHERE x.reason IS NOT NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from lectura.operators.teach import is_teachable

    entries, _ = S.shelf(S.counts(spark, sf))
    taught = stored(V.first_places(entries.filter(is_teachable())), "first-places")
    return V.first_sentences(S.chapter_paragraphs(spark, sf), taught, S.forms(spark))


@query("v6_attach_glosses", "SELECT book_id, lemma, pos, de, en, region_note, mexicanism FROM lex")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = V.lexicon_counts(S.counts(spark, sf))
    return V.attach_glosses(lexicon, S.gloss_table(lexicon)).select(
        "book_id", "lemma", "pos", "de", "en", "region_note", "mexicanism"
    )


_CANDIDATES = """
    SELECT lemma, pos, language, source, language || ':' || source || ':' || lemma AS gloss
    FROM (SELECT DISTINCT lemma, pos FROM lex0), (VALUES ('de'), ('en')) l(language),
         (VALUES ('cache', 0, 5), ('de_dictionary', 1, 3), ('en_dictionary', 2, 2), ('model', 3, 1)) s(source, pr, every)
    WHERE length(lemma) % every = 0"""


def _gloss_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("cache", 5), ("de_dictionary", 3), ("en_dictionary", 2), ("model", 1)]
    layers = F.array(*[
        F.struct(F.lit(lang).alias("language"), F.lit(s).alias("source"), F.lit(e).alias("every"))
        for lang in ("de", "en") for s, e in rows
    ])
    lemmas = V.lexicon_counts(S.counts_once(spark, sf)).select("lemma", "pos").distinct()
    return lemmas.select("lemma", "pos", F.explode(layers).alias("c")).filter(
        F.length("lemma") % F.col("c.every") == 0
    ).select("lemma", "pos", "c.language", "c.source", F.concat_ws(":", "c.language", "c.source", "lemma").alias("gloss"))


@query("v7_resolve_glosses", f"""
    WITH c AS ({_CANDIDATES})
    SELECT lemma, pos, language, arg_min(gloss, pr) AS gloss, arg_min(source, pr) AS source
    FROM c JOIN (VALUES ('cache', 0), ('de_dictionary', 1), ('en_dictionary', 2), ('model', 3)) o(source, pr) USING (source) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.resolve_glosses(_gloss_candidates(spark, sf))


@query("v7_resolve_glosses_regloss", f"""
    WITH c AS ({_CANDIDATES})
    SELECT lemma, pos, language, arg_min(gloss, pr) AS gloss, arg_min(source, pr) AS source
    FROM c JOIN (VALUES ('de_dictionary', 1), ('en_dictionary', 2), ('model', 3)) o(source, pr) USING (source) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.resolve_glosses(_gloss_candidates(spark, sf), regloss=True)


@query("v8_gloss_worklist", """
    WITH o AS (SELECT lemma, pos, sum(book_count)::BIGINT AS uses FROM lex0 WHERE length(lemma) % 2 = 1 GROUP BY ALL)
    SELECT * FROM (SELECT lemma, pos, uses FROM o ORDER BY uses DESC, lemma, pos LIMIT 200)
    UNION ALL SELECT '(cut)', '', greatest(count(*) - 200, 0) FROM o""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = V.lexicon_counts(S.counts(spark, sf))
    glossed = lexicon.filter(F.length("lemma") % 2 == 0).select("lemma", "pos").distinct()
    work, cut = V.gloss_worklist(lexicon, glossed, 200)
    return work.union(cut.select(F.lit("(cut)"), F.lit(""), F.col("cut").cast("long")))


@query("v9_list_chapters", """
    SELECT t.book_id, t.chapter_index, 'Document ' || t.chapter_index AS title, token_count, coalesce(n, 0) AS paragraph_count
    FROM totals t LEFT JOIN (SELECT book_id, chapter_index, count(*) AS n FROM paras GROUP BY ALL) USING (book_id, chapter_index)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    chapters = S.chapters(spark, sf).drop("paragraph_count").join(
        V.chapter_totals(S.counts(spark, sf)), ["book_id", "chapter_index"]
    )
    return V.list_chapters(chapters, S.paragraphs(spark, sf))


@query("v10_gold_recall", r"""
    WITH gold AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*'))) AS lemma FROM benchmark),
    f AS (SELECT book_id, lemma, bool_or(mexicanism) AS flag FROM lex WHERE lemma IN (SELECT lemma FROM gold) GROUP BY ALL)
    SELECT book_id, count(*) AS present, count(*) FILTER (flag) AS flagged, round(avg(flag::INTEGER::DOUBLE), 6) AS recall FROM f GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    gold = S.table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))).alias("w")
    ).select(F.lower("w").alias("lemma"))
    return V.gold_recall(S.unkeyed_lexicon(S.counts(spark, sf)), gold)
