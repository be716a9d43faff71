"""Queries on plays, matching and lyrics (group X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions import text as T
from lectura.operators import songs as X
from lectura.operators import vocab as V
from lectura.plans import stand_ins as S
from lectura.plans.ctes import TIME, values
from lectura.plans.registry import CTES, query
from lectura.session import literal_table, stored

_SP = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
_STOP = "|".join(K.TITLE_STOP_TERMS)


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}', ' ', 'g'))"


def _title_sql(x: str) -> str:
    t = f"regexp_replace(lower({_collapse(x)}), '[‐-―−]', '-', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '\s*[(\[](?:{_STOP})[)\]]\s*$', '')"
    t = rf"regexp_replace({t}, '(\S)\s+[(\[]?(?:feat\.|ft\.|con )\s*.*$', '\1')"
    t = rf"regexp_replace({t}, '\s+-\s+(?:{_STOP})\s*$', '')"
    return _collapse(t)


def _artist_sql(x: str) -> str:
    return rf"strip_accents({_collapse(x)})".replace(_collapse(x), f"lower({_collapse(x)})")


@query("x1_select_candidates", f"""
    SELECT user_id, track_key, count(*) AS plays, max(ts) AS last_played_at FROM plays
    WHERE ts > {TIME} - INTERVAL 30 DAY AND ts <= {TIME} GROUP BY ALL HAVING count(*) >= 3""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.select_candidates(X.with_track_key(S.plays(spark, sf)), S.now())


@query("x1_ever_candidates", """
    SELECT user_id, track_key, min(ts) AS candidate_since FROM (
      SELECT *, lag(ts, 2) OVER (PARTITION BY user_id, track_key ORDER BY ts, seq) AS before FROM plays WHERE ts IS NOT NULL)
    WHERE ts <= before + INTERVAL 7 DAY GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.ever_candidates(X.with_track_key(S.plays(spark, sf)), days=7)


@query("x2_with_favourites", f"""
    WITH c AS (SELECT user_id, track_key FROM plays WHERE ts > {TIME} - INTERVAL 30 DAY AND ts <= {TIME} GROUP BY ALL HAVING count(*) >= 3),
    f AS (SELECT user_id, track_key FROM (SELECT user_id, track_key, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, track_key) AS rn FROM plays WHERE ts IS NOT NULL GROUP BY ALL) WHERE rn <= 3)
    SELECT user_id, track_key, string_agg(reason, '+' ORDER BY reason) AS reason FROM (SELECT *, 'recent' AS reason FROM c UNION ALL SELECT *, 'favourite' FROM f) GROUP BY ALL"""
       .replace("SELECT user_id, track_key, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, track_key) AS rn FROM plays WHERE ts IS NOT NULL GROUP BY ALL",
                "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, track_key) AS rn FROM (SELECT user_id, track_key, count(*) AS n FROM plays WHERE ts IS NOT NULL GROUP BY ALL)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    plays = X.with_track_key(S.plays(spark, sf))
    return X.with_favourites(X.select_candidates(plays, S.now()), plays, 3)


@query("x3_dedupe_tracks", """
    SELECT track_key, arg_max(artist, (ts, seq)) AS artist, arg_max(title, (ts, seq)) AS title, count(*) AS plays FROM plays WHERE ts IS NOT NULL GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.dedupe_tracks(X.with_track_key(S.plays(spark, sf)))


CTES["tracks"] = f"""
    SELECT track_id, artist, title, album, duration_sec, {_artist_sql('artist')} AS artist_key, strip_accents({_title_sql('title')}) AS title_key
    FROM (SELECT p_partkey AS track_id, CASE WHEN p_partkey % 9 IN (4, 7) THEN replace(p_brand, 'ran', 'rn') ELSE p_brand END AS artist,
                 CASE p_partkey % 9 WHEN 2 THEN name[:-2] WHEN 4 THEN name || 'x' WHEN 6 THEN name[:-3] || 'o' || name[-1] ELSE name END
                 || CASE p_type WHEN 'SMALL' THEN ' (Live)' WHEN 'ECONOMY' THEN ' - Remastered' ELSE '' END AS title, p_type AS album, p_size + 180 AS duration_sec
          FROM (SELECT *, upper(split_part(p_name, ' ', 1)[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS name FROM part))"""
CTES["catalog"] = f"""
    SELECT lyric_id, artist, title, album, duration_sec, instrumental, {_artist_sql('artist')} AS artist_key, strip_accents({_title_sql('title')}) AS title_key
    FROM (SELECT p_partkey AS lyric_id, upper(p_brand) AS artist, p_name || CASE WHEN p_retailprice % 3 >= 2 THEN ' blues' ELSE '' END AS title, p_type AS album,
                 p_size + 179 AS duration_sec, p_size = 50 AS instrumental FROM part WHERE p_size > 25)"""


@query("x4_normalize_title", f"SELECT track_id, {_title_sql('title')} AS title_norm, title_key, artist_key FROM tracks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth title in full-width letters and with ligatures, which compare as the plain ones do."""
    wide = F.replace(F.translate("title", "abcdeLR", "ａｂｃｄｅＬＲ"), F.lit("fi"), F.lit("ﬁ"))
    title = F.when(F.col("track_id") % 5 == 1, wide).otherwise(F.col("title"))
    return S.tracks(spark, sf).select("track_id", T.normalize_title(title).alias("title_norm"), T.title_key(title).alias("title_key"), "artist_key")


_SIM = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def _scored_sql(tracks: str) -> str:
    j = lambda x: f"coalesce(list_aggregate(list_sort({x}), 'string_agg', ' '), '')"
    return f"""
      WITH pr AS (SELECT m.artist_key, m.title_key, o.artist_key AS oa, o.title_key AS ot
                  FROM (SELECT DISTINCT artist_key, title_key FROM {tracks}) m, (SELECT DISTINCT artist_key, title_key FROM catalog) o),
      sp AS (SELECT *, {j("list_filter(string_split(title_key, ' '), lambda x: list_contains(string_split(ot, ' '), x))")} AS sh,
             {j("list_filter(string_split(title_key, ' '), lambda x: NOT list_contains(string_split(ot, ' '), x))")} AS l, {j("list_filter(string_split(ot, ' '), lambda x: NOT list_contains(string_split(title_key, ' '), x))")} AS r FROM pr),
      fs AS (SELECT *, trim(sh || ' ' || l) AS f1, trim(sh || ' ' || r) AS f2 FROM sp),
      nm AS (SELECT *, 0.5 * CASE WHEN sh = '' THEN {_SIM('f1', 'f2')} ELSE greatest({_SIM('f1', 'f2')}, {_SIM('sh', 'f1')}, {_SIM('sh', 'f2')}) END + 0.35 * {_SIM('artist_key', 'oa')} AS names FROM fs),
      sc AS (SELECT t.track_id, c.lyric_id, round(names + CASE WHEN abs(t.duration_sec - c.duration_sec) <= 3 THEN 0.15 ELSE 0.0 END, 6) AS score
             FROM {tracks} t JOIN nm USING (artist_key, title_key) JOIN catalog c ON c.artist_key = oa AND c.title_key = ot)
      SELECT track_id, arg_max(lyric_id, (score, -lyric_id)) AS lyric_id, max(score) AS score,
             CASE WHEN max(score) >= 0.85 THEN 'accept' ELSE 'manual' END AS verdict FROM sc WHERE score >= 0.7 GROUP BY ALL"""


CTES["scored"] = _scored_sql("tracks")


@query("x5_score_matches", """
    SELECT t.track_id, coalesce(s.lyric_id, -1) AS lyric_id, coalesce(s.score, 0.0)::DOUBLE AS score, coalesce(s.verdict, 'reject') AS verdict
    FROM tracks t LEFT JOIN scored s USING (track_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL compares all pairs."""
    return X.score_matches(S.tracks(spark, sf), S.catalog(spark, sf)).fillna({"lyric_id": -1, "score": 0.0})


CTES["open_tracks"] = """
    SELECT * FROM tracks t WHERE duration_sec <> 187 AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c.artist_key = t.artist_key AND c.title_key = t.title_key)"""
CTES["ladder"] = f"""
    WITH given AS (SELECT track_id, NULL::BIGINT AS lyric_id, 'manual' AS stage FROM tracks WHERE duration_sec = 187),
    full_match AS (SELECT track_id, min(lyric_id) AS lyric_id, 'exact' AS stage FROM tracks t JOIN catalog c USING (artist_key, title_key, album, duration_sec) WHERE t.duration_sec <> 187 GROUP BY 1),
    named AS (SELECT track_id, min(lyric_id) AS lyric_id, 'title_artist' AS stage FROM tracks t JOIN catalog c USING (artist_key, title_key) WHERE t.duration_sec <> 187
              AND track_id NOT IN (SELECT track_id FROM full_match) GROUP BY 1),
    fuzzy AS (SELECT track_id, lyric_id, CASE verdict WHEN 'accept' THEN 'scored' ELSE 'scored_manual' END AS stage FROM ({_scored_sql('open_tracks')}) WHERE verdict <> 'reject'),
    every AS (SELECT * FROM given UNION ALL SELECT * FROM full_match UNION ALL SELECT * FROM named UNION ALL SELECT * FROM fuzzy),
    allrows AS (SELECT * FROM every UNION ALL SELECT track_id, NULL, 'none' FROM tracks WHERE track_id NOT IN (SELECT track_id FROM every))
    SELECT a.track_id, coalesce(a.lyric_id, -1) AS lyric_id, stage, CASE WHEN stage = 'none' OR coalesce(instrumental, false) THEN 'no_lyrics' WHEN stage = 'scored_manual' THEN 'review' ELSE 'lyrics' END AS outcome
    FROM allrows a LEFT JOIN catalog c ON c.lyric_id = a.lyric_id"""


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    tracks = S.tracks(spark, sf)
    return X.match_ladder(tracks, S.catalog(spark, sf), tracks.filter(F.col("duration_sec") == 187))


@query("x6_match_ladder", "SELECT * FROM ladder")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _ladder(spark, sf).withColumn("lyric_id", F.coalesce("lyric_id", F.lit(-1)))


@query("x7_due_for_lookup", f"""
    SELECT track_id FROM tracks WHERE (artist_key, title_key) NOT IN (
      SELECT artist_key, title_key FROM (SELECT *, duration_sec > 225 AS hit, {TIME} - to_days((duration_sec - 180)::INTEGER) AS checked_at FROM tracks WHERE album <> 'LARGE')
      WHERE hit OR checked_at > {TIME} - INTERVAL 1 MONTH)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    tracks = S.tracks(spark, sf)
    cache = tracks.filter(F.col("album") != "LARGE").select(
        "artist_key", "title_key", (F.col("duration_sec") > 225).alias("hit"),
        (S.now() - F.make_dt_interval(F.col("duration_sec") - 180)).alias("checked_at"),
    )
    return X.due_for_lookup(tracks, cache, S.now()).select("track_id")


CTES["langwords"] = r"SELECT doc_id, lang, w, count(*) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{M}]*')) AS w FROM documents) GROUP BY ALL"
CTES["langtri"] = """
    SELECT lang, substr(' ' || w || ' ', i, 3) AS t, sum(n)::BIGINT AS c
    FROM (SELECT lang, w, n, unnest(generate_series(1, length(w))) AS i FROM (SELECT lang, w, sum(n) AS n FROM langwords WHERE lang IS NOT NULL GROUP BY ALL)) GROUP BY ALL"""
CTES["langs"] = f"""
    WITH tot AS (SELECT lang, -round(1e6 * ln(sum(c) + (SELECT count(DISTINCT t) FROM langtri)))::BIGINT AS unseen FROM langtri GROUP BY lang),
    g AS (SELECT w, lang, sum(round(ln(c + 1) * 1e6)::BIGINT) AS gain FROM (
      SELECT w, substr(' ' || w || ' ', i, 3) AS t FROM (SELECT w, unnest(generate_series(1, length(w))) AS i FROM (SELECT DISTINCT w FROM langwords))) JOIN langtri USING (t) GROUP BY ALL),
    s AS (SELECT doc_id, g.lang, sum(n * gain) AS gains FROM langwords l JOIN g USING (w) GROUP BY ALL),
    d AS (SELECT doc_id, sum(n * length(w)) AS n FROM langwords GROUP BY doc_id),
    e AS (SELECT doc_id, tot.lang AS language, (coalesce(gains, 0) + n * unseen)::DOUBLE / (n + {K.LANGUAGE_PRIOR}) * {K.LANGUAGE_SHARPNESS / 1e6!r} AS e
          FROM d CROSS JOIN tot LEFT JOIN s USING (doc_id, lang))
    SELECT doc_id, arg_max(language, (e, language)) AS language, round(1 / sum(exp(e - top)), 6) AS confidence
    FROM (SELECT *, max(e) OVER (PARTITION BY doc_id) AS top FROM e) GROUP BY doc_id"""


@query("x8_language_gate", """
    SELECT d.doc_id, l.language, l.confidence, CASE WHEN l.confidence >= 0.8 AND l.language = 'es' THEN 'accept' WHEN l.confidence >= 0.8 THEN 'reject' ELSE 'review' END AS route
    FROM documents d LEFT JOIN langs l USING (doc_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The model learns from the languages that the documents state."""
    counts = stored(X.count_words(S.documents(spark, sf), "doc_id", "lang"), "words-of-texts")
    return X.language_gate(S.table(spark, sf, "documents"), X.language_scores(counts, X.learn_languages(counts)))


@query("x9_to_stanzas", r"""
    WITH d AS (SELECT doc_id, regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\n[ \t]*(?:\n[ \t]*)+') AS a FROM documents),
    s AS (SELECT doc_id, list_filter(list_transform(a, lambda p: list_filter(string_split(p, chr(10)), lambda l: trim(l) <> '')), lambda p: len(p) > 0) AS a FROM d),
    u AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS si FROM s),
    v AS (SELECT doc_id, si - 1 AS stanza_index, unnest(p) AS text, generate_subscripts(p, 1) AS li FROM u)
    SELECT doc_id AS track_id, stanza_index::INTEGER AS stanza_index, (row_number() OVER (PARTITION BY doc_id ORDER BY stanza_index, li) - 1)::INTEGER AS line_index, text FROM v""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("track_id"), F.replace("text", F.lit(".\n"), F.lit(".\n \n")).alias("text")
    )
    return X.to_stanzas(docs)


_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}\s]+', '', 'g'), '[\t-\r\x1c-\x20\x85\p{Z}]+', ' ', 'g'))"
CTES["keyed_lines"] = f"SELECT chapter_index AS track_id, paragraph_index AS line_index, text, {_KEY} AS line_key FROM paras"


@query("x10_unique_lines", """
    SELECT track_id, min(line_index) AS line_index, line_key, count(*) AS times FROM keyed_lines WHERE line_key <> '' GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.paragraphs(spark, sf).select(
        F.col("chapter_index").alias("track_id"), F.lit(0).alias("stanza_index"), F.col("paragraph_index").alias("line_index"), "text"
    )
    return X.unique_lines(lines).select("track_id", "line_index", "line_key", "times")


CTES["stanza_keys"] = f"SELECT track_id, stanza_index, string_agg({_KEY}, chr(10) ORDER BY line_index) AS h FROM lyrics GROUP BY ALL"


@query("x11_mark_repeats", """
    SELECT track_id, stanza_index, coalesce(CASE WHEN f < stanza_index THEN f END, -1) AS repeat_of
    FROM (SELECT *, min(stanza_index) OVER (PARTITION BY track_id, h) AS f FROM (
      SELECT * FROM stanza_keys UNION ALL SELECT track_id, stanza_index + 1000, h FROM stanza_keys))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation sung twice."""
    once = S.lyric_lines(spark, sf)
    twice = once.union(once.withColumn("stanza_index", F.col("stanza_index") + 1000))
    return X.mark_repeats(twice).withColumn("repeat_of", F.coalesce("repeat_of", F.lit(-1)))


CTES["sung"] = rf"""
    SELECT track_id, lower(w) AS lemma, count(*) AS n FROM (
      SELECT track_id, unnest(regexp_extract_all(text, '\p{{L}}[\p{{L}}\p{{M}}]*')) AS w FROM (
        SELECT track_id, arg_min(text, (stanza_index, line_index)) AS text FROM (SELECT *, {_KEY} AS kk FROM lyrics) WHERE kk <> '' GROUP BY track_id, kk)) GROUP BY ALL"""


def _sung(spark: SparkSession, sf: str) -> DataFrame:
    return X.song_vocabulary(S.lyric_lines(spark, sf))


def _known_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.word_of_rank(S.counts(spark, sf)).select(F.col("lemma_id").alias("lemma"))


@query("x12_song_vocabulary", "SELECT track_id, lemma, n FROM sung")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _sung(spark, sf)


@query("x13_dense_tracks", """
    SELECT track_id, count(*) AS unknown, count(*) > 18 AS dense FROM sung WHERE lemma NOT IN (SELECT lemma_id FROM ranked) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.dense_tracks(_sung(spark, sf).join(_known_words(spark, sf), "lemma", "left_anti"))


@query("x14_song_coverage", """
    SELECT track_id, c AS coverage, c < 0.95 AS warn FROM (
      SELECT track_id, round(coalesce(sum(n) FILTER (lemma IN (SELECT lemma_id FROM ranked)), 0)::DOUBLE / sum(n), 6) AS c FROM sung GROUP BY ALL)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.song_coverage(_sung(spark, sf), _known_words(spark, sf))


# Senses of the song words: variety and register by word length.
_VARIETIES = "[" + ", ".join(f"'{v}'" for v in K.VARIETIES) + "]"
_REGISTERS = "[" + ", ".join(f"'{v}'" for v in K.REGISTERS) + "]"
CTES["senses"] = f"""
    SELECT DISTINCT lemma, 'NOUN' AS pos, 'de ' || lemma AS gloss_de, 'en ' || lemma AS gloss_en, ({_VARIETIES})[(length(lemma) % 21 + 1)::INTEGER] AS variety,
           ({_REGISTERS})[(length(lemma) % 6 + 1)::INTEGER] AS register, CASE WHEN length(lemma) % 4 IN (0, 1) THEN 'home ' || lemma END AS home_equivalent FROM sung"""


def _sense_columns(words: DataFrame) -> DataFrame:
    size = F.length("lemma")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(v) for v in names]), (size % n + 1).cast("int"))
    return words.select(
        *words.columns, F.lit("NOUN").alias("pos"), F.concat(F.lit("de "), "lemma").alias("gloss_de"), F.concat(F.lit("en "), "lemma").alias("gloss_en"),
        pick(K.VARIETIES, 21).alias("variety"), pick(K.REGISTERS, 6).alias("register"),
        F.when((size % 4).isin(0, 1), F.concat(F.lit("home "), "lemma")).alias("home_equivalent"),
    )


def senses(spark: SparkSession, sf: str) -> DataFrame:
    return _sense_columns(_sung(spark, sf).select("lemma").distinct())


_FOREIGN = "variety NOT IN ('general', 'es-MX')"


@query("x15_render_variety", f"""
    SELECT lemma, pos, gloss_de || chr(10) || gloss_en AS gloss, CASE WHEN {_FOREIGN} THEN split_part(variety, '-', 2) || ' · ' || register END AS badge,
           CASE WHEN {_FOREIGN} THEN 'MX: ' || home_equivalent END AS home_note, {_FOREIGN} AS recognition_only FROM senses""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.render_variety(senses(spark, sf))[0]


@query("x15_variety_violations", f"SELECT lemma, pos, variety, home_equivalent FROM senses WHERE NOT {_FOREIGN} AND home_equivalent IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.render_variety(senses(spark, sf))[1]


@query("x16_match_probe", """
    SELECT coalesce(stage, 'ALL') AS stage, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM ladder), 6) AS share FROM ladder GROUP BY ROLLUP (stage)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.match_probe(_ladder(spark, sf))


def _near_sql(column: str) -> str:
    """Words of the distinct keys of both sides, numbered from the least used one, and the pairs of near words."""
    word = lambda source: f"""
      SELECT key, word, row_number() OVER (PARTITION BY key ORDER BY uses, word) AS place FROM (SELECT key, word, count(*) OVER (PARTITION BY word) AS uses
      FROM (SELECT DISTINCT {column} AS key, unnest(string_split({column}, ' ')) AS word FROM {source}))"""
    less = lambda w: f"list_transform(list_filter(range(1, length({w}) + 1), lambda i: NOT {w}[i] BETWEEN '0' AND '9'), lambda i: {w}[:i - 1] || {w}[i + 1:])"
    one, two = K.SLIP_LETTERS
    return f"""
      m AS ({word('tracks')}), o AS ({word('catalog')}),
      f1 AS (SELECT DISTINCT word, word AS w, 0 AS cut FROM (SELECT word FROM m UNION SELECT word FROM o)),
      f2 AS (SELECT * FROM f1 UNION SELECT word, unnest({less('w')}), 1 FROM f1 WHERE length(word) >= {one}),
      forms AS (SELECT DISTINCT word, w FROM (SELECT * FROM f2 UNION SELECT word, unnest({less('w')}), 2 FROM f2 WHERE cut = 1 AND length(word) >= {two})),
      near AS (SELECT DISTINCT a.word, b.word AS near FROM forms a JOIN forms b USING (w))"""


def _keyed_sql(two: bool, column: str, places: int = 1) -> str:
    """(own, key, k1, s1[, k2]) of both sides."""
    side = lambda own, rare: f"unnest(CASE WHEN {rare} THEN ['mine', 'other'] ELSE ['{'other' if own == 'mine' else 'mine'}'] END)"
    rows = {"mine": "(SELECT key, m.word AS own_word, near AS word, place FROM m JOIN near USING (word))", "other": "(SELECT key, word AS own_word, word, place FROM o)"}
    pair = lambda own: f"""SELECT DISTINCT '{own}' AS own, a.key, least(a.word, b.word) AS k1, {side(own, 'a.place <= 2 AND b.place <= 2')} AS s1, greatest(a.word, b.word) AS k2
      FROM {rows[own]} a JOIN {rows[own]} b ON a.key = b.key AND a.own_word < b.own_word"""
    single = lambda own: f"SELECT DISTINCT '{own}' AS own, key, word AS k1, {side(own, f'place <= {places}')} AS s1 FROM {rows[own]}"
    return f"WITH {_near_sql(column)} " + " UNION ALL ".join((pair if two else single)(own) for own in ("mine", "other"))


_DURATION = K.DURATION_TOLERANCE_SEC


@query("x16_match_buckets", f"""
    WITH aw AS ({_keyed_sql(False, 'artist_key')}), tw AS ({_keyed_sql(False, 'title_key')}), ti AS ({_keyed_sql(False, 'title_key', 2)}), tt AS ({_keyed_sql(True, 'title_key')}),
    r AS (SELECT DISTINCT 'mine' AS own, artist_key, title_key, duration_sec AS d FROM tracks UNION ALL SELECT DISTINCT 'other', artist_key, title_key, duration_sec FROM catalog),
    names AS (SELECT DISTINCT own, artist_key, title_key FROM r),
    spans AS (SELECT DISTINCT own, artist_key, title_key, unnest(CASE own WHEN 'mine' THEN [(d - {_DURATION}) // {K.DURATION_SPAN_SEC}, (d + {_DURATION}) // {K.DURATION_SPAN_SEC}] ELSE [d // {K.DURATION_SPAN_SEC}] END) AS d FROM r),
    k AS (SELECT 'both' AS kind, r.own, a.k1, a.s1, t.k1 AS k2, t.s1 AS s2 FROM names r JOIN aw a ON a.own = r.own AND a.key = artist_key JOIN tw t ON t.own = r.own AND t.key = title_key
          UNION ALL SELECT 'words', r.own, k1, s1, k2, '' FROM names r JOIN tt ON tt.own = r.own AND tt.key = title_key
          UNION ALL SELECT 'title', spans.own, k1, s1, d::VARCHAR, '' FROM spans JOIN ti ON ti.own = spans.own AND ti.key = title_key
          UNION ALL SELECT 'artist', spans.own, k1, s1, d::VARCHAR, '' FROM spans JOIN aw ON aw.own = spans.own AND aw.key = artist_key),
    b AS (SELECT kind, count(*) FILTER (own = 'mine') * count(*) FILTER (own = 'other') AS pairs FROM k GROUP BY kind, k1, s1, k2, s2)
    SELECT kind, count(*) AS buckets, sum(pairs)::BIGINT AS pairs, max(pairs)::BIGINT AS largest FROM b WHERE pairs > 0 GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.match_buckets(S.tracks(spark, sf), S.catalog(spark, sf))


@query("x17_overtag_rate", r"""
    WITH gold AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*'))) AS lemma FROM benchmark),
    t AS (SELECT lemma, bool_or(variety <> 'general') AS tagged FROM senses WHERE lemma IN (SELECT lemma FROM gold) GROUP BY ALL)
    SELECT count(*) AS general_lemmas, count(*) FILTER (tagged) AS overtagged, round(avg(tagged::INTEGER::DOUBLE), 6) AS rate FROM t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    gold = S.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))).alias("w"))
    return X.overtag_rate(senses(spark, sf), gold.select(F.lower("w").alias("lemma")))


@query("x18_distinct_senses", """
    SELECT lemma, pos, count(DISTINCT chapter_index) AS tracks, sum(n)::BIGINT AS uses, min(chapter_index) AS first_track FROM counts GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.distinct_senses(S.counts_once(spark, sf).withColumnRenamed("chapter_index", "track_id"))


_ELISIONS = [("th", "the"), ("ou", "out"), ("pa", "para"), ("na", "nada"), ("an", "and"), ("ch", "ach")]


@query("x19_expand_elisions", f"""
    SELECT track_id, stanza_index, line_index, word_index, s, coalesce(f, lower(s)) AS normalised, f IS NOT NULL AS is_elided
    FROM (SELECT track_id, stanza_index, line_index, (i - 1)::INTEGER AS word_index, s FROM (SELECT *, unnest(a) AS s, generate_subscripts(a, 1) AS i
          FROM (SELECT *, regexp_extract_all(text, '\\p{{L}}[\\p{{L}}\\p{{M}}]*') AS a FROM lyrics))) LEFT JOIN ({values(_ELISIONS)}) e(form, f) ON lower(s) = form""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from lectura.operators.tokens import words

    tokens = words(S.lyric_lines(spark, sf)).drop("first_word")
    return X.expand_elisions(tokens, literal_table(spark, _ELISIONS, "form, full"))


_DEFECT = "length(lemma) % 9"


@query("x20_parse_senses", f"""
    SELECT lemma AS id, CASE {_DEFECT} WHEN 2 THEN 'not JSON' WHEN 3 THEN 'missing glossDe' WHEN 4 THEN 'unknown variety' WHEN 5 THEN 'unknown register' WHEN 6 THEN 'not JSON' ELSE 'ok' END AS outcome FROM senses""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    defect = F.length("lemma") % 9
    table = senses(spark, sf).select(
        F.col("lemma").alias("id"), defect.alias("defect"),
        F.to_json(F.struct(
            "lemma", "pos", F.when(defect != 3, F.col("gloss_de")).alias("glossDe"), F.col("gloss_en").alias("glossEn"),
            F.when(defect == 4, "es-XX").otherwise(F.col("variety")).alias("variety"),
            F.when(defect == 5, "rude").otherwise(F.col("register")).alias("register"), F.lit(0.9).alias("confidence"),
        )).alias("json"),
    )
    response = F.when(F.col("defect") == 2, F.concat(F.lit("Sure: "), "json")).when(
        F.col("defect") == 6, F.substring("json", F.lit(1), F.length("json") - 3)
    ).otherwise(F.col("json"))
    ok, rejected = X.parse_senses(table.select("id", response.alias("response")))
    return ok.select("id", F.lit("ok").alias("outcome")).union(rejected.select("id", F.col("reason").alias("outcome")))
