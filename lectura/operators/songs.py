"""Songs: what was played, which lyrics belong to it, and the vocabulary of lyrics.

``plays(user_id, artist, title, album, mbid, ts, now_playing)`` ·
``catalog(lyric_id, artist, title, album, duration_sec, instrumental, plain)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions import text as T
from lectura.operators.tokens import token_array
from lectura.session import stored


def with_track_key(plays: DataFrame) -> DataFrame:
    """``track_key``: the external id where there is one, else normalised artist and title."""
    named = F.concat_ws("\u0001", T.artist_key(F.col("artist")), T.title_key(F.col("title")))
    return plays.withColumn("track_key", F.coalesce(F.nullif("mbid", F.lit("")), named))


def finished_plays(plays: DataFrame) -> DataFrame:
    """Plays with a time stamp; a track still playing comes back later as a normal play."""
    return plays.filter(F.col("ts").isNotNull() & ~F.coalesce("now_playing", F.lit(False)))


def select_candidates(plays: DataFrame, now: Column, min_plays: int = 3, days: int = 30) -> DataFrame:
    """Tracks played at least ``min_plays`` times in the trailing window."""
    recent = finished_plays(plays).filter(
        (F.col("ts") > now - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= now)
    )
    return recent.groupBy("user_id", "track_key").agg(
        F.count(F.lit(1)).alias("plays"), F.max("ts").alias("last_played_at")
    ).filter(F.col("plays") >= min_plays)


def ever_candidates(plays: DataFrame, min_plays: int = 3, days: int = 30) -> DataFrame:
    """Tracks that met the rule at any moment: the first time of the ``min_plays``-th play in a window."""
    order = Window.partitionBy("user_id", "track_key").orderBy("ts", "seq")
    earlier = F.lag("ts", min_plays - 1).over(order)
    close = F.col("ts") <= earlier + F.make_dt_interval(F.lit(days))
    return (
        finished_plays(plays).withColumn("_close", close).filter("_close")
        .groupBy("user_id", "track_key").agg(F.min("ts").alias("candidate_since"))
    )


def with_favourites(candidates: DataFrame, plays: DataFrame, k: int) -> DataFrame:
    """Candidates plus each reader's ``k`` most played tracks of the whole period."""
    counts = finished_plays(plays).groupBy("user_id", "track_key").agg(F.count(F.lit(1)).alias("plays"))
    order = Window.partitionBy("user_id").orderBy(F.desc("plays"), "track_key")
    favourites = counts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
    return (
        candidates.select("user_id", "track_key", F.lit("recent").alias("reason"))
        .union(favourites.select("user_id", "track_key", F.lit("favourite").alias("reason")))
        .groupBy("user_id", "track_key")
        .agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reason"))
    )


def dedupe_tracks(plays: DataFrame) -> DataFrame:
    """One row per track with the spelling of its latest play."""
    latest = F.max_by(F.struct("artist", "title"), F.struct("ts", "seq"))
    return (
        finished_plays(plays).groupBy("track_key")
        .agg(latest.alias("_t"), F.count(F.lit(1)).alias("plays"))
        .select("track_key", "_t.artist", "_t.title", "plays")
    )


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; 1.0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best similarity among the shared words and either side's words put after them."""
    left, right = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.array_join(F.array_sort(F.array_intersect(left, right)), " ")
    only = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    first = F.trim(F.concat_ws(" ", shared, only(left, right)))
    second = F.trim(F.concat_ws(" ", shared, only(right, left)))
    best = F.greatest(similarity(first, second), similarity(shared, first), similarity(shared, second))
    return F.when(shared == "", similarity(first, second)).otherwise(best)


def with_match_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("artist_key", T.artist_key(F.col("artist"))).withColumn(
        "title_key", T.title_key(F.col("title"))
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): the distinct words of ``words(word)`` that are slips apart, every word with itself too.

    A slip is a letter too many, missing, wrong, or swapped with its neighbour: words are near if they, or what is left
    of them without some letters, are equal. ``SLIP_LETTERS`` says from how many letters on a word may lose one, and two;
    shorter words only match themselves, and a digit is never a slip.
    """
    at = lambda w: F.filter(F.sequence(F.lit(1), F.length(w)), lambda k: ~F.substring(w, k, F.lit(1)).between("0", "9"))
    shorter = lambda w: F.transform(at(w), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    one = shorter(F.col("word"))
    slips = [F.when(F.length("word") >= n, f).otherwise(F.array().cast("array<string>")) for n, f in zip(K.SLIP_LETTERS, (one, F.flatten(F.transform(one, shorter))))]
    forms = F.array_distinct(F.concat(F.array("word"), *slips))
    keyed = words.select("word").distinct().select("word", F.explode(forms).alias("_form"))
    return keyed.join(keyed.withColumnRenamed("word", "near"), "_form").select("word", "near").distinct()


def key_words(records: DataFrame, column: str) -> DataFrame:
    """(column, word, place): the words of every distinct key, numbered from the one that fewest keys hold."""
    words = records.select(column).distinct().select(
        column, F.explode(F.array_distinct(F.split(column, " "))).alias("word")
    )
    uses = words.groupBy("word").agg(F.count(F.lit(1)).alias("_uses"))
    order = Window.partitionBy(column).orderBy("_uses", "word")
    return words.join(uses, "word").select(column, "word", F.row_number().over(order).alias("place"))


def _sides(rare: Column, own: str) -> Column:
    """Which of the two keys must hold its rare words for them to share these."""
    return F.explode(F.when(rare, F.array(F.lit("mine"), F.lit("other"))).otherwise(F.array(F.lit(own)))).alias("side")


def matching_words(tracks: DataFrame, catalog: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(column, own, word, place)`` of the distinct values of ``column`` in the tracks and in the catalog.

    ``word`` is a word of the value, for the tracks also any near word (``own`` is then the word as written).
    """
    mine, other = stored(key_words(tracks, column), "track-words"), stored(key_words(catalog, column), "catalog-words")
    near = near_words(mine.select("word").union(other.select("word")))
    mine = mine.join(near, "word").select(column, F.col("word").alias("own"), F.col("near").alias("word"), "place")
    return stored(mine, "near-track-words"), other.select(column, F.col("word").alias("own"), "word", "place")


def _by_word(words: DataFrame, own: str, places: int = 1) -> DataFrame:
    """Keys ``(word, side)``: two values share one if one of the ``places`` least used words of either is near a word of the other.

    Words that many values hold never join on their own, and slips in the least used word of both are survived.
    """
    return words.select(words.columns[0], "word", _sides(F.col("place") <= places, {"mine": "other", "other": "mine"}[own])).distinct()


def _by_two_words(words: DataFrame, own: str) -> DataFrame:
    """Keys ``(word, word2, side)``: the two least used words of either value are near two words of the other."""
    key = words.columns[0]
    second = words.select(key, F.col("own").alias("_own2"), F.col("word").alias("_word2"), F.col("place").alias("_place2"))
    return words.join(second, key).filter(F.col("own") < F.col("_own2")).select(
        key, F.least("word", "_word2").alias("word"), F.greatest("word", "_word2").alias("word2"),
        _sides((F.col("place") <= 2) & (F.col("_place2") <= 2), {"mine": "other", "other": "mine"}[own]),
    ).distinct()


MATCH_KEYS = ["kind", "k1", "s1", "k2", "s2"]


def numbered_names(records: DataFrame) -> DataFrame:
    """(id, artist_key, title_key): the distinct names, with a number each."""
    names = records.select("artist_key", "title_key").distinct()
    return stored(names.select(F.monotonically_increasing_id().alias("id"), "*"), "names")


def timed_rows(records: DataFrame, names: DataFrame, *more: Column) -> DataFrame:
    """(id, d): the distinct durations under each name, -1 where unknown, and ``more`` aggregates."""
    rows = records.join(names, ["artist_key", "title_key"]).groupBy("id", F.coalesce("duration_sec", F.lit(-1)).alias("d"))
    return stored(rows.agg(*more) if more else rows.count().drop("count"), "durations")


def match_keys(mine: DataFrame, other: DataFrame, my_times: DataFrame, other_times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every way in which two names, ``mine`` of the tracks and ``other`` of the catalog, may meet: equal ``MATCH_KEYS``.

    ``both``: artist and title match in a least used word, up to slips. ``words``: the title does in its two least used
    words. ``title`` (in one of its two), ``artist``: only that one does, and two durations lie in the same span or near it, since no such
    pair reaches the score for a manual check without near durations. Rows are ``(id, *MATCH_KEYS)``, distinct.
    """
    words = {c: dict(zip(("mine", "other"), matching_words(mine, other, c))) for c in ("artist_key", "title_key")}
    # Spans of durations and not durations: names with many recordings would meet at every one of them.
    span = lambda shift: F.floor((F.col("d") + shift) / K.DURATION_SPAN_SEC)
    spans = F.explode(F.array_distinct(F.array(span(-K.DURATION_TOLERANCE_SEC), span(K.DURATION_TOLERANCE_SEC))))
    times = {"mine": my_times.filter("d >= 0").select("id", spans.alias("d")).distinct(), "other": other_times.filter("d >= 0").select("id", span(0).alias("d")).distinct()}
    word, side, none, at = F.col("word"), F.col("side"), F.lit(""), F.col("d").cast("string")

    def keyed(rows: DataFrame, kind: str, *values: Column) -> DataFrame:
        return rows.select("id", F.lit(kind).alias("kind"), *(v.alias(n) for v, n in zip(values, MATCH_KEYS[1:])))

    def meeting(own: str, names: DataFrame) -> DataFrame:
        artist, title = (_by_word(words[c][own], own) for c in ("artist_key", "title_key"))
        both = names.join(artist.withColumnsRenamed({"word": "aw", "side": "as"}), "artist_key").join(title, "title_key")
        two = names.join(_by_two_words(words["title_key"][own], own), "title_key")
        return (
            keyed(both, "both", F.col("aw"), F.col("as"), word, side)
            .union(keyed(two, "words", word, side, F.col("word2"), none))
            .union(keyed(names.join(_by_word(words["title_key"][own], own, 2), "title_key").join(times[own], "id"), "title", word, side, at, none))
            .union(keyed(names.join(artist, "artist_key").join(times[own], "id"), "artist", word, side, at, none))
        )

    return stored(meeting("mine", mine), "track-keys"), stored(meeting("other", other), "catalog-keys")


def match_buckets(tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, buckets, pairs, largest): how many names each kind of key brings together, and its largest key."""
    mine, other = numbered_names(tracks), numbered_names(catalog)
    keys = match_keys(mine, other, timed_rows(tracks, mine), timed_rows(catalog, other))
    count = lambda t, name: t.groupBy(*MATCH_KEYS).agg(F.count(F.lit(1)).alias(name))
    sized = count(keys[0], "_m").join(count(keys[1], "_o"), MATCH_KEYS).withColumn("_pairs", F.col("_m") * F.col("_o"))
    return sized.groupBy("kind").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("_pairs").alias("pairs"), F.max("_pairs").alias("largest"))


def score_matches(tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Best catalog row per track with its score and verdict; no row and no score where none reaches a manual check.

    Names are numbered, paired as ``match_keys`` says and scored once per distinct pair; only pairs that can still be the
    best of a name, whatever the durations, meet the rows, so that copies of a track or of a catalog row never
    multiply. A pair is lost only if neither the artists nor the titles share a least used word up to slips, or if only
    one of them does, the durations are far apart or unknown, and a second word differs.
    """
    wt, wa, wd = K.MATCH_WEIGHTS
    mine, other = numbered_names(tracks), numbered_names(catalog)
    forms, rows = timed_rows(tracks, mine), timed_rows(catalog, other, F.min("lyric_id").alias("lyric_id"))
    left, right = match_keys(mine, other, forms, rows)
    pairs = left.join(right.withColumnRenamed("id", "oid"), MATCH_KEYS).select("id", "oid").distinct()
    names = wt * token_set_ratio(F.col("title_key"), F.col("_ot")) + wa * similarity(F.col("artist_key"), F.col("_oa"))
    scored = stored(
        pairs.join(mine, "id")
        .join(other.select(F.col("id").alias("oid"), F.col("artist_key").alias("_oa"), F.col("title_key").alias("_ot")), "oid")
        .select("id", "oid", names.alias("names")).filter(F.col("names") >= K.MATCH_MANUAL - wd - 1e-6), "scored-names")
    top = scored.groupBy("id").agg(F.max("names").alias("_top"))
    hopeful = scored.join(top, "id").filter(F.col("names") + wd >= F.col("_top") - 1e-6).drop("_top")
    near = (F.col("d") >= 0) & (F.col("_od") >= 0) & (F.abs(F.col("d") - F.col("_od")) <= K.DURATION_TOLERANCE_SEC)
    best = F.max_by(F.struct("lyric_id", "score"), F.struct("score", -F.col("lyric_id")))
    chosen = (
        hopeful.join(forms, "id").join(rows.select(F.col("id").alias("oid"), F.col("d").alias("_od"), "lyric_id"), "oid")
        .withColumn("score", F.round(F.col("names") + F.when(near, wd).otherwise(0.0), 6))
        .filter(F.col("score") >= K.MATCH_MANUAL)
        .groupBy("id", "d").agg(best.alias("_b"))
    )
    keyed = tracks.select("track_id", "artist_key", "title_key", F.coalesce("duration_sec", F.lit(-1)).alias("d"))
    return keyed.join(mine, ["artist_key", "title_key"]).join(chosen, ["id", "d"], "left").select(
        "track_id", "_b.lyric_id", "_b.score", F.coalesce(match_verdict(F.col("_b.score")), F.lit("reject")).alias("verdict")
    )


def match_verdict(score: Column) -> Column:
    return (
        F.when(score >= K.MATCH_ACCEPT, "accept").when(score >= K.MATCH_MANUAL, "manual").otherwise("reject")
    )


def match_ladder(tracks: DataFrame, catalog: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Stage and catalog row per track.

    Stages: text given by the user, all fields equal, title and artist equal, scored, none. Only
    what the equal-key stages leave open is scored. An instrumental match ends as ``no_lyrics``.
    """
    def rows(keys: list[str], name: str) -> DataFrame:
        return catalog.groupBy(*keys).agg(F.min("lyric_id").alias(name))

    names, fields = ["artist_key", "title_key"], ["artist_key", "title_key", "album", "duration_sec"]
    looked = tracks.join(rows(fields, "_full"), fields, "left").join(rows(names, "_named"), names, "left")
    given = F.lit(False)
    if manual is not None:
        marks = manual.select("track_id").distinct().withColumn("_given", F.lit(True))
        looked = looked.join(marks, "track_id", "left")
        given = F.coalesce("_given", F.lit(False))
    stage = (
        F.when(given, "manual").when(F.col("_full").isNotNull(), "exact")
        .when(F.col("_named").isNotNull(), "title_artist")
    )
    looked = looked.withColumn("_stage", stage)
    scored = score_matches(looked.filter(F.col("_stage").isNull()), catalog).filter(
        F.col("verdict") != "reject"
    ).select(
        "track_id", F.col("lyric_id").alias("_scored"),
        F.when(F.col("verdict") == "accept", "scored").otherwise("scored_manual").alias("_how"),
    )
    found = looked.select("track_id", "_stage", "_full", "_named").join(scored, "track_id", "left").select(
        "track_id",
        F.when(F.col("_stage") == "exact", F.col("_full")).when(F.col("_stage") == "title_artist", F.col("_named"))
        .when(F.col("_stage").isNull(), F.col("_scored")).alias("lyric_id"),
        F.coalesce("_stage", "_how", F.lit("none")).alias("stage"),
    )
    return found.join(catalog.select("lyric_id", "instrumental"), "lyric_id", "left").select(
        "track_id", "lyric_id", "stage",
        F.when(F.col("stage") == "none", "no_lyrics")
        .when(F.coalesce("instrumental", F.lit(False)), "no_lyrics")
        .when(F.col("stage") == "scored_manual", "review").otherwise("lyrics").alias("outcome"),
    )


def due_for_lookup(tracks: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Tracks to look up: never tried, or missed more than a month ago."""
    settled = cache.filter(
        F.col("hit") | (F.col("checked_at") > F.add_months(now, -1).cast("timestamp_ntz"))
    ).select("artist_key", "title_key")
    return tracks.join(settled, ["artist_key", "title_key"], "left_anti")


@dataclass(frozen=True)
class LanguageModel:
    """``trigrams(trigram, gains)``: per language, what a trigram adds over one never seen, in millionths of a nat."""

    languages: list[str]
    unseen: list[int]
    trigrams: DataFrame


def count_words(texts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, word, n) of ``texts(text, ...)``: words in lower case."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))
    return texts.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def _trigrams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def learn_languages(counts: DataFrame) -> LanguageModel:
    """Character trigrams of the languages, from ``counts(lang, word, n)``; words without a language teach nothing.

    Counts are summed up before words are cut, so a frequent word is cut once per language. Weights are whole numbers, and
    their sums do not depend on the order of the rows. Only the total of each language comes to the driver.
    """
    counted = counts.filter("lang IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = stored(
        counted.select("lang", F.explode(_trigrams(F.col("word"))).alias("trigram"), "n")
        .groupBy("lang", "trigram").agg(F.sum("n").alias("n")), "trigrams")
    different = seen.select("trigram").distinct().count()
    totals = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    gain = lambda lang: F.max(F.when(F.col("lang") == lang, F.round(F.log1p("n") * 1e6).cast("long")))
    gains = F.array(*[F.coalesce(gain(lang), F.lit(0).cast("long")) for lang in languages]).cast("array<long>")
    unseen = [-round(1e6 * math.log(totals[lang] + different)) for lang in languages]
    return LanguageModel(languages, unseen, seen.groupBy("trigram").agg(gains.alias("gains")))


def language_scores(counts: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, language, confidence) of every text of ``counts(doc_id, word, n)``, a table read twice.

    A language's evidence is its mean log-likelihood per trigram, as if ``LANGUAGE_PRIOR`` trigrams of no evidence
    were read first, so short texts stay doubtful; and so do mixed ones, whose parts speak against each other. The
    confidence is the chance of the best language, among all of them, at ``LANGUAGE_SHARPNESS`` times the evidence.
    Every different word is scored once, and each text joins its counted words; of equal languages the last stands.
    """
    if not model.languages:
        return counts.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence")).filter("false")
    places = range(len(model.languages))
    scored = (
        counts.select("word").distinct().select("word", F.explode(_trigrams(F.col("word"))).alias("trigram"))
        .join(model.trigrams, "trigram").groupBy("word")
        .agg(*[F.sum(F.col("gains")[k]).alias(f"_g{k}") for k in places])
    )
    summed = counts.join(scored, "word", "left").groupBy("doc_id").agg(
        F.sum(F.col("n") * F.length("word")).alias("_n"),
        *[F.sum(F.col("n") * F.coalesce(f"_g{k}", F.lit(0))).alias(f"_s{k}") for k in places])
    sharp = K.LANGUAGE_SHARPNESS / 1e6
    evidence = lambda k: (F.col(f"_s{k}") + F.col("_n") * model.unseen[k]) / (F.col("_n") + K.LANGUAGE_PRIOR) * sharp
    each = F.array(*[F.struct(evidence(k).alias("e"), F.lit(model.languages[k]).alias("language")) for k in places])
    held = summed.select("doc_id", each.alias("_each")).withColumn("_best", F.array_max("_each"))
    others = F.aggregate("_each", F.lit(0.0), lambda total, x: total + F.exp(x["e"] - F.col("_best.e")))
    return held.select("doc_id", "_best.language", F.round(1 / others, 6).alias("confidence"))


def language_gate(docs: DataFrame, scores: DataFrame, target: str = "es", min_conf: float = 0.80) -> DataFrame:
    """Accept confident texts of the target language; a doubtful one, or one without letters, goes to review.

    Another language with enough confidence is rejected. ``scores`` are those of ``language_scores``.
    """
    sure = F.col("confidence") >= min_conf
    return docs.select("doc_id").join(scores, "doc_id", "left").select(
        "doc_id", "language", "confidence",
        F.when(sure & (F.col("language") == target), "accept").when(sure, "reject").otherwise("review").alias("route"),
    )


def to_stanzas(docs: DataFrame) -> DataFrame:
    """(track_id, stanza_index, line_index, text): blank lines part stanzas, lines number on.

    ``docs(track_id, text)``.
    """
    stanzas = F.filter(
        F.transform(
            F.split("text", r"\n[ \t]*(?:\n[ \t]*)+"),
            lambda s: F.filter(F.split(s, "\n"), lambda line: F.trim(line) != ""),
        ),
        lambda s: F.size(s) > 0,
    )
    lines = F.flatten(F.transform(stanzas, lambda s, i: F.transform(s, lambda line: F.struct(i.alias("stanza_index"), line.alias("text")))))
    return docs.select("track_id", F.posexplode(lines).alias("line_index", "_l")).select(
        "track_id", "_l.stanza_index", "line_index", "_l.text"
    )


def unique_lines(lines: DataFrame) -> DataFrame:
    """First occurrence of every distinct line of a track, in document order."""
    place = F.struct("stanza_index", "line_index")
    keyed = lines.withColumn("line_key", T.line_key(F.col("text"))).filter(F.col("line_key") != "")
    return (
        keyed.groupBy("track_id", "line_key")
        .agg(F.min_by(F.struct("stanza_index", "line_index", "text"), place).alias("_f"), F.count(F.lit(1)).alias("times"))
        .select("track_id", "_f.*", "line_key", "times")
    )


def mark_repeats(lines: DataFrame) -> DataFrame:
    """(track_id, stanza_index, repeat_of): the first stanza with the same lines, null if itself."""
    stanza = lines.groupBy("track_id", "stanza_index").agg(
        F.md5(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("line_index", T.line_key(F.col("text")).alias("k")))), lambda x: x["k"]
        ), "\n")).alias("_h")
    )
    first = stanza.groupBy("track_id", "_h").agg(F.min("stanza_index").alias("_first"))
    return stanza.join(first, ["track_id", "_h"]).select(
        "track_id", "stanza_index",
        F.when(F.col("_first") < F.col("stanza_index"), F.col("_first")).alias("repeat_of"),
    )


def song_vocabulary(lines: DataFrame) -> DataFrame:
    """(track_id, lemma, n): word counts over the unique lines only."""
    word = F.filter(token_array(F.col("text")), lambda t: F.regexp_like(t, F.lit(r"^\p{L}")))
    return (
        unique_lines(lines).select("track_id", F.explode(word).alias("_w"))
        .groupBy("track_id", F.lower("_w").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))
    )


def dense_tracks(unknown: DataFrame, cap: int = K.MAX_CARDS_PER_SESSION) -> DataFrame:
    """Tracks by number of words to study, ``dense`` when one sitting cannot hold them."""
    return unknown.groupBy("track_id").agg(F.count(F.lit(1)).alias("unknown")).withColumn(
        "dense", F.col("unknown") > cap
    )


def song_coverage(vocab: DataFrame, known: DataFrame, warn: float = K.SONG_COVERAGE_WARN) -> DataFrame:
    """Share of word tokens known per track; ``known(lemma)``."""
    listed = known.select("lemma").distinct().withColumn("_k", F.lit(True))
    sums = vocab.join(listed, "lemma", "left").groupBy("track_id").agg(
        F.sum(F.when(F.col("_k"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("t")
    )
    ratio = F.round(F.coalesce(F.try_divide("c", "t"), F.lit(1.0)), 6)
    return sums.select("track_id", ratio.alias("coverage"), (ratio < warn).alias("warn"))


def render_variety(senses: DataFrame, home: str = K.HOME_DIALECT) -> tuple[DataFrame, DataFrame]:
    """(card backs, violations): badge and home word only for foreign varieties.

    A home equivalent on a general or home sense is a violation row.
    """
    plain = F.col("variety").isin("general", home)
    country = F.substring_index("variety", "-", -1)
    badge = F.when(~plain, F.concat_ws(" · ", country, "register"))
    equivalent = F.when(~plain & F.col("home_equivalent").isNotNull(),
                        F.concat(F.lit(home.split("-")[-1] + ": "), F.col("home_equivalent")))
    cards = senses.select(
        "lemma", "pos", F.concat_ws("\n", "gloss_de", "gloss_en").alias("gloss"),
        badge.alias("badge"), equivalent.alias("home_note"), (~plain).alias("recognition_only"),
    )
    wrong = senses.filter(plain & F.col("home_equivalent").isNotNull()).select(
        "lemma", "pos", "variety", "home_equivalent"
    )
    return cards, wrong


def match_probe(matches: DataFrame) -> DataFrame:
    """Tracks per stage with their share, and the total row."""
    counts = matches.rollup("stage").agg(F.count(F.lit(1)).alias("n"))
    total = matches.agg(F.count(F.lit(1))).scalar()
    return counts.select(
        F.coalesce("stage", F.lit("ALL")).alias("stage"), "n", F.round(F.col("n") / total, 6).alias("share")
    )


def overtag_rate(senses: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of known-general lemmas that were tagged with a region."""
    tagged = senses.join(gold.select("lemma").distinct(), "lemma", "left_semi").groupBy("lemma").agg(
        F.max(F.col("variety") != "general").alias("tagged")
    )
    return tagged.agg(
        F.count(F.lit(1)).alias("general_lemmas"), F.count_if("tagged").alias("overtagged"),
        F.round(F.avg(F.col("tagged").cast("double")), 6).alias("rate"),
    )


def distinct_senses(words: DataFrame) -> DataFrame:
    """One card per (lemma, pos) over all tracks: how many tracks, uses and the first track."""
    per_track = words.groupBy("lemma", "pos", "track_id").agg(F.sum("n").alias("n"))
    return per_track.groupBy("lemma", "pos").agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("uses"), F.min("track_id").alias("first_track")
    )


def expand_elisions(tokens: DataFrame, elisions: DataFrame) -> DataFrame:
    """Written form and flag for shortened words; ``elisions(form, full)``."""
    table = elisions.select(F.col("form").alias("_form"), F.col("full").alias("_full"))
    return tokens.join(table, F.lower("s") == F.col("_form"), "left").select(
        *tokens.columns, F.coalesce("_full", F.lower("s")).alias("normalised"),
        F.col("_full").isNotNull().alias("is_elided"),
    )


SENSE_TYPE = (
    "lemma string, pos string, glossDe string, glossEn string, variety string, register string, "
    "homeEquivalent string, homeEquivalentNote string, morphNote string, confidence double, "
    "_corrupt string"
)


def parse_senses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed senses, rejected rows) from ``raw(id, response)``: strict JSON, nothing repaired."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.withColumn("s", F.from_json(F.trim("response"), SENSE_TYPE, options))
    s = F.col("s")
    required = ("lemma", "pos", "glossDe", "glossEn", "variety", "register")
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(s[f]), F.lit("")) == "", F.lit(f)) for f in required])), ",")
    reason = (
        F.when(s.isNull() | s["_corrupt"].isNotNull() | ~F.startswith(F.trim("response"), F.lit("{")), "not JSON")
        .when(missing != "", F.concat(F.lit("missing "), missing))
        .when(~s["variety"].isin(*K.VARIETIES), "unknown variety")
        .when(~s["register"].isin(*K.REGISTERS), "unknown register")
    )
    judged = parsed.withColumn("reason", reason)
    ok = judged.filter(F.col("reason").isNull()).select(
        "id", s["lemma"].alias("lemma"), s["pos"].alias("pos"), s["glossDe"].alias("gloss_de"),
        s["glossEn"].alias("gloss_en"), s["variety"].alias("variety"), s["register"].alias("register"),
        s["homeEquivalent"].alias("home_equivalent"), s["morphNote"].alias("morph_note"),
        s["confidence"].alias("confidence"),
    )
    return ok, judged.filter(F.col("reason").isNotNull()).select("id", "reason")
