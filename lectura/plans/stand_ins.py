"""The engine's input tables derived from the driver's tables.

A document is a chapter, its source the book, a line a paragraph. Events are answers, marks,
readings and plays. Every table here grows with the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.operators import tokens as T
from lectura.operators import vocab as V
from lectura.operators.book_words import book_entries
from lectura.session import deal, literal_table, parts_of_texts, spread, stored

RANKED_LEMMAS = 100
GRADE_OF = {"error": "again", "view": "hard", "click": "good", "purchase": "easy"}
ACTION_OF = {"error": "again", "view": "weiter", "click": "good", "purchase": "easy", "signup": "ichKenneDas"}
NOW = "2024-01-25 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def mapped(column: str, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for p in names.items() for v in p]), F.col(column))


# --- texts -------------------------------------------------------------------------------------

def forms(spark: SparkSession) -> DataFrame:
    rows = [(w, w, pos) for pos, ws in K.CLOSED_CLASS_FORMS.items() for w in ws.split()]
    return literal_table(spark, rows, "form, lemma, pos")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"),
        F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"),
    ).filter(F.col("text") != "")


def chapter_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``paragraphs``, dealt out by chapter once as texts, so that nothing made per chapter is shuffled as words."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), "text")
    return deal(docs, ("book_id", "chapter_index"), parts_of_texts(docs)).select(
        "book_id", "chapter_index", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"),
    ).filter(F.col("text") != "")


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.annotate(T.words(paragraphs(spark, sf_dir)), forms(spark))


def full_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens, annotated, before keys."""
    return T.annotate(T.mark_first_words(T.tokenize(chapter_paragraphs(spark, sf_dir))), forms(spark))


def counts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts for a plan that reads them once."""
    return V.count_forms(T.words(chapter_paragraphs(spark, sf_dir)), forms(spark))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, stored: the hub of every plan that uses them more than once."""
    return stored(counts_once(spark, sf_dir), "counts")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter facts that need no tokens."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.size(F.split("text", "\n")).alias("paragraph_count"),
    )


def chapter_totals(counted: DataFrame) -> DataFrame:
    return V.chapter_totals(counted)


def regional(lemma: Column) -> Column:
    return (F.ascii(lemma) + F.length(lemma)) % 7 == 0


def gloss_table(lexicon: DataFrame) -> DataFrame:
    """Glosses per (lemma, pos): some empty, some missing, with their sources."""
    length = F.length("lemma")
    return lexicon.select("lemma", "pos").distinct().filter(length > 1).select(
        "lemma", "pos",
        F.when(length % 5 == 0, "").otherwise(F.concat(F.lit("de:"), "lemma")).alias("de"),
        F.when(length % 3 == 0, "").otherwise(F.concat(F.lit("en:"), "lemma")).alias("en"),
        F.when(regional(F.col("lemma")), F.concat(F.lit("note "), "lemma")).otherwise("").alias("region_note"),
        regional(F.col("lemma")).alias("mexicanism"),
        F.when(length % 5 == 0, F.lit(None).cast("string"))
        .when(length % 2 == 0, "model").otherwise("dictionary").alias("de_source"),
        F.when(length % 3 == 0, F.lit(None).cast("string"))
        .when(length % 2 == 0, "dictionary").otherwise("model").alias("en_source"),
    )


def with_gloss_columns(lexicon: DataFrame) -> DataFrame:
    """The same glosses as columns, where the join itself is not the point."""
    length, known = F.length("lemma"), F.length("lemma") > 1
    text = lambda cond, prefix: F.when(known & cond, F.concat(F.lit(prefix), "lemma"))
    flag = known & regional(F.col("lemma"))
    return lexicon.select(
        "*",
        text(length % 5 != 0, "de:").alias("de"), text(length % 3 != 0, "en:").alias("en"),
        text(regional(F.col("lemma")), "note ").alias("region_note"), flag.alias("mexicanism"),
        F.when(known & (length % 5 != 0), F.when(length % 2 == 0, "model").otherwise("dictionary")).alias("de_source"),
        F.when(known & (length % 3 != 0), F.when(length % 2 == 0, "dictionary").otherwise("model")).alias("en_source"),
        text(length % 4 == 0, "example of ").alias("example"),
    )


def listed_forms() -> dict[str, tuple[str, str]]:
    """``forms`` as a dictionary, for steps in Python."""
    return {w: (w, pos) for pos, ws in K.CLOSED_CLASS_FORMS.items() for w in ws.split()}


def gloss_of(lemma: str) -> dict[str, str | bool | None]:
    """The columns of ``with_gloss_columns`` that a bundle holds, of one lemma."""
    n = len(lemma)
    regional_ = n > 1 and (ord(lemma[0]) + n) % 7 == 0
    text = lambda cond, prefix: prefix + lemma if n > 1 and cond else None
    return {"de": text(n % 5, "de:"), "en": text(n % 3, "en:"), "regionNote": text(regional_, "note "), "mexicanism": regional_,
            "example": text(n % 4 == 0, "example of ")}


def shelf(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with their chapters and glosses, uses of every lemma), for plans that ask no more of ``zipf`` than whether
    it reaches the threshold: it is 0.0 below, as the few lemmas above are all that is joined to the entries."""
    return _with_threshold(V.entries(counted))


def plain_shelf(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``shelf`` without keys, and with the number of ``chapters`` in place of the chapters."""
    entries = counted.filter(F.col("pos") != "PROPN").groupBy("book_id", "lemma", "pos").agg(
        F.sum("n").alias("book_count"), F.min("chapter_index").alias("first_chapter"), F.count(F.lit(1)).alias("chapters"))
    return _with_threshold(stored(entries, "entries"))


def whole_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, lemma, pos, book_count, first_chapter, chapters), names too, stored: the hub of plans that need no chapters."""
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), "text")
    return stored(book_entries(texts, listed_forms(), parts_of_texts(texts)), "books")


def book_shelf(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``plain_shelf`` from ``whole_books``."""
    return _with_threshold(books.filter(F.col("pos") != "PROPN"))


def keyed_shelf(books: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``book_shelf`` with keys; ``exact`` gives every entry its own ``zipf``."""
    return _with_threshold(V.with_keys(books.filter(F.col("pos") != "PROPN")), exact)


def place_shelf(counted: DataFrame) -> DataFrame:
    """``plain_shelf`` with ``lemma|pos`` for key and the chapters of every entry, for plans that ask for words per chapter."""
    entries = V.places(counted).withColumn("key", F.concat_ws("|", "lemma", "pos"))
    return _with_threshold(stored(entries, "entries"))[0]


def with_threshold(entries: DataFrame) -> DataFrame:
    """The entries of ``shelf`` from a lexicon with keys."""
    return _with_threshold(entries)[0]


def _with_threshold(entries: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    uses = stored(V.lemma_uses(entries), "uses")
    found = V.zipf_of_uses(uses)
    if not exact:
        found = stored(found.filter(F.round("zipf", 2) >= K.ZIPF_THRESHOLD), "frequent")
    return with_gloss_columns(V.with_zipf(entries, found)), uses


def unkeyed_lexicon(counted: DataFrame) -> DataFrame:
    """As ``lexicon`` with ``lemma|pos`` for key, where the book-scoped number does not matter."""
    keyed = V.lexicon_counts(counted).withColumn("key", F.concat_ws("|", "lemma", "pos"))
    return with_gloss_columns(V.with_zipf(keyed))


# --- events ------------------------------------------------------------------------------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def word_of_rank(counted: DataFrame) -> DataFrame:
    """(k, lemma_id): the word an event's number stands for, by frequency."""
    return ranked_words(V.lemma_uses(V.lexicon_counts(counted)))


def ranked_words(uses: DataFrame) -> DataFrame:
    ranked = V.most_used(uses, RANKED_LEMMAS)
    return ranked.select(F.col("rank").alias("k"), F.col("lemma").alias("lemma_id"))


def named_events(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    found = events(spark, sf_dir)
    if words is None:
        return found.withColumn("lemma_id", F.concat(F.lit("k"), F.col("k").cast("string")))
    return found.join(words, "k")


def reviews(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    return named_events(spark, sf_dir, words).filter(F.col("event_type") != "signup").select(
        "user_id", "lemma_id", "ts", F.col("event_id").alias("seq"), mapped("event_type", GRADE_OF).alias("grade")
    )


def known_lemmas(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    source = F.when(F.col("value") < 10, "seed").when(F.col("value") < 30, "manual")
    marks = named_events(spark, sf_dir, words).filter(F.col("event_type") == "signup").select(
        "user_id", "lemma_id", "ts", "event_id", source.alias("source")
    )
    return marks.groupBy("user_id", "lemma_id").agg(
        F.max_by(F.struct(F.col("ts").alias("marked_at"), "source"), "event_id").alias("_m")
    ).select("user_id", "lemma_id", "_m.marked_at", "_m.source")


def cards(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Card states straight from event aggregates; ``replay_reviews`` gives the folded ones."""
    answered = named_events(spark, sf_dir, words).filter(F.col("event_type") != "signup")
    grouped = answered.groupBy("user_id", "lemma_id").agg(
        F.count(F.lit(1)).cast("int").alias("reps"),
        F.count_if(F.col("event_type") == "error").cast("int").alias("lapses"),
        F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("stability"),
        F.max_by(F.col("event_type") == "error", "event_id").alias("_failed"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_review"),
    )
    state = (
        F.when((F.col("reps") == 1) & (F.col("stability") < 5), 0).when(F.col("reps") == 1, 1)
        .when(F.col("_failed"), 3).otherwise(2)
    )
    days = F.floor(F.col("stability") / 10).cast("int")
    fsrs = F.struct(
        (F.col("last_review") + F.make_dt_interval(days)).alias("due"), "stability", F.lit(5.0).alias("difficulty"),
        F.lit(0).alias("elapsed_days"), days.alias("scheduled_days"), F.lit(0).alias("learning_steps"),
        "reps", "lapses", state.alias("state"), "last_review",
    )
    length = F.length("lemma_id")
    text = lambda cond, prefix: F.when(cond, F.concat(F.lit(prefix), "lemma_id"))
    face = F.struct(
        F.lit("NOUN").alias("pos"), text(length % 3 != 0, "de\t").alias("de"), text(length % 2 == 0, "en ").alias("en"),
        text(F.col("reps") > 1, "line one\nof ").alias("example"), text(F.col("lapses") > 1, "note ").alias("region_note"),
        (F.col("lapses") > 1).alias("mexicanism"),
    )
    return grouped.select(
        "user_id", "lemma_id", "created_at", fsrs.alias("fsrs"),
        F.when(F.col("stability") > 3, face).alias("face"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who opened which chapter: every ten event numbers belong to one document."""
    opened = events(spark, sf_dir).filter(F.col("event_type") == "view").select(
        "user_id", F.floor(F.col("event_id") / 10).alias("chapter_index"), "ts", "event_id", "k"
    )
    return opened.join(chapters(spark, sf_dir), "chapter_index")


def open_chapters(spark: SparkSession, sf_dir: str, counted: DataFrame) -> DataFrame:
    """(user_id, book_id, chapter_index, token_count, propn_tokens)."""
    pairs = readings(spark, sf_dir).select("user_id", "book_id", "chapter_index").distinct()
    return pairs.join(V.chapter_totals(counted), ["book_id", "chapter_index"]).select(
        "user_id", "book_id", "chapter_index", "token_count", "propn_tokens"
    )


def listed_chapters(spark: SparkSession, sf_dir: str, counted: DataFrame) -> DataFrame:
    """All chapters of the books in which a reader has opened one; chapters without words have no tokens."""
    pairs = readings(spark, sf_dir).select("user_id", "book_id").distinct()
    zero = F.lit(0).cast("long")
    return (
        pairs.join(chapters(spark, sf_dir).select("book_id", "chapter_index"), "book_id")
        .join(V.chapter_totals(counted), ["book_id", "chapter_index"], "left")
        .select("user_id", "book_id", "chapter_index", F.coalesce("token_count", zero).alias("token_count"), F.coalesce("propn_tokens", zero).alias("propn_tokens"))
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of reading positions."""
    from lectura.operators.logs import reading_fraction

    return readings(spark, sf_dir).select(
        F.col("event_id").alias("id"), "user_id", "book_id", "chapter_index",
        F.concat(F.lit("c"), F.col("chapter_index").cast("string"), F.lit("p"), F.col("k").cast("string")).alias("paragraph_id"),
        reading_fraction(F.col("k"), F.col("paragraph_count")).alias("fraction"), F.col("ts").alias("updated_at"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("book_id")).agg(
        F.concat(F.lit("Book "), F.first("source")).alias("title"),
        F.count(F.lit(1)).cast("int").alias("chapter_count"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.sum("n_chars") % 86400)).alias("imported_at"),
    )


# --- pages -------------------------------------------------------------------------------------

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, doc_ord, doc_name, media_type, item_type, html): the host is the book."""
    url = F.col("url")
    path = F.regexp_extract(url, r"^https?://[^/]+/([a-z]+)/([0-9]+)", 1)
    number = F.regexp_extract(url, r"^https?://[^/]+/([a-z]+)/([0-9]+)", 2)
    secure, mobile = F.startswith(url, F.lit("https:")), F.contains(url, F.lit("://m."))
    return spread(table(spark, sf_dir, "pages")).select(
        F.regexp_extract(url, "^https?://([^/]+)", 1).alias("book_id"), F.col("page_id").alias("doc_ord"),
        F.concat(path, F.lit("-"), number, F.lit(".xhtml")).alias("doc_name"),
        F.when(mobile, "application/x-dtbncx+xml").when(secure, "application/xhtml+xml").otherwise("text/html").alias("media_type"),
        F.when(F.contains(url, F.lit("#top")), "nav").when(secure, "document").otherwise("unknown").alias("item_type"),
        "html",
    )


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents entries from the links of each page; the first is aimed at the page itself."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    return pages(spark, sf_dir).select(
        "book_id", "doc_ord", "doc_name", F.posexplode(links).alias("i", "link")
    ).select(
        "book_id", (F.col("doc_ord") * 1000 + F.col("i")).alias("ord"),
        F.when(F.col("i") == 0, F.concat(F.lit("text/"), "doc_name"))
        .when(F.col("i") == 1, F.concat("doc_name", F.lit("#"), F.substring("link", F.lit(2), F.length("link"))))
        .otherwise(F.col("link")).alias("href"),
        F.concat(F.lit("  "), F.substring("link", F.lit(2), F.length("link")), F.lit(" ")).alias("title"),
    )


# --- songs -------------------------------------------------------------------------------------

def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays: the number names the song, clicks carry an external id."""
    return events(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("seq"),
        F.concat(F.lit("Ártist "), (F.col("k") % 7).cast("string")).alias("artist"),
        F.concat(F.lit("Canción "), F.col("k").cast("string"),
                 F.when(F.col("event_type") == "view", " (Remastered)").when(F.col("event_type") == "purchase", " feat. X").otherwise("")).alias("title"),
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("mb"), F.col("k").cast("string"))).alias("mbid"),
        F.when(F.col("value") < 60, F.col("ts")).alias("ts"), (F.col("value") >= 60).alias("now_playing"),
    )


def lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lyrics: a turn is a stanza, its lines the lines."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("track_id"), F.col("turn").alias("stanza_index"),
        F.posexplode(F.split("text", "\n")).alias("line_index", "text"),
    ).filter(F.trim("text") != "")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks, spelt as players report them: with qualifiers, and some with a slip in the title or the artist."""
    from lectura.operators.songs import with_match_keys

    part, slip = table(spark, sf_dir, "part"), F.col("p_partkey") % 9
    name, brand = F.initcap("p_name"), F.col("p_brand")
    name = F.when(slip == 2, F.substring(name, F.lit(1), F.length(name) - 1)).when(slip == 4, F.concat(name, F.lit("x"))).when(
        slip == 6, F.concat(F.substring(name, F.lit(1), F.length(name) - 2), F.lit("o"), F.substring(name, -1, 1))).otherwise(name)
    brand = F.when(slip.isin(4, 7), F.replace(brand, F.lit("ran"), F.lit("rn"))).otherwise(brand)
    return with_match_keys(part.select(
        F.col("p_partkey").alias("track_id"), brand.alias("artist"),
        F.concat(name, F.when(F.col("p_type") == "SMALL", " (Live)").when(F.col("p_type") == "ECONOMY", " - Remastered").otherwise("")).alias("title"),
        F.col("p_type").alias("album"), (F.col("p_size") + 180).alias("duration_sec"),
    ))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lyrics catalog: other spellings, some titles longer, some instrumental."""
    from lectura.operators.songs import with_match_keys

    part = table(spark, sf_dir, "part")
    return with_match_keys(part.filter(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("lyric_id"), F.upper("p_brand").alias("artist"),
        F.concat("p_name", F.when(F.col("p_retailprice") % 3 >= 2, " blues").otherwise("")).alias("title"),
        F.col("p_type").alias("album"), (F.col("p_size") + 179).alias("duration_sec"), (F.col("p_size") == 50).alias("instrumental"),
    ))
