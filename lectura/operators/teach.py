"""Which words to study next, and in what sittings.

``vocab([user_id,] book_id, chapter_index, key, n)``: with ``user_id`` the rows are what each
reader has open; the same plan answers one chapter or all chapters of all readers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions.text import lemma_id, let
from lectura.operators.known import reader_state
from lectura.operators.srs import FACE_TYPE, new_cards
from lectura.session import deal

OPEN_CHAPTER = ("user_id", "book_id", "chapter_index")


@dataclass(frozen=True)
class TeachOptions:
    min_book_count: int = K.MIN_BOOK_COUNT
    zipf_threshold: float = K.ZIPF_THRESHOLD
    regional_min_book_count: int = K.REGIONAL_MIN_BOOK_COUNT
    excluded_pos: tuple[str, ...] = field(default=K.CLOSED_CLASS_POS)


DEFAULTS = TeachOptions()


def teach_reason(opts: TeachOptions = DEFAULTS) -> Column:
    """First matching rule of a teachable entry, else null."""
    excluded = F.col("pos").isin("PROPN", *opts.excluded_pos)
    return (
        F.when(excluded, F.lit(None).cast("string"))
        .when(F.col("book_count") >= opts.min_book_count, "bookCount")
        .when(F.col("zipf") >= opts.zipf_threshold, "zipf")
        .when(F.col("mexicanism") & (F.col("book_count") >= opts.regional_min_book_count), "mexicanism")
    )


def is_teachable(opts: TeachOptions = DEFAULTS) -> Column:
    return teach_reason(opts).isNotNull()


def classify_all(lexicon: DataFrame, known: DataFrame, opts: TeachOptions = DEFAULTS) -> DataFrame:
    """Class and reason of every entry against one list of known lemmas ``known(lemma_id)``."""
    listed = known.select("lemma_id").distinct().withColumn("_known", F.lit(True))
    reason = teach_reason(opts)
    class_ = (
        F.when(F.col("_known"), "ALREADY_KNOWN")
        .when(F.col("pos").isin(*opts.excluded_pos), "SKIPPED_CLOSED_CLASS")
        .when(reason.isNotNull(), "TEACH")
        .otherwise("GLOSS_ONLY")
    )
    return (
        lexicon.filter(F.col("pos") != "PROPN")
        .withColumn("lemma_id", lemma_id(F.col("lemma")))
        .join(listed, "lemma_id", "left")
        .withColumn("class", class_)
        .withColumn("reason", F.when(F.col("class") == "TEACH", reason))
        .drop("_known")
    )


def assign_to_chapters(classes: DataFrame) -> DataFrame:
    """Baked lists: every taught or gloss-only key under its first chapter.

    ``teach`` is ordered by use, ``gloss_only`` by key. A chapter's vocabulary bounds both.
    """
    taught = F.when(F.col("class") == "TEACH", F.struct((-F.col("book_count")).alias("c"), "key"))
    gloss = F.when(F.col("class") == "GLOSS_ONLY", F.col("key"))
    return classes.groupBy("book_id", F.col("first_chapter").alias("chapter_index")).agg(
        F.transform(F.array_sort(F.collect_list(taught)), lambda x: x["key"]).alias("teach_set"),
        F.array_sort(F.collect_list(gloss)).alias("gloss_only"),
    )


def classify_vocabulary(
    vocab: DataFrame, lexicon: DataFrame, known: DataFrame, carded: DataFrame,
    opts: TeachOptions = DEFAULTS,
) -> DataFrame:
    """Every (reader, chapter, key) with ``is_known``, ``is_carded`` and its ``part``.

    ``part``: ``teach``, ``gloss_only`` or null (known, or teachable and already carded). Keys
    without entry and names drop out. One join on (reader, word) serves both state tests.
    """
    entries = lexicon.select(
        "book_id", "key", lemma_id(F.col("lemma")).alias("lemma_id"), "pos", "book_count",
        is_teachable(opts).alias("teachable"),
    ).filter(F.col("pos") != "PROPN")
    flagged = (
        vocab.join(entries, ["book_id", "key"])
        .join(reader_state(known, carded), ["user_id", "lemma_id"], "left")
        .withColumn("is_known", F.coalesce("is_known", F.lit(False)))
        .withColumn("is_carded", F.coalesce("is_carded", F.lit(False)))
    )
    return flagged.withColumn("part", _part())


def _part() -> Column:
    return (
        F.when(F.col("is_known"), F.lit(None).cast("string"))
        .when(~F.col("teachable"), "gloss_only")
        .when(~F.col("is_carded"), "teach")
    )


def classify_opened(words: DataFrame, opened: DataFrame, known: DataFrame, carded: DataFrame, empty: bool = False) -> DataFrame:
    """As ``classify_vocabulary``, from ``words(book_id, chapter_index, key, lemma_id, pos, teachable, …)`` without names and
    ``opened(user_id, book_id, chapter_index)``; with ``empty`` an opened chapter without words has one row without key.

    What a reader knows comes to the chapters the reader opened, as lists, and not the words of all opened chapters to
    the readers: the words are shuffled once, by chapter, and everything made per reader and chapter follows there.
    """
    lists = reader_state(known, carded).groupBy("user_id").agg(
        *[F.collect_list(F.when(F.col(f"is_{c}"), F.col("lemma_id"))).alias(f"_{c}") for c in ("known", "carded")])
    readers = opened.select(*OPEN_CHAPTER).join(lists, "user_id", "left")
    listed = lambda c: F.coalesce(F.array_contains(f"_{c}", F.col("lemma_id")), F.lit(False)).alias(f"is_{c}")
    chapter = ["book_id", "chapter_index"]
    rows = words.repartition(*chapter).join(readers, chapter, "right" if empty else "inner")
    return rows.select("user_id", *words.columns, listed("known"), listed("carded")).withColumn(
        "part", F.when(F.col("key").isNotNull(), _part()))


def opened_sets(
    words: DataFrame, opened: DataFrame, known: DataFrame, carded: DataFrame, sets: dict[str, Column], empty: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """One row per reader and opened chapter: the arrays ``sets`` of the chapter's words, and what the reader knows.

    Each value of ``sets`` is a struct with ``lemma_id``, or null for a word outside that set. Sets are gathered and sorted
    once per chapter, so that a reader's rows are cut out of arrays (``unless_in``) and never sorted or shuffled.
    ``parts`` as in ``session.deal``.
    """
    chapter = ["book_id", "chapter_index"]
    rows = deal(words, chapter, parts).groupBy(*chapter).agg(
        *[F.array_sort(F.collect_list(word)).alias(name) for name, word in sets.items()])
    return _with_readers(rows, opened, known, carded, empty)


def _with_readers(chapters: DataFrame, opened: DataFrame, known: DataFrame, carded: DataFrame, empty: bool) -> DataFrame:
    """Rows per chapter, for each reader who opened it, with the lists ``_known``, ``_carded`` and ``_state`` (either)."""
    of = lambda c: F.collect_list(F.when(F.col(c), F.col("lemma_id")))
    lists = reader_state(known, carded).groupBy("user_id").agg(
        of("is_known").alias("_known"), of("is_carded").alias("_carded"), F.collect_list("lemma_id").alias("_state"))
    readers = opened.select(*OPEN_CHAPTER).join(lists, "user_id", "left")
    return chapters.join(readers, ["book_id", "chapter_index"], "right" if empty else "inner")


def unless_in(words: Column, listed: str) -> Column:
    """The words of an array whose lemma is not in the reader's list; a missing list holds nothing."""
    return F.when(F.col(listed).isNull(), words).otherwise(F.filter(words, lambda w: ~F.array_contains(F.col(listed), w["lemma_id"])))


def select_opened(words: DataFrame, opened: DataFrame, known: DataFrame, carded: DataFrame, parts: int | None = None) -> DataFrame:
    """``select_teach_set`` of opened chapters, from the words and states of ``classify_opened``."""
    word = lambda use: F.struct(use.alias("use"), "key", "lemma_id", "book_count")
    found = opened_sets(words, opened, known, carded, {
        "_teach": F.when(F.col("teachable"), word(-F.col("book_count"))),
        "_gloss": F.when(~F.col("teachable"), word(F.lit(0).cast("long"))),
    }, parts=parts)
    part = lambda name, kept: F.struct(F.lit(name).alias("part"), kept.alias("words"))
    parts = F.array(part("teach", unless_in(F.col("_teach"), "_state")), part("gloss_only", unless_in(F.col("_gloss"), "_known")))
    return found.select(*OPEN_CHAPTER, F.explode(parts).alias("_p")).select(
        *OPEN_CHAPTER, "_p.part", F.posexplode("_p.words").alias("ord", "_w")
    ).select(*OPEN_CHAPTER, "part", "_w.key", "_w.lemma_id", "_w.book_count", "ord")


def drift_of_opened(words: DataFrame, opened: DataFrame, known: DataFrame, carded: DataFrame, baked: Column, parts: int | None = None) -> DataFrame:
    """``drift_of`` the opened chapters; a baked word is teachable."""
    fixed = F.coalesce(baked, F.lit(False)).alias("fixed")
    found = opened_sets(words, opened, known, carded, {
        "_teach": F.when(F.col("teachable"), F.struct("lemma_id", fixed)), "_gloss": F.when(~F.col("teachable"), F.struct("lemma_id")),
    }, parts=parts).select(
        *OPEN_CHAPTER, F.size(F.filter("_teach", lambda w: w["fixed"])).cast("long").alias("_baked"),
        unless_in(F.col("_teach"), "_state").alias("_live"), F.size(unless_in(F.col("_gloss"), "_known")).alias("_rest"))
    sums = found.withColumn("both", F.size(F.filter("_live", lambda w: w["fixed"])).cast("long")).select(
        *OPEN_CHAPTER, (F.size("_live") - F.col("both")).alias("only_live"), (F.col("_baked") - F.col("both")).alias("only_baked"),
        "both", (F.size("_live") + F.col("_rest")).alias("_listed"))
    return sums.filter((F.col("_listed") > 0) & (F.col("only_live") + F.col("only_baked") + F.col("both") > 0)).drop("_listed")


CHAPTERS_TOGETHER = 64


def last_offered(words: DataFrame, opened: DataFrame, carded: DataFrame, about: Sequence[str], parts: int | None = None) -> DataFrame:
    """(user_id, lemma_id, book_id, key, …): of the words of opened chapters that a reader has no card for, the entry with
    the largest (book_id, key) of every lemma, with its columns ``about``.

    Words go to their reader as arrays, a chapter at a time. The words of a reader of many chapters are cut by lemma, so
    that a group holds about as many as ``CHAPTERS_TOGETHER`` chapters do.
    """
    found = opened_sets(words, opened, carded.filter("false"), carded, {"_words": F.struct("lemma_id", "key", *about)}, parts=parts)
    cuts = opened.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / CHAPTERS_TOGETHER).cast("int").alias("_cuts"))
    mine = found.select("user_id", "book_id", unless_in(F.col("_words"), "_carded").alias("_words")).join(cuts, "user_id")
    in_cut = F.filter("_words", lambda w: F.pmod(F.xxhash64(w["lemma_id"]), F.col("_cuts")) == F.col("_cut"))
    dealt = mine.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).select(
        "user_id", "_cut", "book_id", F.when(F.col("_cuts") == 1, F.col("_words")).otherwise(in_cut).alias("_words")
    )
    dealt = deal(dealt, ("user_id", "_cut"), parts)
    word = lambda book: lambda w: F.struct(w["lemma_id"].alias("lemma_id"), book.alias("book_id"), *[w[c].alias(c) for c in ("key", *about)])
    each = dealt.groupBy("user_id", "_cut").agg(F.array_sort(F.flatten(F.collect_list(F.transform("_words", word(F.col("book_id")))))).alias("_all"))
    last = F.filter("_all", lambda w, i: F.coalesce(F.get("_all", i + 1)["lemma_id"] != w["lemma_id"], F.lit(True)))
    return each.select("user_id", F.explode(last).alias("_w")).select("user_id", "_w.*")


def select_teach_set(
    vocab: DataFrame, lexicon: DataFrame, known: DataFrame, carded: DataFrame,
    opts: TeachOptions = DEFAULTS,
) -> DataFrame:
    """Live teach and gloss-only sets, uncapped, with ``ord`` inside each set."""
    return order_teach_set(classify_vocabulary(vocab, lexicon, known, carded, opts))


def order_teach_set(classified: DataFrame) -> DataFrame:
    rows = classified.filter(F.col("part").isNotNull())
    use = F.when(F.col("part") == "teach", -F.col("book_count")).otherwise(F.lit(0))
    order = Window.partitionBy(*OPEN_CHAPTER, "part").orderBy(use, "key")
    return rows.select(
        *OPEN_CHAPTER, "part", "key", "lemma_id", "book_count",
        (F.row_number().over(order) - 1).alias("ord"),
    )


def teach_drift(live: DataFrame, baked: DataFrame) -> DataFrame:
    """Per reader and chapter: keys only live, only baked, and in both.

    ``baked(book_id, chapter_index, key)`` is compared with each reader's own ``live`` rows.
    """
    readers = live.select(*OPEN_CHAPTER).distinct()
    fixed = readers.join(baked, ["book_id", "chapter_index"]).select(
        *OPEN_CHAPTER, "key", F.lit(1).alias("b")
    )
    now = live.filter(F.col("part") == "teach").select(*OPEN_CHAPTER, "key", F.lit(1).alias("l"))
    return now.join(fixed, [*OPEN_CHAPTER, "key"], "full_outer").groupBy(*OPEN_CHAPTER).agg(
        F.count_if(F.col("b").isNull()).alias("only_live"),
        F.count_if(F.col("l").isNull()).alias("only_baked"),
        F.count_if(F.col("b").isNotNull() & F.col("l").isNotNull()).alias("both"),
    )


def drift_of(classified: DataFrame, baked: Column) -> DataFrame:
    """As ``teach_drift``, from ``classify_opened`` rows; ``baked`` says whether the chapter's baked list has the key.

    A baked key stands under the first chapter that holds it, so it is among the words of its chapter.
    """
    live, fixed = F.coalesce(F.col("part") == "teach", F.lit(False)), F.coalesce(baked, F.lit(False))
    sums = classified.groupBy(*OPEN_CHAPTER).agg(
        F.count_if(live & ~fixed).alias("only_live"), F.count_if(fixed & ~live).alias("only_baked"),
        F.count_if(live & fixed).alias("both"), F.count("part").alias("_listed"),
    )
    return sums.filter((F.col("_listed") > 0) & (F.col("only_live") + F.col("only_baked") + F.col("both") > 0)).drop("_listed")


def sessions_remaining(cards: Column, cap: int = K.MAX_CARDS_PER_SESSION) -> Column:
    return F.ceil(cards / F.lit(cap)).cast("int")


_CARD = "struct<use:bigint,key:string,lemma_id:string>"
_SEGMENT = f"struct<first:int,last:int,cards:array<{_CARD}>>"


def split_segments(
    teach: DataFrame, first_seen: DataFrame, chapters: DataFrame,
    cap: int = K.MAX_CARDS_PER_SESSION, opened: DataFrame | None = None,
) -> DataFrame:
    """Cut each reader's teach set of a chapter into sittings of at most ``cap`` cards.

    ``teach`` from ``select_teach_set``; ``first_seen`` from ``vocab.debuts``;
    ``chapters(book_id, chapter_index, paragraph_count)``. A greedy pack in reading order that
    never cuts a paragraph: one row per (reader, chapter, segment) with its ordered cards. A chapter of
    ``opened`` with nothing to teach is one segment without cards. Keys no
    token carries go to the last segment, which they may fill but not stretch. The cards of one
    chapter are the unit of work, so one shuffle on the chapter serves both groupings.
    """
    cards = teach.filter(F.col("part") == "teach").join(
        first_seen, ["book_id", "chapter_index", "key"], "left"
    )
    card = F.struct((-F.col("book_count")).alias("use"), "key", "lemma_id").cast(_CARD)
    by_paragraph = (
        cards.repartition(*OPEN_CHAPTER)
        .groupBy(*OPEN_CHAPTER, "debut")
        .agg(F.array_sort(F.collect_list(card)).alias("cards"))
    )
    packed = _steps(by_paragraph)
    if opened is not None:
        packed = opened.select(*OPEN_CHAPTER).join(packed, list(OPEN_CHAPTER), "left")
    kinds = dict(packed.dtypes)
    packed = packed.select(*OPEN_CHAPTER, *[
        F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("steps", "orphans")
    ])
    return _cut(packed, chapters, cap)


def _steps(by_paragraph: DataFrame, keys: Sequence[str] = OPEN_CHAPTER) -> DataFrame:
    return by_paragraph.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("debut").isNotNull(), F.struct("debut", "cards")))
        ).alias("steps"),
        F.flatten(F.collect_list(F.when(F.col("debut").isNull(), F.col("cards")))).alias("orphans"),
    )


def opened_segments(
    words: DataFrame, opened: DataFrame, known: DataFrame, carded: DataFrame, chapters: DataFrame,
    cap: int = K.MAX_CARDS_PER_SESSION, empty: bool = False, parts: int | None = None,
) -> DataFrame:
    """``segments_of`` the opened chapters, from the words and states of ``classify_opened``.

    The steps of a chapter are made once, and each reader's cards are cut out of them. Without ``empty``, chapters with
    nothing to teach have no segments.
    """
    chapter = ["book_id", "chapter_index"]
    card = F.struct((-F.col("book_count")).alias("use"), "key", "lemma_id").cast(_CARD)
    by_paragraph = deal(words.filter("teachable"), chapter, parts).groupBy(*chapter, "debut").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    found = _with_readers(_steps(by_paragraph, chapter), opened, known, carded, empty)
    kinds = dict(found.dtypes)
    some = lambda c: F.coalesce(c, F.array().cast(kinds[c]))
    left = F.transform(some("steps"), lambda s: F.struct(s["debut"].alias("debut"), unless_in(s["cards"], "_state").alias("cards")))
    packed = found.select(
        *OPEN_CHAPTER, F.filter(left, lambda s: F.size(s["cards"]) > 0).alias("steps"), unless_in(some("orphans"), "_state").alias("orphans"))
    return _cut(packed if empty else packed.filter((F.size("steps") > 0) | (F.size("orphans") > 0)), chapters, cap)


def segments_of(classified: DataFrame, chapters: DataFrame, cap: int = K.MAX_CARDS_PER_SESSION) -> DataFrame:
    """As ``split_segments``, from ``classify_opened`` rows that carry their ``debut``; every chapter in them has segments.

    The rows lie by chapter already, so nothing is shuffled by reader.
    """
    card = F.struct((-F.col("book_count")).alias("use"), "key", "lemma_id").cast(_CARD)
    taught = F.col("part") == "teach"
    by_paragraph = classified.groupBy(*OPEN_CHAPTER, F.when(taught, F.col("debut")).alias("debut")).agg(
        F.array_sort(F.collect_list(F.when(taught, card))).alias("cards"))
    return _cut(_steps(by_paragraph), chapters, cap)


def _cut(packed: DataFrame, chapters: DataFrame, cap: int) -> DataFrame:
    sized = packed.join(
        chapters.select("book_id", "chapter_index", F.col("paragraph_count").cast("int").alias("_n")),
        ["book_id", "chapter_index"],
    )

    def state(done: Column, start: Column, current: Column, last: Column) -> Column:
        return F.struct(
            done.cast(f"array<{_SEGMENT}>").alias("done"), start.cast("int").alias("start"),
            current.cast(f"array<{_CARD}>").alias("current"), last.cast("int").alias("last"),
        )

    def closed(s: Column, end: Column) -> Column:
        segment = F.struct(
            s["start"].alias("first"), end.cast("int").alias("last"), F.array_sort(s["current"]).alias("cards")
        ).cast(_SEGMENT)
        return state(F.array_append(s["done"], segment), end, F.array(), s["last"])

    def overflow_closed(s: Column, end_exists: Column) -> Column:
        over = (F.size(s["current"]) > cap) & end_exists
        return F.when(over, closed(s, s["last"] + 1)).otherwise(s)

    def merge(s: Column, p: Column) -> Column:
        full = lambda a: (F.size(a["current"]) > 0) & (F.size(a["current"]) + F.size(p["cards"]) > cap)
        return let(
            overflow_closed(s, F.lit(True)),
            lambda a: let(
                F.when(full(a), closed(a, p["debut"])).otherwise(a),
                lambda b: state(b["done"], b["start"], F.concat(b["current"], p["cards"]), p["debut"]),
            ),
        )

    def finish(s: Column) -> Column:
        return let(
            overflow_closed(s, s["last"] + 1 < F.col("_n")), lambda a: closed(a, F.col("_n"))["done"]
        )

    start = state(F.array(), F.lit(0), F.array(), F.lit(-1))
    segments = sized.select(
        *OPEN_CHAPTER, "orphans", F.aggregate("steps", start, merge, finish).alias("segments")
    ).select(*OPEN_CHAPTER, "orphans", F.size("segments").alias("_count"),
             F.posexplode("segments").alias("segment", "_s"))
    is_last = F.col("segment") == F.col("_count") - 1
    own = F.col("_s.cards")
    filled = F.slice(
        F.array_sort(F.concat(own, F.col("orphans"))), 1, F.greatest(F.lit(cap), F.size(own))
    )
    return segments.select(
        *OPEN_CHAPTER, "segment",
        F.col("_s.first").alias("paragraph_start"), F.col("_s.last").alias("paragraph_end"),
        F.when(is_last & (F.size("orphans") > 0), filled).otherwise(own).alias("cards"),
    )


def segment_cards(segments: DataFrame) -> DataFrame:
    """Segments to one row per card, in study order."""
    return segments.select(
        *OPEN_CHAPTER, "segment", F.posexplode("cards").alias("ord", "_c")
    ).select(*OPEN_CHAPTER, "segment", "ord", "_c.key", "_c.lemma_id")


def card_face(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(
        "book_id", "key",
        F.struct("pos", "de", "en", "example", "region_note", "mexicanism").alias("face"),
    )


def next_session(segments: DataFrame, stored: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Cards of the next session of every open chapter.

    A stored unfinished session comes back untouched (``resumed``); otherwise the first segment
    of a fresh selection with faces attached. ``stored(user_id, book_id, chapter_index, ord, key,
    lemma_id)`` has one row per queued card.
    """
    open_ = stored.select(*OPEN_CHAPTER).distinct()
    fresh = segment_cards(segments.filter(F.col("segment") == 0)).join(
        open_, list(OPEN_CHAPTER), "left_anti"
    )
    columns = [*OPEN_CHAPTER, "ord", "key", "lemma_id"]
    cards = fresh.select(*columns, F.lit(False).alias("resumed")).unionByName(
        stored.select(*columns, F.lit(True).alias("resumed"))
    )
    return cards.join(card_face(lexicon), ["book_id", "key"], "left")


def over_cap(baked: DataFrame, cap: int = K.MAX_CARDS_PER_SESSION) -> DataFrame:
    """Chapters whose baked teach list exceeds the cap."""
    return baked.select("book_id", "chapter_index", F.size("teach_set").alias("cards")).filter(
        F.col("cards") > cap
    )


def cards_over_cap(classes: DataFrame, cap: int = K.MAX_CARDS_PER_SESSION) -> DataFrame:
    """``over_cap`` from the classes themselves: the lists are counted and not made."""
    return classes.filter("class = 'TEACH'").groupBy("book_id", F.col("first_chapter").alias("chapter_index")).agg(
        F.count(F.lit(1)).cast("int").alias("cards")).filter(F.col("cards") > cap)


def gloss_view(keys: DataFrame, lexicon: DataFrame, opts: TeachOptions = DEFAULTS) -> DataFrame:
    """What a tap on a word shows; unknown keys have no row."""
    return view(keys.join(lexicon, ["book_id", "key"]), keys.columns, opts)


def view(entries: DataFrame, keep: Sequence[str], opts: TeachOptions = DEFAULTS) -> DataFrame:
    return entries.select(
        *keep, lemma_id(F.col("lemma")).alias("lemma_id"), "lemma", "pos",
        (~F.col("pos").isin(*opts.excluded_pos)).alias("cardable"),
        "de", "en", "example", "region_note", "mexicanism",
    )


def add_cards(
    requests: DataFrame, lexicon: DataFrame, cards: DataFrame, now: Column, order: Sequence[str], opts: TeachOptions = DEFAULTS
) -> DataFrame:
    """The card table ``(user_id, lemma_id, created_at, fsrs, face)`` after ``requests(user_id, book_id, key, …)``.

    Offerable words get a new card that is due now, with the face copied from the entry asked for; of several
    requests for one word the last by the columns ``order`` wins. Refused and carded words change nothing.
    """
    wanted = gloss_view(requests, lexicon, opts).filter("cardable").groupBy("user_id", "lemma_id").agg(
        F.max_by(_face(), F.struct(*order)).alias("face")
    )
    fresh = new_cards(wanted.join(cards.select("user_id", "lemma_id").distinct(), ["user_id", "lemma_id"], "left_anti"), now)
    return cards.select(*fresh.columns).unionByName(fresh)


def _face() -> Column:
    return F.struct("pos", "de", "en", "example", "region_note", "mexicanism").cast(FACE_TYPE)


def cards_of(chosen: DataFrame, lexicon: DataFrame, now: Column) -> DataFrame:
    """The new cards of ``add_cards`` alone, where ``chosen(user_id, book_id, key)`` has offerable words only, one entry a word."""
    return new_cards(gloss_view(chosen, lexicon).select("user_id", "lemma_id", _face().alias("face")), now)


def addable_cards(
    requests: DataFrame, lexicon: DataFrame, cards: DataFrame, opts: TeachOptions = DEFAULTS
) -> DataFrame:
    """Requests ``(user_id, book_id, key)`` to add a word by hand: carded, offerable or refused."""
    have = cards.select("user_id", "lemma_id").distinct().withColumn("_have", F.lit(True))
    view = gloss_view(requests, lexicon, opts)
    return view.join(have, ["user_id", "lemma_id"], "left").select(
        *requests.columns, "lemma_id",
        F.when(~F.col("cardable"), "refused").when(F.col("_have"), "carded").otherwise("offerable")
        .alias("status"),
    )
