"""Paragraphs to tokens, and what a reader sees of them.

``paragraphs(book_id, chapter_index, paragraph_index, text)`` →
``tokens(…, token_index, s, ws, l, p, t)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions.text import sentences
from lectura.session import deal

PARAGRAPH = ("book_id", "chapter_index", "paragraph_index")


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.TOKEN_PATTERN), F.lit(0))


def tokenize(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Lossless tokens: joining ``s`` in order gives back the paragraph."""
    keep = [c for c in paragraphs.columns if c != text]
    exploded = paragraphs.select(*keep, F.posexplode(token_array(F.col(text))).alias("token_index", "s"))
    return exploded.withColumn("kind", _kind())


def _kind() -> Column:
    return (
        F.when(F.regexp_like("s", F.lit(r"^\p{L}")), "word")
        .when(F.regexp_like("s", F.lit(r"^\p{N}")), "number")
        .when(F.regexp_like("s", F.lit("^" + K.WHITESPACE)), "space")
        .otherwise("mark")
    )


def words(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Word tokens only, with the flag for the first word of the paragraph.

    The other tokens are dropped inside the array, before any row is made of them.
    """
    keep = [c for c in paragraphs.columns if c != text]
    only = F.regexp_extract_all(F.col(text), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))
    return paragraphs.select(*keep, F.posexplode(only).alias("word_index", "s")).withColumn(
        "first_word", F.col("word_index") == 0
    )


def sentence_words(paragraphs: DataFrame) -> DataFrame:
    """Word tokens of every sentence: ``sentence_index``, ``sentence``, ``word_index`` in it, ``s`` and ``first_word``.

    ``first_word`` marks the first word of the paragraph, as in ``words``.
    """
    keep = [c for c in paragraphs.columns if c != "text"]
    split = paragraphs.select(*keep, sentences(F.col("text")).alias("_all"))
    each = split.select("*", F.posexplode("_all").alias("sentence_index", "sentence")).withColumn(
        "_opens", ~F.exists(F.slice("_all", F.lit(1), F.col("sentence_index")), lambda s: F.regexp_like(s, F.lit(r"\p{L}")))
    )
    found = words(each.select(*keep, "sentence_index", "sentence", "_opens", F.col("sentence").alias("text")))
    return found.withColumn("first_word", F.col("first_word") & F.col("_opens")).drop("_opens")


def annotate(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Lemma and part of speech by a form dictionary ``forms(form, lemma, pos)``.

    Unlisted words: lemma is the lower-cased form; PROPN when capitalised inside the paragraph,
    else NOUN. No broadcast hint: the dictionary may be of any size.
    """
    dictionary = forms.select(
        F.col("form").alias("_form"), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos")
    )
    is_word = F.col("kind") == "word" if "kind" in tokens.columns else F.lit(True)
    capital = F.regexp_like("s", F.lit(r"^\p{Lu}")) & ~F.col("first_word")
    joined = tokens.join(dictionary, is_word & (F.lower("s") == F.col("_form")), "left")
    lemma = F.when(is_word, F.coalesce("_lemma", F.lower("s")))
    pos = F.when(
        is_word, F.coalesce("_pos", F.when(capital, "PROPN").otherwise("NOUN"))
    )
    if "kind" in tokens.columns:
        pos = pos.when(F.col("kind") == "number", "NUM").when(F.col("kind") == "mark", "PUNCT")
    return joined.withColumn("l", lemma).withColumn("p", pos).drop("_form", "_lemma", "_pos")


def mark_first_words(tokens: DataFrame) -> DataFrame:
    """Flag the first word of every paragraph of a full token stream."""
    paragraph = [c for c in tokens.columns if c not in ("token_index", "s", "kind")]
    first = F.min(F.when(F.col("kind") == "word", F.col("token_index"))).over(
        Window.partitionBy(*paragraph)
    )
    return tokens.withColumn("first_word", F.coalesce(F.col("token_index") == first, F.lit(False)))


def shape_tokens(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The four token shapes; nulls stand for absent fields."""
    entries = lexicon.select(
        "book_id", F.col("lemma").alias("l"), F.col("pos").alias("p"), F.col("key").alias("t")
    )
    return tokens.join(entries, ["book_id", "l", "p"], "left").select(
        *PARAGRAPH, "token_index", "s",
        F.when(F.col("kind") == "space", True).alias("ws"),
        F.when(F.col("kind") == "word", F.col("l")).alias("l"),
        F.when(F.col("kind") != "space", F.col("p")).alias("p"),
        F.when((F.col("kind") == "word") & (F.col("p") != "PROPN"), F.col("t")).alias("t"),
    )


def shape_texts(paragraphs: DataFrame, vocab: DataFrame, forms: DataFrame, about: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``shape_tokens`` of ``paragraphs`` by the words ``vocab(book_id, chapter_index, lemma, pos, key)`` of their chapters, with
    their columns ``about`` beside ``t``.

    Texts and words are dealt out by chapter together, before any token is made; keys meet tokens there, and all that is
    made per chapter or paragraph follows without another shuffle. ``parts`` as in ``session.deal``: tokens are sorted
    twice there, and a part should hold few enough for memory.
    """
    chapter, none = ["book_id", "chapter_index"], F.lit(None)
    entry = F.struct(F.col("key").alias("t"), *about)
    words = vocab.select(
        *chapter, none.cast("int").alias("paragraph_index"), none.cast("string").alias("text"),
        F.col("lemma").alias("_l"), F.col("pos").alias("_p"), entry.alias("_e"))
    kinds = dict(words.dtypes)
    texts = paragraphs.select(*PARAGRAPH, "text", *[none.cast(kinds[c]).alias(c) for c in ("_l", "_p", "_e")])
    dealt = deal(texts.unionByName(words), chapter, parts).select(
        *PARAGRAPH, "_l", "_p", "_e", token_array(F.col("text")).alias("_all"))
    opens = F.array_position(F.transform("_all", lambda s: F.regexp_like(s, F.lit(r"^\p{L}"))), True) - 1
    # Before the rows of tokens, else it would be found again for each of them.
    told = dealt.withColumn("_opens", opens)
    tokens = told.select(*PARAGRAPH, "_l", "_p", "_e", "_opens", F.posexplode_outer("_all").alias("token_index", "s"))
    found = annotate(tokens.withColumn("first_word", F.coalesce(F.col("token_index") == F.col("_opens"), F.lit(False))).withColumn("kind", _kind()), forms)
    is_entry = F.col("_e").isNotNull()
    keyed = found.withColumn("l", F.when(is_entry, F.col("_l")).otherwise(F.col("l"))).withColumn(
        "p", F.when(is_entry, F.col("_p")).otherwise(F.col("p"))
    ).withColumn("_e", F.max("_e").over(Window.partitionBy(*chapter, "l", "p"))).filter(F.col("s").isNotNull())
    tapped = (F.col("kind") == "word") & (F.col("p") != "PROPN")
    return keyed.select(
        *PARAGRAPH, "token_index", "s",
        F.when(F.col("kind") == "space", True).alias("ws"),
        F.when(F.col("kind") == "word", F.col("l")).alias("l"),
        F.when(F.col("kind") != "space", F.col("p")).alias("p"),
        *[F.when(tapped, F.col(f"_e.{c}")).alias(c) for c in ("t", *about)],
    )


def is_tappable() -> Column:
    return ~F.coalesce("ws", F.lit(False)) & F.col("t").isNotNull()


def merge_runs(tokens: DataFrame, gloss_only: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Maximal runs of untappable tokens as one text run; tappable tokens stay single.

    ``gloss_only(book_id, chapter_index, key)`` marks words; a marked word carries its German
    gloss. A paragraph comes from one text, which bounds every window here.
    """
    order = Window.partitionBy(*PARAGRAPH).orderBy("token_index")
    tappable = is_tappable()
    starts = tappable | F.coalesce(F.lag(tappable).over(order), F.lit(True))
    runs = (
        tokens.withColumn("_tap", tappable)
        .withColumn("run_index", (F.sum(starts.cast("int")).over(order) - 1).cast("int"))
        .groupBy(*PARAGRAPH, "run_index")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("token_index", "s"))), lambda x: x["s"]), ""
            ).alias("text"),
            F.max(F.when(F.col("_tap"), F.col("t"))).alias("key"),
        )
    )
    marks = gloss_only.select("book_id", "chapter_index", "key", F.lit(True).alias("_marked"))
    glosses = lexicon.select("book_id", "key", "de")
    return (
        runs.join(marks, ["book_id", "chapter_index", "key"], "left")
        .join(glosses, ["book_id", "key"], "left")
        .select(
            *PARAGRAPH, "run_index",
            F.when(F.col("key").isNull(), "text").otherwise("word").alias("kind"),
            "text", "key",
            F.coalesce("_marked", F.lit(False)).alias("marked"),
            F.when(F.col("_marked"), F.col("de")).alias("reveal"),
        )
    )


def runs_of(tokens: DataFrame) -> DataFrame:
    """As ``merge_runs``, from ``shape_texts`` with ``marked`` and ``de`` of every key beside it: no row is joined or shuffled."""
    order = Window.partitionBy(*PARAGRAPH).orderBy("token_index")
    tappable = is_tappable()
    starts = tappable | F.coalesce(F.lag(tappable).over(order), F.lit(True))
    runs = tokens.withColumn("run_index", (F.sum(starts.cast("int")).over(order) - 1).cast("int")).groupBy(*PARAGRAPH, "run_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_index", "s"))), lambda x: x["s"]), "").alias("text"),
        F.max(F.when(tappable, F.struct("t", "marked", "de"))).alias("_e"),
    )
    marked = F.coalesce("_e.marked", F.lit(False))
    return runs.select(
        *PARAGRAPH, "run_index", F.when(F.col("_e").isNull(), "text").otherwise("word").alias("kind"), "text", F.col("_e.t").alias("key"),
        marked.alias("marked"), F.when(marked, F.col("_e.de")).alias("reveal"),
    )


def chapter_keys(tokens: DataFrame, chapters: DataFrame) -> DataFrame:
    """Lexicon keys a chapter can reach: its gloss-only list and its tappable tokens."""
    seen = tokens.filter(is_tappable()).select("book_id", "chapter_index", F.col("t").alias("key"))
    listed = chapters.select("book_id", "chapter_index", F.explode("gloss_only").alias("key"))
    return seen.union(listed).distinct()


def lexicon_slice(lexicon: DataFrame, keys: DataFrame, on: Sequence[str] = ("book_id", "key")) -> DataFrame:
    return lexicon.join(keys, list(on), "left_semi")
