"""Web or e-book documents to titled chapters of clean paragraphs.

``pages(book_id, doc_ord, doc_name, media_type, html)`` and ``toc(book_id, ord, href, title)``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions import text as T
from lectura.operators.ranking import ordered_rank
from lectura.session import stored


def html_to_paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per prose paragraph; documents without prose yield none."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(
        *keep, F.posexplode(T.paragraph_texts(F.col(html))).alias("paragraph_index", "text")
    )


def split_on_headings(pages: DataFrame, html: str = "html") -> DataFrame:
    keep = [c for c in pages.columns if c != html]
    return pages.select(
        *keep, F.posexplode(T.heading_sections(F.col(html))).alias("section_ord", "section")
    ).select(*keep, "section_ord", "section.title", "section.anchor", "section.html")


def whole_documents(pages: DataFrame) -> DataFrame:
    """Each document as its own single section, titled by its first heading."""
    return pages.select(
        *[c for c in pages.columns if c != "html"],
        F.lit(0).alias("section_ord"),
        T.html_title(F.col("html")).alias("title"),
        F.lit(None).cast("string").alias("anchor"),
        "html",
    )


def strip_boilerplate(
    paragraphs: DataFrame, order: Sequence[str] = ("chapter_index", "paragraph_index")
) -> DataFrame:
    """Keep what stands between the START and END markers of each book.

    Only the two marker positions of a book matter, so they are aggregated map-side and joined
    back; no book is ordered as a whole.
    """
    position = F.struct(*[F.col(c) for c in order])
    is_start = F.regexp_like("text", F.lit(K.BOILERPLATE_START))
    is_end = F.regexp_like("text", F.lit(K.BOILERPLATE_END))
    markers = (
        paragraphs.filter(is_start | is_end)
        .groupBy("book_id")
        .agg(
            F.min(F.when(is_start & ~is_end, position)).alias("_start"),
            F.max(is_start).alias("_has_start"),
            F.min(F.when(is_end, position)).alias("_end"),
        )
    )
    started = ~F.coalesce("_has_start", F.lit(False)) | (position > F.col("_start"))
    running = F.col("_end").isNull() | (position < F.col("_end"))
    return (
        paragraphs.filter(~(is_start | is_end))
        .join(markers, "book_id", "left")
        .filter(F.coalesce(started, F.lit(False)) & running)
        .drop("_start", "_has_start", "_end")
    )


def _matches(name: Column, globs: Sequence[str]) -> Column:
    matched = F.lit(False)
    for glob in globs:
        matched = matched | F.regexp_like(name, F.lit("^" + fnmatch.translate(glob).replace(r"\Z", r"\z")))
    return matched


def select_documents(
    pages: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(kept documents, error rows): globs on document names, include first and exclude after.

    A book whose include matches nothing, or whose exclude removes all, is one error row.
    """
    name = F.col("doc_name")
    included = _matches(name, include) if include else F.lit(True)
    kept = included & ~_matches(name, exclude)
    verdict = (
        pages.groupBy("book_id")
        .agg(F.max(included).alias("_included"), F.max(kept).alias("_kept"))
        .filter(~F.col("_included") | ~F.col("_kept"))
        .select(
            "book_id",
            F.when(~F.col("_included"), "include matched nothing")
            .otherwise("exclude removed every document")
            .alias("error"),
        )
    )
    return pages.filter(kept), verdict


def content_documents(pages: DataFrame) -> DataFrame:
    """Content documents only: no navigation, no cover, known document types."""
    is_document = F.coalesce(F.col("item_type") == "document", F.lit(False)) | F.coalesce(
        F.col("media_type").isin(*K.DOCUMENT_MEDIA_TYPES), F.lit(False)
    )
    return pages.filter(
        is_document & ~F.coalesce(F.col("item_type").isin("nav", "cover"), F.lit(False))
    )


def toc_titles(toc: DataFrame) -> DataFrame:
    """(book_id, target, title): ``doc`` and ``doc#fragment`` targets, first entry wins."""
    path = F.substring_index("href", "#", 1)
    name = F.element_at(F.split(path, "/"), -1)
    fragment = F.when(F.contains("href", F.lit("#")), F.expr("substring(href, instr(href, '#') + 1)"))
    target = F.when(F.coalesce(fragment, F.lit("")) != "", F.concat(name, F.lit("#"), fragment)).otherwise(name)
    entries = toc.select("book_id", "ord", target.alias("target"), name.alias("_name"),
                         T.normalize_text(F.coalesce("title", F.lit(""))).alias("title"))
    return (
        entries.filter((F.col("_name") != "") & (F.col("title") != ""))
        .groupBy("book_id", "target")
        .agg(F.min_by("title", "ord").alias("title"))
    )


def assemble_chapters(sections: DataFrame, titles: DataFrame, keep_boilerplate: bool = False) -> DataFrame:
    """Paragraph rows with chapter number and title.

    Title order: contents entry of the section, own heading, contents entry of the document,
    a generated number. Sections without prose take no number.
    """
    # The texts become rows at once: a filter on the array would evaluate the markup rules twice.
    # Several plans read them, so they are stored: the markup is parsed once.
    prose = stored(html_to_paragraphs(sections), "prose")
    numbered = ordered_rank(
        prose.filter(F.col("paragraph_index") == 0).select("book_id", "doc_ord", "section_ord"),
        ["book_id"], ["doc_ord", "section_ord"], "chapter_index",
    )
    by_section = titles.select("book_id", F.col("target").alias("_st"), F.col("title").alias("_section_title"))
    by_document = titles.select("book_id", F.col("target").alias("doc_name"), F.col("title").alias("_doc_title"))
    titled = (
        prose.withColumn("_st", F.concat("doc_name", F.lit("#"), "anchor"))
        .join(by_section, ["book_id", "_st"], "left")
        .join(by_document, ["book_id", "doc_name"], "left")
        .join(numbered, ["book_id", "doc_ord", "section_ord"])
    )
    paragraphs = titled.select(
        "book_id", "chapter_index", "paragraph_index", "text",
        F.coalesce(
            "_section_title", "title", "_doc_title",
            F.concat(F.lit("Capítulo "), (F.col("chapter_index") + 1).cast("string")),
        ).alias("title"),
    )
    return paragraphs if keep_boilerplate else strip_boilerplate(paragraphs)


def resolve_metadata(books: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Title and author: explicit, else extracted, else file stem / ``Desconocido``."""
    given = {"title": F.lit(None), "author": F.lit(None)}
    joined = books
    if overrides is not None:
        renamed = overrides.select(
            "path", F.col("title").alias("_title"), F.col("author").alias("_author")
        )
        joined = books.join(renamed, "path", "left")
        given = {"title": F.col("_title"), "author": F.col("_author")}

    def filled(column: Column) -> Column:
        return F.nullif(T.normalize_text(column.cast("string")), F.lit(""))

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = F.coalesce(filled(given["title"]), filled(F.col("title")), stem)
    author = F.coalesce(filled(given["author"]), filled(F.col("author")), F.lit("Desconocido"))
    keep = [c for c in books.columns if c not in ("title", "author")]
    return joined.select(
        *keep, title.alias("title"), author.alias("author"),
        T.make_book_id(author, title).alias("book_id"),
    )
