from pyspark.sql import functions as F

from lectura.functions import text as T
from lectura.operators import documents as D


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_normalize_text(spark):
    cases = {
        " un\t río  \n\n ancho ": "un río ancho",
        "tres\u00a0barcos\u2009y\u3000medio": "tres barcos y medio",
        "ven\u00adta\u00adna": "ventana",
        "Corazo\u0301n, pin\u0303a": "Corazón, piña",
    }
    for raw, want in cases.items():
        assert one(spark, raw, T.normalize_text) == want
        assert one(spark, raw, lambda c: T.normalize_text(c, full_nfc=True)) == want


def test_what_may_compose_covers_unicode():
    import sys
    import unicodedata

    import regex

    pattern = regex.compile(T.MAY_COMPOSE.replace("\\x{1d15e}-\\x{1d1c0}\\x{2f800}-\\x{2fa1f}", "\\U0001d15e-\\U0001d1c0\\U0002f800-\\U0002fa1f"))
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert not [c for c in letters if unicodedata.normalize("NFC", c) != c and not pattern.match(c)]
    parts = [unicodedata.normalize("NFD", c) for c in letters]
    assert not [p for p in parts if len(p) > 1 and unicodedata.normalize("NFC", p) != p and not pattern.search(p)]


def test_paragraphs(spark):
    cases = {
        "<body><h1>Mapa</h1><p>Norte</p><p>Sur</p></body>": ["Norte", "Sur"],
        "<body><p></p><p>\n</p><p>Este</p></body>": ["Este"],
        "<body><div>Lago</div><div>Isla</div></body>": ["Lago", "Isla"],
        "<head><style>b{top:1px}</style></head><p>Faro</p><script>x()</script>": ["Faro"],
        '<p>la costa<sup><a href="#n9">9</a></sup>, al fin</p>': ["la costa, al fin"],
        "<p>1 &amp;gt; 0 &ntilde; &#241; &#xF1; &zzz;</p>": ["1 &gt; 0 ñ ñ ñ &zzz;"],
        "<p>sin<p>cierre</p>": ["sin", "cierre"],
    }
    for html, want in cases.items():
        assert one(spark, html, T.paragraph_texts) == want, html


def test_sections_and_titles(spark):
    html = '<h2>Alba</h2><p>Gallos.</p><h3 id="s2">Tarde</h3><p>Sombra.</p><h3>  </h3>'
    found = one(spark, html, T.heading_sections)
    assert [(s.title, s.anchor, s.html) for s in found] == [("Alba", None, "<p>Gallos.</p>"), ("Tarde", "s2", "<p>Sombra.</p>")]
    assert len(one(spark, "<p>Nada más.</p>", T.heading_sections)) == 1
    assert one(spark, "<body><h4>Parada 12</h4></body>", T.html_title) == "Parada 12"
    assert one(spark, "<body><p>sin nombre</p></body>", T.html_title) is None


def test_book_ids(spark):
    rows = [("Ana María Ficticia", "Un Título, ¿Inventado?"), ("", "¿Y qué?"), ("", "")]
    df = spark.createDataFrame(rows, "a string, t string")
    assert [r.i for r in df.select(T.make_book_id(F.col("a"), F.col("t")).alias("i")).collect()] == [
        "ficticia-un-titulo-inventado", "y-que", "libro"]


START, END = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THIS PROJECT GUTENBERG EBOOK X ***"


def stripped(spark, *chapters):
    rows = [("b", c, p, t) for c, ps in enumerate(chapters) for p, t in enumerate(ps)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index long, paragraph_index int, text string")
    kept = D.strip_boilerplate(df).orderBy("chapter_index", "paragraph_index").collect()
    return [(r.chapter_index, r.text) for r in kept]


def test_boilerplate(spark):
    assert stripped(spark, ["junk", START, "a"]) == [(0, "a")]
    assert stripped(spark, [START, "a", END, "z"]) == [(0, "a")]
    assert stripped(spark, [START, "a"], [END, "licence"], ["more"]) == [(0, "a")]
    assert stripped(spark, ["a", END, "z"]) == [(0, "a")]
    assert stripped(spark, ["a"], ["b"]) == [(0, "a"), (1, "b")]
    assert stripped(spark, ["a", END, "b", START, "c"]) == []


def test_select_documents(spark):
    names = ["apendice.xhtml", "dia-lunes.xhtml", "dia-martes.xhtml", "portada.xhtml"]
    df = spark.createDataFrame([("b", n) for n in names], "book_id string, doc_name string")

    def kept(include=(), exclude=()):
        rows, errors = D.select_documents(df, include, exclude)
        return sorted(r.doc_name for r in rows.collect()), [r.error for r in errors.collect()]

    assert kept() == (sorted(names), [])
    assert kept(["dia-*"])[0] == ["dia-lunes.xhtml", "dia-martes.xhtml"]
    assert kept(["*.xhtml"], ["ap*", "port*"])[0] == ["dia-lunes.xhtml", "dia-martes.xhtml"]
    assert kept(["noche*"]) == ([], ["include matched nothing"])
    assert kept((), ["*"]) == ([], ["exclude removed every document"])


def test_chapters_take_their_names_from_the_contents(spark):
    pages = spark.createDataFrame(
        [("b", 0, "cover.xhtml", "<body></body>"),
         ("b", 1, "one.xhtml", '<h2 id="i">I</h2><p>Uno.</p><h2 id="ii">II</h2><p>Dos.</p>'),
         ("b", 2, "two.xhtml", "<p>Tres.</p>")],
        "book_id string, doc_ord long, doc_name string, html string")
    toc = spark.createDataFrame(
        [("b", 0, "text/one.xhtml", "Parte"), ("b", 1, "text/one.xhtml#i", "I. La sierra"), ("b", 2, "one.xhtml#i", "late")],
        "book_id string, ord long, href string, title string")
    out = D.assemble_chapters(D.split_on_headings(pages), D.toc_titles(toc))
    assert [tuple(r) for r in out.select("chapter_index", "title", "text").orderBy("chapter_index").collect()] == [
        (0, "I. La sierra", "Uno."), (1, "II", "Dos."), (2, "Capítulo 3", "Tres.")]
