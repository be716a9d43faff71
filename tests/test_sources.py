import json

from pyspark.sql import functions as F

from lectura.operators import quality as Q
from lectura.plans import stand_ins as S
from lectura.plans.bundle_queries import bundle_tables
from lectura.session import shared_folder
from lectura.sources import bundles as B
from lectura.sources import seeds as I


def book(spark):
    rows = [("b", 0, 0, "El sol sale. El sol, luz; 12 soles."), ("b", 0, 1, "La luz del sol"), ("b", 1, 0, "Otra luz en Roma")]
    df = spark.createDataFrame(rows, "book_id string, chapter_index long, paragraph_index int, text string")
    return bundle_tables(df, S.forms(spark)), rows


def test_round_trip_in_both_layouts(spark, tmp_path):
    tables, rows = book(spark)
    content = B.whole_bundles(tables).first()["content"]
    parsed = json.loads(content)
    assert list(parsed) == ["book", "chapters", "lexicon", "schemaVersion"]
    assert parsed["book"]["uniqueLemmas"] == len(parsed["lexicon"])
    assert B.whole_bundles(tables).first()["content"] == content
    (tmp_path / "one.json").write_text(content)
    folder = shared_folder(spark, "test")
    B.write_bundles(tables, folder)
    for read in (B.read_bundles(spark, str(tmp_path)), B.read_bundle_lines(spark, folder)):
        texts = {(r.chapter_index, r.paragraph_index): r.text for r in read["paragraphs"].collect()}
        assert texts == {(c, p): t for _, c, p, t in rows}
        assert read["lexicon"].count() == len(parsed["lexicon"])
        assert Q.validate_tables(read).count() == 0
    files = I.read_files(spark, str(tmp_path))
    assert Q.validate_bundles(files).count() == 0


def test_defects_are_named(spark):
    tables, _ = book(spark)
    good = json.loads(B.whole_bundles(tables).first()["content"])

    def broken(change):
        copy = json.loads(json.dumps(good))
        change(copy)
        return json.dumps(copy)

    first = lambda b: b["chapters"][0]["paragraphs"][0]["tokens"]
    key = next(iter(good["lexicon"]))
    cases = {
        "Q1": lambda b: b.update(schemaVersion="1"), "Q2": lambda b: b.update(chapters=[]),
        "Q3": lambda b: b["book"].pop("title"), "Q4": lambda b: b["chapters"][1].update(index=5),
        "Q5": lambda b: b["chapters"][0]["paragraphs"][1].update(id="c0p0"), "Q6": lambda b: first(b)[0].pop("s"),
        "Q7": lambda b: first(b)[1].update(l="x"), "Q8": lambda b: first(b)[0].update(t="zzz"),
        "Q9": lambda b: first(b)[0].pop("l"), "Q10": lambda b: b["chapters"][0].update(glossOnly=["zzz"]),
        "Q11": lambda b: b["lexicon"][key].pop("zipf"), "Q12": lambda b: b["lexicon"][key].update(de=" "),
        "Q13": lambda b: b["lexicon"][key].update(mexicanism=True, regionNote=None) or b["lexicon"][key].pop("regionNote"),
        "Q14": lambda b: b["lexicon"][key].update(example={"de": "x"}), "Q15": lambda b: b["book"].update(uniqueLemmas=1),
    }
    files = spark.createDataFrame([(rule, broken(change)) for rule, change in cases.items()], "path string, content string")
    found = {(r.path, r.rule) for r in Q.validate_bundles(files).collect()}
    assert found == {(rule, rule) for rule in cases}


def test_seeds_and_routing(spark):
    files = spark.createDataFrame(
        [("a", '[" Sol", "sol", "", "LUZ "]'), ("b", "{}"), ("c", "[1]"), ("d", "[]"), ("e", "nope"), ("f", '"text"')],
        "path string, content string")
    assert {r.path: r.kind for r in I.route_imports(files).collect()} == {
        "a": "known", "b": "book", "c": "known", "d": "known", "e": "unrecognised", "f": "unrecognised"}
    ok, errors = I.parse_known(files.filter(F.col("path").isin("a", "b", "c", "d")))
    assert sorted(r.lemma_id for r in ok.collect()) == ["luz", "sol"]
    assert {r.path for r in errors.collect()} == {"b", "c", "d"}
