"""Walks over works with several names, and services asked one after another, on small made-up literatures."""

import pytest

from lemmagraph.operators import identity
from lemmagraph.operators.walk import CATEGORY, NEITHER, OUTSIDE, Refused

ANSWERS = "asked string, ids array<string>, msc array<string>, category string"


def walked(spark, answers, refs, seeds, depth=3, subjects=("14N",), categories=("math.AG",)):
    a = spark.createDataFrame([(x, list(ids), list(msc) if msc is not None else None, cat) for x, ids, msc, cat in answers], ANSWERS)
    r = spark.createDataFrame(refs, "asked string, dst string")
    s = spark.createDataFrame([(x,) for x in seeds], "id string")
    return {w.key: w for w in identity.walk(a, r, s, depth, list(subjects), list(categories)).collect()}


GOOD = ("14N35",)


def test_a_work_met_deep_turns_out_to_be_a_seed(spark):
    answers = [("doi:10.1/b", ["doi:10.1/b"], GOOD, ""), ("doi:10.1/c", ["doi:10.1/c"], GOOD, ""), ("doi:10.1/a", ["doi:10.1/A", "arXiv:2001.00001v3"], (), "")]
    refs = [("arxiv:2001.00001", "doi:10.1/b"), ("doi:10.1/b", "doi:10.1/c"), ("doi:10.1/c", "DOI:10.1/A")]
    # the seed's own source knows no other name; its DOI, cited at depth 3, tells the number
    got = walked(spark, answers, refs, ["arXiv:2001.00001"], depth=4)
    assert set(got) == {"doi:10.1/a", "doi:10.1/b", "doi:10.1/c"}
    a = got["doi:10.1/a"]
    assert (a.home, a.depth, a.kept, a.names, a.cited_by) == ("arxiv:2001.00001", 1, True, 2, 1)
    assert (got["doi:10.1/b"].cited_by, got["doi:10.1/c"].depth) == (1, 3)
    # one level less, and the DOI is not met
    assert set(walked(spark, answers, refs, ["arXiv:2001.00001"], depth=3)) == {"arxiv:2001.00001", "doi:10.1/b", "doi:10.1/c"}


def test_two_kept_works_become_one_and_the_shallower_remains(spark):
    answers = [("doi:1", ["doi:1"], GOOD, ""), ("doi:2", ["doi:2"], GOOD, ""), ("doi:3", ["doi:3"], GOOD, ""), ("zbl:9", ["zbl:9", "doi:1", "doi:3"], (), "")]
    refs = [("doi:1", "doi:2"), ("doi:2", "doi:3"), ("doi:3", "zbl:9")]
    got = walked(spark, answers, refs, ["doi:1"], depth=4)
    assert set(got) == {"doi:1", "doi:2"} and got["doi:1"].names == 3 and got["doi:1"].home == "doi:1"
    assert got["doi:1"].cited_by == 1 and got["doi:2"].cited_by == 1  # doi:3 now is the seed itself, which does not cite itself


def test_an_exclusion_ends_where_a_kept_work_takes_its_name(spark):
    answers = [("doi:x", ["doi:x"], ("55N91",), ""), ("doi:y", ["doi:y"], GOOD, ""), ("zbl:1", ["zbl:1", "doi:x", "doi:y"], (), "")]
    refs = [("doi:s", "doi:x"), ("doi:s", "doi:y"), ("doi:s", "doi:z"), ("doi:s", "doi:v"), ("doi:y", "zbl:1")]
    answers.append(("doi:v", ["doi:v"], None, "math.NT"))
    two = walked(spark, answers, refs, ["doi:s"], depth=2)
    assert {k: w.why for k, w in two.items() if not w.kept} == {"doi:x": OUTSIDE, "doi:z": NEITHER, "doi:v": CATEGORY}
    three = walked(spark, answers, refs, ["doi:s"], depth=3)
    assert three["doi:x"].kept and three["doi:x"].home == "doi:y" and three["doi:x"].names == 3 and "doi:y" not in three


def test_chains_categories_nulls_and_limits(spark):
    answers = [("doi:1", ["doi:2"], (), ""), ("doi:2", ["doi:3", None], (), "math.AG"), (None, ["doi:1"], GOOD, ""), ("doi:9", [], GOOD, "")]
    refs = [("doi:s", "doi:1"), (None, "doi:7"), ("doi:s", None), ("doi:s", "doi:s")]
    got = walked(spark, answers, refs, ["doi:s", "doi:s"], depth=2)
    assert set(got) == {"doi:s", "doi:1"} and got["doi:1"].names == 3 and got["doi:1"].kept and got["doi:s"].cited_by == 0
    assert set(walked(spark, answers, refs, ["doi:s"], depth=1, subjects=())) == {"doi:s"}
    assert walked(spark, answers, refs, [], depth=2) == {}
    for depth, subjects in [(0, ("14N",)), (2, ())]:
        with pytest.raises(Refused):
            walked(spark, answers, refs, ["doi:s"], depth, subjects)


WORKS = "key string, ids array<string>, title string, authors array<string>, year string, msc array<string>, category string, version string, open_pdf string"


def test_the_first_name_with_an_answer_counts(spark):
    rows = spark.createDataFrame([("a", ["mr:1", "doi:2", "arXiv:3v2"]), ("b", ["doi:9"]), ("c", None), ("d", [])], "key string, ids array<string>")
    answers = spark.createDataFrame([("arxiv:3", "number"), ("mr:1", "no such service"), ("doi:3", "x"), (None, "null")], "asked string, title string")
    got = {r.key: r.answer.title for r in identity.first_hit(rows, answers, ("doi", "arxiv")).collect()}
    assert got == {"a": "number"}
    both = answers.union(spark.createDataFrame([("DOI:2", "doi")], answers.schema))
    assert identity.first_hit(rows, both, ("doi", "arxiv")).first().answer.title == "doi"


def test_a_book_is_classified_by_the_title_that_another_service_tells(spark):
    empty = ("", [], "", [], "", "", "")
    works = spark.createDataFrame([("book", ["doi:10.1/2nd"], *empty), ("paper", ["doi:10.1/p"], *empty), ("none", ["doi:10.1/n"], *empty), ("coded", ["arxiv:7"], "", [], "", ["05C10"], "", "", "")], WORKS)
    index = spark.createDataFrame([("doi:10.1/p", ["doi:10.1/p", "arxiv:5"], [])], "asked string, ids array<string>, msc array<string>")
    graph = spark.createDataFrame([("doi:10.1/2nd", "Intersection Théory", ["William Fulton"])], "asked string, title string, authors array<string>")
    titles = spark.createDataFrame([("intersection theory|fulton", ["zbl:0541"], ["14C17", "14-02"])], "asked string, ids array<string>, msc array<string>")
    preprints = spark.createDataFrame([("arxiv:5", "math.AG", "v3"), ("arxiv:7", "math.CO", "v1")], "asked string, category string, version string")
    got = {r.key: r for r in identity.classified(works, index, graph, titles, preprints).collect()}
    assert got["book"].msc == ["14C17", "14-02"] and got["book"].ids == ["doi:10.1/2nd", "zbl:0541"] and got["book"].authors == ["William Fulton"]
    assert (got["paper"].category, got["paper"].version, got["paper"].ids) == ("math.AG", "v3", ["doi:10.1/p", "arxiv:5"])
    assert (got["coded"].category, got["coded"].version) == ("", "v1") and got["none"].msc == [] and len(got) == 4
