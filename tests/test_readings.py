"""Bibliographies, titles and sources as papers really spell them."""

import pytest

from lemmagraph.functions.similarity import Pool, likelihood, pool
from lemmagraph.functions.text import fold_text
from lemmagraph.sources import latex
from lemmagraph.sources.bibtex import item_query, items


@pytest.mark.parametrize(
    ("printed", "ident"),
    [
        ("arXiv:2401.00001v2", "2401.00001v2"), ("https://arxiv.org/pdf/2401.00001v2", "2401.00001v2"), ("https://arxiv.org/abs/math.AG/0601001", "math.AG/0601001"),
        (r"\arXiv{2407.08747}", "2407.08747"), ("arXiv: math/0601001", "math/0601001"), ("arXiv 2407.08747", "2407.08747"),
    ],
)
def test_printed_arxiv_identifiers(printed, ident):
    assert items(rf"\bibitem{{a}} A. Author, \emph{{Title}}, {printed}, 2024.")[0]["arxiv"] == ident


def test_titles_fold_without_markup():
    assert fold_text(r"Schr{\"o}dinger") == fold_text("Schrödinger") == "schrodinger"
    assert fold_text("{{Gromov}}--{{Witten}} $K$-theory") == "gromov witten k theory"
    assert likelihood(r"On the Schr{\"o}dinger equation", [], "", "", "On the Schrödinger equation", [], "") == 0.75


def test_text_as_it_stands_is_not_read():
    text = "a \\verb|50%| kept % gone\nb \\% c % gone\n\\begin{verbatim}\n% kept\n\\end{verbatim}\\\\% gone\n\\begin{filecontents}{x}\n% kept\n\\end{filecontents}"
    blank = latex.blank_comments(text)
    assert len(blank) == len(text) and "gone" not in blank and blank.count("kept") == 3
    body = "\\begin{thm}One.\\end{thm}\n\\begin{verbatim}\n\\begin{thm}No.\\end{thm}\n\\end{verbatim}\n\\verb|50%| then \\begin{thm}Two.\\end{thm}\n\\begin{filecontents}{x}\\begin{thm}No.\\end{thm}\\end{filecontents}\n"
    paper = "\\documentclass{article}\\newtheorem{thm}{Theorem}[section]\\begin{document}\\section{A}\n" + body + "\\end{document}"
    found = latex.extract({"main.tex": paper.encode()}, "v1")
    assert [(s.number, s.statement) for s in found.statements] == [("1.1", "One."), ("1.2", "Two.")]


def test_numbers_of_shared_and_nested_counters():
    head = "\\documentclass{book}\\newtheorem{thm}{Theorem}[section]\\newtheorem{lem}[thm]{Lemma}\\newtheorem{ex}{Example}[subsection]\\newtheorem{q}{Question}\\newtheorem*{r}{Remark}\\newtheorem{fact}{Fact}[thm]"
    e = lambda name: f"\\begin{{{name}}}x\\end{{{name}}}"
    body = ["\\section{A}", e("thm"), e("lem"), e("q"), e("r"), e("fact"), "\\subsection{B}", e("ex"), e("thm"), e("fact"), "\\section*{S}", e("ex"), "\\section{C}", e("lem"), e("q"), e("ex"), "\\appendix\\section{D}", e("thm"), e("ex")]
    found = latex.extract({"main.tex": (head + "\\begin{document}" + "\n".join(body) + "\\end{document}").encode()}, "v1")
    assert [s.number for s in found.statements] == ["1.1", "1.2", "1", "", "1", "1.1.1", "1.3", "1.1.2", "2.1", "2", "2.0.1", "A.1", "A.0.1"]
    assert found.skipped == ["Fact 1 at main.tex:10: duplicate number"]


def test_pool_takes_the_earliest_work():
    c = lambda ident, confidence, title="T", year="", also=(), source="a": {"id": ident, "also": list(also), "source": source, "confidence": confidence, "title": title, "year": year}
    out = pool([c("doi:1", 0.9, year="2001"), c("arxiv:2", 0.8, year="2001", source="b"), c("doi:3", 0.95, year="1999"), c("mr:4", 0.7, "Other", also=["DOI:3"])])
    assert [(w["ids"], w["confidence"], w["source"]) for w in out] == [(["doi:3", "mr:4"], 0.95, "a"), (["doi:1", "arxiv:2"], 0.9, "a, b")]
    assert Pool().ranked() == []


def test_printed_entries_lose_their_markup_and_keep_their_identifiers():
    doi = "10.1002/(SICI)1097(19980815)17:15<1661::AID-SIM968>3.0.CO;2-2"
    (one,) = items(rf"\bibitem{{a}} E. Schr{{\"o}}dinger, \emph{{Waves}}, pp. 487--518, {doi}. \end{{thebibliography}} rest")
    assert one["doi"] == doi and one["text"].startswith("E. Schrodinger, Waves, pp. 487-518") and not one["text"].endswith(".")


@pytest.mark.parametrize(
    ("raw", "year"),
    [("A. B, T, 2020, arXiv:1912.06162", "2020"), ("A. B, T, https://arxiv.org/abs/1912.06162, 2021.", "2021"), ("A. B, T (1999), 10.1000/2005.1", "1999"), ("A. B, T, arXiv:1912.06162", "")],
)
def test_an_identifier_is_no_year(raw, year):
    assert item_query(raw)[2] == year


def test_a_bad_archive_is_a_row(spark, tmp_path):
    import gzip

    from lemmagraph.sources import files

    for name, data in {"good": gzip.compress(b"text"), "cut": gzip.compress(b"text" * 99)[:-9], "plain": b"as it is"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "e-print").write_bytes(data)
    got = {r.version: r for r in files.unpack_archives(spark, str(tmp_path)).collect()}
    assert bytes(got["good"].content) == b"text" and bytes(got["plain"].content) == b"as it is" and got["good"].error is None
    assert got["cut"].path is None and "EOFError" in got["cut"].error


def test_the_best_candidate_settles_a_query(spark):
    from lemmagraph.sources import answers

    schema = "query_id bigint, id string, also array<string>, confidence double"
    first = spark.createDataFrame([(1, "zbl:1", ["doi:10.1/a"], 0.99), (1, "doi:10.1/b", [], 0.95), (2, "doi:10.1/c", [], 0.95), (2, "zbl:3", [], 0.91)], schema)
    second = spark.createDataFrame([(1, "doi:10.1/x", [], 0.5), (2, "doi:10.1/y", [], 0.5)], schema)
    assert {r.id for r in answers.found_anywhere(first, second).collect()} == {"zbl:1", "doi:10.1/b", "doi:10.1/x", "doi:10.1/c", "zbl:3"}


def test_pieces_of_a_text_give_it_back(spark):
    from lemmagraph.operators import link

    text = r"By \cite[Thm.~2]{a}, \cite{b} and \cite{b}; see \cite{b}\cite{c}."
    edges = [("r", 1, "w1", "unspecified", r"\cite{b}"), ("r", 2, "w2", "unspecified", r"\cite{b}"), ("r", 3, "v#2", "locator", "thm. 2"), ("s", 1, "w9", "unspecified", r"\cite{c}")]
    rows = link.pieces(spark.createDataFrame([("r", text), ("e", ""), ("n", None)], "key string, statement string"), spark.createDataFrame(edges, "src string, seq int, dst string, origin string, evidence string")).orderBy("src", "pos").collect()
    assert "".join(r.raw for r in rows) == text and [r.pos for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.shown, r.dst) for r in rows if r.kind == "cite"] == [("Thm.~2", "v#2"), ("b", "w1"), ("b", "w2"), ("b", "w2"), ("c", None)]


def test_documents_are_read_by_typed_positions(spark, tmp_path):
    import json

    from lemmagraph.sources import records

    work = {"record": 1, "key": "k", "ids": ["a", 5, "", None], "title": 7, "depth": "2", "authors": "x", "provenance": "", "versions": [{"id": "v1", "has_source": 1}, {"id": 3}, "no", {"id": "v2", "has_pdf": "yes"}], "references": [{"citekey": "c"}, {"work": "w"}, {"text": "t", "citekey": None}]}
    results = {"version": "v1", "results": [{"local": "thm-1", "aliases": ["x", 1]}, {"title": "no local"}], "edges": [{"src": "a", "to": "b", "confidence": True}, {"src": "a", "to": "c", "confidence": 1}, {"src": "a", "to": "d", "confidence": 0.25}, {"src": "a"}], "same_as": [{"left": "l", "right": "r"}]}
    for path, doc in {"x/work.json": work, "x/v1/results.json": results, "x/same_as.json": [{"left": "p", "right": "q", "confidence": "high"}], "y/work.json": [1], "z/work.json": {"record": True, "key": "z"}}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(doc))
    got = {r.path.split("/", 1)[1][-60:].split(tmp_path.name + "/")[-1]: r for r in records.scan(spark, f"file://{tmp_path}").collect()}
    (w,) = got["x/work.json"].works
    assert (w.ids, w.title, w.depth, w.authors, w.provenance) == (["a"], "", 0, [], "declared")
    assert [(v.id, v.work, v.has_source, v.has_pdf) for v in got["x/work.json"].versions] == [("v1", "k", True, False), ("v2", "k", False, True)]
    assert [(r.version, r.citekey, r.text) for r in got["x/work.json"].refs] == [("v1", "c", ""), ("v1", "", "t")]
    r = got["x/v1/results.json"]
    assert [(x.key, x.aliases) for x in r.results] == [("v1#thm-1", ["x"])] and [(e.dst, e.confidence) for e in r.edges] == [("b", 1.0), ("c", 1.0), ("d", 0.25)]
    assert [(p.lhs, p.confidence) for p in [*r.same_as, *got["x/same_as.json"].same_as]] == [("l", 1.0), ("p", 1.0)]
    assert {k: v.reason for k, v in got.items() if v.reason} == {"y/work.json": "not a JSON object", "z/work.json": "record version"}


def test_identifiers_that_entries_state():
    from lemmagraph.sources.bibtex import declared

    assert declared({"doi": "10.48550/arXiv.2401.1", "eprint": "2402.2", "mrnumber": " 7 "}) == ["arxiv:2401.1", "mr:7"]
    assert declared({"eprint": "arXiv:2402.2", "version": "v3", "zbl": "1", "zblnumber": "2"}) == ["arxiv:2402.2v3", "zbl:1"]
    assert declared({"eprint": "x", "eprinttype": "jstor", "url": "https://doi.org/10.1/a?b"}) == ["doi:10.1/a"]
    assert declared({"doi": "no", "url": "https://arxiv.org/abs/2401.1v2"}) == ["arxiv:2401.1v2"] and declared({"url": ""}) == []
