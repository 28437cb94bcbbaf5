"""A library of three invented works, from files to answers."""

import json

import pytest
from pyspark.sql import functions as F

from lemmagraph import serve
from lemmagraph.functions import similarity
from lemmagraph.operators import link
from lemmagraph.sources import answers, bibtex, files, latex, records

PAPER = r"""\documentclass{article}
\newtheorem{theorem}{Theorem}[section]
\newtheorem{lemma}[theorem]{Lemma}
\newcommand{\RR}{\mathbf{R}}
\begin{document}
\section{First}
\begin{theorem}\label{thm:main} Let $\RR$ stand. \end{theorem}
\begin{proof} As in \cite[Theorem 1.1]{other} and \cite{third}. \end{proof}
\section{Second}
%LEMMA
\begin{theorem}\label{thm:next} More. \end{theorem}
\begin{proof} By Theorem~\ref{thm:main}. \end{proof}
\end{document}"""
LEMMA = r"\begin{lemma}\label{lem:help} Help. \end{lemma}"


def work(key, versions, refs, **more):
    base = {"record": 1, "key": key, "ids": [key], "title": key, "authors": ["A. Author"], "year": "2024", "provenance": "declared", "depth": 1}
    return {**base, "versions": [{"id": v, "has_source": s} for v, s in versions], "references": [{"citekey": c, "work": w, "text": c} for c, w in refs], **more}


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("works")
    a, b, c = "arxiv:2401.00001", "arxiv:2401.00002", "doi:10.4171/synth.0003"
    docs = {
        "arxiv/2401.00001": work(a, [(f"{a}v1", True), (f"{a}v2", True)], [("other", b), ("third", c)], ids=[a, "doi:10.48550/arXiv.2401.00001"]),
        "arxiv/2401.00002": work(b, [(f"{b}v1", True)], [("other", "doi:10.48550/arxiv.2401.00001"), ("third", c)]),
        "doi/10.4171_synth.0003": work(c, [(c, False)], [], provenance="resolved", depth=2),
    }
    for home, doc in docs.items():
        (root / home).mkdir(parents=True)
        (root / home / "work.json").write_text(json.dumps(doc))
    for home, local, text in (("arxiv/2401.00001", "v1", PAPER.replace("%LEMMA", LEMMA)), ("arxiv/2401.00001", "v2", PAPER), ("arxiv/2401.00002", "v1", PAPER)):
        src = root / home / local / "src"
        src.mkdir(parents=True)
        (src / "paper.tex").write_text(text)
    return root


def statements(spark, library):
    sources = files.read_sources(spark, f"file://{library}")
    version = F.concat(F.lit("arxiv:"), F.regexp_extract("home", r"arxiv/([^/]+)/(v\d)$", 1), F.regexp_extract("home", r"(v\d)$", 1))
    return latex.extract_corpus(sources.select(version.alias("version"), "path", "content"))


def test_extract_link_rebuild_answer(spark, library):
    found = statements(spark, library).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.seq):
        got.setdefault(r.version, []).append((r.local, r.number, r.aliases))
    assert got["arxiv:2401.00001v1"] == [("thm-1.1", "1.1", ["thm:main"]), ("lem-2.1", "2.1", ["lem:help"]), ("thm-2.2", "2.2", ["thm:next"])]
    assert got["arxiv:2401.00001v2"] == got["arxiv:2401.00002v1"] == [("thm-1.1", "1.1", ["thm:main"]), ("thm-2.1", "2.1", ["thm:next"])]
    assert "\\mathbf{R}" in next(r.statement for r in found if r.local == "thm-1.1")

    index = records.rebuild(spark, f"file://{library}")
    assert index.counts() == {"works": 3, "versions": 4, "results": 0, "edges": 0, "references": 4, "same_as": 0}
    held = index.table("refs").select("version").distinct().collect()
    assert {r[0] for r in held} == {"arxiv:2401.00001v2", "arxiv:2401.00002v1"}  # the last version with a source holds them

    extracted = spark.createDataFrame(found, statements(spark, library).schema)
    results = extracted.select(F.concat_ws("#", "version", "local").alias("key"), "version", "local", "taxon", "number", "statement", "proof", "aliases", "seq")
    versions = index.table("versions").select("id", "work")
    refs = index.table("refs").join(versions.withColumnRenamed("id", "version").withColumnRenamed("work", "citing"), "version").select(F.col("citing").alias("work"), "citekey", F.col("work").alias("cited"), F.lit(0).alias("seq"))
    from lemmagraph.functions.identifiers import norm

    aliases = index.table("works").select(F.explode(F.transform("ids", norm)).alias("id"), "key").distinct()
    prefixes = versions.select(F.col("id").alias("version"), F.regexp_replace("id", "[^A-Za-z0-9.-]+", "-").alias("prefix"))
    linked = link.link(results, versions, link.citekeys(refs, aliases), prefixes)
    assert {r.what: r.n for r in link.report(linked).collect()} == {"internal": 3, "locator": 3, "unspecified": 3, "unmatched": 0, "ambiguous": 0}
    hit = {(r.src, r.dst) for r in linked["edges"].where("origin = 'locator'").collect()}
    assert ("arxiv:2401.00002v1#thm-1.1", "arxiv:2401.00001v2#thm-1.1") in hit  # the last version answers

    documents = records.results_documents(extracted, linked["edges"].withColumn("confidence", F.lit(1.0))).collect()
    for r in documents:
        number, _, v = r.version.removeprefix("arxiv:").partition("v")
        (library / "arxiv" / number / f"v{v}" / "results.json").write_text(r.document)
    index = records.rebuild(spark, f"file://{library}")
    assert index.counts()["results"] == 7 and index.counts()["edges"] == 9
    out = str(library.parent / "index")
    index.save(f"file://{out}")
    lib = serve.Library(records.open_index(spark, f"file://{out}"))
    assert lib.neighbourhood("arxiv:2401.00001")["cites"] == ["arxiv:2401.00002", "doi:10.4171/synth.0003"]
    assert lib.neighbourhood("doi:10.48550/arXiv.2401.00001")["found"] and not lib.neighbourhood("nothing")["found"]
    seen = lib.closure("arxiv:2401.00001v1#thm-2.2")
    assert [r["key"] for r in seen["closure"]][:1] == ["arxiv:2401.00001v1#thm-1.1"] and seen["missing"] == []
    assert lib.closure("arxiv:2401.00001v1#thm-2.2", depth=0)["closure"] == []
    assert lib.dependents("arxiv:2401.00001v1#thm-1.1")["used_by"][0]["edge"]["src"] == "arxiv:2401.00001v1#thm-2.2"
    assert lib.get("nothing") is None and "statement" not in lib.get("arxiv:2401.00001v1#thm-1.1", text=False)
    assert lib.bib("arxiv:2401.00001").startswith("@article{arxiv240100001,")
    assert [w["key"] for w in lib.search("synth 0003")["works"]] == ["doi:10.4171/synth.0003"]
    assert serve.answer(lib, "/counts")[1]["results"] == 7
    assert serve.answer(lib, "/nowhere")[0] == 404 and serve.answer(lib, "/result?key=x")[0] == 404 and serve.answer(lib, "/closure?key=x&depth=y")[0] == 400
    reply = serve.dispatch(lib, {"id": 1, "method": "tools/call", "params": {"name": "get", "arguments": {"key": "x"}}})
    assert reply["result"]["isError"] and serve.dispatch(lib, {"method": "notifications/initialized"}) is None
    assert serve.dispatch(lib, {"id": 2, "method": "no"})["error"]["code"] == -32601


def test_malformed_records_are_set_aside(spark, tmp_path):
    cases = {"a": ("[]", "not a JSON object"), "b": ('{"key": "x"}', "record version"), "c": ('{"record": 2, "key": "x"}', "record version"), "d": ('{"record": true, "key": "x"}', "record version"), "e": ('{"record": 1}', "no key"), "f": ("{not json", "not JSON")}
    for name, (text, _) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "work.json").write_text(text)
    (tmp_path / "g" / "v1").mkdir(parents=True)
    (tmp_path / "g" / "work.json").write_text(json.dumps({"record": 1, "key": "k", "versions": [{"has_source": True}, {"id": "v"}], "references": [{"work": "w"}, {"text": "t"}], "title": 7}))
    (tmp_path / "g" / "v1" / "results.json").write_text('{"results": []}')
    (tmp_path / "g" / "same_as.json").write_text('[{"left": "a", "right": "b", "confidence": true}, {"left": "a"}]')
    index = records.rebuild(spark, f"file://{tmp_path}")
    reasons = {r.path.split("/")[-2]: r.reason for r in index.quarantine.collect()}
    assert reasons == {**{n: why for n, (_, why) in cases.items()}, "v1": "no version"}
    assert index.counts() == {"works": 1, "versions": 1, "results": 0, "edges": 0, "references": 1, "same_as": 1}
    assert index.table("works").first().title == "" and index.table("same_as").first().confidence == 1.0
    with pytest.raises(NotImplementedError):
        records.open_index(spark, "other:thing")


def test_numbering_details():
    text = r"""\documentclass{book}\newtheorem{thm}{Theorem}[section]\newtheorem*{note}{Note}\newtheorem{q}[thm]{Question}
\newenvironment{fact}{\begin{thm}{\bf Fact.}}{\end{thm}}
\begin{document}\section{A}\begin{thm}\label{a}x\end{thm}\begin{note}y\end{note}\begin{note}z\end{note}
\section*{no}\begin{q}w\end{q}\begin{fact}v\end{fact}
\appendix\section{B}\begin{thm}u\end{thm}\end{document}"""
    found = latex.extract({"m.tex": text.encode()}, "v")
    assert [s.local for s in found.statements] == ["thm-1.1", "note-star-1", "note-star-2", "q-1.2", "fact-1.3", "thm-A.1"]
    aux = rb"\relax\newlabel{a}{{7.3}{9}{}{}{}}\newlabel{a@cref}{{x}{y}}"
    found = latex.extract({"m.tex": text.encode(), "m.aux": aux}, "v")
    assert [s.local for s in found.statements][:1] == ["thm-7.3"] and found.statements[0].page == "9" and found.statements[3].number == "7.4"
    with pytest.raises(latex.Refused):
        latex.find_main({"a.tex": "x"})
    assert latex.splice({"a": "1\\input{b}2", "b.tex": "3\\input{a}"}, "a").problems == ["cycle: a"] or latex.splice({"a": "1\\input{b}2", "b.tex": "3\\input{a}"}, "a").text == "132"


def test_bibliographies(spark, tmp_path):
    (tmp_path / "x.bib").write_text('@string{a = "b"}\n@article(K1, title = "A {"}" # {B}, doi = {10.48550/arXiv.2401.00009}, zbl={1})\n@book{K2, url={https://arxiv.org/abs/2402.00001v2}}\n@comment{no}')
    rows = {r.citekey: r for r in bibtex.read_bibtex(spark, f"file://{tmp_path}/x.bib").collect()}
    assert rows["K2"].identifiers == ["arxiv:2402.00001v2"] and rows["K1"].identifiers == ["arxiv:2401.00009", "zbl:1"]
    bibtex.register(spark)
    assert spark.sql("select citekey from parse_bibtex('@misc{z, year = 1}')").first()[0] == "z"
    sources = spark.createDataFrame([("v", "a.tex", r"\bibitem{k} T, \emph{X}, 1999."), ("v", "b.bbl", r"\bibitem{k} B, arXiv:2401.00003.")], "version string, path string, text string")
    assert bibtex.items_of_sources(sources).first().arxiv == "2401.00003"


def test_scores_and_candidates():
    s = similarity.likelihood
    assert s("On Rings", [], "", "", "On rings", [], "") == 0.75
    assert s("On Rings", ["Noether"], "1921", "", "On Rings", ["Emmy Noether"], "1922") == 1.0
    assert s("On Rings", [], "", "", "On Rings and Modules", [], "") == 0.69
    text = "A. Arabia, Cycles de Schubert et cohomologie, Invent. 1986"
    assert s(text, [], "1986", text, "Cycles de Schubert", ["Arabia, Alberto"], "1986") == 1.0
    pooled = similarity.pool([{"id": "zbl:1", "also": [], "source": "z", "confidence": 0.9, "title": "T", "year": "1990"}, {"id": "doi:10.1/a", "also": ["ZBL:1"], "source": "c", "confidence": 0.95, "title": "U", "year": "1991"}])
    assert len(pooled) == 1 and pooled[0]["ids"][0] == "doi:10.1/a" and pooled[0]["source"] == "c, z"


def test_settings_archives_answers(spark, tmp_path):
    import io
    import tarfile

    root = files.write_template(tmp_path / "lib").parent
    with pytest.raises(files.BadSettings):
        files.load_settings(root)
    (root / files.SETTINGS).write_text('[crawl]\nseeds = ["doi:10.1/x"]\ndepth = 2\nsubjects = ["14N"]\ncap = 5\n')
    s = files.load_settings(root / "deeper") if (root / "deeper").mkdir() is None else None
    assert s.depth == 2 and s.fingerprint(["t"]) == files.load_settings(root).fingerprint(["t"])
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("../x")
        t.addfile(info, io.BytesIO(b""))
    with pytest.raises(ValueError):
        files.unpack(buffer.getvalue())
    assert files.unpack(b"%PDF-1.4")["paper.pdf"]
    answer = json.dumps({"result": {"identifier": "zbMATH Open Web Interface contents unavailable due to conflicting licenses.", "title": {"title": "T"}, "links": [{"type": "doi", "identifier": "10.1/a"}], "msc": [{"code": "14N35"}], "references": []}})
    r = spark.createDataFrame([(answer,)], "v string").select(answers.zbmath(F.col("v")).alias("z")).first().z
    assert r.ids == ["doi:10.1/a"] and r.title == "T" and r.msc == ["14N35"]
    waits = []
    clock = iter([0.0, 0.0, 1.0, 1.0]).__next__
    budget = answers.Budget(clock=clock, sleep=waits.append)
    budget.take("https://export.arxiv.org/a")
    budget.take("https://export.arxiv.org/b")
    assert waits == [2.0]


def test_walk_refuses_and_streams(spark):
    from lemmagraph.operators import walk
    from lemmagraph.streaming import tumbling

    empty = spark.createDataFrame([], "key string, msc array<string>, category string")
    with pytest.raises(walk.Refused):
        walk.walk(empty, empty, empty, 0, [])
    with pytest.raises(walk.Refused):
        walk.walk(empty, empty, empty, 2, [])
    live = spark.readStream.format("rate").load().selectExpr("timestamp as ts", "'a' as event_type", "cast(value as double) as value")
    assert tumbling(live).isStreaming


def test_tokens_definitions_digest():
    text = "a % c\n\n\\begin{thm}$x$ {\\bf y}\\end{thm}\\"
    assert "".join(t for _, _, t in latex.tokens(text)) == text and {"comment", "begin", "end", "math", "open"} <= {k for k, _, _ in latex.tokens(text)}
    defs = latex.definitions(r"\newcommand{\a}[1]{x#1}\def\b#1{y}\newenvironment{box}{\bf}{z}")
    assert defs == {"a": r"\newcommand{\a}[1]{x#1}", "b": r"\def\b#1{y}", "env:box": r"\newenvironment{box}{\bf}{z}"}
    paper = r"\documentclass{article}\usepackage{tikz,hyperref}\newtheorem{thm}{Theorem}\newenvironment{box}{}{}\begin{document}\begin{thm}\begin{box}x\end{box}\end{thm}\end{document}"
    digest = latex.extract({"m.tex": paper.encode()}, "v", published_as="doi:10.1/x").digest
    head = files.header(digest)
    assert head["requires"] == "tikz" and head["published-as"] == "doi:10.1/x" and files.required_packages(digest) == ["tikz"]
    assert "newenvironment{box}" in files.macro_block(digest) and files.is_digest(digest)


def test_plan_documents_and_services(spark, tmp_path):
    from lemmagraph.operators import walk

    works = spark.createDataFrame([("a", ["14N10"], ""), ("b", ["14N10"], ""), ("c", ["35A01"], ""), ("d", [], "")], "key string, msc array<string>, category string")
    refs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "a")], "src string, dst string")
    walked = walk.walk(works, refs, works.where("key = 'a'"), 2, ["14N"])
    assert {r.key: r.why for r in walked.collect()} == {"a": "", "b": "", "c": walk.OUTSIDE, "d": walk.NEITHER}
    chosen = walk.select(walked, spark.createDataFrame([("b", "pdf")], "key string, kind string"), 5)
    doc = walk.save_plan(str(tmp_path / "plan.json"), chosen, walked, "f")
    assert doc["order"] == ["a", "b"] and doc["selected"] == ["b"] and [e["key"] for e in doc["excluded"]] == ["c", "d"]
    assert walk.load_plan(str(tmp_path / "plan.json"), "f") == doc and walk.load_plan(str(tmp_path / "plan.json"), "g") is None
    first = spark.createDataFrame([(1, "doi:10.1/a", ["zbl:1"], 0.95), (2, "zbl:2", [], 0.95)], "query_id bigint, id string, also array<string>, confidence double")
    second = spark.createDataFrame([(1, "doi:10.1/b", [], 0.9), (2, "doi:10.1/c", [], 0.9)], first.schema)
    assert sorted(r.id for r in answers.found_anywhere(first, second).collect()) == ["doi:10.1/a", "doi:10.1/c", "zbl:2"]
    asked = spark.createDataFrame([("doi:10.1/A",)], "id string")
    held = spark.createDataFrame([("doi:10.1/A", ["doi:10.1/a"]), ("doi:10.1/A", ["doi:10.1/z"])], "id string, ids array<string>")
    assert answers.same_work(asked, held).count() == 1
    q = spark.createDataFrame([(1, "On Rings", ["Noether"], "1921")], "query_id bigint, title string, surnames array<string>, year string")
    c = spark.createDataFrame([(1, "doi:10.1/a", "Ueber Ringe", "On Rings", ["Emmy Noether"], "1921"), (1, "doi:10.1/b", "Fields", "", ["X"], "1900")], "query_id bigint, id string, title string, original string, authors array<string>, year string")
    assert [r.id for r in answers.by_title(q, c).collect()] == ["doi:10.1/a"]
