"""Stages of the pipeline on rows they must tell apart."""

import random

import corpus_pipeline as p

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITALIAN = "La mattina gli uomini del villaggio andavano al mercato con i loro cavalli e tornavano la sera quando il sole era basso sopra le colline; le donne preparavano il pane e i bambini giocavano nella piazza vicino alla chiesa."
FINNISH = "Mieleni minun tekevi, aivoni ajattelevi, veli kulta, veikkoseni, kaunis kasvinkumppalini, tule nyt kanssa laulamahan, saa kera sanelemahan yhtehen yhyttyamme, kahtaalta kaytyamme."


def test_foreign_and_random_texts_go(spark, documents):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400))
    rows = [(-1, ITALIAN, None, "s", 0), (-2, FINNISH, None, "s", 0), (-3, noise, None, "s", 0)]
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in p.identify_language(spark, docs.unionByName(spark.createDataFrame(rows, COLUMNS)), "").collect()}
    assert not kept & {-1, -2, -3} and len(kept) >= 0.98 * docs.count()


def test_one_row_a_group_whatever_the_ids(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
    a, b, c, d = (" ".join(random.Random(seed).choices(words, k=80)) for seed in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (3, c), (0, d), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in p.near_dedup(spark, docs, "").collect()), key=lambda x: x[1])
    assert got == sorted([(1, a), (None, b), (2, c), (0, d)], key=lambda x: x[1])
