import zlib

import numpy as np

import corpus_pipeline as P
from tests.llm import cases
from tests.llm.test_dedup import expected_components
from tidemill.llm.queries import ORACLES, QUERIES, tokenizer_path
from tidemill.llm.tokens import load_tokenizer

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(docs)
    every = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = [{r.doc_id for r in d.collect()} for d in outs]
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in outs[:-1])
    assert {i for i, r in every.items() if any(c.isalpha() for c in r.text or "")} == kept[0]
    first, _ = expected_components([(i, every[i].text) for i in kept[0]])
    assert kept[1] == {c for _, _, c in first}
    bench = [cases.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + 10]) for w in bench for j in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = {i for i in kept[1] if not any(tuple((w := cases.words(every[i].text))[j : j + n]) in windows for n in sizes for j in range(len(cases.words(every[i].text)) - n + 1))}
    assert kept[2] == clean and 0 < len(kept[3]) <= len(kept[2]) and kept[3] <= kept[2] and kept[4] == kept[3]
    tokenizer, at = load_tokenizer(tokenizer_path()), 0
    for r in sorted(outs[4].collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(every[r.doc_id].text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id for r in P.run(spark, SF).collect()} == kept[4]


def test_texts_of_several_known_languages_stay(spark):
    english, german, russian = "the quick brown fox jumps over lazy dogs and then they were", "der schnelle braune fuchs springt nicht über die faulen hunde", "быстрая лиса прыгает через ленивую"
    rows = [(i, " ".join([t] * 3), lang, "s", 1) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 20)]
    three = " ".join([" ".join([english] * 4), " ".join([german] * 4), " ".join([russian] * 4)])
    rows += [(100, three, None, "s", 1), (101, f"{english} 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀", None, "s", 1), (102, "ભાષા અને લેખન " * 5 + "the fox", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert max(x.score for x in P.identify(docs.filter("doc_id = 100"), P.fit(docs), spans=False).collect()) < P.MIN_SHARE
    assert {x.doc_id for x in P.identify_languages(spark, docs, SF).collect()} == {*range(60), 100, 101}


def test_stages_take_awkward_rows(spark):
    odd, none = cases.frame(spark), cases.empty(spark)
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns and got.count() <= odd.count()
        assert stage(spark, none, SF).count() == 0
    assert P.STAGES[-1][1](spark, odd, SF).count() == odd.count()
    assert P.STAGES[-1][1](spark, none, SF).count() == 0
