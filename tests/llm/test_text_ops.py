import math

import pytest

from tests.llm import cases
from tidemill.llm import decontaminate, langid, licenses, mixing, quality


def test_decontaminate_matches_brute_force(spark):
    items = [(1, cases.prose(41, 30)), (2, cases.prose(42, 10)), (3, "tiny item"), (4, "one"), (4, "one"), (5, None), (None, "null id item here"), (6, ""), (7, cases.prose(42, 10)), (8, cases.prose(43, 5)), (9, "a a a a a a a a a a a a")]
    a, b, c = (cases.prose(s, n).split() for s, n in ((41, 30), (42, 10), (43, 5)))
    extra = [" ".join(["x"] * 3 + a[5:15] + ["y"]), " ".join(a[5:14]), " ".join(a[:12] + ["zz"] + a[12:]), ", ".join(b).upper(), " ".join(c * 2), " ".join(c[:4]), "has a TINY-item and one.", " ".join(["a"] * 25), " ".join(a + a)]
    rows = cases.rows(extra)
    windows = {}
    for i, t in items:
        w = cases.words(t)
        if i is not None and w:
            for j in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    want = []
    for r in rows:
        w, hit, found = cases.words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    found |= own
                    hit |= set(range(j, j + n))
        want.append((str(r[0]), len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, h1 int")
    for bound in (decontaminate.MAX_SHARED, 0):  # looked up in tasks, and joined with a shuffle
        got = decontaminate.decontaminate(cases.frame(spark, extra), bench, max_shared=bound, keep_row=True)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in got.collect()) == sorted(want)
        assert got.select("row.*").columns == cases.frame(spark).columns
        assert decontaminate.decontaminate(cases.empty(spark), bench, max_shared=bound).count() == 0
        assert decontaminate.decontaminate(cases.frame(spark), bench.limit(0), max_shared=bound).filter("n_hit > 0").count() == 0


def test_licenses_match_brute_force(spark):
    passage = next(iter(licenses.PASSAGES)).split()
    cut = passage[:5] + ["inserted", "words"] + passage[5:12] + passage[13:]
    extra = ["Under the MIT license; under the mit license", "under the mit", "CC BY NC and cc-by-nc", " ".join(passage), " ".join(cut), " ".join(passage[:6]), "apache license version 2 0 Apache-License (version 2)", "underK the mit license"]
    rows = cases.rows(extra)
    got = licenses.scan_licenses(cases.frame(spark, extra)).collect()
    want = []
    for r in rows:
        w, places, labels = cases.words(r[1]), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    places.append(j)
                    labels.add(label)
        want.append((str(r[0]), len(w), len(places), str(min(places, default=None)), str(max(places, default=None)), ",".join(sorted(labels))))
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert by[103].labels == by[104].labels == "mit" and by[103].score == 1.0 and licenses.LEAST_SHARE <= by[104].score < 1
    assert by[105].labels == "" and by[105].score == 0.0
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan_licenses(cases.empty(spark)).count() == 0


def test_licenses_that_resemble_each_other(spark):
    notice = {label: text for text, label in licenses.PASSAGES.items()}
    texts = [notice["gpl"], notice["lgpl"], notice["gpl"] + " and " + notice["lgpl"], " ".join(["x", notice["lgpl"], "y"] * 40), notice["gpl"][:-15]]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["gpl", "lgpl", "gpl,lgpl", "lgpl", "gpl"]
    assert len(got[3].places) == 40 and all(got[i].score == 1 for i in range(4))


def test_a_text_has_two_hashes_of_its_own(spark):
    """The second begins with a seed of its own, and isn't a hash of the first."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"text {i}",) for i in range(50)], "t string").select("t", *licenses.text_key("t"))
    got = df.select("h1", "h2", F.xxhash64("t").alias("own"), F.xxhash64("t", F.lit(1)).alias("chained"), F.xxhash64(F.lit(1), "t").alias("seeded")).collect()
    assert all(r.h1 == r.own and r.h2 == r.seeded != r.chained for r in got) and len({r.h2 for r in got}) == 50


def test_language_of_held_out_and_mixed_texts(spark):
    english = "the quick brown fox jumps over lazy dogs and then they were with that thing which would have been there"
    german = "der schnelle braune fuchs springt nicht über die faulen hunde und dann wurden sie mit diesem ding gewesen"
    russian = "быстрая коричневая лиса прыгает через ленивую собаку и потом они были там"
    import random

    r = random.Random(2)
    some = lambda s, n: " ".join(r.choice(s.split()) for _ in range(n))
    rows = [(i, some(t, 40), lang) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "ru"]
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    mixed = spark.createDataFrame([(1, some(english, 30) + " " + some(german, 20) + " " + some(russian, 40))], "doc_id long, text string")
    spans = langid.identify(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "de", "ru"] and abs(spans[0].end_word - 30) <= 2 and abs(spans[1].end_word - 50) <= 2
    edges = langid.identify(cases.frame(spark), model, keep_row=True).collect()
    assert len(edges) == len(cases.rows())
    assert {e.lang_pred for e in edges if e.row.text is None or not any(c.isalpha() for c in e.row.text)} == {"und"}
    assert all(e.lang_pred in model.languages and 0 <= e.score <= 1 for e in edges if any(c.isalpha() for c in e.row.text or ""))
    none = langid.fit(cases.empty(spark))
    assert none.languages == [] and {e.lang_pred for e in langid.identify(cases.frame(spark), none).collect()} == {"und"}
    assert langid.identify(cases.empty(spark), model).count() == 0


def test_every_labelled_language_is_learned(spark):
    import random
    import zlib

    r = random.Random(6)
    vocabulary = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(230)}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(lang for lang in vocabulary for _ in range(6))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(vocabulary)
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    own = langid.learn([t for _, t, _ in learned], [lang for _, _, lang in learned])
    assert (model.table == own.table).all() and (model.scripts == own.scripts).all()
    held = [(i, text(lang, 30), lang) for i, lang in enumerate(vocabulary)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), model, spans=False).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in held)


def test_scores_worked_out_in_parts_are_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["the dog and the fox " * 30, "der hund und der fuchs " * 20, "", "x" * 3000 + " the hund", "собака и лиса"]
    model = langid.learn(texts[:2] + texts[4:], ["en", "de", "ru"])
    scores, _, _, counts = langid.word_scores(pa.array(texts), model)
    every, whole = scores[np.arange(len(scores))], langid.viterbi(scores, counts)
    assert (langid.viterbi(every, counts) == whole).all()
    monkeypatch.setattr(langid, "CELLS", 50)
    assert np.allclose(scores[np.arange(len(scores))], every, rtol=1e-4) and (langid.viterbi(scores, counts) == whole).all()


def test_symbols_alone_are_of_no_language(spark):
    prose = "“the dog” — ‘and’ … the fox — was there — … “again”"
    model = langid.fit(spark.createDataFrame([(i, prose, "en") for i in range(20)], "doc_id long, text string, lang string"))
    assert model.scripts[langid.SCRIPTS.index("common")].all()
    texts = ["— … ”", "×", "😀 — 。", "— … the — … fox — собака", "… собака …", "𐌰𐌱"]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, spans=False).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in range(3)] == [("und", 0.0)] * 3
    assert got[3].lang_pred == "en" and abs(got[3].score - 6 / 18) < 1e-9
    assert got[4].score == 0 and got[5].lang_pred == "en"


def plain_languages(rows, penalty=12.0, share=0.01, bits=16):
    """doc_id: (lang_pred, score), by loops over words and languages."""
    import re
    import zlib

    leads = {**dict.fromkeys([*range(0x61, 0x7B), *range(0xC3, 0xCA)], "latin"), **dict.fromkeys([*range(0xCA, 0xCD), 0xE1], "other"), **dict.fromkeys(range(0xCD, 0xD0), "greek"), **dict.fromkeys(range(0xD0, 0xD4), "cyrillic"), 0xE0: "indic", **dict.fromkeys(range(0xE3, 0xEA), "kana_han")}

    def words(text):
        return [w for w in re.findall(rb"[a-z\x80-\xff]+", cases.lower(text).encode())]

    def cells(w):
        padded = b" " + w + b" "
        return [((padded[i] * 0x10001 + padded[i + 1] * 0x101 * 7 + padded[i + 2]) * 0x9E3779B1 % 2**32) >> (32 - bits) for i in range(len(w))]

    counts, scripts = {}, {}
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            own, kinds = counts.setdefault(lang, {}), scripts.setdefault(lang, {})
            for w in words(text):
                kinds[leads.get(w[0], "common")] = kinds.get(leads.get(w[0], "common"), 0) + 1
                for c in cells(w):
                    own[c] = own.get(c, 0) + 1
    langs, seen = sorted(counts), len({c for own in counts.values() for c in own})
    total = {x: math.log(sum(counts[x].values()) + seen) for x in langs}
    written = {x: {k for k, n in scripts[x].items() if n >= share * sum(scripts[x].values())} for x in langs}
    out = {}
    for i, text, _ in rows:
        best, known, sizes = [], [], []
        for w in words(text or ""):
            may = [x for x in langs if leads.get(w[0], "common") in written[x]]
            value = {x: (sum(math.log(counts[x].get(c, 0) + 1) - total[x] for c in cells(w)) if x in may else -1e6 if may else 0.0) for x in langs}
            last = best[-1][0] if best else None
            step, back = {}, {}
            for x in langs:
                top = max(langs, key=lambda y: last[y]) if last else x  # noqa: B023
                back[x] = top if last and last[top] - penalty > last[x] else x
                step[x] = value[x] + (0 if not last else last[back[x]] - penalty * (back[x] != x))
            best.append((step, back))
            known.append(bool(may))
            sizes.append(len(w) if any(ch.isalpha() for ch in w.decode()) else 0)
        if not any(ch.isalpha() for ch in text or "") or not best:
            out[i] = ("und", 0.0)
            continue
        x, weight = max(langs, key=lambda y: best[-1][0][y]), dict.fromkeys(langs, 0)
        for (_, back), ok, n in zip(reversed(best), reversed(known), reversed(sizes), strict=True):
            weight[x] += n * ok
            x = back[x]
        pred = max(langs, key=lambda y: weight[y])
        out[i] = (pred, weight[pred] / max(1, sum(sizes)))
    return out


def test_languages_match_plain_loops(spark):
    import random

    r = random.Random(12)
    pools = {"en": "the quick brown fox jumps over lazy dogs and then they were with that — “thing”", "fr": "le été çà où élève naïve renard brun saute par-dessus les chiens – paresseux et puis", "ru": "быстрая лиса прыгает через ленивую собаку и потом они были там", "ja": "速い茶色の 狐は 怠け者の 犬を 飛び越える 。 、"}
    some = lambda lang, n: " ".join(r.choice(pools[lang].split()) for _ in range(n))
    rows = [(i, some(lang, 25), lang if i % 9 else None) for i, lang in enumerate(sorted(pools) * 20)]
    rows += [(200 + i, " ".join(some(r.choice(sorted(pools)), r.randint(1, 12)) for _ in range(3)), None) for i in range(40)]
    rows += [(300 + i, t, "en") for i, t in enumerate([None, "", "— … ”", "×", "÷ x", "😀 —", "12 34", "。、", "the", "ßß ǅ", "Ἀ ἄ"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(docs, langid.fit(docs), spans=False).collect()}
    want = plain_languages(rows)
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_viterbi_matches_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(4)
    counts = np.array([5, 1, 0, 4])
    scores = r.normal(0, 3, (10, 3)).astype(np.float32)
    got, at = langid.viterbi(scores, counts, 2.0), 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if n:
            assert math.isclose(value(got[at : at + n]), max(map(value, itertools.product(range(3), repeat=n))), rel_tol=1e-4)
        at += n


def test_quality_learns_and_takes_any_text(spark):
    good, bad = [cases.prose(s, 60) for s in range(120)], [cases.prose(s, 60).upper().replace(" ", "!! ") for s in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    held = {r.doc_id: r.predicted for r in quality.score_quality(docs, model).join(docs.filter("crc32(string(doc_id)) % 5 = 0"), "doc_id").collect()}
    assert sum(p == (i < 120) for i, p in held.items()) >= 0.95 * len(held)
    edges = quality.score_quality(cases.frame(spark), model).collect()
    assert len(edges) == len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in edges)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(cases.frame(spark), None).collect()} == {0.5}
    assert quality.score_quality(cases.empty(spark), model).count() == 0


def test_quality_learns_from_as_many_rows_as_are_short_enough(spark, monkeypatch):
    """Long labelled texts are left out before rows are picked; scores are of long ones too, to their end."""
    docs = spark.createDataFrame([(i, cases.prose(i, 20 if i % 3 else 400)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda texts, label, weights: seen.append((texts, label.tolist())))
    quality.fit(docs, labels, max_rows=20, max_bytes=400)
    quality.fit(docs, labels, max_rows=20, max_bytes=1 << 20)
    assert [len(texts) for texts, _ in seen] == [20, 20] and [label.count(1) for _, label in seen] == [10, 10]
    assert max(map(len, seen[0][0])) <= 400 < max(map(len, seen[1][0]))


def test_quality_scores_the_whole_text_by_direct_convolution():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(8)
    m = quality.Model(r.normal(0, 1, (quality.TAPS, 256, quality.FILTERS)), r.normal(0, 1, quality.FILTERS), r.normal(0, 1, 2 * quality.FILTERS), 0.1)
    for text in ("", "a", cases.prose(1, 10), cases.prose(2, 400), "z" * 256, "z" * 511):
        b = np.frombuffer(text.encode() + bytes(quality.TAPS + 2), np.uint8)
        n = len(text.encode())
        steps = [sum(m.taps[k, b[i + k]] for k in range(quality.TAPS)) for i in range(0, n, 2)]
        halves = [steps[a : a + 128] for a in range(0, max(1, -(-(n + quality.TAPS) // 256) * 128), 128)]
        most = [np.max(h, axis=0) if h else np.full(quality.FILTERS, -np.inf) for h in halves]
        chunks = [np.maximum(np.maximum(x, y) + m.bias, 0) for x, y in zip(most, most[1:] or most, strict=False)]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ m.head + m.offset
        assert abs(quality.scores(pa.array([text]), m)[0] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-4


def test_topics_are_clusters_of_words(spark):
    """Profiles by a plain hash, and texts of two vocabularies, in two languages each, that come out as topics."""
    import random

    import numpy as np
    import pyarrow as pa

    from tidemill.llm import topics

    def bucket(word):
        h = sum((b + 1) * topics.BASE**i for i, b in enumerate(word)) % 2**32
        return h * topics.MULTIPLE % 2**32 >> 28

    texts = [r[1] for r in cases.rows()]
    count, share = topics.profiles_of(pa.array(texts))
    for text, n, got in zip(texts, count, share, strict=True):
        words = cases.lower(text or "").encode().split()
        words = [w for w in words if w]
        assert n == len(words) and np.allclose(got, np.bincount([bucket(w) for w in words], minlength=16) / max(1, n))
    r = random.Random(3)
    pool = {(lang, t): [w for w in cases.prose(t, 3000, 900).split() if bucket(w.encode()) % 2 == t and (len(w) % 2 == 0) == (lang == "a")] for lang in "ab" for t in (0, 1)}
    rows = [(i, " ".join(r.choice(pool[lang, t]) for _ in range(60)), lang, f"s{t}") for i, (lang, t) in enumerate(sorted(pool) * 50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    by = {}
    for x in got:
        by.setdefault(x.topic, set()).add(x.source)
    assert 2 <= len(by) <= topics.TOPICS and all(len(s) == 1 for s in by.values())


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (5 + i % 13), ["en", "de"][i % 2], ["a", "b", "c"][i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.25, "de": 0.75}}
    for cells in (mixing.MAX_CELLS, 0):
        got = mixing.mix(docs, want, sweeps=20 if cells else 4, max_cells=cells).toPandas()
        weighted = got.n_tokens * got.weight
        for dim, shares in want.items():
            for k, share in shares.items():
                assert abs(weighted[got[dim] == k].sum() / weighted.sum() - share) < 1e-3
        assert got.probability.max() == pytest.approx(1.0) and got.kept[got.probability == got.probability.max()].all()
    edges = mixing.mix(cases.frame(spark), keep_row=True).collect()
    assert len(edges) == len(cases.rows()) and all(0 <= r.probability <= 1 + 1e-12 and r.weight >= 0 for r in edges)
    assert all(r.n_tokens == len((r.row.text or "").encode().split()) for r in edges)
    assert mixing.mix(cases.empty(spark)).count() == 0
    # a sample's tokens come near the shares
    tokens = got[got.kept].groupby("lang").n_tokens.sum()
    assert abs(tokens["de"] / tokens.sum() - 0.75) < 0.1
