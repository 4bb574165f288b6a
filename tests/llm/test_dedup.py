import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tidemill.llm import bytewise as bw
from tidemill.llm import components, exact_dedup, near_dedup, substrings
from tidemill.llm.components import connected_components
from tidemill.llm.shards import runs


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def expected_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    up = {i: i for i, _ in sets if i is not None}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(up, i), find(up, j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), None if i is None else find(up, i)) for i, s in sets if i is not None), [len(s) for i, s in sets if i is None]


@pytest.mark.parametrize(("block", "most", "sets"), [(None, 16, 2), (8, 16, 100), (8, 1, 1)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block, most, sets):
    monkeypatch.setattr(near_dedup, "MOST_BLOCKS", most)
    monkeypatch.setattr(near_dedup, "MOST_SET_BLOCKS", sets)
    if block:  # many blocks of few
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    extra = cases.near_copies(11, 60) + cases.near_copies(12, 25) + [cases.prose(s, 80) + " " + cases.prose(99, 25) for s in range(40)]
    rows = cases.rows(extra)
    got = near_dedup.near_duplicates(cases.frame(spark, extra)).collect()
    want, unknown = expected_components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == sorted(unknown)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_duplicates(cases.empty(spark), percent=50)


def test_clusters_whose_hub_connects_little(spark, monkeypatch):
    """Two families that chains of copies tie together: most of a cluster are strays, of which some are linked."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(near_dedup, "MOST_SET_BLOCKS", 0)
    words = cases.prose(51, 160).split()
    chain = []
    for i in range(30):  # each a few words from the one before, the last nothing like the first
        words[5 * i : 5 * i + 4] = [f"x{i}{k}" for k in range(4)]
        chain.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(chain + chain[::7] + cases.near_copies(52, 20))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = expected_components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want and len({c for *_, c in want}) < 20


def test_signatures_within_the_distance_share_a_key(spark):
    """The pigeonhole guarantee, for any signatures at most MAX_DISTANCE apart."""
    r = np.random.default_rng(3)
    a = r.integers(0, 2**16, (200, near_dedup.SLOTS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[r.choice(near_dedup.SLOTS, near_dedup.MAX_DISTANCE, replace=False)] ^= 1
    pack = lambda x: x.view(np.int64).reshape(len(x), -1).tolist()
    df = spark.createDataFrame(list(zip(pack(a), pack(b), strict=True)), "a array<long>, b array<long>")
    shared = df.select(near_dedup._masked_keys(df.a).alias("a"), near_dedup._masked_keys(df.b).alias("b")).selectExpr("arrays_overlap(a, b) AS ok")
    assert shared.filter("ok").count() == 200


@pytest.mark.parametrize("few", [components.SMALL, 0])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(components, "SMALL", few)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("split", [1, 128])
def test_exact_duplicates(spark, monkeypatch, keep, split):
    monkeypatch.setattr(exact_dedup, "MIN_SPLIT", split)
    extra = ["Same TEXT é"] * 30 + ["same text É", "same text é"]
    rows = cases.rows(extra)
    got = exact_dedup.exact_duplicates(cases.frame(spark, extra), keep=keep).collect()
    groups = {}
    for r in rows:
        groups.setdefault(cases.lower(r[1] or ""), []).append(r[0])
    best = min if keep == "smallest" else max
    want = sorted((str(i), str(best((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_duplicates(cases.empty(spark)).count() == 0


def expected_repeats(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for j in range(len(b) - length + 1):
            k = b[j : j + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "block", "most"), [(40, None, 8), (40, 2, 100), (40, 2, 1), (200, None, 8), (200, 3, 100), (9, None, 8)])
def test_repeats_match_brute_force(spark, monkeypatch, length, block, most):
    if block:
        monkeypatch.setattr(substrings, "BLOCK_SEGMENTS", block)
        monkeypatch.setattr(substrings, "MOST_BLOCKS", most)
    shared = cases.prose(77, 60)
    extra = [cases.prose(s, 20) + shared[s : 260 + s] + cases.prose(s + 50, 20) for s in range(12)] + ["abcabcabc" * 60, "xabcabcabc" * 50, "\x00" * 450, cases.prose(5, 50) * 3]
    rows = [r for r in cases.rows(extra) if r[1] is None or len(r[1]) < 50_000]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    got = substrings.remove_repeats(df, length=length).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected_repeats([r[1] for r in rows], length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.remove_repeats(cases.empty(spark)).count() == 0


def test_repeats_of_unique_ids_and_a_very_long_text(spark):
    long = cases.prose(8, 40_000)
    df = spark.createDataFrame([(1, long), (2, long[1000:1300] + "!"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(df).collect()}
    assert got == {1: (len(long), 300, 1), 2: (301, 300, 1), 3: (0, 0, 0)}


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(1)
    data = np.concatenate([r.integers(97, 100, 300), np.full(90, 97), r.integers(97, 99, 200)]).astype(np.uint8)
    raw = data.tobytes()
    for part in (data, data[300:390], np.zeros(40, np.uint8), data[:1]):
        words = substrings.eights(part)
        sa, _ = substrings.suffix_array(words)
        assert sa.tolist() == sorted(range(len(part)), key=lambda i: part.tobytes()[i:])  # noqa: B023
        same = [len(os.path.commonprefix([part.tobytes()[a:], part.tobytes()[b:]])) for a, b in zip(sa, sa[1:], strict=False)]
        assert substrings.kasai(words, sa, 50).tolist() == [0, *(min(x, 50) for x in same)]
    hit = substrings.repeated_in_shard(data, np.arange(len(data) - 39), 40)
    assert hit.tolist() == [raw.count(raw[i : i + 40]) > 1 or raw.find(raw[i : i + 40], i + 1) >= 0 or raw.find(raw[i : i + 40]) < i for i in range(len(data) - 39)]


def test_equal_strings_have_equal_anchors_wherever_they_stand(monkeypatch):
    text = cases.prose(31, 300).encode()
    anchors = lambda data: [(h, off - t) for s, _ in substrings.pieces(bw.Slice(0, np.frombuffer(data, np.uint8), np.array([0, len(data)])), 200) for _, _, many, off, h, *_ in [substrings.segments(s, 200)] for many, off, h in zip(many, off, h, strict=True) for t in range(many)]
    own = anchors(text)
    assert len(own) == len(text) - 199
    long = cases.prose(32, 20_000).encode()
    assert anchors(long + text)[-len(own) :] == own
    monkeypatch.setattr(substrings, "PIECE", 700)
    assert anchors(text) == own and anchors(long + text)[-len(own) :] == own


def test_runs_keep_to_their_target():
    r = np.random.default_rng(9)
    key = np.sort(np.concatenate([r.integers(0, 900, 40_000), np.full(3000, 450)]))
    table = pa.table({"k": key, "v": np.arange(len(key))})
    for weigh in (None, lambda t: t.column("v").to_numpy() % 5):
        at = 0
        for t, starts in runs(iter(table.to_batches(700)), 1, 1000, weigh):
            k, own = t.column("k").to_numpy(), t.num_rows if weigh is None else int(weigh(t).sum())
            assert t.column("v").to_numpy().tolist() == list(range(at, at + t.num_rows))
            assert starts.tolist() == np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist()
            assert own <= 1000 or len(starts) == 1
            at += t.num_rows
            assert at == len(key) or key[at] != key[at - 1]
        assert at == len(key)


@pytest.mark.parametrize("seed", range(4))
def test_large_keys_connect_what_is_near(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 7)
    r = np.random.default_rng(seed)
    sigs = r.integers(0, 2**16, (3, near_dedup.SLOTS), dtype=np.uint16)[r.integers(0, 3, 60)]
    for row in sigs:
        at = r.choice(near_dedup.SLOTS, r.integers(0, 34), replace=False)
        row[at] = r.integers(0, 2**16, len(at))
    rows = [(k, i, min(range(k, 60, 2)), s) for k in (0, 1) for i, s in enumerate(sigs.view(np.int64).reshape(60, -1).tolist()) if i % 2 == k]
    up = list(range(60))
    for i in range(60):
        for j in range(i % 2, i, 2):
            if (sigs[i] != sigs[j]).sum() <= near_dedup.MAX_DISTANCE:
                p, q = find(up, i), find(up, j)
                up[max(p, q)] = min(p, q)
    members = spark.createDataFrame(rows, "key long, doc_id long, hub long, sig array<long>")
    edges = near_dedup._large_keys(members, spark.createDataFrame([], "a long, b long"))
    got = {x.node: x.component for x in connected_components(edges).collect()}
    assert [got.get(i, i) for i in range(60)] == [find(up, i) for i in range(60)]
    assert len({find(up, i) for i in range(60)}) > 4
