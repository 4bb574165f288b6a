import zlib

import numpy as np
import pytest

from tests.llm import cases
from tidemill.llm import tokens
from tidemill.llm.queries import tokenizer_path


@pytest.mark.parametrize("limit", [6, 16])
def test_codes_are_optimal_within_the_limit_and_decode(limit):
    r = np.random.default_rng(limit)
    counts = np.zeros(300, np.int64)
    used = r.choice(300, 50, replace=False)
    counts[used] = (1.6 ** r.uniform(0, 30, 50)).astype(int) + 1
    lengths = tokens.code_lengths(counts, limit)
    assert lengths.max() <= limit and set(np.flatnonzero(lengths)) == set(used)
    assert np.sum(2.0 ** -lengths[used]) == pytest.approx(1)
    if limit == 16:
        import heapq

        heap, cost = sorted(counts[used].tolist()), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        free = int((counts * lengths).sum())
        assert free >= cost and (lengths.max() == limit or free == cost)
    symbol, bits = tokens.decode_table(lengths, limit)
    for sizes in ([], [0, 0], [1], [700, 0, 1, 3000], [256], [512, 256]):
        ids = r.choice(used, sum(sizes)).astype(np.uint32)
        data = tokens.encode_block(np.arange(len(sizes)), np.ones(len(sizes), bool), np.array(sizes, int), ids, lengths, tokens.canonical_codes(lengths))
        back = tokens.decode_block(data, symbol, bits, limit)
        assert back.ids.tolist() == ids.tolist() and back.sizes.tolist() == sizes and back.doc_ids.tolist() == list(range(len(sizes)))


def test_one_symbol_and_too_many():
    assert tokens.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert tokens.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        tokens.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_files_read_back_as_the_tokenizer_encodes(spark, tmp_path, name):
    extra = ["don't STOP <|endoftext|> now", "é H̱ x<|startoftext|>", "12 34,56", cases.prose(6, 3000)]
    rows = cases.rows(extra)
    tokenizer = tokens.load_tokenizer(tokenizer_path(name))
    assert tokens.white_space_splits(tokenizer) == (name == "word_bpe_49k.json")
    path = tokens.write_token_files(cases.frame(spark, extra), tokenizer_path(name), str(tmp_path / "out"))
    got = tokens.read_token_files(spark, path).collect()
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert list(r.ids) in want[r.doc_id]
        want[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    assert not any(want.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_files_of_nothing(spark, tmp_path):
    path = tokens.write_token_files(cases.empty(spark), tokenizer_path(), str(tmp_path / "out"))
    assert tokens.read_token_files(spark, path).count() == 0


def test_words_and_their_cuts_give_the_whole_texts_ids():
    import random

    import pyarrow as pa

    from tidemill.llm import bytewise as bw

    r = random.Random(12)
    parts = ["a", "B", "the", "Q", "it's", "'S", "'", "''t", "1", "23", ".", ",", "!!", "--", "<", ">", "=", "̸", "̱", "́", "é", "Ü", "ß", "İ", "K", "—", "…", "日本", "ж", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x00", "\x1c", "\x85", " ", " ", " ", "  ", "\n", "\t", "😀", "ǆ", "ﬁ", "H", "h", "$"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    path = tokenizer_path()
    whole = tokens.load_tokenizer(path)
    for by_sign in (False, True):
        own, at = tokens.WordTokenizer(path, 1, True, by_sign), 0
        for s in bw.slices(pa.array(texts)):
            ids, counts = own.encode(s)
            for t, got in zip(texts[at : at + s.rows], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert got.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], repr(t)
            at += s.rows
