"""Token ids of documents in compact files: canonical length-limited Huffman codes in independent blocks.

Documents are range-partitioned by doc_id and tokenised in that order; global counts of ids give one code book. A file
is a table of blocks in the shared folder or wherever the caller names. A block stands for itself but for the code
book:

    4 bytes "TMH1"; uint32 documents, ids, ids between checkpoints, checkpoints
    int64 doc_id of each document; uint8 whether it is known; uint32 ids of each document
    uint32 bit offset of each checkpoint; codes, from the highest bit of big-endian uint64 words on, and one word of 0

Decoding reads a code's symbol and length from a table by the next MAX_BITS bits, for all checkpoints in lockstep.

Words between ASCII white space are tokenised once and remembered by a 64-bit hash, in a table of bounded size; this
equals tokenising whole texts for a tokenizer whose tokens never hold white space, which white_space_splits() checks.
Where signs_split() finds that tokens don't cross from letters to signs either, and that case counts for nothing, words
are cut there and lower-cased, so that there are fewer different ones.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bytewise as bw
from tidemill.llm.store import bounded_batches, cut, new_path, width

MAX_BITS, CHECKPOINT = 16, 256
#: Bytes of text of a block, so that decoding has many checkpoints to go along; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Remembered words (a power of two), and ids that they may have in all before all are forgotten.
CACHE_BITS, CACHE_IDS = 22, 1 << 24


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def white_space_splits(tokenizer) -> bool:
    """Whether no token crosses white space and white space itself gives none."""
    probe = ["the", "o'clock", "7", "é", "é", "!?", "x", "́y", "ßS", "<|endoftext|>"]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in probe for b in probe for gap in (" ", "\n", " \t ", "\r\x0b\x0c"))


#: Kinds of bytes within words: letters, digits, signs that tokens never share with them, and all others.
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 0
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x27, 0x3C]] = _OTHER  # contractions; special tokens


def signs_split(tokenizer) -> bool:
    """Whether letters, digits and signs of ASCII, but for ' and words with <, never share a token, and case counts for nothing."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    signs = [chr(c) for c in range(0x21, 0x7F) if _KIND[c] == _SIGN]
    probe = ["word", "wordé", "12", "x"]
    if any(not t.content.startswith("<") for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    cuts = [(a, b) for x in signs for y in (x, x + "-", x * 3) for w in probe for a, b in ((w if w[-1] < "\x7f" else w[0], y), (y, w))] + [("ab", "12"), ("1", "ab"), ("1", "a")]
    return all(ids(a + b) == ids(a) + ids(b) for a, b in cuts) and all(ids(w.upper()) == ids(w) for w in ("word", "aqz", "t'sre"))


def units(s: bw.Slice, by_sign: bool) -> tuple[bw.Words, np.ndarray]:
    """Words between white space, with by_sign also cut where kinds of bytes change, and the bytes that they stand for:
    with by_sign those of lower case, but of letters before a byte beyond ASCII, which may be a mark on them."""
    if not by_sign:
        return bw.words(s, bw.NOT_SPACE, lower=False), s.data
    data = s.data
    low = bw.LOWER[data]
    if len(data):
        marked = np.append(data[1:] >= 0x80, False)
        low[marked] = data[marked]
    w = bw.words(bw.Slice(s.first, low, s.offsets), bw.NOT_SPACE, lower=False, hashes=False)
    tags = np.flatnonzero(data == 0x3C)
    whole = np.zeros(len(w.start) + 1, bool)  # words with < stay as they are
    whole[np.searchsorted(w.start, tags, "right") - 1] = True
    whole = whole[: len(w.start)]
    raw = bw.ranges(w.start[whole], (w.end - w.start)[whole])
    low[raw] = data[raw]
    kind = _KIND[data]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    if len(cut):
        word = np.searchsorted(w.start, cut, "right") - 1
        inside = (word >= 0) & (cut > w.start[word]) & (cut < w.end[word]) & ~whole[word]
        cut, word = cut[inside], word[inside]
        start, end = np.concatenate([w.start, cut]), np.concatenate([w.end, cut])
        start.sort()
        end.sort()
        first = np.searchsorted(start, s.offsets)
        first[-1] = len(start)
        w = bw.Words(start, end, np.repeat(np.arange(s.rows), np.diff(first)), first)
    w.hash = bw.span_hashes(bw.prefix_hashes(low), w.start, w.end)
    return w, low


class WordTokenizer:
    """Tokenises slices of texts, word by word where by_word, and those cut by_sign."""

    def __init__(self, path: str, end_id: int, by_word: bool, by_sign: bool):
        self.tokenizer, self.by_word, self.by_sign, self.end_id = load_tokenizer(path), by_word, by_sign, end_id
        self.key = np.zeros(1 << CACHE_BITS, np.uint64)
        self.at = np.zeros(1 << CACHE_BITS, np.int32)
        self.size = np.full(1 << CACHE_BITS, -1, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.forget()

    def forget(self) -> None:
        self.size[:] = -1
        self.pool[0] = self.end_id
        self.used = 1

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum())), size

    def _keep(self, ids: np.ndarray) -> int:
        at = self.used
        self.used += len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def encode(self, s: bw.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, each row's count), the end id after each row's."""
        if not self.by_word:
            raw = s.data.tobytes()
            ids, size = self._encode([raw[a:b].decode() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)])
            return np.insert(ids, np.cumsum(size), self.end_id), size + 1
        if self.used > CACHE_IDS:
            self.forget()
        w, data = units(s, self.by_sign)
        slot = (w.hash >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        hit = (self.key[slot] == w.hash) & (self.size[slot] >= 0)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, first, back = np.unique(w.hash[miss], return_index=True, return_inverse=True)
            where, raw = miss[first], data.tobytes()
            ids, n = self._encode([raw[a:b].decode() for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)])
            begin = self._keep(ids) + np.cumsum(n) - n
            at[miss], size[miss] = begin[back], n[back]
            self.key[slot[where]], self.at[slot[where]], self.size[slot[where]] = new, begin, n
        # a unit for each word, and one of the end id for each row
        begins = np.zeros(len(at) + s.rows, np.int64)
        sizes = np.ones(len(begins), np.int64)
        place = np.arange(len(at)) + w.row
        begins[place], sizes[place] = at, size
        counts = np.add.reduceat(sizes, w.first[:-1] + np.arange(s.rows)) if s.rows else sizes[:0]
        return self.pool[bw.ranges(begins, sizes)], counts


#: Of this process, so that what a worker remembers lasts from task to task.
_tokenizers: dict[tuple, WordTokenizer] = {}


def _tokenizer(*how) -> WordTokenizer:
    if how not in _tokenizers:
        _tokenizers[how] = WordTokenizer(*how)
    return _tokenizers[how]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most limit bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))  # of the items in order, which are leaves
        both = both[by]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take = 2 * len(leaves) - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend with (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for bits in np.unique(lengths[order]).tolist():
        own = order[lengths[order] == bits]
        code <<= bits - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), bits
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) by the next limit bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    fill = np.left_shift(1, limit - lengths[order])
    symbol, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    symbol[: fill.sum()], bits[: fill.sum()] = np.repeat(order, fill), np.repeat(lengths[order], fill)
    return symbol, bits


def encode_block(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits = lengths[ids]
    ends = np.cumsum(bits)
    total = int(ends[-1]) if len(ends) else 0
    begin = ends - bits
    words = np.zeros((total + 63) // 64 + 1, np.uint64)
    if len(ids):
        code, word, room = codes[ids], begin >> 6, 64 - (begin & 63)
        over = bits - room  # bits that go to the next word
        fits = over <= 0
        own = np.where(fits, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        new = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[new]] = np.bitwise_or.reduceat(own, new)
        rest = np.flatnonzero(~fits)
        words[word[rest] + 1] |= code[rest] << (64 - over[rest]).astype(np.uint64)
    points = begin[::CHECKPOINT].astype("<u4")
    head = np.array([len(doc_ids), len(ids), CHECKPOINT, len(points)], "<u4")
    return b"".join([b"TMH1", head.tobytes(), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), points.tobytes(), words.astype(">u8").tobytes()])


@dataclass
class Block:
    doc_ids: np.ndarray
    known: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray


def decode_block(data: bytes, symbol: np.ndarray, table_bits: np.ndarray, limit: int = MAX_BITS) -> Block:
    if data[:4] != b"TMH1":
        raise ValueError("not a block of token ids")
    docs, n, step, points = np.frombuffer(data, "<u4", 4, 4).tolist()
    at = 20
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs).astype(bool)
    sizes = np.frombuffer(data, "<u4", docs, at := at + docs)
    bit = np.frombuffer(data, "<u4", points, at := at + 4 * docs).astype(np.int64)
    words = np.frombuffer(data, ">u8", offset=at + 4 * points).astype(np.uint64)
    out = np.zeros(points * step, np.uint32)
    lanes, last = np.arange(points) * step, points - 1
    for k in range(step):
        if points and last * step + k >= n:
            lanes, bit, last = lanes[:last], bit[:last], last - 1
            if not len(lanes):
                break
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        peek = (words[word] << shift | (words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift)) >> np.uint64(64 - limit)
        out[lanes + k] = symbol[peek]
        bit = bit + table_bits[peek]
    return Block(doc_ids, known, sizes, out[:n])


_BLOCKS = "pid int, before long, n_ids long, doc_ids array<long>, sizes array<int>, ids binary"


def _tokenise(path: str, end_id: int, by_word: bool, by_sign: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, tokenizer = TaskContext.get().partitionId(), 0, _tokenizer(path, end_id, by_word, by_sign)
        for b in batches:
            for s in bw.slices(b.column(1), BLOCK_BYTES):
                ids, sizes = tokenizer.encode(s)
                one = lambda x, t: pa.array([x], t)
                yield pa.RecordBatch.from_arrays(
                    [one(pid, pa.int32()), one(before, pa.int64()), one(len(ids), pa.int64()), pa.ListArray.from_arrays(pa.array([0, s.rows], pa.int32()), b.column(0).slice(s.first, s.rows)), bw.list_array(sizes, np.array([s.rows]), pa.int32()), one(ids.astype(kind).tobytes(), pa.binary())],
                    ["pid", "before", "n_ids", "doc_ids", "sizes", "ids"],
                )
                before += len(ids)

    return run


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """A written table of blocks of token ids in ascending doc_id order, and the size of the vocabulary."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = load_tokenizer(tokenizer_path)
    vocabulary = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a repeated doc_id is split by its texts
    dealt = rows.repartitionByRange(width(spark), "doc_id", F.crc32(F.coalesce("text", F.lit("")))).sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit(""))), "text")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    return cut(dealt.mapInArrow(_tokenise(tokenizer_path, end_id, white_space_splits(tokenizer), signs_split(tokenizer), kind), _BLOCKS), "tokens"), vocabulary


def _count(kind: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return run


def _encode(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        for b in batches:
            for r in range(b.num_rows):
                doc_ids = b.column("doc_ids")[r].values
                known = np.array(doc_ids.is_valid())
                data = encode_block(doc_ids.fill_null(0).to_numpy(), known, b.column("sizes")[r].values.to_numpy(), np.frombuffer(b.column("ids")[r].as_buffer(), kind), lengths, codes)
                yield pa.RecordBatch.from_arrays([b.column("pid").slice(r, 1), b.column("before").slice(r, 1), b.column("n_ids").slice(r, 1), pa.array([data], pa.binary())], ["pid", "before", "n_ids", "block"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenise docs and write {path}/codes and {path}/blocks; read_token_files() reads them back.

    Texts are encoded whole, without special tokens, and end_id follows each. Null texts count as empty. Documents
    stand in ascending doc_id order, null ones first, rows of one doc_id by their text; every row is written. Other
    columns aren't read. An empty table gives empty files.
    """
    spark = docs.sparkSession
    blocks, vocabulary = token_blocks(docs, tokenizer_path, end_id, id_col, text_col)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    limit = max(MAX_BITS, vocabulary.bit_length() + 1)
    counts = np.zeros(vocabulary, np.int64)
    for r in blocks.select("ids").mapInArrow(_count(kind, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    # ids before each partition: a row for each partition
    totals = sorted(blocks.groupBy("pid").agg(F.sum("n_ids").alias("n")).collect())
    offsets, at = {}, 0
    for pid, n in totals:
        offsets[pid] = at
        at += n
    book = spark.createDataFrame([(limit, [int(x) for x in lengths], offsets)], "max_bits int, lengths array<int>, offsets map<int, long>")
    book.coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    blocks.mapInArrow(_encode(shared, kind), "pid int, before long, n_ids long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _read(shared, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, bits, limit, offsets = shared.value
        for b in batches:
            for r in range(b.num_rows):
                x = decode_block(b.column("block")[r].as_py(), symbol, bits, limit)
                sizes = x.sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                ids = x.ids.astype("<u4")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                start = offsets[b.column("pid")[r].as_py()] + b.column("before")[r].as_py() + ends - sizes
                cols = [pa.array(x.doc_ids, pa.int64(), mask=~x.known), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids_too:
                    cols.append(bw.list_array(ids.astype(np.int64), sizes, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 and ids, from written files."""
    bounded_batches(spark)
    book = spark.read.parquet(f"{path}/codes").first()
    symbol, bits = decode_table(np.array(book["lengths"], np.int64), book["max_bits"])
    shared = spark.sparkContext.broadcast((symbol, bits, book["max_bits"], dict(book["offsets"])))
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_read(shared, ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def token_files_of(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write docs' token files to the shared folder and read them back, without the ids."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer_path, new_path(spark, "token-files"), end_id), ids=False)
