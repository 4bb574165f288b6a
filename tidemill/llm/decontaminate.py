"""Benchmark decontamination by winnowing.

Of each six neighbouring 5-word hashes the least is kept as a fingerprint, in documents and benchmark items alike, so
that any ten words that both hold give both the same fingerprint at the same place. Items of fewer than ten words are
one window and are looked up by the hash of all their words. A shared fingerprint aligns a document with an item; the
alignment is extended to both sides over equal words, and counts where it covers a whole window.

Benchmark fingerprints are looked up in each task while items have at most 2 * MAX_SHARED characters, a checked bound of
some tens of MB; beyond it, documents' fingerprints are joined to them with a shuffle and the found pairs are extended after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bytewise as bw
from tidemill.llm.store import bounded_batches, cut, with_row

WINDOW, GRAM = 10, 5
NEIGHBOURS = WINDOW - GRAM + 1
MAX_SHARED = 2_000_000


def winnow(w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, index of its first word) of each position that holds the least hash of some window of WINDOW words."""
    g = bw.gram_hashes(w.hash, GRAM)
    n = len(g) - NEIGHBOURS + 1
    if n <= 0:
        return g[:0], np.zeros(0, np.int64)
    whole = bw.in_one_row(w, WINDOW)
    least = g[:n].copy()
    for j in range(1, NEIGHBOURS):
        np.minimum(least, g[j : j + n], out=least)
    kept = np.zeros(len(g), bool)
    for j in range(NEIGHBOURS):
        kept[j : j + n] |= (g[j : j + n] == least) & whole
    at = np.flatnonzero(kept)
    return g[at], at


@dataclass
class Postings:
    """The benchmark's fingerprints, sorted, each with its item and word, and the items' words."""

    key: np.ndarray  # uint64
    item: np.ndarray  # index into items
    word: np.ndarray  # index of the first word in the item
    length: np.ndarray  # words of the item that the key covers: GRAM, or all of a short item
    items: list  # item ids as text
    first: np.ndarray  # items + 1
    hashes: np.ndarray


def postings(ids: list, texts: pa.Array) -> Postings:
    keys, items, at, lengths, firsts, hashes = [], [], [], [], [np.zeros(1, np.int64)], []
    total = 0
    for s in bw.slices(texts):
        w = bw.words(s, bw.ALNUM)
        size = np.diff(w.first)
        f, p = winnow(w)
        keys.append(f)
        items.append(s.first + w.row[p])
        at.append(p - w.first[w.row[p]])
        lengths.append(np.full(len(f), GRAM))
        for n in range(1, WINDOW):
            short = np.flatnonzero(size == n)
            if len(short):
                keys.append(bw.gram_hashes(w.hash, n)[w.first[short]])
                items.append(s.first + short)
                at.append(np.zeros(len(short), np.int64))
                lengths.append(np.full(len(short), n))
        firsts.append(total + w.first[1:])
        hashes.append(w.hash)
        total += len(w.hash)
    if not keys:
        z = np.zeros(0, np.int64)
        return Postings(z.astype(np.uint64), z, z, z, [], np.zeros(1, np.int64), z.astype(np.uint64))
    key, item, word, length = (np.concatenate(x) for x in (keys, items, at, lengths))
    order = np.argsort(key, kind="stable")
    return Postings(key[order], item[order], word[order], length[order], ids, np.concatenate(firsts), np.concatenate(hashes))


def _found(w: bw.Words, p: Postings) -> tuple[np.ndarray, np.ndarray]:
    """(index of a document's word, posting) for all equal fingerprints."""
    f, at = winnow(w)
    looked, place = [f], [at]
    size = p.first[p.item + 1] - p.first[p.item]
    for n in np.unique(size[size < WINDOW]).tolist():  # short items are looked up everywhere
        at = np.flatnonzero(bw.in_one_row(w, n))
        looked.append(bw.gram_hashes(w.hash, n)[at])
        place.append(at)
    h, at = np.concatenate(looked), np.concatenate(place)
    lo = np.searchsorted(p.key, h, "left")
    hit = np.flatnonzero((lo < len(p.key)) & (p.key[np.minimum(lo, len(p.key) - 1)] == h)) if len(p.key) else np.zeros(0, np.int64)
    lo = lo[hit]
    many = np.searchsorted(p.key, h[hit], "right") - lo
    return np.repeat(at[hit], many), bw.ranges(lo, many)


def extend(w: bw.Words, p: Postings, word: np.ndarray, posting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, end word) of the distinct maximal runs of equal words that cover a window of their item."""
    item = p.item[posting]
    diagonal = word - p.word[posting]  # where the item's first word would stand
    if not len(word):
        return item, word, word
    pairs = np.unique(np.stack([item, diagonal, word]), axis=1)
    item, diagonal, word = pairs
    base, size = p.first[item], p.first[item + 1] - p.first[item]
    row = w.row[word]
    lo, hi = w.first[row], w.first[row + 1]
    start, end = word.copy(), word.copy()

    def equal(at: np.ndarray, live: np.ndarray) -> np.ndarray:
        q = at - diagonal[live]
        ok = (at >= lo[live]) & (at < hi[live]) & (q >= 0) & (q < size[live])
        return ok & (w.hash[np.clip(at, 0, len(w.hash) - 1)] == p.hashes[np.clip(base[live] + q, 0, len(p.hashes) - 1)])

    live = np.arange(len(word))
    while len(live):
        live = live[equal(end[live], live)]
        end[live] += 1
    live = np.arange(len(word))
    while len(live):
        live = live[equal(start[live] - 1, live)]
        start[live] -= 1
    ok = end - start >= np.minimum(size, WINDOW)
    runs = np.unique(np.stack([item[ok], start[ok], end[ok]]), axis=1)
    return runs[0], runs[1], runs[2]


def _marked(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n words some [start, end) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:n] > 0


def _rows_of(w: bw.Words, rows: int, item: np.ndarray, start: np.ndarray, end: np.ndarray, names: list) -> list[pa.Array]:
    """n_words, n_hit, items and spans of each row."""
    hit = np.bincount(w.row[_marked(len(w.start), start, end)], minlength=rows)
    row = w.row[start]
    order = np.lexsort((end, start, row))
    row, start, end, item = row[order], start[order], end[order], item[order]
    many = np.bincount(row, minlength=rows)
    offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    items = [sorted({names[i] for i in item[offsets[r] : offsets[r + 1]]}) if many[r] else [] for r in range(rows)]
    struct = pa.StructArray.from_arrays([pa.array([names[i] for i in item], pa.string()), pa.array(start - w.first[row]), pa.array(end - w.first[row])], ["item_id", "first_word", "end_word"])
    return [pa.array(np.diff(w.first)), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(offsets), struct)]


_SPANS = "array<struct<item_id: string, first_word: long, end_word: long>>"
_OUT = f"n_words long, n_hit long, items array<string>, spans {_SPANS}"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            for s in bw.slices(b.column("text")):
                w = bw.words(s, bw.ALNUM)
                item, start, end = extend(w, p, *_found(w, p))
                own = b.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *_rows_of(w, s.rows, item, start, end, p.items), *own.columns[2:]], ["doc_id", "n_words", "n_hit", "items", "spans", *b.schema.names[2:]])

    return run


def _fingerprints(lengths: list[int], whole_items: bool):
    """Rows (h1, h2, key): a text's fingerprints, and the hashes of its runs of n words for the given lengths n; of items, where those are the whole item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in bw.slices(b.column("text")):
                w = bw.words(s, bw.ALNUM)
                f, at = winnow(w)
                keys, rows = [f], [w.row[at]]
                size = np.diff(w.first)
                for n in lengths:
                    g = bw.gram_hashes(w.hash, n)
                    at = w.first[:-1][size == n] if whole_items else np.flatnonzero(bw.in_one_row(w, n))
                    keys.append(g[at])
                    rows.append(w.row[at])
                pick = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(keys)]), axis=1)
                row = pa.array(pick[0].astype(np.int64) + s.first)
                yield pa.RecordBatch.from_arrays([b.column("h1").take(row), b.column("h2").take(row), pa.array(pick[1].view(np.int64))], ["h1", "h2", "key"])

    return run


def _extend_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of pairs (h1, h2, text, item_id, item_text)."""
    for b in batches:
        for r in range(b.num_rows):
            p = postings([b.column("item_id")[r].as_py()], b.column("item_text").slice(r, 1))
            for s in bw.slices(b.column("text").slice(r, 1)):
                w = bw.words(s, bw.ALNUM)
                _, start, end = extend(w, p, *_found(w, p))
                if len(start):
                    again = pa.array(np.full(len(start), r))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(again) for c in ("h1", "h2", "item_id")), pa.array(start), pa.array(end)], ["h1", "h2", "item_id", "first_word", "end_word"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their text's number of words in its place."""
    for b in batches:
        at = b.schema.get_field_index("text")
        for s in bw.slices(b.column(at)):
            w = bw.words(s, bw.ALNUM, hashes=False)
            yield b.slice(s.first, s.rows).set_column(at, "n_words", pa.array(np.diff(w.first)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_shared: int = MAX_SHARED, keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans and, if keep_row, row (docs' own columns): one row for each row of docs.

    Words are runs of 0-9, a-z, A-Z (without case) and characters beyond ASCII. A window is ten consecutive words of an
    item; an item of fewer words, but not none, is one window. n_hit counts the document's words inside any occurrence
    of a window; items holds the ids of items with occurring windows, as sorted text; spans the maximal shared runs.

    Null and wordless texts have no words and hit nothing; items of null text or null id are left out. Items of equal
    text are all found; rows that repeat an item_id count once. Rows that repeat a doc_id each give a row. Other
    columns aren't read. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.struct("*").alias("row")] * keep_row)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    # an item gives at most half its length in fingerprints
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= 2 * max_shared:
        got = items.toArrow().combine_chunks()
        p = postings(got.column("item_id").to_pylist(), got.column("text").combine_chunks())
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(p)), with_row(f"doc_id long, {_OUT}", rows))
    return _by_shuffle(rows, items)


def _by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    """As decontaminate() returns it, for benchmarks of any size. Texts go by two 64-bit hashes (the
    constant comes first: it seeds the text's hash); each distinct text is extended once per item."""
    hashed = lambda df: df.withColumns({"text": F.coalesce("text", F.lit(""))}).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    docs, items = hashed(rows), hashed(items).distinct()
    texts, item_texts = docs.select("h1", "h2", "text").dropDuplicates(["h1", "h2"]), items.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    short = [r[0] for r in item_texts.select("text").mapInArrow(_count_words, "n_words long").filter(F.col("n_words").between(1, WINDOW - 1)).distinct().collect()]
    printed = "h1 long, h2 long, key long"
    prints = cut(item_texts.mapInArrow(_fingerprints(short, True), printed), "item-prints").select(F.col("h1").alias("i1"), F.col("h2").alias("i2"), "key")
    pairs = texts.mapInArrow(_fingerprints(short, False), printed).join(prints, "key").select("h1", "h2", "i1", "i2").distinct()
    named = items.select(F.col("h1").alias("i1"), F.col("h2").alias("i2"), "item_id", F.col("text").alias("item_text"))
    both = pairs.join(named, ["i1", "i2"]).join(texts, ["h1", "h2"]).select("h1", "h2", "text", "item_id", "item_text")
    spans = both.mapInArrow(_extend_pairs, "h1 long, h2 long, item_id string, first_word long, end_word long")
    span = "array<struct<first_word: long, end_word: long, item_id: string>>"
    per_text = spans.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("first_word", "end_word", "item_id"))).alias("s"))
    carried = [c for c in ("row",) if c in docs.columns]
    counted = docs.select("doc_id", "h1", "h2", "text", *carried).mapInArrow(_count_words, with_row("doc_id long, h1 long, h2 long, n_words long", docs))
    joined = counted.join(per_text, ["h1", "h2"], "left").withColumn("s", F.coalesce("s", F.array().cast(span)))
    zero = F.lit(0).cast("long")
    hit = F.aggregate("s", F.struct(zero.alias("n"), zero.alias("to")), lambda acc, x: F.struct((acc.n + F.greatest(zero, x.end_word - F.greatest(acc.to, x.first_word))).alias("n"), F.greatest(acc.to, x.end_word).alias("to")), lambda acc: acc.n)
    return joined.select("doc_id", "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("s", lambda x: x.item_id))).alias("items"), F.transform("s", lambda x: F.struct(x.item_id.alias("item_id"), x.first_word.alias("first_word"), x.end_word.alias("end_word"))).alias("spans"), *carried)
