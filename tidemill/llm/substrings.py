"""Repeated substrings across a corpus, cut down to suffix arrays over what can repeat.

A string of 200 bytes is ordered by its least 40-byte hash, its anchor; equal strings have equal anchors at equal
places. Neighbouring strings of a document that share an anchor are one segment, so that each string is in exactly one.
Segments whose anchor is nowhere else need no look; equal segments repeat as a whole and are found by their counts.
What is left, different segments around equal anchors, is dealt into shards by the anchor and the bytes before or after
it, of which a shared string holds 80 on one side at least. In a shard a suffix array is built by Larsson-Sadakane
refinement (ranks of doubled prefixes, only of suffixes not yet told apart), neighbours' common prefixes are measured by
Kasai's scan, and strings as long as that are repeated. An anchor with many segments is dealt into several shards: each
pair of them is merged by binary search of one's strings in the other's suffix array. Beyond MOST_BLOCKS shards, whose
pairs would grow with the square, its strings are counted by their place and a hash instead.

Kasai's scan carries a common prefix, less one byte, from a position to the next; here stretches of the text are scanned
in lockstep, 8 bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bytewise as bw
from tidemill.llm.shards import block_pairs, runs
from tidemill.llm.store import bounded_batches, cut

LENGTH = 200
#: Segments of an anchor in one shard, on average; shards of an anchor whose pairs are all merged.
BLOCK_SEGMENTS, MOST_BLOCKS = 2048, 8
#: Bytes that a table of whole groups holds, or a single group: 100 times as much memory at most.
SHARD_BYTES = 1 << 19
#: Starts of a text that are looked at together, and the bits that number them. Hashes are compared without so many
#: bits, always the same, so that equal strings have equal anchors wherever they stand.
PIECE, PLACE_BITS = 1 << 20, 21
#: Positions that Kasai's scan reads in one go.
STRETCH = 256


def gram_length(length: int) -> int:
    return max(1, length // 5)


def side(length: int) -> int:
    """A string that holds an anchor holds so many bytes before it, or as many after it."""
    return (length - gram_length(length)) // 2


def pieces(s: bw.Slice, length: int) -> Iterator[tuple[bw.Slice, int]]:
    """A slice, or overlapping parts of one of a very long text that hold each string once; with where they begin."""
    most = max(PIECE, 2 * length)
    if len(s.data) <= most:
        yield s, 0
        return
    for a in range(0, len(s.data) - length + 1, most - length + 1):
        data = s.data[a : a + most]
        yield bw.Slice(s.first, data, np.clip(s.offsets - a, 0, len(data))), a


def segments(s: bw.Slice, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, anchor's offset, anchor hash, digest, sides) of each segment of a slice.

    sides holds, in its upper and lower 32 bits, hashes of the side() bytes before and after the anchor, or 0 where no
    string of the segment holds as many there.
    """
    k = gram_length(length)
    w = length - k + 1
    none = np.zeros(0, np.int64)
    n = len(s.data)
    if n < length:
        return (none,) * 7
    prefix = bw.prefix_hashes(s.data)
    at = np.arange(n - k + 1)
    h = bw.span_hashes(prefix, at, at + k)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | at.astype(np.uint64)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    anchor = (least & low).astype(np.int64)  # for each start in the slice
    size = np.maximum(np.diff(s.offsets) - length + 1, 0)
    start = bw.ranges(s.offsets[:-1], size)
    if not len(start):
        return (none,) * 7
    row = np.repeat(np.arange(s.rows), size)
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    begin, a, row = start[first], own[first], row[first]
    digest = bw.span_hashes(prefix, begin, begin + many + length - 1)
    near = side(length)
    sides = np.zeros(len(a), np.uint64)
    for shift, ok, start, end in ((32, a - near >= begin, a - near, a), (0, a + k + near <= begin + many + length - 1, a + k, a + k + near)):
        x = np.flatnonzero(ok)
        half = bw.span_hashes(prefix, start[x], end[x]) >> np.uint64(32)
        sides[x] |= np.maximum(half, np.uint64(1)) << np.uint64(shift)
    return row, begin - s.offsets[row], many, a - begin, h[a].view(np.int64), digest.view(np.int64), sides.view(np.int64)


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, skipped in (x for whole in bw.slices(b.column(1)) for x in pieces(whole, length)):
                row, first, many, off, anchor, digest, sides = segments(s, length)
                place = (first + skipped) << 32 | many << 16 | off
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s.first + row)), pa.array(place), pa.array(anchor), pa.array(digest), pa.array(sides)], ["k", "place", "anchor", "digest", "sides"])

    return run


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, and from the end, as ordered integers; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(n + 1, np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + n + 1]
    return out


def suffix_array(words: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, or in that of their first depth bytes at least; each suffix's rank, shared by those alike).

    words are the data's eights(). Larsson and Sadakane's refinement: a rank by h bytes, with the rank of the suffix h
    further on, gives one by 2 h; a rank is the place of its group's first suffix, and groups of one are not looked at
    again.
    """
    n = len(words) - 1
    depth = n if depth is None else depth
    every = np.arange(n)
    sa = np.argsort(words[:n])
    key = words[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, every, 0))
    rank[sa] = group
    h = 8
    while h < depth:
        alone = new & np.append(new[1:], True)
        place = np.flatnonzero(~alone)
        if not len(place):
            break
        own, old = sa[place], group[place]
        further = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + h + 1, n - own)  # of those that end, the shorter is first
        order = np.argsort(old.astype(np.uint64) << np.uint64(32) | further.astype(np.uint64))
        own, further = own[order], further[order]  # groups stay at their places
        sa[place] = own
        split = np.ones(len(place), bool)
        split[1:] = (old[1:] != old[:-1]) | (further[1:] != further[:-1])
        new[place] = split
        group = np.maximum.accumulate(np.where(new, every, 0))
        rank[own] = group[place]
        h *= 2
    return sa, rank


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first bytes of different eights are equal."""
    d = x ^ y
    out = np.zeros(len(d), np.int64)
    for k in range(1, 8):
        out += d < np.uint64(1 << 8 * (8 - k))
    return out


def kasai(words: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """How many bytes, cap at most, each suffix of an array in full order shares with the one before it; 0 for the first.

    Along the text a position shares at least one byte less with its neighbour than the position before it did with its
    own. Stretches of the text go in lockstep, each from nothing.
    """
    n = len(sa)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    out = np.zeros(n, np.int64)
    begin = np.arange(0, n, STRETCH)
    h = np.zeros(len(begin), np.int64)
    for t in range(min(STRETCH, n)):
        i = begin + t
        if i[-1] >= n:
            begin, h, i = begin[:-1], h[:-1], i[:-1]
        at = place[i]
        j = sa[np.maximum(at - 1, 0)]
        most = np.minimum(cap, n - np.maximum(i, j))  # equal zeros beyond the end don't count
        h = np.maximum(h - 1, 0)
        live = np.flatnonzero((h < most) & (at > 0))
        while len(live):
            x, y = words[i[live] + h[live]], words[j[live] + h[live]]
            same = x == y
            h[live[~same]] += _alike(x[~same], y[~same])
            live = live[same]
            h[live] += 8
            live = live[h[live] < most[live]]
        h = np.where(at > 0, np.minimum(h, most), 0)
        out[at] = h
    return out


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many bytes, cap at most and a multiple of 8 below it, the data has alike from a[i] and b[i] on."""
    out = np.full(len(a), cap, np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 8):
        rest = np.uint64(8 * (8 - min(8, cap - at)))
        x, y = (words[np.minimum(z[live] + at, len(words) - 1)] >> rest for z in (a, b))
        out[live[x != y]] = at
        live = live[x == y]
    return out


def binary_search(words: np.ndarray, sorted_starts: np.ndarray, queries: np.ndarray, length: int) -> np.ndarray:
    """Which strings of length bytes that start at queries equal one that starts at a sorted start."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(sorted_starts), np.int64)
    while len(sorted_starts) and (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        at, q = sorted_starts[mid], queries[live]
        alike = common_prefixes(words, at, q, length)
        differ = alike < length
        less = np.zeros(len(live), bool)
        less[differ] = words[(at + alike)[differ]] < words[(q + alike)[differ]]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
    found = np.minimum(lo, max(0, len(sorted_starts) - 1))
    return (lo < len(sorted_starts)) & (common_prefixes(words, sorted_starts[found], queries, length) >= length) if len(sorted_starts) else np.zeros(len(queries), bool)


def repeated_in_shard(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings that start at starts, ascending, equal another of them."""
    words = eights(data)
    sa, _ = suffix_array(words)
    lcp = kasai(words, sa, length)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    place = np.flatnonzero(wanted[sa])
    hit = np.zeros(len(data), bool)
    if len(place) > 1:
        same = np.minimum.reduceat(lcp[: place[-1] + 1], place[:-1] + 1) >= length  # the least between two wanted ones
        order = sa[place]
        hit[order[1:][same]] = hit[order[:-1][same]] = True
    return hit[starts]


def repeated_across(data: np.ndarray, left: np.ndarray, right: np.ndarray, edge: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of two shards, of the bytes before edge and from edge on, are in the other."""
    words, out = eights(data), []
    for own, other, a, z in ((left, right, edge, len(data)), (right, left, 0, edge)):
        sa, _ = suffix_array(eights(data[a:z]), length)
        wanted = np.zeros(z - a, bool)
        wanted[other - a] = True
        out.append(binary_search(words, sa[wanted[sa]] + a, own, length))
    return out[0], out[1]


def _sizes(t: pa.Table) -> np.ndarray:
    return pc.binary_length(t.column("bytes")).to_numpy().astype(np.int64)


def _many(place: np.ndarray) -> np.ndarray:
    return (place >> 16) & 0xFFFF


def _repeats(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run of an anchor's rows, the starts whose strings other rows of it hold, as (k, first, many)."""
        for t, starts in runs(batches, 3, SHARD_BYTES, _sizes):
            col = lambda name: t.column(name).to_numpy()  # noqa: E731, B023
            i, j, block, k, place, n = (col(c) for c in ("i", "j", "block", "k", "place", "n"))
            whole = next(bw.slices(t.column("bytes"), 1 << 62))
            data, base, size = whole.data, whole.offsets[:-1], np.diff(whole.offsets)
            many = _many(place)
            hit_rows, hit_starts = [], []
            single = i == j
            # all whole groups of the table are one shard, a segment of two groups there once
            own = np.flatnonzero(single)
            order = own[np.lexsort((place[own], k[own]))]
            own = order[np.append(True, (k[order[1:]] != k[order[:-1]]) | (place[order[1:]] != place[order[:-1]]))] if len(own) else own
            if len(own):
                part = data[bw.ranges(base[own], size[own])]
                at = np.cumsum(size[own]) - size[own]
                begin = bw.ranges(at, many[own])
                hit = repeated_in_shard(part, begin, length)
                hit_rows.append(np.repeat(own, many[own])[hit])
                hit_starts.append((begin - np.repeat(at, many[own]))[hit])
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if single[lo]:
                    continue
                sides = [lo + np.flatnonzero(block[lo:hi] == x) for x in (i[lo], j[lo])]
                both = np.concatenate(sides)
                part = data[bw.ranges(base[both], size[both])]
                at = np.cumsum(size[both]) - size[both]
                begin = [bw.ranges(at[x], many[y]) for x, y in ((slice(0, len(sides[0])), sides[0]), (slice(len(sides[0]), None), sides[1]))]
                edge = int(size[sides[0]].sum())
                for side, first, hit, a in zip(sides, begin, repeated_across(part, *begin, edge, length), (at[: len(sides[0])], at[len(sides[0]) :]), strict=True):
                    hit_rows.append(np.repeat(side, many[side])[hit])
                    hit_starts.append((first - np.repeat(a, many[side]))[hit])
            if not hit_rows:
                continue
            row, first = np.concatenate(hit_rows), np.concatenate(hit_starts)
            keep = n[row] == 1  # others are repeated as a whole
            row, first = row[keep], first[keep]
            order = np.lexsort((first, row))
            row, first = row[order], first[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
            begin = np.flatnonzero(new)
            length_of = np.diff(np.append(begin, len(row)))
            yield pa.RecordBatch.from_arrays([pa.array(k[row[begin]]), pa.array((place[row[begin]] >> 32) + first[begin]), pa.array(length_of)], ["k", "first", "many"])

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each string of a segment: its place relative to the anchor, its hash, and where it starts."""
        for b in batches:
            place = b.column("place").to_numpy()
            for s in bw.slices(b.column("bytes")):
                own = slice(s.first, s.first + s.rows)
                many = _many(place[own])
                row = np.repeat(np.arange(s.rows), many)
                begin = bw.ranges(s.offsets[:-1], many)
                at = begin - s.offsets[row]
                hashes = bw.span_hashes(bw.prefix_hashes(s.data), begin, begin + length)
                take = pa.array(s.first + row)
                cols = [b.column("anchor").take(take), b.column("k").take(take), pa.array((place[own] & 0xFFFF)[row] - at), pa.array(hashes.view(np.int64)), pa.array((place[own] >> 32)[row] + at), b.column("n").take(take)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "k", "off", "hash", "first", "n"])

    return run


def _cut_out(length: int):
    """The bytes of wanted segments: rows (k, wanted list, text) to a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column("wanted")
            many = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            row = np.repeat(np.arange(b.num_rows), many)
            place = flat.field("place").to_numpy()
            texts = [x.as_py().encode() for x in b.column("text")]
            first = (place >> 32).tolist()
            ends = ((place >> 32) + ((place >> 16) & 0xFFFF) + length - 1).tolist()
            data = pa.array([texts[r][a:z] for r, a, z in zip(row.tolist(), first, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), b.column("k").take(pa.array(row)), pa.array(place), flat.field("n"), flat.field("blocks"), data], ["anchor", "k", "place", "n", "blocks", "bytes"])

    return run


def _strip(length: int, kept_too: bool):
    """What is left of each text without the bytes under its repeated starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, spans, sha, kept = [], [], [], [], []
            for text, found in zip(b.column("text"), b.column("found"), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                if found.is_valid:
                    first, many = found.values.field("first").to_numpy(), found.values.field("many").to_numpy()
                    np.add.at(step, first, 1)
                    np.add.at(step, first + many + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                n_bytes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                rest = data[~gone].tobytes()
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * kept_too, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept_too])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes): one row for each row of docs.

    Texts are UTF-8 bytes, null ones empty. A byte goes if a string of length bytes that covers it also starts anywhere
    else, in the same document or another; all strings are judged on the input. n_spans counts maximal removed runs.
    kept can end within a character and is therefore binary.

    Texts shorter than length lose nothing. Copies of a text, also rows that repeat a doc_id, are strings elsewhere to
    each other. Null doc_ids give rows like any others. Other columns aren't read.
    """
    if not 8 <= length < 1 << 16:
        raise ValueError(f"length {length}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a row is known by its doc_id, or, if those repeat or miss, by a hash of doc_id and text: equal rows lose the same
    plain = rows.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()
    rows = rows.withColumn("k", F.col("doc_id") if plain else F.xxhash64("doc_id", "text"))
    every = rows.select("k", "text").mapInArrow(_segments(length), "k long, place long, anchor long, digest long, sides long")
    shape = (F.col("place") % (1 << 32)).alias("shape")
    again = cut(every.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1").select("anchor"), "repeated-anchors")
    live = cut(every.join(again, "anchor"), "segments")  # of both sides exchanged, a frequent anchor's can be split
    distinct = live.groupBy("anchor", "digest", shape, "sides").agg(F.count("*").alias("n"), F.min(F.struct("k", "place")).alias("one"))
    distinct = cut(distinct, "distinct-segments")
    # different segments can only share a string if they share the bytes on one side of the anchor
    halves = F.array_compact(F.array(F.when(F.shiftright("sides", 32) != 0, F.xxhash64("anchor", F.shiftright("sides", 32))), F.when(F.col("sides").bitwiseAND(2**32 - 1) != 0, F.xxhash64("anchor", F.col("sides").bitwiseAND(2**32 - 1), F.lit(1)))))
    grouped = distinct.select(F.explode(halves).alias("anchor"), "one.k", "one.place", "n")
    several = cut(grouped.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1").select("anchor", F.ceil(F.col("m") / BLOCK_SEGMENTS).alias("blocks")), "shared-sides")
    look = grouped.join(several, "anchor").select("anchor", "k", "place", "n", "blocks")
    wanted = look.groupBy("k").agg(F.collect_list(F.struct("anchor", "place", "n", "blocks")).alias("wanted"))  # bounded by the document
    cut_out = rows.select("k", "text").join(wanted, "k").select("k", "wanted", "text").mapInArrow(_cut_out(length), "anchor long, k long, place long, n long, blocks long, bytes binary")
    large = not several.filter(F.col("blocks") > MOST_BLOCKS).isEmpty()
    if large:
        cut_out = cut(cut_out, "cut-out")
    dealt = block_pairs(cut_out.filter(F.col("blocks") <= MOST_BLOCKS), "blocks", ["anchor"], "k", "place").select("anchor", "i", "j", "block", "k", "place", "n", "bytes")
    partly = dealt.mapInArrow(_repeats(length), "k long, first long, many long")
    if large:
        strings = cut_out.filter(F.col("blocks") > MOST_BLOCKS).mapInArrow(_strings(length), "anchor long, k long, off long, hash long, first long, n long")
        string = ["anchor", "off", "hash"]
        repeated = cut(strings.groupBy(*string).agg(F.count("*").alias("c")).filter("c > 1").select(*string), "repeated-strings")
        partly = partly.union(strings.filter("n = 1").join(repeated, string, "left_semi").select("k", "first", F.lit(1).cast("long").alias("many")))
    whole = live.join(distinct.filter("n > 1").select("anchor", "digest", "shape"), (live.anchor == distinct.anchor) & (live.digest == distinct.digest) & (live.place % (1 << 32) == F.col("shape")), "left_semi")
    found = whole.select("k", F.shiftright("place", 32).alias("first"), (F.shiftright("place", 16).bitwiseAND(0xFFFF)).alias("many")).union(partly)
    per_row = found.groupBy("k").agg(F.collect_list(F.struct("first", "many")).alias("found"))  # bounded by the document
    final = rows.join(per_row, "k", "left").select("doc_id", "text", "found")
    return final.mapInArrow(_strip(length, kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
