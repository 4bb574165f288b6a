"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, links confirmed on whole shingle sets.

A signature is 64 minima of 16 bits each, packed into 16 chunks of four. Two documents of Jaccard similarity s agree in
a slot with probability s, so at 0.75 the distance (slots that differ) is 16 on average, and over 31 with a
probability of about 1.5e-5. By pigeonhole two signatures at most 31 apart have a chunk with at most one differing
slot; a key for each chunk and each slot left out therefore meets every such pair, whatever the data.

Keys that hold the same documents are processed once. Inside a key, signatures are compared in numpy with all others
of the key, and only edges that join what is not joined yet leave it. Connected documents form a cluster, whose shingle
sets are compared exactly, again with only joining links kept. Keys and clusters are cut into blocks, and each pair of
blocks is a task of its own: no group meets in one task, no pair is dropped. In a key or cluster beyond a size each
member is first compared with its hub, and only the strays, which are not connected with it so far, with all.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bytewise as bw
from tidemill.llm.components import connected_components
from tidemill.llm.shards import block_pairs, runs
from tidemill.llm.store import bounded_batches, cut, drop, width

SLOTS, PER_CHUNK, BITS = 64, 4, 16
CHUNKS = SLOTS // PER_CHUNK
MAX_DISTANCE = 2 * CHUNKS - 1
SHINGLE = 5
#: Documents of one key, and shingles of one cluster, that a block holds on average; blocks of a key, and of a cluster,
#: whose pairs are all compared. In a larger one, most of which its hub connects, only strays are.
BLOCK_DOCS, BLOCK_SHINGLES, MOST_BLOCKS, MOST_SET_BLOCKS = 1024, 1 << 17, 16, 2
#: The least similarity, in per cent, for which signatures within MAX_DISTANCE hold nearly every pair.
LEAST_PERCENT = 75

_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 2**32, (2, SLOTS), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, SLOTS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, k: int = SHINGLE, limit: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, flat sorted hashes, each row's count) of rows' sets of distinct k-word shingles."""
    for s in bw.slices(texts, limit):
        w = bw.words(s, bw.NOT_SPACE)
        grams = bw.gram_hashes(w.hash, k)
        good = bw.in_one_row(w, k)
        h, row = grams[good], w.row[: len(good)][good]
        size = np.diff(w.first)
        for n in range(1, k):  # fewer words than k: the whole sequence
            short = np.flatnonzero(size == n)
            if len(short):
                h = np.concatenate([h, bw.gram_hashes(w.hash, n)[w.first[short]]])
                row = np.concatenate([row, short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield s.first, h[new], np.bincount(row[new], minlength=s.rows)


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A (rows, CHUNKS) int64 array; rows with an empty set are zero."""
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), SLOTS), np.uint16)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        x = (bw.mix(h) >> np.uint64(32)).astype(np.uint32)
        for k in range(SLOTS):
            y = (x ^ _XOR[k]) * _MUL[0, k]
            y ^= y >> np.uint32(15)
            y *= _MUL[1, k]
            least = np.minimum.reduceat(y, starts)
            out[full, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out.view(np.int64).reshape(len(counts), CHUNKS)


def digests(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's set, as a (2, rows) int64 array."""
    ends = np.cumsum(counts)
    out = []
    for each in (h, bw.mix(h ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(each, out=total[1:])
        out.append(bw.mix(total[ends] - total[ends - counts]).view(np.int64))
    return np.stack(out)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, h, counts in shingle_sets(b.column(1)):
            n = len(counts)
            digest = digests(h, counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(first, n), pa.array(counts, pa.int64()), pa.array(digest[0]), pa.array(digest[1]), bw.list_array(signatures(h, counts).ravel(), np.full(n, CHUNKS), pa.int64())],
                ["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def _masked_keys(sig: Column) -> Column:
    """A key for each chunk with each of its slots left out."""
    keys = []
    for c in range(CHUNKS):
        for drop in range(PER_CHUNK):
            mask = ~(((1 << BITS) - 1) << (BITS * drop)) & (2**64 - 1)
            keys.append(F.xxhash64(sig[c].bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)), F.lit(c * PER_CHUNK + drop)))
    return F.array(*keys)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _sigs(t: pa.Table) -> np.ndarray:
    flat = t.column("sig").combine_chunks().flatten().to_numpy()
    return np.ascontiguousarray(flat).reshape(t.num_rows, CHUNKS)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(a).view(np.uint16) != np.ascontiguousarray(b).view(np.uint16)).sum(axis=1)


class _Joined:
    """A union-find over rows whose find() is an array operation."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of a key's rows, edges that span the graph of signatures at most MAX_DISTANCE apart."""
    for t, starts in runs(batches, 3):
        doc, sig, block = _column(t, "doc_id"), _sigs(t), _column(t, "block")
        two_blocks = _column(t, "i") != _column(t, "j")
        run = np.zeros(t.num_rows, np.int64)
        run[starts] = 1
        run = np.cumsum(run)
        longest = int(np.diff(np.append(starts, t.num_rows)).max())
        joined, a, b = _Joined(t.num_rows), [], []
        for shift in range(1, longest):
            top = joined.flatten()
            i = np.flatnonzero((run[shift:] == run[:-shift]) & (top[shift:] != top[:-shift]) & ~(two_blocks[shift:] & (block[shift:] == block[:-shift])))
            for part in np.array_split(i, len(i) // 65536 + 1):
                part = part[_distance(sig[part], sig[part + shift]) <= MAX_DISTANCE]
                for x in part[doc[part] != doc[part + shift]].tolist():
                    if joined.join(x, x + shift):
                        a.append(doc[x])
                        b.append(doc[x + shift])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _to_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows (doc_id, hub, sig, hub_sig) whose signatures are at most MAX_DISTANCE apart."""
    for b in batches:
        t = pa.Table.from_batches([b])
        hub = np.ascontiguousarray(b.column("hub_sig").flatten().to_numpy()).reshape(b.num_rows, CHUNKS)
        near = pa.array((_distance(_sigs(t), hub) <= MAX_DISTANCE) & (_column(t, "doc_id") != _column(t, "hub")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(near), b.column("hub").filter(near)], ["a", "b"])


class _Signatures:
    """Signatures of rows, for _across()."""

    def __init__(self, t: pa.Table):
        self.sig = _sigs(t)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others that are near x."""
        return others[_distance(self.sig[others], np.broadcast_to(self.sig[x], (len(others), CHUNKS))) <= MAX_DISTANCE]


class _Sets(_Signatures):
    """Shingle sets of rows, their hashes numbered."""

    def __init__(self, t: pa.Table, percent: int):
        super().__init__(t)
        sets = t.column("shingles").combine_chunks()
        self.percent, self.size = percent, np.diff(sets.offsets.to_numpy()).astype(np.int64)
        _, self.ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        self.at = np.cumsum(self.size) - self.size
        self.has = np.zeros(int(self.ids.max()) + 1, bool)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        size = self.size
        big, small = np.maximum(size[others], size[x]), np.minimum(size[others], size[x])
        others = super().near(x, others[100 * small >= self.percent * big])
        if not len(others):
            return others
        mine = self.ids[self.at[x] : self.at[x] + size[x]]
        self.has[mine] = True
        both = np.add.reduceat(self.has[self.ids[bw.ranges(self.at[others], size[others])]].astype(np.int64), np.cumsum(size[others]) - size[others])
        self.has[mine] = False
        return others[100 * both >= self.percent * (size[others] + size[x] - both)]


def _across(prepare: Callable, target: int, weigh: Callable | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run, edges from its strays to any of its rows, between what has different labels and isn't joined yet."""
        for t, starts in runs(batches, 3, target, weigh):
            a, b = [], []
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                own = t.slice(lo, hi - lo)
                stray = np.flatnonzero(_column(own, "stray"))
                others = np.flatnonzero(~_column(own, "stray"))
                if not len(stray) or not len(others):
                    continue
                doc, compared = _column(own, "doc_id"), prepare(own)
                _, group = np.unique(_column(own, "label"), return_inverse=True)
                first = np.zeros(int(group.max()) + 1, np.int64)
                first[group[::-1]] = np.arange(hi - lo)[::-1]
                joined = _Joined(hi - lo)
                joined.up = first[group]  # those of a label are joined
                for x in stray.tolist():
                    top = joined.flatten()
                    for z in compared.near(x, others[top[others] != top[x]]).tolist():
                        if joined.join(x, z):
                            a.append(doc[x])
                            b.append(doc[z])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _hub_first(members: DataFrame, payload: list[str], size: Column, block: int, to_hub: Callable, across: Callable, edges: DataFrame | None = None) -> DataFrame:
    """Edges that join the members (key, doc_id, hub, payload; a written table's) of large groups, beyond the edges given.

    Each member is first compared with its group's hub. Connected with all edges so far, most members of a group of near
    copies are then in their hub's component, by this group or another; only the others, the strays, are compared with
    all members of their group, block by block. A group without strays is done, and its payload never shuffled.
    """
    hubs = cut(members.filter("doc_id = hub").dropDuplicates(["key"]).select("key", *[F.col(c).alias(f"hub_{c}") for c in payload]), "hubs")
    star = members.join(hubs, "key").select("doc_id", "hub", *payload, *[f"hub_{c}" for c in payload]).mapInArrow(to_hub, "a long, b long")
    edges = cut(star if edges is None else edges.union(star), "star-edges")
    labels = cut(connected_components(edges), "labels")
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("component").alias(name))
    slim = members.select("key", "doc_id", "hub", size.alias("size"))
    labelled = slim.join(of("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).join(of("hub", "hub_label"), "hub", "left").withColumn("is_stray", F.col("label") != F.coalesce("hub_label", "hub"))
    labelled = cut(labelled.select("key", "doc_id", "label", "is_stray", "size"), "labelled")
    drop(hubs, labels)
    count = lambda c: F.ceil(F.sum(c) / block)
    open_ = cut(labelled.groupBy("key").agg(count("size").alias("n_j"), count(F.when(F.col("is_stray"), F.col("size")).otherwise(0)).alias("n_i")).filter("n_i > 0"), "open-groups")
    if open_.isEmpty():
        return edges
    rows = members.select("key", "doc_id", *payload).join(labelled.drop("size").join(open_, "key").distinct(), ["key", "doc_id"])
    deal = lambda own, other: (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    (i, js), (j, is_) = deal("n_i", "n_j"), deal("n_j", "n_i")
    keep = ["doc_id", "label", *payload]
    strays = rows.filter("is_stray").select("key", i.alias("i"), js.alias("j"), *keep, F.lit(True).alias("stray"))
    dealt = strays.unionByName(rows.select("key", is_.alias("i"), j.alias("j"), *keep, F.lit(False).alias("stray")))
    found = dealt.repartition(width(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(across, "a long, b long")
    return edges.union(found)


def _large_keys(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that join the members (key, doc_id, hub, sig) of large keys, beyond the edges of small ones."""
    return _hub_first(cut(members, "large-keys"), ["sig"], F.lit(1), BLOCK_DOCS, _to_hub, _across(_Signatures, 1 << 15), edges)


def _set_to_hub(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of rows (doc_id, hub, shingles, hub_shingles) of sets of Jaccard similarity percent / 100."""
        for b in batches:
            own, hub, sets = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "hub", "hub_shingles"))
            lists = b.column("shingles")
            flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            at = np.cumsum(size) - size
            near = np.zeros(b.num_rows, bool)
            for h in np.unique(hub).tolist():
                rows = np.flatnonzero(hub == h)
                one = np.sort(sets[rows[0]])
                mine = flat[bw.ranges(at[rows], size[rows])]
                both = np.add.reduceat((one[np.minimum(np.searchsorted(one, mine), len(one) - 1)] == mine).astype(np.int64), np.cumsum(size[rows]) - size[rows])
                near[rows] = (100 * both >= percent * (size[rows] + len(one) - both)) & (own[rows] != h)
            mask = pa.array(near)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(mask), b.column("hub").filter(mask)], ["a", "b"])

    return run


def _shingle_counts(t: pa.Table) -> np.ndarray:
    return pc.list_value_length(t.column("shingles")).to_numpy().astype(np.int64)


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text's shingles in place of the text; texts other than the digested one, of a repeated doc_id, go."""
    for b in batches:
        for first, h, counts in shingle_sets(b.column("text")):
            n = len(counts)
            own = b.slice(first, n)
            same = (digests(h, counts) == np.stack([own.column("d1").to_numpy(), own.column("d2").to_numpy()])).all(axis=0)
            sets = bw.list_array(h.view(np.int64), counts, pa.int64())
            cols = [own.column(c) for c in ("doc_id", "cluster", "blocks", "sig")]
            yield pa.RecordBatch.from_arrays([*cols, sets], ["doc_id", "cluster", "blocks", "sig", "shingles"]).filter(pa.array(same))


def _confirm(percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run of a cluster's rows, links that span the graph of sets of Jaccard similarity percent / 100."""
        for t, starts in runs(batches, 3, 2 * BLOCK_SHINGLES, _shingle_counts):
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                own = t.slice(lo, hi - lo)
                doc, block, sets = _column(own, "doc_id"), _column(own, "block"), _Sets(own, percent)
                two_blocks = own.column("i")[0].as_py() != own.column("j")[0].as_py()
                joined, a, b = _Joined(hi - lo), [], []
                for x in np.argsort(-sets.size, kind="stable").tolist():
                    top = joined.flatten()
                    for y in sets.near(x, np.flatnonzero((top != top[x]) & ((block != block[x]) if two_blocks else True))).tolist():
                        if joined.join(x, y):
                            a.append(doc[x])
                            b.append(doc[y])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words are maximal runs without ASCII white space, after lower-casing A-Z. A document's set: its distinct five-word
    shingles; with fewer words, the whole sequence as one. Documents are linked when 100 * intersection >= percent *
    union of their sets, held as 64-bit hashes. component_id is the smallest doc_id that links reach.

    Null, empty or blank texts have an empty set and stay alone. Equal sets are one node, whatever their number.
    Rows that repeat a doc_id each give a row, of its own n_shingles; they are one node, in one component. A row of
    null doc_id is linked with nothing: its component_id is null and it is kept. Other columns, whatever their names,
    aren't read. An empty table gives no rows.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent {percent}: signatures are made for {LEAST_PERCENT} to 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(rows.mapInArrow(_sign, "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>"), "signed")
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["d1", "d2", "n_shingles"]
    nodes = cut(known.groupBy(*same).agg(F.min("doc_id").alias("lo"), F.count("*").alias("n"), F.first("sig").alias("sig")), "nodes")  # a row for each distinct set
    # keys, and of keys with the same documents one
    keys = nodes.select(F.col("lo").alias("doc_id"), F.explode(_masked_keys(F.col("sig"))).alias("key"))
    held = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("hub"), F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x2"))
        .filter("n > 1").groupBy("n", "hub", "x1", "x2").agg(F.min("key").alias("key"))
    )
    held = cut(held.select("key", "hub", "n"), "keys")
    # what is held grows with the corpus: it is merged with, never broadcast
    members = lambda which: keys.join(held.filter(which).hint("merge"), "key").join(nodes.select(F.col("lo").alias("doc_id"), "sig"), "doc_id").select("key", "doc_id", "hub", "sig", F.ceil(F.col("n") / BLOCK_DOCS).alias("blocks"))
    small, large = f"n <= {MOST_BLOCKS * BLOCK_DOCS}", f"n > {MOST_BLOCKS * BLOCK_DOCS}"
    dealt = block_pairs(members(small), "blocks", ["key"], "doc_id").select("key", "i", "j", "doc_id", "block", "sig")
    edges = dealt.mapInArrow(_near, "a long, b long")
    if not held.filter(large).isEmpty():
        edges = _large_keys(members(large), edges)
    clusters = cut(connected_components(edges), "clusters")
    # the sets of clustered documents, once more from their texts
    inside = clusters.join(nodes.select(F.col("lo").alias("node"), "sig", "d1", "d2", "n_shingles"), "node")
    sized = clusters.join(nodes.select(F.col("lo").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"))
    sized = cut(sized, "cluster-sizes")
    inside = inside.join(sized, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "blocks", "sig", "d1", "d2", "n_shingles")

    texts = inside.join(rows, "doc_id").select("doc_id", "cluster", "blocks", "sig", *same, "text")
    sets = texts.mapInArrow(_own_sets, "doc_id long, cluster long, blocks long, sig array<long>, shingles array<long>")
    is_large = F.col("blocks") > MOST_SET_BLOCKS
    large_clusters = not sized.filter(is_large).isEmpty()
    if large_clusters:
        sets = cut(sets, "sets")
    dealt = block_pairs(sets.filter(~is_large), "blocks", ["cluster"], "doc_id").select("cluster", "i", "j", "doc_id", "block", "sig", "shingles")
    links = dealt.mapInArrow(_confirm(percent), "a long, b long")
    if large_clusters:
        members = sets.filter(is_large).select(F.col("cluster").alias("key"), "doc_id", F.col("cluster").alias("hub"), "sig", "shingles")
        links = links.union(_hub_first(members, ["sig", "shingles"], F.size("shingles"), BLOCK_SHINGLES, _set_to_hub(percent), _across(functools.partial(_Sets, percent=percent), 2 * BLOCK_SHINGLES, _shingle_counts)))
    twins = known.join(nodes.filter("n > 1").select(*same, "lo"), same).select(F.col("doc_id").alias("a"), F.col("lo").alias("b"))
    found = connected_components(links.union(twins))
    drop(nodes, held, clusters, sized)
    return (
        signed.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
    )
