"""Language identification by words: script ranges narrow the candidates, Viterbi labels spans of mixed-language text.

A word's score for a language is the log likelihood of its byte trigrams, the blanks around it included, under add-one
smoothing. A word in a script that a language is not written in cannot be of that language. Along a document, the best
labelling pays a penalty for each change of language between neighbouring words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bytewise as bw
from tidemill.llm.store import bounded_batches, with_row

TABLE_BITS = 16
#: Expected labelled documents of each language that are learned from.
SAMPLE_PER_LANGUAGE = 600
#: Numbers of words' bytes times languages that are worked on at once.
CELLS = 16 << 20
#: What a change of language between two words costs, in nats, and the least share of a language's words in a script.
SWITCH_PENALTY, SCRIPT_SHARE = 12.0, 0.01
UNKNOWN = "und"

#: Letters as bytes: a-z once A-Z are lower case, and all beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True

SCRIPTS = ["common", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "kana_han", "hangul", "other"]
#: What is counted of a language: trigrams by table index, words by script, and texts.
WIDTH = (1 << TABLE_BITS) + len(SCRIPTS) + 1


def _script_of_lead() -> np.ndarray:
    """Script by a UTF-8 lead byte; E0 is refined by the byte after it."""
    t = np.zeros(256, np.uint8)
    at = SCRIPTS.index
    t[0x61:0x7B] = t[0xC3:0xCA] = at("latin")
    t[0xCA:0xCD] = t[0xE1] = at("other")
    t[0xCD:0xD0] = at("greek")
    t[0xD0:0xD4] = at("cyrillic")
    t[0xD4:0xD6] = at("armenian")
    t[0xD6:0xD8] = at("hebrew")
    t[0xD8:0xDE] = at("arabic")
    t[0xE0] = at("indic")
    t[0xE3:0xEA] = at("kana_han")
    t[0xEA:0xEE] = at("hangul")
    return t


_SCRIPT = _script_of_lead()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2**TABLE_BITS, languages) float32
    scripts: np.ndarray  # (scripts, languages) bool


def _trigrams(s: bw.Slice) -> tuple[bw.Words, np.ndarray, np.ndarray]:
    """The slice's words, a table index for each of their bytes in order, and each word's script."""
    w = bw.words(s, LETTER, hashes=False)
    data = np.full(len(s.data) + 2, 0x20, np.uint32)
    lower = bw.LOWER[s.data]
    inside = LETTER[lower]
    data[1:-1][inside] = lower[inside]
    at = bw.ranges(w.start, w.end - w.start)
    edge = np.zeros(len(s.data) + 1, bool)  # neighbours over a row's border are blanks
    edge[s.offsets] = True
    before = np.where(edge[at], 0x20, data[at])
    after = np.where(edge[at + 1], 0x20, data[at + 2])
    index = ((before * np.uint32(0x10001) + data[at + 1] * np.uint32(0x101) * np.uint32(7) + after) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)
    first = lower[w.start]
    script = _SCRIPT[first]
    e0 = np.flatnonzero((first == 0xE0) & (w.start + 1 < len(lower)))
    script[e0[(lower[w.start[e0] + 1] & 0xFE) == 0xB8]] = SCRIPTS.index("thai")
    return w, index, script


def _count(texts: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their counts: language * WIDTH + a trigram's table index, or after these a word's script, or a text."""
    cells = [of.astype(np.int64) * WIDTH + WIDTH - 1]
    for s in bw.slices(texts):
        w, index, script = _trigrams(s)
        base = of[s.first + w.row].astype(np.int64) * WIDTH
        cells += np.unique(np.repeat(base, w.end - w.start) + index, return_counts=True), base + (1 << TABLE_BITS) + script
    found = [x if isinstance(x, tuple) else np.unique(x, return_counts=True) for x in cells]
    cell, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return cell, np.bincount(at, np.concatenate([n for _, n in found]), len(cell)).astype(np.int64)


def _model(names: list[str], cell: np.ndarray, count: np.ndarray) -> Model:
    """A model out of the counts of all cells, of those languages that have a text."""
    lang, place = np.divmod(cell, WIDTH)
    used, lang = np.unique(lang, return_inverse=True)
    n, size = len(used), 1 << TABLE_BITS
    gram, script = place < size, (place >= size) & (place < WIDTH - 1)
    seen = max(1, len(np.unique(place[gram])))
    total = np.log(np.bincount(lang[gram], count[gram], n) + seen)
    table = np.empty((size, n), np.float32)
    table[:] = -total
    table[place[gram], lang[gram]] = np.log(count[gram] + 1) - total[lang[gram]]
    scripts = np.zeros((len(SCRIPTS), n))
    scripts[place[script] - size, lang[script]] = count[script]
    return Model([names[i] for i in used], table, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def learn(texts: list[str], langs: list[str]) -> Model:
    """A model of the languages of labelled texts."""
    languages = sorted(set(langs))
    at = {x: i for i, x in enumerate(languages)}
    return _model(languages, *_count(pa.array(texts, pa.string()), np.array([at[x] for x in langs], np.int64)))


class Scores:
    """Words' scores, worked out for those that are asked for: a row for each word, a column for each language."""

    def __init__(self, model: Model, index: np.ndarray, size: np.ndarray, script: np.ndarray):
        self.model, self.index, self.size, self.script = model, index, size, script
        self.start = np.cumsum(size) - size
        self.shape = (len(size), len(model.languages))

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        size, n = self.size[at], self.shape[1]
        got = np.zeros((len(at), n), np.float32)
        where = bw.ranges(self.start[at], size)
        word = np.repeat(np.arange(len(at)), size)
        step = max(1, CELLS // n)
        for a in range(0, len(where), step):
            part = word[a : a + step]
            begin = np.flatnonzero(np.diff(part, prepend=-1))
            got[part[begin]] += np.add.reduceat(self.model.table[self.index[where[a : a + step]]], begin, axis=0)
        may = self.model.scripts[self.script[at]]
        return np.where(may, got, np.where(may.any(axis=1), np.float32(-1e6), np.float32(0))[:, None])


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _lettered(s: bw.Slice, w: bw.Words) -> np.ndarray:
    """For each word whether it holds a letter, by its code points."""
    low = bw.LOWER[s.data]
    plain = np.concatenate([[0], np.cumsum((low >= 0x61) & (low < 0x7B))])
    out = plain[w.end] > plain[w.start]
    rest = np.flatnonzero(~out)
    if len(rest):
        size = w.end[rest] - w.start[rest]
        at = bw.ranges(w.start[rest], size)
        begins = s.data[at] >= 0xC0
        word, at = np.repeat(np.arange(len(rest)), size)[begins], at[begins]
        b0, b1, b2, b3 = (s.data[np.minimum(at + k, len(s.data) - 1)].astype(np.int64) & (0xFF if k == 0 else 0x3F) for k in range(4))
        point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        out[rest] = np.bincount(word, _letters()[np.minimum(point, 0x10FFFF)], len(rest)) > 0
    return out


def word_scores(texts: pa.Array, model: Model) -> tuple[Scores, np.ndarray, np.ndarray, np.ndarray]:
    """(scores of all words, their bytes or 0 for one without a letter, whether a language is written in their script,
    words of each row)."""
    indices, sizes, scripts, per_row, weights = [], [], [], [], []
    for s in bw.slices(texts):
        w, index, script = _trigrams(s)
        indices.append(index)
        sizes.append(w.end - w.start)
        scripts.append(script)
        weights.append(sizes[-1] * _lettered(s, w))
        per_row.append(np.diff(w.first))
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    size, script = cat(sizes, np.int64), cat(scripts, np.uint8)
    return Scores(model, cat(indices, np.uint32), size, script), cat(weights, np.int64), model.scripts.any(axis=1)[script], cat(per_row, np.int64)


def viterbi(scores: np.ndarray | Scores, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best labels of each row's words: highest sum of scores less penalty for each change. Rows go in lockstep.

    Ties go to staying, then to the first language. Scores are read relative to each word's best, those of a run of
    steps at a time.
    """
    out = np.zeros(len(scores), np.int32)
    if not len(scores):
        return out
    n = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # rows with more than t words
    done = np.concatenate([[0], np.cumsum(live)])
    best_before = np.zeros(len(scores), np.int32)
    switched = np.zeros((len(scores), -(-n // 8)), np.uint8)  # a bit for each language
    v = np.zeros((int(live[0]), n), np.float32)
    begin = end = 0
    for t in range(int(size[0])):
        if t == end:
            begin, end = t, max(t + 1, int(np.searchsorted(done, done[t] + CELLS // (4 * n), "right")) - 1)
            places = np.concatenate([first[: live[u]] + u for u in range(begin, end)])
            part = scores[places]
            part -= part.max(axis=1, keepdims=True)
        k = live[t]
        own = slice(done[t] - done[begin], done[t + 1] - done[begin])
        at = places[own]
        now = v[:k]
        if t:
            top = now.argmax(axis=1)
            change = now[np.arange(k), top] - np.float32(penalty)
            sw = change[:, None] > now
            best_before[at] = top
            switched[at] = np.packbits(sw, axis=1)
            now = np.where(sw, change[:, None], now)
        now = now + part[own]
        v[:k] = now - now.max(axis=1, keepdims=True)
    state = v.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        now = state[:k]
        out[at] = now
        if t:
            state[:k] = np.where((switched[at, now >> 3] >> (7 - (now & 7))) & 1, best_before[at], now)
    return out


def _label(model_of, spans: bool, explained: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        names = np.array([*model.languages, UNKNOWN])
        n = len(model.languages)
        for whole, part in ((b, x) for b in batches for x in bw.slices(b.column(1), max(1 << 14, CELLS // max(4, n)))):
            b = whole.slice(part.first, part.rows)
            texts = b.column(1)
            scores, size, known, counts = word_scores(texts, model)
            label = viterbi(scores, counts)
            row = np.repeat(np.arange(b.num_rows), counts)
            by = np.bincount(row * n + label, weights=size * known, minlength=b.num_rows * n).reshape(-1, n)
            total = np.bincount(row, weights=size, minlength=b.num_rows)
            pred = by.argmax(axis=1)
            score = by[np.arange(b.num_rows), pred] / np.maximum(total, 1)
            none = total == 0  # no word with a letter
            pred[none], score[none] = n, 0
            cols = [b.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
            kept = ["doc_id", "lang_pred", "score"]
            if spans:
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(new)
                base = np.cumsum(counts) - counts
                end = np.append(begin[1:], len(label)) - base[row[begin]]
                struct = pa.StructArray.from_arrays([pa.array(begin - base[row[begin]]), pa.array(end), pa.array(names[label[begin]].tolist(), pa.string())], ["first_word", "end_word", "lang"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=b.num_rows))]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), struct))
                kept.append("spans")
            if explained:
                cols.append(pa.array(by.sum(axis=1) / np.maximum(total, 1)))
                kept.append("explained")
            cols += b.columns[2:]
            yield pa.RecordBatch.from_arrays(cols, [*kept, *b.schema.names[2:]])

    return run


def training_rows(docs: DataFrame, id_col: str = "doc_id"):
    """Whether a row may be learned from: a known doc_id whose crc32, as text, modulo 4 is not 2."""
    return F.col(id_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _count(b.column(0), b.column(1).to_numpy())], ["cell", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn every language of the labelled training rows from a sample, about per_language rows of each, chosen by a
    hash of doc_id. Rows are counted where they lie; a language's counts come to the driver. Only text and lang are read."""
    spark = docs.sparkSession
    rows = docs.filter(training_rows(docs, id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    bounded_batches(spark)
    scale = 1_000_000
    rates = spark.createDataFrame([(lang, i, min(scale, -(-per_language * scale // n))) for i, (lang, n) in enumerate(counts)], "lang string, language int, rate int")
    sample = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale)) < F.col("rate")).select("text", "language")
    got = sample.mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return _model([lang for lang, _ in counts], got.column("cell").to_numpy(), got.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, keep_row: bool = False, explained: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, spans (first_word, end_word, lang) and, if asked for, explained and row (docs' own columns): one row for each row of docs.

    Words are runs of a-z, A-Z and characters beyond ASCII. lang_pred is the language of most of a text's letters, as
    bytes; score their share of the bytes of words with a letter. A null text, or one without a letter, is "und" with
    score 0 and no spans or, of symbols, spans of no weight; so are all texts where the model knows no language. Letters
    in a script of no learned language count for none; explained is the share of all learned languages together.
    Repeated rows give equal rows, null doc_ids stay null, other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.struct("*").alias("row")] * keep_row)
    span = "array<struct<first_word: long, end_word: long, lang: string>>"
    if not model.languages:
        empty = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *[F.array().cast(span).alias("spans")] * spans, *[F.lit(0.0).alias("explained")] * explained]
        return rows.select("doc_id", *empty, *["row"] * keep_row)
    return rows.mapInArrow(_label(spark.sparkContext.broadcast(model), spans, explained), with_row(f"doc_id long, lang_pred string, score double{f', spans {span}' * spans}{', explained double' * explained}", rows))
