"""Awkward rows that every operator must take, and plain forms of what words and shingles are."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key long, h1 long, row string, salt int, sig string, text_ string, blocks long, kept boolean, place long"


def lower(text):
    return text.translate(ASCII)


def words(text):
    return WORD.findall(lower(text or ""))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(n))


def rows(extra=()):
    """(doc_id, text, lang, source, ...): nulls in any column, empty, blank, tiny, very long, repeated and near texts."""
    base = prose(1, 120)
    near = base.replace(" ", "  ", 3).upper() + " end"
    texts = [None, "", "   \n", "a", "a b", "!!! ...", "É È", base, base, near, prose(2, 60_000), prose(2, 60_000) + " more", prose(3, 9), "x" * 5000, "ab " * 3000, "a\x00b \x1c c d", "KK İ under THE mit License, x", prose(4, 30) + " cc-by-nc", "naïve café 日本語 текст"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, base, "en", "s0", 1), (None, None, None, None, None), (5, "another text under an old id", "de", "s1", 9)]
    out += [(100 + i, t, "en", "s0", 0) for i, t in enumerate(extra)]
    return [(*r, "w", 1, 2, "r", 3, "s", "t", 4, True, 5) for r in out]


def frame(spark, extra=()):
    return spark.createDataFrame(rows(extra), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(seed, n, length=150):
    """Texts with a few words changed, from hardly to a lot."""
    r = random.Random(seed)
    base = prose(seed, length).split()
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out
