"""Column functions on text, paths, tags, CSV lines and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commas that are followed by an even number of quotes.
_BARE_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text: Column | str, delimiter: str = " ") -> Column:
    """Parts between a literal delimiter, empty ones at the end left out."""
    quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in delimiter)
    return F.split(F.regexp_replace(col(text), f"(?:{quoted})+$", ""), quoted)


def word_count(text: Column | str) -> Column:
    return F.size(F.split(col(text), " ")).cast("long")


def first_word(text: Column | str, delimiter: str = " ") -> Column:
    return F.split_part(col(text), F.lit(delimiter), F.lit(1))


def last_word(text: Column | str, delimiter: str = " ") -> Column:
    return F.split_part(col(text), F.lit(delimiter), F.lit(-1))


def pipe_tags(tags: Column | str) -> Column:
    """Tags of "a|b|c"."""
    return split_words(tags, "|")


def angle_tags(tags: Column | str) -> Column:
    """Tags of "<a><b><c>"; none give an empty array."""
    return F.regexp_extract_all(col(tags), F.lit("<(.*?)>"), F.lit(1))


def combined_tags(tags: Column) -> Column:
    """One key for a set of tags: sorted and joined by |."""
    return F.array_join(F.array_sort(tags), "|")


def split_quoted(line: Column | str) -> Column:
    """A CSV line's fields, quotes kept, commas inside quotes not splitting."""
    return F.split(col(line), _BARE_COMMA)


def unquote(text: Column | str) -> Column:
    return F.replace(col(text), F.lit('"'), F.lit(""))


def csv_line(*fields: Column | str, separator: str = ", ") -> Column:
    """Fields in double quotes, joined."""
    return F.concat_ws(separator, *[F.concat(F.lit('"'), col(f).cast("string"), F.lit('"')) for f in fields])


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def extension(path: Column | str) -> Column:
    return F.substring_index(col(path), ".", -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def int_or(text: Column | str, default: int | None = None, kind: str = "long") -> Column:
    """text as a number, or default where it is none."""
    value = col(text).try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def glob_to_regex(glob: Column | str) -> Column:
    """An anchored regular expression: * is any text, ? one character; dots and backslashes stand for themselves."""
    out = col(glob)
    for a, b in (("\\", "\\\\"), (".", "\\."), ("*", ".*"), ("?", ".")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit("^"), out, F.lit("$"))


def timestamp_from_path(path: Column | str) -> Column:
    """The hour that a path .../yyyy/MM/dd/HH/file stands for; null where parts aren't numbers."""
    part = lambda k: F.split_part(col(path), F.lit("/"), F.lit(k)).try_cast("int")
    return F.try_make_timestamp_ntz(part(-5), part(-4), part(-3), part(-2), F.lit(0), F.lit(0))


def sha256_text(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def stable_name(*fields: Column | str) -> Column:
    """A name from a hash of fields that is the same in every process."""
    return F.hex(F.xxhash64(*[col(f) for f in fields]))


def char_code_hash(text: Column | str) -> Column:
    """The 32-bit polynomial hash by 31 of ASCII text, as int."""
    codes = F.transform(F.split(col(text), ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: (acc * 31 + c) % F.lit(2**32))
    return F.when(h >= 2**31, h - F.lit(2**32)).otherwise(h).cast("int")


def zip_names(names: list[str], values: Column) -> Column:
    """A map of names to an array's values, as far as both go."""
    return F.map_from_arrays(F.slice(F.array(*map(F.lit, names)), 1, F.least(F.lit(len(names)), F.size(values))), F.slice(values, 1, len(names)))


def fields_or_null(values: Column, names: list[str]) -> list[Column]:
    """A column for each name, null where the array is short."""
    return [F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)]


def bucket(value: Column | str, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that value is greater than, bounds falling."""
    out = F
    for bound, label in bounds:
        out = out.when(col(value) > bound, label)
    return out.otherwise(otherwise)


def stroke_segments(drawing: Column | str) -> Column:
    """Segments ((x0, y0), (x1, y1)) of neighbouring points of each stroke [[x...], [y...]], as a flat array."""
    def of(stroke: Column) -> Column:
        x, y = stroke[0], stroke[1]
        return F.when(F.size(x) < 2, F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 2, F.lit(0))), lambda i: F.struct(F.get(x, i).alias("x0"), F.get(y, i).alias("y0"), F.get(x, i + 1).alias("x1"), F.get(y, i + 1).alias("y1")))
        )

    return F.flatten(F.transform(col(drawing), of))


def entity(kind: str, key: Column | str, **properties: Column | str) -> Column:
    """A JSON entity: its key, and each property in a wrapper that names its type."""
    wrapped = [F.struct(col(c).alias(name)).alias(name) for name, c in properties.items()]
    return F.to_json(F.struct(F.struct(F.lit(kind).alias("kind"), col(key).alias("name")).alias("key"), F.struct(*wrapped).alias("properties")))


def epoch_time(seconds: Column | str) -> Column:
    """The time so many seconds, a number or text, after 1970 began (UTC); null for what is no number."""
    return F.timestamp_micros((col(seconds).cast("string").try_cast("double") * 1_000_000).cast("long"))


#: English words of numbers.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ["", " thousand", " million", " billion", " trillion"]


def in_words(number: Column | str) -> Column:
    """A whole number in English words, as "one thousand, two hundred and five"; null from 10**15 on, with "minus" below 0."""
    n = col(number).cast("long")
    size = F.abs(n)
    word = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))

    def group(x: Column) -> Column:
        rest, tens = x % 100, F.floor((x % 100) / 10)
        small = F.when(rest < 20, word(_ONES, rest)).otherwise(F.concat(word(_TENS, tens), F.when(rest % 10 > 0, F.concat(F.lit("-"), word(_ONES, rest % 10))).otherwise("")))
        hundreds = F.concat(word(_ONES, F.floor(x / 100)), F.lit(" hundred"))
        return F.when(x < 100, small).when(rest == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" and "), small))

    groups = [F.floor(size / 10**(3 * k)) % 1000 for k in range(len(_SCALES))]
    high = [F.when(g > 0, F.concat(group(g), F.lit(name))) for g, name in reversed(list(zip(groups, _SCALES, strict=True))[1:])]
    above = F.concat_ws(", ", *high)
    low = groups[0]
    whole = F.when(size < 1000, group(low)).when(low == 0, above).otherwise(F.concat(above, F.when(low < 100, F.lit(" and ")).otherwise(F.lit(", ")), group(low)))
    return F.when(size < 10**15, F.concat(F.when(n < 0, F.lit("minus ")).otherwise(F.lit("")), whole))


def signature(message: Column | str, key: bytes) -> Column:
    """The HMAC-SHA256 of a text under a key, as hex digits. The key is part of the plan: give one that may be seen there."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(col(message), "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
