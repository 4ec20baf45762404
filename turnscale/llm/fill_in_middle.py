"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit ends that are found eight bytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Words of a block: what is made while marks are found takes a few times its 8 MB, however long a text is.
BLOCK = 1 << 20
BYTE = 0x0101010101010101
HIGH, LOW = np.uint64(0x80 * BYTE), np.uint64(0x7F * BYTE)


def every_byte(value: int) -> np.uint64:
    return np.uint64(value * BYTE)


def space_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte of the words that is ASCII white space.

    The sums stay below 256 in every byte, as the top bits are off: the top bit of `low + 0x80 - k` says that low >= k.
    """
    low = words & LOW
    from_tab, beyond = low + every_byte(0x80 - 0x09), low + every_byte(0x80 - 0x0E)
    not_blank = (low ^ every_byte(0x20)) + every_byte(0x7F)
    return ((from_tab & ~beyond) | ~not_blank) & ~words & HIGH


def lead_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that begins a code point: any but 10xxxxxx."""
    return ~(words & ~(words << np.uint64(1))) & HIGH


def word_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that isn't space where the next one is; nothing follows the last word."""
    ends = np.empty_like(words)
    for at in range(0, len(words), BLOCK):
        block = words[at : at + BLOCK + 1]  # and the word after it
        spaces = space_marks(block)
        after = spaces >> np.uint64(8)
        after[:-1] |= spaces[1:] << np.uint64(56)
        ends[at : at + BLOCK] = (~spaces & HIGH & after)[:BLOCK]
    return ends


class Units:
    """The units of a batch of UTF-8 texts: n of each text, and the bytes and code points before its k-th unit's end.

    A unit is a word with the white space before it, or the white space at a text's end. Each text begins at a 64-bit
    word and has a space or more after it.
    """

    def __init__(self, texts: list[memoryview]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes // 8 + 1)])  # in words
        self.data = np.full(int(self.starts[-1]) * 8, 0x20, np.uint8)
        for text, start in zip(texts, self.starts.tolist(), strict=False):
            if len(text):
                self.data[8 * start : 8 * start + len(text)] = np.frombuffer(text, np.uint8)
        self.words = self.data.view("<u8")
        self.ends = word_ends(self.words)
        last = 8 * self.starts[:-1] + sizes - 1
        spaced = (sizes > 0) & np.isin(self.data[np.maximum(last, 0)], np.frombuffer(b" \t\n\v\f\r", np.uint8))
        self.ends[last[spaced] // 8] |= np.uint64(0x80) << (8 * (last[spaced] % 8)).astype(np.uint64)
        self.counts = np.bitwise_count(self.ends)
        self.before = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])  # ends before each word
        self.leads = np.concatenate([[0], np.cumsum(self._lead_counts(), dtype=np.int64)])
        self.n = self.before[self.starts[1:]] - self.before[self.starts[:-1]]

    def _lead_counts(self) -> np.ndarray:
        return np.concatenate([np.bitwise_count(lead_marks(self.words[at : at + BLOCK])) for at in range(0, len(self.words), BLOCK)] or [np.zeros(0, np.uint8)])

    def cut(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, code points) of each text's first k units."""
        start = self.starts[:-1]
        rank = self.before[start] + k
        word = np.searchsorted(self.before, rank, side="left") - 1  # the first word by whose end there are so many
        word = np.where(k > 0, word, start)
        # In the word: a product puts into each byte the number of marks up to it; bytes with too few come before the one sought.
        upto = (self.ends[word] >> np.uint64(7)) * np.uint64(BYTE)
        sought = np.where(k > 0, rank - self.before[word], 1).astype(np.uint64)
        enough = ((upto | HIGH) - sought * np.uint64(BYTE)) & HIGH
        at = np.where(k > 0, 8 * (word - start) + 9 - np.bitwise_count(enough).astype(np.int64), 0)
        word, rest = start + at // 8, (8 * (at % 8)).astype(np.uint64)
        inside = np.bitwise_count(lead_marks(self.words[word]) & ((np.uint64(1) << rest) - np.uint64(1)))
        return at, self.leads[word] + inside - self.leads[start]


def views(texts: pa.Array) -> list[memoryview]:
    """The UTF-8 of each text, without copying; a null is empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def rearranged(texts: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array, sentinels: tuple[str, str, str]) -> pa.StructArray:
    units = Units(views(texts))
    draws = [c.to_numpy(zero_copy_only=False).astype(np.int64) % (units.n + 1) for c in (first, second)]
    (a, a_chars), (b, b_chars) = units.cut(np.minimum(*draws)), units.cut(np.maximum(*draws))
    p, s, m = (x.encode() for x in sentinels)
    outputs, forms = [], form.to_pylist()
    for kind, x, y, text in zip(forms, a.tolist(), b.tolist(), views(texts), strict=True):
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        parts = {"plain": (text,), "psm": (p, prefix, s, suffix, m, middle), "spm": (s, suffix, p, prefix, m, middle)}[kind]
        outputs.append(b"".join(parts))
    plain = np.array([k == "plain" for k in forms], bool)
    columns = {
        "n": pa.array(units.n), "form": form,
        "prefix_chars": pa.array(a_chars, pa.int64(), mask=plain), "middle_chars": pa.array(b_chars - a_chars, pa.int64(), mask=plain),
        "output": pa.array(outputs, pa.string()),
    }
    return pa.StructArray.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns.values()], list(columns))


def draw(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be told apart wherever texts are cut: the first character of each stands nowhere else in them."""
    p, s, m = sentinels
    if len({p, s, m}) < 3 or not all(x and all(x[0] not in y[1:] for y in sentinels) for x in sentinels) or any(x != y and x.startswith(y) for x in sentinels for y in sentinels):
        raise ValueError("sentinels must be different, none the beginning of another, and begin with a character that no other place of them has")
    return p, s, m


def fill_in_middle(documents: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of documents without text, and n, form, prefix_chars, middle_chars, output (replaced if there).

    A text of n units is cut after two numbers of units from 0 to n, drawn by doc_id; of a hundred texts `rate` are
    rearranged, `spm` in a hundred of these with the suffix first. A null or empty text, or one that holds a sentinel, stays
    plain, with null lengths; a null doc_id draws as an empty one, equal ids draw alike. One pass, without a shuffle.
    """
    sentinels = checked(sentinels)
    text, name = F.coalesce("text", F.lit("")), free_name(documents, "cut")
    h1, h2, h3, h4 = draw(seed, F.col("doc_id"))
    held = [F.contains(text, F.lit(x)) for x in sentinels]
    form = F.when((text == "") | held[0] | held[1] | held[2] | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")

    @F.arrow_udf("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>")
    def cut(texts: pa.Array, forms: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return rearranged(texts, forms, first, second, sentinels)

    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("text", *added)]
    rows = bound_batches(documents).select(*others, cut(text, form, h1, h2).alias(name))
    return rows.select(*others, *[F.col(f"{name}.{c}") for c in added])


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of: the parts between the first sentinels, put in their order again."""
    p, s, m = checked(sentinels)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    after, before, between = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, between, after)).otherwise(output)


def fill_in_middle_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text restored from it."""
    rows = fill_in_middle(documents.select("doc_id", "text"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
