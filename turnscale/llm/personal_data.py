"""Personal data: e-mail and IP addresses, card and phone numbers, and more of them by contexts that these are found in.

Bootstrapping: what plain patterns find are seeds. The words around seeds are lexical patterns; one is trusted as far as its
places are taken by what is known already. Identifiers in trusted places become known themselves, by the patterns that
name them, and make further patterns trusted.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches, delete, free_name, saved_at

#: The kinds, in the order in which spans of one start stand.
KINDS = ("email", "ip", "card", "phone")

# The patterns of seeds. They never scan a run of characters more than a few times: what comes before an @ is
# looked at only where a domain follows, and runs of digits are taken whole.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Shapes of identifiers that can become known, and the kinds that they can have.
NUMBER = re.compile(r"\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)*+")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
SPELT_AT = re.compile(r" ?[(\[{][aA][tT][)\]}] ?([A-Za-z0-9-]++(?: ?(?:\.|[(\[{][dD][oO][tT][)\]}]) ?[A-Za-z0-9-]++)++)")
SPELT_DOT = re.compile(r" ?[(\[{]dot[)\]}] ?")
CODE = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z-]*+[0-9][A-Za-z0-9-]*+")
SHAPES = {"number": ("card", "phone"), "colons": ("ip",), "spelt": ("email",), "code": KINDS}

#: Bytes that a word of a context has at most; a longer one is no context.
CUE_BYTES = 64
#: Different identifiers that a pattern must have been seen with; the share of its places that they must have; how sure
#: an identifier must be; rounds of pattern and identifier.
SUPPORT, PRECISION, SURE, ROUNDS = 3, 0.5, 0.6, 3
#: Patterns are looked up by so many hash buckets: this bounds what is sent to tasks, whatever the patterns.
BUCKETS = 1 << 21
#: Patterns of which a task remembers whether they are likely.
MOST_KNOWN = 500_000
#: Words that are counted at once, and bytes of a text whose words make one list.
WORDS_AT_ONCE, LIST_BYTES = 1 << 18, 1 << 22

#: What every pattern and shape has.
DIGIT, AT = re.compile("[0-9]"), re.compile(r"[(\[{][aA][tT][)\]}]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    found, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, end := m.end()))
    return found


def addresses(text: str) -> list[Span]:
    small = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255
    return [m.span() for m in ADDRESS.finditer(text) if all(map(small, m.group().split(".")))]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def numbers(text: str) -> Iterator[Span]:
    """Groups of digits of 7 to 19 in all; of longer ones, their parts between spaces."""
    for m in NUMBER.finditer(text):
        size = m.end() - m.start()
        if size < 7:
            continue
        if len(digits_of(m.group())) <= 19:
            parts = [m.span()]
        else:
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^ ]+", m.group())]
        yield from ((a, b) for a, b in parts if 7 <= len(digits_of(text[a:b])) <= 19)


def spelt(text: str) -> Iterator[Span]:
    end = 0
    for m in SPELT_AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, (end := m.end())


def codes(text: str) -> Iterator[Span]:
    for m in CODE.finditer(text):
        if 6 <= m.end() - m.start() <= 34 and len(digits_of(m.group())) >= 4:
            yield m.span()


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, shape) of what might be an identifier and isn't one by its pattern, none over another."""
    found = [(*m.span(), 1, "colons") for m in COLONS.finditer(text) if len(m.group()) > 6] if text.count(":") > 1 else []
    if AT.search(text):
        found += [(a, b, 2, "spelt") for a, b in spelt(text)]
    if DIGIT.search(text):
        found += [(a, b, 0, "number") for a, b in numbers(text)] + [(a, b, 3, "code") for a, b in codes(text)]
    kept, end, at = [], 0, 0
    for start, stop, _, shape in sorted(found, key=lambda c: (c[0], c[2])):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= end and not (at < len(taken) and taken[at][0] < stop):
            kept.append((start, stop, shape))
            end = stop
    return kept


def value_of(text: str, shape: str) -> str:
    """What is the same however it is written: digits of numbers, an address in small letters."""
    if shape in ("number", "card", "phone"):
        return digits_of(text)
    if shape == "spelt":
        text = SPELT_DOT.sub(".", re.sub(r" ?[(\[{]at[)\]}] ?", "@", text.lower())).replace(" ", "")
    return text.lower()


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z alone


BEFORE, AFTER = 3 * CUE_BYTES, 2 * CUE_BYTES
WORDS, SPACE = re.compile(WORD), " \t\n\x0b\x0c\r"


def cues(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: the word before the token that it stands in, the two words, and the word after."""
    while start and text[start - 1] not in SPACE:
        start -= 1
        if end - start > 4 * CUE_BYTES:
            return []  # in the middle of something that is no token of a sentence
    low = max(0, start - BEFORE)
    words = WORDS.findall(text, low, start)
    if low and words and text[low] not in SPACE and text[low - 1] not in SPACE:
        words = words[1:]  # cut off
    at, limit = end, min(len(text), end + AFTER)
    if (rest := WORDS.match(text, at, limit)) is not None:
        at = rest.end()  # what is left of the token
    after = WORDS.search(text, at, limit)
    if after and after.end() == limit < len(text):
        after = None  # cut off
    short = lambda w: lowered(w).decode("utf-8", "surrogatepass") if len(lowered(w)) <= CUE_BYTES else None
    last = [short(w) for w in words[-2:]]
    out = []
    if last and last[-1] is not None:
        out.append(f"1 {last[-1]}")
        if len(last) == 2 and last[0] is not None:
            out.append(f"2 {last[0]} {last[1]}")
    if after and (right := short(after.group())) is not None:
        out.append(f"+ {right}")
    return out


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("shape", pa.string()), ("value", pa.string()), ("cues", pa.list_(pa.string()))]))
FOUND_DDL = "array<struct<start:long,end:long,kind:string,shape:string,value:string,cues:array<string>>>"


def identifiers(text: str | None) -> list[dict]:
    """Seeds with their kind, and what has a shape alone, of a whole text."""
    if not text:
        return []
    digits = DIGIT.search(text) is not None
    if not digits and "@" not in text and ":" not in text and AT.search(text) is None:
        return []  # no pattern and no shape is without one of these
    seeds = [(a, b, kind) for kind, find in FINDERS.items() if digits or kind == "email" for a, b in find(text)]
    taken, merged = sorted((a, b) for a, b, _ in seeds), []
    for a, b in taken:  # spans of several kinds can overlap
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    both = [(a, b, kind, None) for a, b, kind in seeds] + [(a, b, None, shape) for a, b, shape in candidates(text, merged)]
    return [{"start": a, "end": b, "kind": kind, "shape": shape, "value": value_of(text[a:b], kind or shape), "cues": cues(text, a, b)} for a, b, kind, shape in both]


def found_in(text: Column) -> Column:
    @F.arrow_udf(FOUND_DDL)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([identifiers(t) for t in texts.to_pylist()], FOUND)

    return find(text)


def bucket(cue: bytes) -> int:
    """As pmod(xxhash64(cue), BUCKETS) in Spark."""
    import xxhash

    return xxhash.xxh64_intdigest(cue, 42) % BUCKETS


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists; one of more than CUE_BYTES is empty."""
    data = lowered(text or "")
    if len(data) <= LIST_BYTES:
        words = data.split()  # bytes: ASCII white space alone
        yield words if max(map(len, words), default=0) <= CUE_BYTES else [w if len(w) <= CUE_BYTES else b"" for w in words]
        return
    stream = (m.group() if m.end() - m.start() <= CUE_BYTES else b"" for m in re.finditer(WORD.encode(), data))
    while words := list(itertools.islice(stream, WORDS_AT_ONCE)):
        yield words


def places(texts: Iterable[str | None], keep: Callable[[bytes], bool] = lambda cue: True) -> Iterator[tuple[bytes, int]]:
    """(pattern, places) of texts: every word that another follows or precedes, and every two words before a third.

    With keep, only patterns for which it holds; two words only if it holds for the second of them, too. Patterns come
    several times, once for some WORDS_AT_ONCE words of any texts.
    """

    def counted(words: list[bytes | None]) -> Iterator[tuple[bytes, int]]:
        # Each pattern is counted where the word is that takes its place; the first two words were there before. All are
        # counted, and those taken off that have a text's end in their place.
        ends = [i for i, w in enumerate(words) if w is None]
        single, after = Counter(words[1:-1]), Counter(words[2:])
        single.subtract(words[i - 1] for i in ends if i > 1)
        after.subtract(words[i + 1] for i in ends if 0 < i < len(words) - 1)
        trusted = {w for w, n in single.items() if w and n and keep(b"1 " + w)}
        yield from ((b"1 " + w, single[w]) for w in trusted)
        yield from ((cue, n) for w, n in after.items() if w and n and keep(cue := b"+ " + w))
        double = Counter(itertools.compress(zip(words[:-2], words[1:-1], strict=True), map(trusted.__contains__, words[1:-1])))
        double.subtract(pair for i in ends if i > 1 and (pair := (words[i - 2], words[i - 1]))[1] in trusted)
        yield from ((cue, n) for (a, b), n in double.items() if a and n and keep(cue := b"2 " + a + b" " + b))

    words: list[bytes | None] = [None, None]  # None parts texts
    for text in texts:
        for own in word_lists(text):
            words += own
            if len(words) > WORDS_AT_ONCE:
                yield from counted(words)
                words = words[-2:]
        words.append(None)
    yield from counted(words)


def place_counts(texts: DataFrame, likely: DataFrame) -> DataFrame:
    """(cue, places) of the likely patterns over all texts (text).

    Tasks leave out patterns of other hash buckets than the likely ones' before anything is shuffled; the bits of the
    buckets go to the driver and to tasks: 2 million at most. A join leaves the likely ones.
    """
    numbered = likely.select(F.pmod(F.xxhash64("cue"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
    bits = np.zeros(BUCKETS, bool)
    bits[numbered.toPandas()["b"].to_numpy(np.int64)] = True
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = np.unpackbits(packed).tobytes(), {}

        def keep(cue: bytes) -> bool:
            found = known.get(cue)
            if found is None:
                found = bool(wanted[bucket(cue)])
                if cue[:1] != b"2" and len(known) < MOST_KNOWN:  # single words come again
                    known[cue] = found
            return found

        for batch in batches:
            sums: Counter = Counter()
            for cue, n in places(batch.column(0).to_pylist(), keep):
                sums[cue] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["cue", "places"])

    counted = texts.select("text").mapInArrow(run, "cue string, places long").groupBy("cue").agg(F.sum("places").alias("places"))
    return counted.join(likely, "cue", "left_semi")


def one_less_product(share: Column) -> Column:
    """One less the product of what each share leaves."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - share, F.lit(1e-12)))))


def kinds_of(shape: Column) -> Column:
    return F.create_map(*itertools.chain.from_iterable((F.lit(s), F.array(*map(F.lit, kinds))) for s, kinds in SHAPES.items()))[shape]


def bootstrap(texts: DataFrame, found: DataFrame, support: int = SUPPORT, precision: float = PRECISION, sure: float = SURE, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """(value, kind, score) of the identifiers that are known in the end, seeds with 1, and the path of their table.

    found: (start, end, kind, shape, value, cues), a row for each identifier of texts. A pattern's confidence for a kind is
    the score of the known identifiers in its places over all its places and one; it counts from `precision` and `support`
    different identifiers on. An identifier's score for a kind of its shape is what the product of its patterns' doubts
    leaves. Patterns whose places could not be taken by enough identifiers, were all of them known, are left out before.
    """
    spark = found.sparkSession
    marks = found.select("value", F.explode("cues").alias("cue")).groupBy("cue", "value").agg(F.count("*").alias("n"))
    marks, marks_at = saved_at(marks, "marks")
    likely, likely_at = saved_at(marks.groupBy("cue").agg(F.count("*").alias("values"), F.sum("n").alias("taken")).filter(F.col("values") >= support), "likely")
    counts = place_counts(texts, likely.select("cue")).join(likely, "cue").filter(F.col("taken") >= precision * (F.col("places") + 1)).select("cue", "places")
    counts, counts_at = saved_at(counts, "places")
    links, links_at = saved_at(marks.join(counts, "cue"), "links")
    open_, open_at = saved_at(found.filter("kind is null").select("value", F.explode(kinds_of(F.col("shape"))).alias("kind")).distinct(), "open")
    seeds = found.filter("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    known, known_at = saved_at(seeds, "known")
    for _ in range(rounds):
        trusted = links.join(known, "value").groupBy("cue", "kind", "places").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("values"))
        trusted = trusted.filter(F.col("values") >= support).select("cue", "kind", (F.col("hits") / (F.col("places") + 1)).alias("share")).filter(F.col("share") >= precision)
        named = links.select("cue", "value").join(trusted, "cue").groupBy("value", "kind").agg(one_less_product(F.col("share")).alias("score")).filter(F.col("score") >= sure)
        fresh = named.join(open_, ["value", "kind"], "left_semi").join(seeds, ["value", "kind"], "left_anti")
        more, more_at = saved_at(seeds.unionByName(fresh), "known")
        delete(spark, known_at)
        known, known_at = more, more_at
    for path in (marks_at, likely_at, counts_at, links_at, open_at):
        delete(spark, path)
    return known, known_at


def find_personal_data(documents: DataFrame, **limits: float) -> DataFrame:
    """The columns of documents without text, and spans (replaced if there): array of (start, end, kind, base), in order of
    start and kind. start and end are code points; base says that the kind's own pattern has found it.

    limits: as bootstrap's. A null or empty text has none; equal rows all have theirs; an empty table gives none. Texts
    are read twice: for identifiers, and to count the places of patterns.
    """
    name, row = free_name(documents, "found"), free_name(documents, "row")
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("text", "spans")]
    texts = bound_batches(documents)
    rows, _ = saved_at(texts.select(*others, F.monotonically_increasing_id().alias(row), found_in(F.col("text")).alias(name)), "identifiers")
    found = rows.select(F.col(row).alias("at"), F.explode(name).alias("f")).select("at", "f.*")
    known, known_at = bootstrap(texts, found, **limits)
    best, _ = saved_at(known.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("named")), "named")
    delete(documents.sparkSession, known_at)
    open_ = found.filter("kind is null").select("at", "start", "end", "shape", "value")
    hits = open_.join(best, "value").filter(F.array_contains(kinds_of(F.col("shape")), F.col("named")))
    span = lambda start, end, kind, base: F.struct(start.alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("k"), end.alias("end"), kind.alias("kind"), base.alias("base"))
    added = hits.groupBy(F.col("at").alias(row)).agg(F.collect_list(span(F.col("start"), F.col("end"), F.col("named"), F.lit(False))).alias(f"{name}_more"))
    base = F.transform(F.filter(name, lambda f: f["kind"].isNotNull()), lambda f: span(f["start"], f["end"], f["kind"], F.lit(True)))
    every = F.array_sort(F.when(F.col(f"{name}_more").isNull(), base).otherwise(F.concat(base, f"{name}_more")))
    spans = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return rows.join(added, row, "left").select(*others, spans.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets in its place; of spans that overlap, the first covers the others."""
    step = lambda so, s: F.when(s["end"] <= so["at"], so).otherwise(
        F.struct(
            F.when(s["start"] < so["at"], so["out"]).otherwise(F.concat(so["out"], F.substr(text, (so["at"] + 1).cast("int"), (s["start"] - so["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).alias("out"),
            s["end"].alias("at"),
        )
    )
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda so: F.concat(so["out"], F.substr(text, (so["at"] + 1).cast("int"))))


def personal_data_digest(documents: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the spans of the kinds' own patterns, and all spans as text."""
    rows = find_personal_data(documents.select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
