"""SentencePiece encoding and decoding with the tokenizers library, built from a model's protobuf."""

from __future__ import annotations

import codecs
import functools
import itertools
import os
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, free_name

#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK, UNKNOWN_TEXT = "▁", " \u2047 "
# A byte that is of no character is one U+FFFD.
codecs.register_error("a-mark-each", lambda e: ("\ufffd" * (e.end - e.start), e.end))
#: Characters handed to the library at once, words of which the ids are kept, words that go to it as one text, and ids
#: whose bytes are put together at once.
BATCH_CHARS, CACHE, JOINED, IDS_AT_ONCE = 1 << 20, 300_000, 100, 1 << 20


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message: varints as numbers, the other kinds as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What encoding needs of a SentencePiece model."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in wire(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(wire(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                spec = dict(wire(value))
                model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                model.suffix = bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(wire(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        model.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
            raise ValueError("only unigram and BPE models with escaped, leading spaces are supported")
        return model

    @property
    def words_apart(self) -> bool:
        """No piece has the mark after another character, so that a text can be cut before any run of marks."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def normaliser(model: PieceModel):
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, by the score of the piece: the order in which BPE joins them."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    pairs = [(-s, p[:i], p[i:]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    return [(a, b) for _, a, b in sorted(pairs, key=lambda x: x[0])]


def build(model: PieceModel):
    """The tokenizer: normaliser, mark, scores or merges, byte fallback and decoder of the model."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if model.kind == UNIGRAM:
        # A text must not spell a control, unknown or byte piece: with a space before it, which no normal text has, none does.
        # So bytes are put in by PieceCodec, which knows what was unknown.
        core = models.Unigram([(p if kind in (NORMAL, USER_DEFINED) else " " + p, s) for p, s, kind in model.pieces], unk_id=model.unknown, byte_fallback=False)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    return out


class PieceCodec:
    """Encodes and decodes batches of whole texts.

    Where no piece reaches over the start of a word, or into or out of a line end, a text with single spaces is the
    sequence of its words: each distinct word of a batch goes to the library once, and its ids are kept for the next
    batches until there are CACHE of them. Other texts go to the library whole.
    """

    def __init__(self, data: bytes):
        self.model = PieceModel.parse(data)
        self.tokenizer, self.normaliser = build(self.model), normaliser(self.model)
        plain = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.simple = self.model.dummy_prefix and not self.model.charsmap and not self.model.squeeze
        apart = self.model.words_apart and MARK in plain and not any("\n" in p for p in plain)
        # Without byte pieces a run of unknown characters is one piece, and that can reach over a line end.
        self.by_word = self.simple and apart and self.model.byte_fallback and not any(kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        own = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode()}
        self.bytes = [own.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in self.model.pieces]
        found = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.of_byte = [found[b] for b in range(256)] if self.model.kind == UNIGRAM and self.model.byte_fallback and len(found) == 256 else None
        self.control = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        self.marked = {i for i, (p, _, kind) in enumerate(self.model.pieces) if kind not in own and p.startswith(MARK)}
        # The ids that begin a word, where texts go to the library by words; the pieces' bytes, one after the other.
        self.begins = np.zeros(len(self.model.pieces), bool)
        self.begins[[*self.marked, *([found[10]] if 10 in found else [])]] = True
        self.ends = np.cumsum([len(b) for b in self.bytes], dtype=np.int64)
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.odd = np.array([kind in (CONTROL, UNKNOWN) for _, _, kind in self.model.pieces])

    def normal(self, text: str) -> str:
        if self.simple:  # the same, without a copy for the library
            return (MARK + text).replace(" ", MARK) if text else ""
        return self.normaliser.normalize_str(text)

    def ids(self, normal: list[str]) -> Iterator[bytes]:
        for text, found in zip(normal, self.tokenizer.encode_batch_fast(normal, add_special_tokens=False), strict=True):
            if self.of_byte and self.model.unknown in found.ids:
                yield array("i", self.with_bytes(text)).tobytes()
            else:
                yield array("i", found.ids).tobytes()

    def word_ids(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word. No piece reaches over a word's start, so many words go as one text, and are told apart by it."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for group, found in zip(groups, self.ids(["".join(g) for g in groups]), strict=True):
            ids = np.frombuffer(found, np.int32)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(group):
                yield from self.ids(group)
                continue
            edges = [*(4 * starts).tolist(), len(found)]
            yield from (found[a:b] for a, b in itertools.pairwise(edges))

    def with_bytes(self, normal: str) -> Iterator[int]:
        """The ids of a text, with the byte pieces of its unknown characters."""
        found = self.tokenizer.encode(normal, add_special_tokens=False)
        for i, (start, end) in zip(found.ids, found.offsets, strict=True):
            if i == self.model.unknown:
                yield from map(self.of_byte.__getitem__, normal[start:end].encode())
            else:
                yield i

    def spaced(self, text: str) -> str | None:
        """The words of a text with a space between any two: a word is preceded by a space, or begins with the line end
        before it. None if the text isn't made of such."""
        spaced = text.replace("\n", " \n")
        if not self.by_word or not text or "  " in spaced or spaced[0] == " " or spaced[-1] == " " or MARK in text:
            return None
        return spaced

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for group in grouped(texts):
            parts = [self.spaced(t) for t in group]
            apart = self.by_words([p for p in parts if p is not None])
            whole = self.ids([self.normal(t) for t, p in zip(group, parts, strict=True) if p is None])
            for own in parts:
                yield np.frombuffer(next(whole), np.int32) if own is None else next(apart)

    def by_words(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of texts of words with spaces between them. Each distinct word is looked up once."""
        if not texts:
            return
        if len(self.known) > CACHE // 2:  # what isn't asked for until there are as many others again is forgotten
            self.before, self.known = self.known, {}
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        asked = [w for w in words if w not in self.known]
        self.known.update((w, self.before[w]) for w in asked if w in self.before)
        new = [w for w in asked if w not in self.before]
        self.known.update(zip(new, self.word_ids([w if w[0] == "\n" else MARK + w for w in new]), strict=True))
        found = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, joined = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), np.int32)
        ids = []
        for at in range(0, len(places), IDS_AT_ONCE):
            some = places[at : at + IDS_AT_ONCE]
            own = sizes[some]
            upto = np.cumsum(own)
            ids.append(joined[np.arange(upto[-1]) + np.repeat(starts[some] - upto + own, own)])
        edges = np.concatenate([[0], np.cumsum(sizes[places])])[split.offsets.to_numpy()]
        yield from np.split(np.concatenate(ids), edges[1:-1])

    def decode(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Texts of ids: the bytes of their pieces, without the mark that the model puts before a text.

        Control pieces have no text and part the bytes of a character, an unknown piece is UNKNOWN_TEXT, and a byte that
        is of no character U+FFFD.
        """
        for own in map(np.asarray, ids):
            if not len(own):
                yield ""
                continue
            odd = self.odd[own].any()
            text = "".join(map(self.read, self.parted(own))) if odd else self.read(own)
            first = next((i for i in own.tolist() if i not in self.control), None) if odd else int(own[0])
            yield text[1:] if self.model.dummy_prefix and first in self.marked else text

    def parted(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The runs of ids between control pieces."""
        for control, part in itertools.groupby(ids.tolist(), self.control.__contains__):
            if not control:
                yield np.array(list(part), np.int64)

    def read(self, ids: np.ndarray) -> str:
        """The text of the pieces' bytes, which are copied from where they stand one after the other."""
        out = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            some = ids[at : at + IDS_AT_ONCE]
            ends = self.ends[some]
            sizes = ends - np.where(some > 0, self.ends[some - 1], 0)
            upto = np.cumsum(sizes)
            out.append(self.joined[np.arange(upto[-1]) + np.repeat(ends - upto, sizes)].tobytes())
        return b"".join(out).decode("utf-8", "a-mark-each")

    def plain(self, text: str) -> str:
        """What decoding gives back: the text after the model's normaliser."""
        return self.normal(text).replace(MARK, " ").removeprefix(" " if self.model.dummy_prefix else "")


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


@functools.lru_cache(maxsize=2)
def codec(data: bytes) -> PieceCodec:
    return PieceCodec(data)


@functools.lru_cache(maxsize=2)
def reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def same_ids(checked, texts: list[str], ids: list[np.ndarray], check: Iterable[bool]) -> Iterator[bool | None]:
    """Whether the SentencePiece library, which gets batches of whole texts, has these ids; None where it isn't asked."""
    check = list(check)
    found = (f for group in grouped(itertools.compress(texts, check)) for f in checked.encode(group, num_threads=1))
    for own, c in zip(ids, check, strict=True):
        yield array("i", next(found)).tobytes() == own.tobytes() if c else None


def read_model(path: str) -> bytes:
    """The model file's bytes. It is read by the driver and goes to tasks with their code: half a megabyte."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name, compression=None) as stream:
        return stream.read()


def threaded(threads: int) -> None:
    """Let the library encode a batch with so many threads, unless the worker has begun with another number."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"


def encode_documents(documents: DataFrame, model: bytes, threads: int = 2, check_one_in: int = 1) -> DataFrame:
    """The columns of documents without text, and n_tokens, token_ids, round_trip, parity (replaced if there).

    round_trip: decoding the ids gives the text back, as the model normalises it. parity: that the SentencePiece library has the
    same ids for the whole text; with check_one_in over 1 on one text in so many by its hash, and null on the others. A null text has null in all four;
    an empty one no tokens. One pass over whole texts in batches, without a shuffle; `threads` encode a batch.
    """

    @F.pandas_udf("struct<n_tokens:long,token_ids:array<int>,round_trip:boolean,parity:boolean>")
    def encode(texts: pd.Series, check: pd.Series) -> pd.DataFrame:
        threaded(threads)
        pieces, checked = codec(model), reference(model)
        filled = [t if isinstance(t, str) else "" for t in texts]
        ids = list(pieces.encode(filled))
        back = [x == pieces.plain(t) for x, t in zip(pieces.decode(ids), filled, strict=True)]
        same = list(same_ids(checked, filled, ids, check))
        return pd.DataFrame({"n_tokens": [len(x) for x in ids], "token_ids": ids, "round_trip": back, "parity": pd.Series(same, dtype=object)})

    added = ["n_tokens", "token_ids", "round_trip", "parity"]
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("text", *added)]
    found = encode(F.col("text"), F.pmod(F.xxhash64("text"), F.lit(check_one_in)) == 0)
    name = free_name(documents, "encoded")
    rows = bound_batches(documents).select(*others, F.struct(F.col("text").isNotNull().alias("there"), found.alias("e")).alias(name))
    return rows.select(*others, *[F.when(F.col(f"{name}.there"), F.col(f"{name}.e.{c}")).alias(c) for c in added])


def decode_tokens(tokens: DataFrame, model: bytes, ids: str = "token_ids", threads: int = 2) -> DataFrame:
    """The columns of tokens with `text` in place of the ids; null ids give a null text."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        threaded(threads)
        texts = codec(model).decode(np.asarray(x if x is not None else [], np.int64) for x in batch)
        return pd.Series([t if x is not None else None for t, x in zip(texts, batch, strict=True)], dtype=object)

    return bound_batches(tokens).select(*[F.col(f"`{c}`") for c in tokens.columns if c not in (ids, "text")], decode(ids).alias("text"))


def default_model(spark: SparkSession) -> str:
    """Path of the model: the setting turnscale.piece_model of the session, or the public one of this machine."""
    return spark.conf.get("turnscale.piece_model", "/opt/tokenizers/piece_bpe_32k.model")
