import os
import struct

import numpy as np
import pytest
from llm_fixtures import empty_documents, odd_documents
from pyspark.sql import functions as F

from turnscale.llm import pieces, vector_search

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def vectors(spark, n=800, dims=64, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    x[100:120] = x[100:101]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(n)]
    rows += [(5000, None), (5050, []), (5100, [0.0] * dims), (5150, [float("nan")] * dims), (5200, [None, *[1.0] * (dims - 1)]), (5250, [1.0] * 3), (None, [1.0] * dims), (5300, [float("inf")] * dims)]
    return spark.createDataFrame([(*r_, "q", 1.0) for r_ in rows], "vec_id long, embedding array<double>, query_id string, score double"), x


def test_recall_and_order(spark):
    df, x = vectors(spark)
    got = vector_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0, block=300).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 800, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        exact = unit @ unit[q]
        best = [i for i in np.lexsort((np.arange(800), -np.round(exact, 12))) if i != q][:5]
        hits += len(set(best) & {r.vec_id for r in mine})
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in mine)
    assert len(got) == 80 and hits >= 0.9 * 80
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]


def test_few_vectors(spark):
    df, _ = vectors(spark, 3, 8)
    got = vector_search.nearest_neighbours(df.filter("vec_id < 3"), F.col("vec_id") == 0, radius_share=0.0).collect()
    assert sorted(r.vec_id for r in got) == [1, 2]
    assert vector_search.nearest_neighbours(df.filter("vec_id = 5000"), F.lit(True)).count() == 0
    assert vector_search.nearest_neighbours(df.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 5, 9, 17, 40, 64])
def test_index_finds_every_code_within_the_radius(radius):
    r = np.random.default_rng(radius)
    codes = r.integers(0, 256, (400, 8)).astype(np.uint8)
    codes[:50] = codes[0] ^ np.packbits(r.random((50, 64)) < 0.1, axis=1)
    index = vector_search.MultiIndex(codes)
    for q in codes[:5]:
        want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
        assert sorted(index.within(q, radius)) == want.tolist()


def test_rotation_is_orthogonal_and_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 16)) * np.linspace(3, 0.1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = vector_search.fit_rotation(x)
    assert np.allclose(turn.T @ turn, np.eye(16))
    loss = lambda m: np.mean((np.sign(x @ m) / 4 - x @ m) ** 2)
    assert loss(turn) < loss(np.eye(16))


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2.1e200]), (2, [5e-324, 0.0]), (3, [1.7e308, -1.7e308]), (4, [1.0, 2.0]), (5, [-1e-310, -2e-310]), (6, [0.0, 0.0]), (7, [1e308, None])]
    found = vector_search.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, k=9).collect()
    kept = {i: np.ldexp(np.array(v), -np.frexp(np.abs(v).max())[1]) for i, v in rows[:6]}
    assert len(found) == 30 and all(np.isfinite(x.score) for x in found)
    for q, own in kept.items():
        got = [(x.vec_id, x.score) for x in sorted(found, key=lambda x: x.rank) if x.query_id == q]
        want = sorted((-float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)), i) for i, v in kept.items() if i != q)
        assert [round(-s, 9) for s, _ in want] == [round(s, 9) for _, s in got]


def test_radius_fits_the_vectors():
    """On clustered vectors most codes are never looked at, and nearly all of the nearest are found."""
    r = np.random.default_rng(4)
    middles = r.normal(size=(200, 64))
    x = middles[r.integers(0, 200, 6000)] + 0.15 * r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = vector_search.fit_rotation(x[:2000])
    radius = vector_search.learn_radius(x[:2000], turn, 5)
    index = vector_search.MultiIndex(vector_search.encode(x, turn))
    found, looked = 0, 0
    for q in range(100):
        near = x @ x[q]
        near[q] = -9
        best = set(np.argsort(-near)[:5].tolist())
        own = index.within(index.codes[q], radius)
        found, looked = found + len(best & set(own.tolist())), looked + len(own)
    assert found >= 0.95 * 500 and looked < 0.1 * 100 * 6000
    assert vector_search.learn_radius(x[:1], turn, 5) == 64


def test_every_length_is_searched_by_itself(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8 if i % 3 else 5).tolist()) for i in range(60)] + [(100, [1.0])]
    found = vector_search.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=3).collect()
    for q in range(0, 60, 10):
        mine = np.array(rows[q][1])
        scores = sorted((-float(np.dot(v, mine) / np.linalg.norm(v) / np.linalg.norm(mine)), i) for i, v in rows[:60] if i != q and len(v) == len(mine))
        got = sorted((x.rank, x.vec_id) for x in found if x.query_id == q)
        assert len(got) == 3 and len({i for _, i in got} & {i for _, i in scores[:3]}) >= 2
    assert not [x for x in found if x.query_id == 100], "no other vector has its length"


TEXTS = ["", " ", "  a  b ", "plain words here", "<s> </s> <0x0A> ▁ x", "\n\n\tx \n y", "日本語🙂 ñ é", "a" * 3000 + " b", "tail ", "one\ntwo three\n", "\u0000  "]


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(MODEL):
        pytest.skip("no model here")
    return pieces.read_model(MODEL)


def test_parity_with_the_reference_library(model):
    codec, other = pieces.PieceCodec(model), pieces.reference(model)
    ids = list(codec.encode(TEXTS))
    assert [x.tolist() for x in ids] == [other.encode(t) for t in TEXTS]
    assert list(codec.decode(ids)) == [t.replace("▁", " ") for t in TEXTS] == [codec.plain(t) for t in TEXTS]
    assert [other.decode(x.tolist()) for x in ids] == list(codec.decode(ids))


def test_any_ids_decode_as_the_reference_library_does(model):
    codec, other = pieces.PieceCodec(model), pieces.reference(model)
    assert list(codec.decode([np.array([1, 306, 2]), np.array([0, 306])])) == ["th", " \u2047  th"]
    r = np.random.default_rng(5)
    some = [r.integers(0, top, n) for top in (4, 300, len(codec.bytes)) for n in (1, 2, 3, 8, 40) for _ in range(60)]
    assert list(codec.decode(some)) == [other.decode(x.tolist()) for x in some]


def test_encode_and_decode_documents(spark, model):
    docs = odd_documents(spark)
    out = pieces.encode_documents(docs, model, check_one_in=1)
    assert out.columns == [*(c for c in docs.columns if c not in ("text", "token_ids")), "n_tokens", "token_ids", "round_trip", "parity"]
    rows = out.collect()
    assert all(r.n_tokens == len(r.token_ids) and r.round_trip and r.parity for r in rows if r.n_tokens is not None)
    assert sum(r.n_tokens is None for r in rows) == docs.filter("text is null").count()
    back = pieces.decode_tokens(out.select("doc_id", "token_ids"), model)
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(map(str, (r.text for r in docs.collect())))
    assert pieces.encode_documents(empty_documents(spark), model).count() == 0


def test_parity_is_checked_on_every_text(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    got = {r.doc_id: r.parity for r in pieces.encode_documents(docs, model).collect()}
    assert got == {i: True for i in range(len(TEXTS))} | {len(TEXTS): None}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def own_model(kind, squeeze=0, byte_fallback=True):
    listed = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    listed += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] if byte_fallback else []
    words = ["▁", "a", "b", "c", "▁a", "ab", "▁ab", "abc", "bc", "▁abc", "▁▁", "é"]
    listed += [(w, -1.0 - n / 4, pieces.NORMAL) for n, w in enumerate(reversed(words))]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in listed)
    data += field(2, field(3, kind) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2))
    return data + field(3, field(1, b"identity") + field(3, 1) + field(4, squeeze) + field(5, 1))


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_own_models(kind, squeeze):
    data = own_model(kind, squeeze)
    codec, other = pieces.PieceCodec(data), pieces.reference(data)
    assert codec.model.kind == kind and codec.model.squeeze == bool(squeeze)
    texts = ["abc ab a", "abcabc", "  ab   abc ", "xyz é 日", "", "a\nb", "cab abc bca"]
    ids = list(codec.encode(texts))
    assert [x.tolist() for x in ids] == [other.encode(t) for t in texts]
    assert list(codec.decode(ids)) == [codec.plain(t) for t in texts] == [other.decode(other.encode(t)) for t in texts]


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_texts_cannot_spell_control_pieces(kind, byte_fallback):
    data = own_model(kind, byte_fallback=byte_fallback)
    codec, other = pieces.PieceCodec(data), pieces.reference(data)
    texts = ["a <s> b", "</s> x", "<unk> here", "x <0x41> y", "<s>", "<0x41><0x42>ab", "ab<unk>", " <s>", "a  </s>", "日<s>本", "xxab\u0000<0x0A>\n"]
    ids = list(codec.encode(texts))
    assert [x.tolist() for x in ids] == [other.encode(t) for t in texts]
    assert not {1, 2} & {i for x in ids for i in x.tolist()}
    assert list(codec.decode(ids)) == [other.decode(x.tolist()) for x in ids]
    if byte_fallback:
        assert list(codec.decode(ids)) == [codec.plain(t) for t in texts]


def test_columns_with_the_names_of_steps(spark, model):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], "doc_id long, text string, _e int, encoded int, Encoded_ int, text_ int")
    row = pieces.encode_documents(docs, model).head()
    assert row.parity and (row["_e"], row["encoded"], row["Encoded_"]) == (1, 2, 3)


def test_unsupported_models():
    with pytest.raises(ValueError):
        pieces.PieceModel.parse(own_model(3))


def test_batches_look_up_each_word_once(monkeypatch):
    """Ids of odd texts in one batch, whose ids are put together in small parts; the reference gets texts by the batch."""
    with open(MODEL, "rb") as f:
        data = f.read()
    own, reference, calls = pieces.PieceCodec(data), pieces.reference(data), []
    monkeypatch.setattr(pieces, "IDS_AT_ONCE", 2)
    texts = ["", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n", "a \n b", "▁", "x\0y z", "é😀 ü\n\n\nq", "\na", "a\n", "b c b d", "\r\n a"] * 3
    found = list(own.encode(texts))
    assert [x.tolist() for x in found] == [reference.encode(t) for t in texts]

    class Counting:
        def encode(self, group, **how):
            calls.append(len(group))
            return reference.encode(group, **how)

    found[1] = found[1][:0]
    check = [n % 2 == 1 for n in range(len(texts))]
    assert list(pieces.same_ids(Counting(), texts, found, check)) == [n > 1 if c else None for n, c in enumerate(check)]
    assert calls == [24]
