import random
from collections import defaultdict

import numpy as np
from llm_fixtures import empty_documents, odd_documents, sentence
from pyspark.sql import functions as F

from turnscale.llm import near_copies


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return a == b or bool(x) and len(x & y) >= 0.8 * len(x | y)


def planted(seed=4):
    r = random.Random(seed)
    rows, group = [], {}
    for g in range(30):
        base = sentence(r, r.randint(60, 400)).split()
        for _ in range(r.randint(1, 12)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = "edit" + str(r.randint(0, 9999))
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    return rows, group


def test_groups_are_what_similarity_links(spark):
    rows, group = planted()
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = defaultdict(set)
    for r in near_copies.near_copy_groups(docs).collect():
        found[r.root].add(r.doc_id)
    together = {(min(m), i) for m in found.values() for i in m}
    want = {(root(i), i) for i in range(len(rows))}
    assert all(len({group[i] for i in m}) == 1 for m in found.values())
    assert want <= together
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {min(m) for m in found.values()}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(r.doc_id is None for r in rows) == docs.filter("doc_id is null").count()
    named = [r for r in rows if r.doc_id is not None]
    assert len({(r.doc_id, r.text) for r in named}) == len(named)
    texts = [r.text for r in named]
    assert len(set(texts)) == len(texts) and {t for t in texts if t is None or not t.split()} >= {None, "", " "}
    first = {t: min(r.doc_id for r in docs.collect() if r.doc_id is not None and r.text == t) for t in texts}
    assert all(first[r.text] == r.doc_id for r in named)
    assert near_copies.drop_near_copies(empty_documents(spark)).count() == 0


def test_near_copies_meet_past_an_unrelated_text(spark):
    """Texts of the same pairs of words in another order share every two-word SimHash, and no five words."""
    r = random.Random(6)
    blocks = [" ".join(f"w{n}x{k}" for k in range(3)) for n in range(60)]
    base = "a " + " a ".join(blocks) + " a"
    rows = [(0, base), (1, base.replace("w30x1", "edit"))]
    for i in range(40):
        r.shuffle(blocks)
        rows.append((2 + i, "a " + " a ".join(blocks) + " a"))
    assert not any(alike(t, rows[0][1]) for _, t in rows[2:])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(docs).collect()) == [0, *range(2, 42)]


def test_every_pair_of_a_cell_meets(spark):
    rows = [(c, n) for c, size in ((1, 23), (2, 4), (3, 1)) for n in range(c * 100, c * 100 + size)] + [(4, 100), (4, 101)]
    members = spark.createDataFrame(rows, "cell long, node long")
    found = near_copies.cell_pairs(members, lambda left, right: F.col(left + "node") % 7 != 0, block=5)
    want = {(a, b) for c, size in ((1, 23), (2, 4)) for a in range(c * 100, c * 100 + size) for b in range(a + 1, c * 100 + size)}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) <= want and {(a, b) for a, b in want if a % 7 and b % 7} <= set(got)


def test_nodes_of_one_root_are_not_paired(spark):
    """Of a cell of 40 texts in a group, 9 in another and 3 alone, just the pairs across meet, whatever the block."""
    root = {n: 0 if n < 40 else 40 if n < 49 else n for n in range(52)}
    members = spark.createDataFrame([(1, n, root[n]) for n in root] + [(2, n, 0) for n in range(30)], "cell long, node long, root long")
    want = sorted((a, b) for a in root for b in root if a < b and root[a] != root[b])
    for block in (4, 1000):
        assert sorted(map(tuple, near_copies.cell_pairs(members, lambda x, y: F.lit(True), block=block).collect())) == want


def test_a_large_group_of_near_copies_and_one_apart(spark):
    """200 near copies of a text, each with words of its own: one group, by way of far fewer pairs than they have."""
    r = random.Random(3)
    base = sentence(r, 300).split()
    rows = [(0, sentence(r, 200))]
    for i in range(200):
        words = list(base)
        for _ in range(2):
            words[r.randrange(300)] = f"own{i}"
        rows.append((i + 1, " ".join(words)))
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1]


def edits(r, words):
    """One text for each kind of edit, near a similarity of 0.8."""
    new, n = lambda k: sentence(r, k).split(), len(words)
    at = r.randrange(n // 10, n - n // 5)
    yield "22 % appended", words + new(int(n * 0.22))
    yield "15 % appended", words + new(int(n * 0.15))
    yield "9 % block replaced", words[:at] + new(int(n * 0.09)) + words[at + int(n * 0.09) :]
    yield "20 % block put in", words[:at] + new(int(n * 0.2)) + words[at:]
    yield "15 % cut off", words[: n - int(n * 0.15)]
    places = set(r.sample(range(n), n // 50))
    yield "words changed", ["edit" if i in places else w for i, w in enumerate(words)]


def test_no_kind_of_edit_is_missed(spark):
    r = random.Random(8)
    rows, kinds = [], []
    for _ in range(240):
        base = sentence(r, r.randint(120, 600))
        kind, words = list(edits(r, base.split()))[len(kinds) % 6]
        if alike(base, " ".join(words)):
            kinds.append((kind, len(rows), len(rows) + 1))
            rows += [(len(rows), base), (len(rows) + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {x.doc_id: x.root for x in near_copies.near_copy_groups(docs).collect()}
    missed = [kind for kind, a, b in kinds if root[a] != root[b]]
    counts = {kind: (sum(k == kind for k, _, _ in kinds), missed.count(kind)) for kind, _, _ in kinds}
    assert len(counts) == 6 and min(n for n, _ in counts.values()) >= 20
    assert not missed, counts
    assert len(set(root.values())) == len(kinds)


def test_prefixes_of_similar_sets_meet():
    r = random.Random(9)
    for n in (1, 2, 4, 5, 6, 9, 10, 37, 100):
        for _ in range(30):
            x = set(r.sample(range(-10_000, 10_000), n))
            y = set(r.sample(sorted(x), r.randint(max(1, int(0.8 * n)), n))) | set(r.sample(range(20_000, 30_000), r.randint(0, n // 4)))
            if len(x & y) >= 0.8 * len(x | y):
                common = np.array(sorted(r.sample(sorted(x | y), len(x) // 2)), np.int64)
                first = [set(near_copies.prefix(np.array(sorted(s), np.int64), common, 0.8).tolist()) for s in (x, y)]
                assert first[0] & first[1]


def test_parity_bits_never_differ_more_than_the_sets():
    r = np.random.default_rng(2)
    for n in (1, 5, 50, 400, 5000):
        x, y = (np.unique(np.concatenate([r.integers(-(1 << 63), 1 << 63, n), np.arange(n) << 22])) for _ in range(2))
        bits = np.bitwise_count((near_copies.parity_bits(x) ^ near_copies.parity_bits(y)).view(np.uint64)).sum()
        long, half = near_copies.parity_bits(x, 32), near_copies.parity_bits(x, 16)
        assert near_copies.sketch_longs(len(x)) * 32 >= len(x) and not np.any(long[:16] ^ long[16:] ^ half)
        assert bits <= len(np.setxor1d(x, y)) and not np.any(near_copies.parity_bits(x) ^ near_copies.parity_bits(x.copy()))


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With hashes of a few values, different texts share one; they are told by the second hash."""
    monkeypatch.setattr(near_copies, "node", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    r = random.Random(5)
    texts = [sentence(r, 30 + i) for i in range(24)] + [None, "", " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [(200, texts[3] + " end"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, near_copies.drop_near_copies(docs).collect()))
    assert kept == [(i, t) for i, t in enumerate(texts)]


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    from turnscale.llm import common

    r = random.Random(6)
    before = common.marked()
    docs = spark.createDataFrame([(i, sentence(r, 40) if i % 3 else "the same text of some words here " * 5) for i in range(60)], "doc_id long, text string")
    rows = near_copies.drop_near_copies(docs)
    names = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._GIVEN[before:])
    assert names == ["clashes", "groups", "roots", "stays"] and rows.count() == 41
