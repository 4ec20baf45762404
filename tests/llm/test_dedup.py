import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_fixtures import empty_documents, odd_documents
from pyspark.sql import functions as F

from turnscale.llm import components, line_dedup, simhash

TABLE = {i: i + 32 for i in range(65, 91)}


def brute_lines(rows, least_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(TABLE)
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc_id, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < least_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_line_dedup_matches_brute_force(spark, batches, fanout):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = line_dedup.line_dedup_digest(docs, least_docs=10, batches=batches, fanout=fanout)
    got = Counter(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == brute_lines(rows, 10)
    assert sum(n * k[2] for k, n in got.items()) > 40


def test_line_dedup_rows(spark):
    docs = odd_documents(spark)
    kept = line_dedup.dedup_lines(docs, keep_first=True, counts=False)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    footers = [r.doc_id for r in kept.filter("text like '%shared footer line%'").collect()]
    assert footers == [min(r.doc_id for r in docs.filter("text like '%shared footer line%'").collect())]
    assert kept.filter("text is null").count() == docs.filter("text is null").count()
    assert line_dedup.dedup_lines(docs).columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert line_dedup.line_dedup_digest(empty_documents(spark)).count() == 0


def test_runs_compact_in_levels(spark, tmp_path):
    keys = spark.range(50).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"))
    runs = line_dedup.LineRuns(spark, str(tmp_path), 4, fanout=2)
    for n in range(7):
        runs.add(keys.filter(F.col("h1") % (n + 1) == 0))
    assert [len(level) for level in runs.levels] == [1, 1, 1] and len(runs.written) == 11
    assert {r.h1 for r in runs.common().collect()} == {h for h in range(50) if sum(h % (n + 1) == 0 for n in range(7)) >= 4}


def test_a_batch_leaves_out_what_the_runs_have_as_common(spark, tmp_path):
    key = lambda *h: spark.createDataFrame([(x, 0) for x in h], "h1 long, h2 long")
    runs = line_dedup.LineRuns(spark, str(tmp_path), 3, fanout=2)
    runs.add(key(1, 1, 1, 2))
    assert [r.h1 for r in runs.unknown(key(1, 2, 3)).orderBy("h1").collect()] == [2, 3]
    runs.add(key(1, 2, 2, 3))
    assert [r.h1 for r in runs.unknown(key(1, 2, 3)).collect()] == [3], "the merged runs have 2 in three documents"
    counted = [{r.h1: r.docs for r in runs._read([p], False).collect()} for p in runs.written]
    assert counted == [{2: 1}, {2: 2, 3: 1}, {3: 1}] and {r.h1 for r in runs.common().collect()} == {1, 2}


def test_many_lines_take_no_longer_each(spark):
    rows = [(i, "\n".join(f"line {i} {n}" if n % 2 else f"shared {n}" for n in range(16_000))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    assert {(r.n_lines, r.n_dropped) for r in line_dedup.line_dedup_digest(docs).collect()} == {(16_000, 8_000)}
    assert time.monotonic() - start < 90


def brute_simhash(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_near_duplicates_match_brute_force(spark):
    docs = odd_documents(spark)
    base = docs.filter("doc_id = 30").head().text
    near = spark.createDataFrame([(1000 + i, base + " " * i + f" w{i}") for i in range(6)] + [(2000, "zero"), (None, base)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(near)
    given = rows.collect()
    prints = [brute_simhash(r.text) for r in given]
    roots = brute_components(prints)
    least = defaultdict(lambda: None)
    for r, root in zip(given, roots, strict=True):
        if r.doc_id is not None:
            least[root] = r.doc_id if least[root] is None else min(least[root], r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", least[root]) for r, p, root in zip(given, prints, roots, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(rows).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    named = [r for r in kept.collect() if r.doc_id is not None]
    assert len({r.doc_id for r in named}) == len(named) == len({v for k, v in least.items() if v is not None and v < 1000})
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


def test_anchors_find_every_link(spark):
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    words = {int(c) for c in centres}
    for c in centres:
        at = int(c)
        for _ in range(40):
            for b in r.integers(0, 64, r.integers(1, 4)):
                at ^= 1 << int(b)
            words.add(at)
    words = sorted(words)
    rows = spark.createDataFrame([(simhash.signed(w),) for w in words], "fingerprint long")
    found = {r.node: r.root for r in components.components(simhash.covering_links(rows)).collect()}
    roots = brute_components(words)
    group = defaultdict(list)
    for w, root in zip(words, roots, strict=True):
        group[root].append(simhash.signed(w))
    for members in group.values():
        assert {found.get(m, m) for m in members} == {min(members)}
    assert max(len(simhash.anchor_masks(s)) for s in range(64)) == 33
    # every word is within 1 of exactly one anchor of its own last bit
    for w in words[:50]:
        near = [m for m in simhash.anchor_masks(_syndrome(w)) if (m % (1 << 64)).bit_count() <= 1 and not m % (1 << 64) >> 63]
        assert len(near) == 1 and _syndrome(w ^ near[0]) == 0


def _syndrome(word):
    s = 0
    for p in range(1, 64):
        if word >> (p - 1) & 1:
            s ^= p
    return s
