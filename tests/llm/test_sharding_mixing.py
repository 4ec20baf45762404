import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from llm_fixtures import brute_packets, empty_documents, n_words, odd_documents, text_hash
from pyspark.sql import functions as F

from turnscale.llm import mixing, sharding


def spark_xxh64(shard, doc_id):
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), 42)
    return h if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)


def brute_shard(doc_id, weights):
    def score(i):
        u = ((spark_xxh64(i, doc_id) >> 11) + 0.5) * 2.0**-53
        return -math.log(u) / weights[i]

    return min(range(len(weights)), key=lambda i: (score(i), i))


def test_shards_match_brute_force(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_documents(docs, 7, bucket_rows=5).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and r.shard == brute_shard(r.doc_id, [1.0] * 7) and r.grown_shard == brute_shard(r.doc_id, [1.0] * 8)
        assert r.grown_shard in (r.shard, 7)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty_documents(spark)).count() == 0


def test_weighted_shards(spark):
    rows = spark.range(6000).withColumn("shard", F.lit("old"))
    counts = {r.shard: r["count"] for r in sharding.assign_shards(rows, ["id"], [1, 2, 3]).groupBy("shard").count().collect()}
    assert all(abs(counts[i] - 1000 * (i + 1)) < 150 for i in range(3))
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, ["id"], [1, 0])


def entries_of(docs):
    return [(r.doc_id, r.text, r.source, n_words(r.text)) for r in docs.collect()]


@pytest.mark.parametrize("quantum", [200, 7])
def test_mix_serves_packets_by_finish_time(spark, quantum):
    docs = odd_documents(spark).cache()
    rows = mixing.mix_sources(docs, bucket_rows=7, quantum=quantum).collect()
    again = mixing.mix_sources(docs.repartition(5), bucket_rows=50, quantum=quantum).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    entries = entries_of(docs)
    packets, target = brute_packets(entries, quantum)
    budget, taken, by_source = math.floor(1.5 * sum(e[3] for e in entries)), Counter(), Counter()
    left = budget
    for _, n, _, words in packets:
        taken[n] += min(words, left)
        left -= min(words, left)
    want = Counter((e[0], text_hash(e[1]), e[2], e[3], taken[n]) for n, e in enumerate(entries))
    assert Counter((r.doc_id, r.text_hash, r.source, r.size, r.taken) for r in rows) == want
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        by_source[r.source] += r.taken
    assert sum(by_source.values()) == budget and all(abs(by_source[s] - target[s]) <= quantum for s in target)
    assert mixing.mix_sources(empty_documents(spark)).count() == 0
    blank = docs.filter("text = '' or text is null")
    assert mixing.mix_sources(blank).agg(F.sum("taken")).head()[0] == 0


def whole_mix(docs):
    """(id, text hash, source, pass) of brute force in the mix's order, equal rows as one; how often each row stays."""
    merged = Counter()
    for doc_id, text, source, words in entries_of(docs):
        merged[doc_id, text, source] += words
    entries = [(*k, n) for k, n in merged.items()]
    packets, _ = brute_packets(entries, None)
    left, order = math.floor(1.5 * sum(e[3] for e in entries)), []
    for _, n, k, words in packets:
        left -= words
        if left < 0:
            break
        order.append((entries[n][0], text_hash(entries[n][1]), entries[n][2], k))
    return order, Counter(o[:3] for o in order)


def test_whole_documents_are_cut_where_the_finish_times_say(spark):
    docs = odd_documents(spark).cache()
    order, copies = whole_mix(docs)
    found = [(r.doc_id, r.text_hash, r.source, r["pass"]) for r in mixing.mix_order(docs, bucket_rows=7).collect()]
    assert found == order
    # By source first, as without the sort by finish time, the budget would end before the last sources.
    unsorted = sorted(order, key=lambda o: (o[3], str(o[2])))
    assert unsorted != order and any(o[3] == 1 for o in order[: len(order) - 20])
    mixed = mixing.take_mix(docs, bucket_rows=7)
    assert mixed.columns == docs.columns
    rows = Counter((r.doc_id, text_hash(r.text), r.source) for r in docs.collect())
    want = Counter({k: n * copies[k] for k, n in rows.items() if copies[k]})
    assert Counter((r.doc_id, text_hash(r.text), r.source) for r in mixed.collect()) == want
    assert mixing.take_mix(empty_documents(spark)).count() == 0
    assert mixing.take_mix(docs.filter("text is null")).count() == 0
