"""Each stage against a plain Python version of it, on what its predecessor kept."""

import math
import os
import random
from collections import Counter

import pytest
from llm_fixtures import WORDS, brute_packets, n_words, sentence

import corpus_pipeline
from turnscale.llm import passage_quality, pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(9)
    texts, quality = [], []
    for i in range(220):
        bad = i % 5 == 0
        text = "\n".join(" ".join((r.choice(WORDS) + str(r.randint(0, 40))).upper() + "!!" if bad else r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(5, 60))) for _ in range(r.randint(1, 4)))
        texts.append(text + ("\nA footer that many documents share." if i % 4 == 1 else ""))
        quality.append(int(not bad))
    clean = [i for i in range(220) if quality[i]]
    for i in clean[:12]:
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts += [texts[i], " ".join(words)]
        quality += [1, 1]
    texts += [texts[clean[20]]] * 14
    quality += [1] * 14
    rows = [(i, t, "en", None if i % 17 == 3 else f"s{i % 3 if i % 2 else 0}", len(t)) for i, t in enumerate(texts)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "s1", 0), (None, sentence(r, 30), "en", "s2", 1), rows[7]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    if not os.path.exists(MODEL):
        pytest.skip("no model here")
    path = tmp_path_factory.mktemp("steps")
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    kept.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return kept


def plain(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_quality(spark, sf_dir, steps):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = passage_quality.train(docs, labels)
    want = Counter(tuple(r) for r in steps[0] if model.scores([passage_quality.encode_passages(r.text)])[0] >= 0.5)
    assert plain(steps[1]) == want
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in steps[1]}
    assert sum(i in kept for i, q in truth.items() if q == 0) <= 2 and sum(i not in kept for i, q in truth.items() if q == 1) <= 2


def test_line_dedup(steps):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for n, r in enumerate(steps[1]):
        for k in {key(x) for x in (r.text or "").split("\n")} - {""}:
            holders.setdefault(k, []).append((n, r.doc_id))
    want = Counter()
    for r in steps[1]:
        def stays(line, r=r):
            own = holders.get(key(line), [])
            return len(own) < 10 or r.doc_id == min(i for _, i in own if i is not None)
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if stays(x)]
        text = r.text if len(kept) == len(lines) else "\n".join(kept)
        want[r.doc_id, text, r.lang, r.source, None if text is None else len(text)] += 1
    assert plain(steps[2]) == want and sum("footer" in (r.text or "") for r in steps[2]) == 1


def test_near_duplicates(steps):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rows = [r for r in steps[2] if r.doc_id is not None]
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i].text == rows[j].text or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    kept = [r for r in steps[3] if r.doc_id is not None]
    assert Counter(r.doc_id for r in kept) == Counter(least.values())
    assert len(kept) < len(rows) - 20 and plain(steps[3]) - plain(steps[2]) == Counter()
    assert sum(r.doc_id is None for r in steps[3]) == sum(r.doc_id is None for r in steps[2])


def test_mix(steps):
    merged = Counter()
    for r in steps[3]:
        merged[r.doc_id, r.text, r.source] += n_words(r.text)
    entries = [(*k, n) for k, n in merged.items()]
    left, copies = math.floor(1.5 * sum(e[3] for e in entries)), Counter()
    for _, n, _, words in brute_packets(entries, None)[0]:
        left -= words
        if left < 0:
            break
        copies[entries[n][:3]] += 1
    want = Counter()
    for r in steps[3]:
        if n := copies[r.doc_id, r.text, r.source]:
            want[tuple(r)] += n
    assert plain(steps[4]) == want


def test_tokens(spark, sf_dir, steps):
    other = pieces.reference(pieces.read_model(MODEL))
    want = Counter((r.doc_id, r.source, tuple(other.encode(r.text))) for r in steps[4])
    assert Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in steps[5]) == want
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in steps[5])
    again = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in again.collect()) == want


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "source_mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
