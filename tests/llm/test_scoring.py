import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import WORDS, empty_documents, odd_documents, sentence
from pyspark.sql import functions as F

from turnscale.llm import passage_quality, quality_rules, secret_scan


def brute_repeats(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked |= set(range(i, i + 8))
    return len(marked)


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.encode().split():
            lines += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), lines, brute_repeats(words)


@pytest.mark.parametrize(("share", "copies_count"), [(0.0, True), (0.12, True), (0.0, False)])
def test_quality_rules_match_brute_force(spark, share, copies_count):
    docs = odd_documents(spark).unionByName(odd_documents(spark).limit(1).withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit(("a b c d e f g h i " * 6 + "# * tail\nx\nx\n") * 2)}))
    rows = quality_rules.apply_quality_rules(docs, least_docs=10, share=share, copies_count=copies_count)
    given = docs.collect()
    key = lambda line: b" ".join(line.encode().split()).lower()
    texts, holders = {}, {}
    for n, r in enumerate(given):
        own = n if copies_count else r.text
        texts.setdefault(r.source, set()).add(own)
        for line in (r.text or "").split("\n"):
            if key(line):
                holders.setdefault((r.source, key(line)), set()).add(own)
    want, clean = Counter(), Counter()
    for r in given:
        counts = brute_counts(r.text)
        limit = max(10, share * len(texts[r.source]))
        lines = (r.text or "").split("\n")
        common = [bool(key(x)) and len(holders[r.source, key(x)]) > limit for x in lines]
        gone = sum(len(x.encode().split()) for x, c in zip(lines, common, strict=True) if c)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        kept = not failed and counts[0] - gone >= 20 and gone <= 0.5 * counts[0]
        want[(r.doc_id, *counts, failed, kept, gone)] += 1
        if kept:
            clean[r.doc_id, r.source, "\n".join(x for x, c in zip(lines, common, strict=True) if not c), r.d] += 1
    assert Counter(map(tuple, rows.collect())) == want
    out = quality_rules.clean_documents(docs, least_docs=10, share=share, copies_count=copies_count)
    assert out.columns == docs.columns and Counter((r.doc_id, r.source, r.text, r.d) for r in out.collect()) == clean
    assert quality_rules.apply_quality_rules(empty_documents(spark)).count() == 0 == quality_rules.clean_documents(empty_documents(spark)).count()


def test_shared_lines_reject_depleted_documents(spark):
    r = random.Random(2)
    footer = sentence(r, 40)
    rows = [(i, footer + "\n" + sentence(r, 4 if i < 3 else 60), "h") for i in range(15)] + [(99, sentence(r, 30), "h")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.kept for x in quality_rules.apply_quality_rules(docs).collect()}
    assert sorted(i for i, kept in got.items() if not kept) == [0, 1, 2, 99]
    apart = quality_rules.clean_documents(docs, copies_count=False).collect()
    assert {x.doc_id for x in apart} == {*range(3, 15), 99} and not any(footer in x.text for x in apart)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_words(seed):
    r = random.Random(seed)
    for n in (0, 7, 8, 9, 40, 300):
        words = [r.choice("abc").encode() for _ in range(n)]
        assert quality_rules.repeated_words(words) == brute_repeats(words)


def corpus(spark, n=400):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join((w.upper() + "!!" if bad and r.random() < 0.8 else w) for w in (r.choice(WORDS) for _ in range(r.randint(5, 300))))
        rows.append((i, text, None if i % 9 else i, "l"))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, label string")
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")


def test_classifier_on_held_out_labels(spark):
    docs, labels = corpus(spark)
    found = passage_quality.classify_quality(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id is not null and quality is not null").collect()}
    held = [r for r in found.collect() if r.held_out]
    assert len(held) > 80 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = passage_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 300) < 15
    assert kept.filter("score is not null").count() > 0


def test_classifier_on_odd_rows(spark):
    docs, labels = corpus(spark, 40)
    odd = odd_documents(spark)
    found = passage_quality.classify_quality(odd, labels).collect()
    assert len(found) == odd.count() and all(r.score is not None for r in found)
    assert passage_quality.classify_quality(empty_documents(spark), labels).count() == 0
    unlabelled = passage_quality.classify_quality(odd, labels.filter("false")).collect()
    assert all(r.score == pytest.approx(0.5) for r in unlabelled)


def test_gradients():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(n, passage_quality.FEATURES)) for n in (1, 3, 2)]
    model = passage_quality.fit_mil(bags, np.array([0.0, 1.0, 1.0]), hidden=5, attention=3, steps=1)
    x, starts, y, w = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    loss = lambda: -np.mean(w * (y * np.log(p := model.forward(x, starts)["y"]) + (1 - y) * np.log(1 - p)))
    grads = passage_quality.gradients(model, x, starts, y, w)
    for k, at in (("W", (2, 1)), ("V", (1, 2)), ("U", (0, 0)), ("w", (1,)), ("c", (3,)), ("b", (0,))):
        before = model.weights[k].copy()
        values = []
        for step in (1e-6, -1e-6):
            model.weights[k] = before.copy()
            model.weights[k][at] += step
            values.append(loss())
        model.weights[k] = before
        assert grads[k][at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-4, abs=1e-9)


def test_scan_tells_secrets_from_long_words(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40))
        text = sentence(r, 30) + f' token = "{value}" ' + sentence(r, 10) if i % 2 else sentence(r, 20) + " " + "".join(r.choice(WORDS) for _ in range(9)) + " " + sentence(r, 5)
        rows.append((i, text, "src/app.py" if i % 3 else None, "x"))
    rows += [(None, None, None, "x"), (500, "", "tests/a", "x"), (501, "bare " + "0f" * 25 + " word", "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    found = secret_scan.scan_secrets(docs)
    got = {(x.doc_id, x.place): x.secret for x in found.collect()}
    assert len(got) == 121 and all(secret == bool(i % 2) for (i, _), secret in got.items() if i < 500)
    assert secret_scan.scan_secrets(empty_documents(spark)).count() == 0
    one_kind = secret_scan.scan_secrets(docs.filter("doc_id % 2 = 1 and doc_id < 500")).collect()
    assert all(x.score is None and x.secret for x in one_kind)
    labels = secret_scan.find_candidates(docs, "source").select("doc_id", "place", "value", (F.col("doc_id") % 2 == 0).cast("int").alias("label"))
    turned = secret_scan.scan_secrets(docs, labels=labels).collect()
    assert all(x.secret == (x.doc_id % 2 == 0) for x in turned if x.doc_id < 500)


def test_scan_features(spark):
    words = spark.createDataFrame([("abc", 3), ("cab", 2), ("bcab", 1)], "word string, n long")
    table = secret_scan.transition_table(words)
    counts = Counter(w[i : i + 2] for w in ("abc", "cab", "bcab") for i in range(len(w) - 1))
    a = secret_scan.ALPHABET
    total = sum(n for p, n in counts.items() if p[0] == "a")
    assert table[a.index("a") * len(a) + a.index("b")] == pytest.approx(math.log((counts["ab"] + 1) / (total + len(a))))
    rows = spark.createDataFrame([("zabcabc9cab",)], "value string")
    rows = rows.withColumn("chars", secret_scan.characters(F.col("value")))
    got = rows.select(secret_scan.dictionary_coverage(F.col("chars"), ["abc", "cab"]).alias("c"), secret_scan.mean_transition(F.col("chars"), table).alias("t")).head()
    assert got.c == pytest.approx(9 / 11)
    plain = "zabcabc0cab"
    assert got.t == pytest.approx(np.mean([table[a.index(x) * len(a) + a.index(y)] for x, y in zip(plain, plain[1:])]))
    docs = spark.createDataFrame([(1, 'key="' + "A1" * 12 + '" mid ' + "b" * 25, "p")], "doc_id long, text string, source string")
    found = [tuple(r) for r in secret_scan.find_candidates(docs, "source").select("place", "start", "value", "before", "after").collect()]
    assert found == [(0, 5, "A1" * 12, 'key="', '" mid '), (1, 35, "b" * 25, '" mid ', "")]


def brute_features(text, path, words, table):
    """The start and FEATURES of every candidate of a text."""
    a, out = secret_scan.ALPHABET, []
    for m in re.finditer(secret_scan.CANDIDATE, text or ""):
        v, before, after = m.group(), text[: m.start()].split("\x00")[-1], text[m.end() :]
        last = [x.end() for x in re.finditer(secret_scan.CANDIDATE, text) if x.end() <= m.start()]
        nxt = [x.start() for x in re.finditer(secret_scan.CANDIDATE, text) if x.start() >= m.end()]
        before = text[last[-1] if last else 0 : m.start()][-secret_scan.CONTEXT :]
        after = text[m.end() : nxt[0] if nxt else len(text)][: secret_scan.CONTEXT]
        low = v.lower()
        plain = "".join("0" if c in "0123456789" else c if c in a[:26] else "_" for c in low)
        end = covered = 0
        for i in range(len(low)):
            end = max(end, i + max([n for n in secret_scan.DICTIONARY_LENGTHS if i + n <= len(low) and low[i : i + n] in words], default=0))
            covered += end > i
        share = lambda cs, v=v: sum(c in cs for c in v) / len(v)
        flag = lambda found: float(found is not None)
        out.append((m.start(), float(len(v)), share("0123456789"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), float(len(set(v))),
            sum(table[a.index(x) * len(a) + a.index(y)] for x, y in zip(plain, plain[1:])) / (len(v) - 1), covered / len(low), float((path or "").count("/")),
            flag(re.search(r"(?i)(^|[/_.-])(tests?|examples?|docs?|mocks?|fixtures?)([/_.-]|$)", path or "")), flag(re.search(secret_scan.CREDENTIAL + r"[^\n]{0,12}$", before)),
            flag(re.search(r"(=|:)\s*[\"']?$", before)), float(bool(re.search(r"[\"']$", before) and re.search(r"^[\"']", after))),
            flag(re.search(secret_scan.PLACEHOLDER, " ".join((before, v, after)))), float(len(re.split(r"\s+", before.strip(" "))))))
    return out


def test_candidates_and_features_match_brute_force(spark):
    r = random.Random(4)
    key = lambda n, cs: "".join(r.choice(cs) for _ in range(n))
    rows = []
    for i in range(60):
        parts = [sentence(r, r.randint(0, 12)), f'api_key: "{key(r.randint(20, 60), "abcDEF0123_-")}"', "password=" + key(24, "xyz789"), key(30, "abc") + " is an example", "".join(r.choice(WORDS) for _ in range(6)), "é日本 " + key(21, "Q/+=")]
        r.shuffle(parts)
        rows.append((i, r.choice([" ", "\n", "\t", ""]).join(parts), r.choice([None, "", "src/app.py", "tests/a/b.py", "docs/x"])))
    rows += [(100, None, "a"), (101, "", "a"), (102, "0123456789abcdef" * 200, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = secret_scan.scan_secrets(docs, "path")
    words = secret_scan.vocabulary(docs)
    common, table = set(secret_scan.common_words(words, 2000)), secret_scan.transition_table(words)
    want = {(i, x[0]): x[1:] for i, t, p in rows for x in brute_features(t, p, common, table)}
    got = {(x.doc_id, x.start): tuple(x[f] for f in secret_scan.FEATURES) for x in found.collect()}
    assert len(want) > 200 and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_short_passwords_and_unquoted_keys(spark):
    """Where a credential's name is assigned a value, candidates are found from 8 characters on; a run ends at its `=`."""
    short = {
        'password = "hunter2!x"': ["hunter2!x"],
        "PASSWORD: p@ss.w0rd.\nnext line": ["p@ss.w0rd"],
        "db_password_2='S3cret:pw9'": ["S3cret:pw9"],
        'env["api_key"] = "k3y-0123456"': ["k3y-0123456"],
        "token = short7": [],
        "the password is hunter2!x": [],
        "name = hunter2!x": [],
        "API_TOKEN=" + "a1" * 12: ["a1" * 12],
        "LONG_NAME_OF_A_SETTING_HERE=" + "b2" * 12 + "==": ["LONG_NAME_OF_A_SETTING_HERE=", "b2" * 12 + "=="],
        "secret=abcd1234 token=efgh5678,password=ijkl9012": ["abcd1234", "efgh5678", "ijkl9012"],
        "password = " + "c3" * 9 + "!" + "d4" * 30: ["c3" * 9 + "!" + "d4" * 30],
    }
    texts = list(short)
    rows = [(i, "é " + t + " tail", None) for i, t in enumerate(texts)]
    r = random.Random(11)
    for i in range(100, 300):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40)) if i % 2 else "".join(r.choice(WORDS) for _ in range(8))
        rows.append((i, sentence(r, 12) + (f' token = "{value}" ' if i % 2 else f" {value} ") + sentence(r, 6), "src/a.py"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, given = {}, {i: t for i, t, _ in rows}
    for x in secret_scan.find_candidates(docs.filter("doc_id < 100"), "source").orderBy("doc_id", "place").collect():
        assert given[x.doc_id][x.start : x.start + len(x.value)] == x.value
        found.setdefault(x.doc_id, []).append(x.value)
    assert {i: found.get(i, []) for i in range(len(texts))} == dict(enumerate(short.values()))
    scanned = secret_scan.scan_secrets(docs)
    assert scanned.count() == 200 + sum(map(len, short.values())) and scanned.filter("score is null").count() == 0
    labelled = secret_scan.weak_labels(scanned).join(scanned, ["doc_id", "place", "value_sha256"])
    assert labelled.filter("n_chars < 20").count() == 0 < labelled.count()


def test_a_megabyte_in_one_run(spark):
    docs = spark.createDataFrame([(1, "data " + "aGVsbG8gd29ybGQx" * 62_500, "p"), (2, 'token = "' + "0f" * 20 + '"', "p")], "doc_id long, text string, source string")
    start = time.monotonic()
    assert {r.n_chars for r in secret_scan.scan_secrets(docs).collect()} == {1e6, 40.0}
    assert time.monotonic() - start < 90


def test_weak_labels_find_secrets_without_their_context(spark):
    """One key in four has no name: nothing but its shape tells it from long words."""
    r = random.Random(7)
    rows, truth = [], {}
    for i in range(400):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40)) if i % 2 else "".join(r.choice(WORDS) for _ in range(8))
        text = sentence(r, 12) + (f' token = "{value}" ' if i % 2 and i % 8 != 3 else f" {value} ") + sentence(r, 6)
        truth[i] = bool(i % 2)
        rows.append((i, text, "src/a.py"))
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {x.doc_id: (x.secret, x.score) for x in found.collect()}
    assert sum(got[i][0] for i in truth if i % 8 == 3) >= 45 and not any(got[i][0] for i in truth if not truth[i])


def planted_findings(seed, n=240):
    """Rows of a file tree whose truth comes from how they were made: keys, and digests of files, of one length. Most keys
    stand in quotes after a credential's name, one in four without any sign, where labels made of signs call it none."""
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        secret, plain = i % 2 == 0, i % 8 != 2
        value = "".join(r.choice("0123456789abcdef") for _ in range(40))
        if secret:
            value = "".join(r.choice("ABCDEFGHJKMNPQRSTUVWXYZ0123456789abcdefghijkmnpqrstuvwxyz") for _ in range(40))
        lead = (f'api_key = "{value}"' if plain else f"send {value} along") if secret else f"checked {value} twice"
        rows.append((i, f"some words here {i} {lead} and more words", f"{'config' if secret else 'docs/sums'}/f{i}.txt"))
        truth[i] = secret
    return rows, truth


def test_values_are_scored_by_forests_that_have_not_seen_them(spark):
    """Length does not tell them apart. The forests find the secrets that their own labels call none, as most like them are."""
    rows, truth = planted_findings(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = {r.doc_id: r for r in secret_scan.scan_secrets(df, "path", folds=4).collect()}
    assert set(found) == set(truth)
    secrets, called = {i for i, want in truth.items() if want}, {i for i, r in found.items() if r.secret}
    assert len(called & secrets) >= 0.95 * len(called) and len(called & secrets) >= 0.9 * len(secrets)
    assert len([i for i in called if i % 8 == 2]) >= 24, "of 30 without a sign"


def test_folds_leave_the_scored_values_out(spark):
    findings = spark.createDataFrame([(i, 0, f"{i:04x}", float(i % 50), float(i % 50 > 24)) for i in range(400)], "doc_id long, place int, value_sha256 string, n_chars double, want double")
    noise = findings.select("doc_id", "place", "value_sha256", (F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int").alias("label"))
    scored = secret_scan.out_of_fold(findings, noise, ["n_chars"], trees=5).join(noise, ["doc_id", "place", "value_sha256"]).collect()
    agree = sum((r.score >= 0.5) == (r.label == 1) for r in scored) / 400
    assert len(scored) == 400 and 0.35 < agree < 0.65, "labels that mean nothing cannot be told from what was not seen"
    right = secret_scan.out_of_fold(findings, findings.select("doc_id", "place", "value_sha256", F.col("want").cast("int").alias("label")), ["n_chars"], trees=5).collect()
    assert sum((r.score >= 0.5) == (r.want == 1) for r in right) > 390
    one = secret_scan.out_of_fold(findings, noise.withColumn("label", F.lit(1)), ["n_chars"], trees=5).collect()
    assert len(one) == 400 and {r.score for r in one} == {None}


def plain_features(text):
    """encode_passages, a passage and a word at a time."""
    import zlib

    data = (text or "").encode()
    words = data.split()
    if not words:
        return [[0.0] * passage_quality.FEATURES]
    passages = [words[i : i + passage_quality.PASSAGE] for i in range(0, len(words), passage_quality.PASSAGE)]
    out = []
    for n, own in enumerate(passages):
        spaces = len(own) - (n == len(passages) - 1)
        counts = [0.0] * passage_quality.N_CLASSES
        for byte in b"".join(own) + b" " * spaces:
            counts[next((k for k, kind in enumerate(passage_quality.CLASSES) if byte in kind), len(passage_quality.CLASSES))] += 1
        counts[4] = data.count(b"\n") / len(passages)
        lengths = [len(w) for w in own]
        mean = sum(lengths) / len(own)
        spread = math.sqrt(max(sum(x * x for x in lengths) / len(own) - mean**2, 0))
        earlier = set(passages[n - 1]) if n else set()
        capitals = sum(2 * sum(65 <= b <= 90 for b in w) > len(w) for w in own)
        bags = [0.0] * passage_quality.BUCKETS
        for w in own:
            bags[zlib.crc32(w) % passage_quality.BUCKETS] += 4 / len(own)
        rest = [mean / 10, spread / 10, len(set(own)) / len(own), sum(w in earlier for w in own) / len(own), capitals / len(own), math.log1p(len(own)) / 5]
        out.append([4 * c / max(sum(counts), 1) for c in counts] + rest + bags)
    return out


def plain_score(model, bag):
    """The score of one bag, a passage at a time: gated attention over tanh encodings, then a logistic one."""
    p, encoded, weights = model.weights, [], []
    for x in bag:
        x = [min(max((v - c) / s, -6), 6) for v, c, s in zip(x, model.centre, model.scale, strict=True)]
        h = [math.tanh(sum(a * b for a, b in zip(x, p["W"][:, k], strict=True)) + p["b"][k]) for k in range(len(p["b"]))]
        gate = sum(w * math.tanh(sum(a * b for a, b in zip(h, p["V"][:, k], strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, k], strict=True)))) for k, w in enumerate(p["w"]))
        encoded.append(h)
        weights.append(math.exp(gate))
    z = [sum(w * h[k] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for k in range(len(p["b"]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + float(p["d"]))))


def test_features_and_scores_match_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", " \n", "One", "THE end!\n\nof (it) @ 3 = 4", " ".join(sentence(r, 70) for _ in range(3)), "é ü 日本 " * 40, "A\tb\x0bc #tag\n" * 30, "same words " * 100]
    for text in texts:
        assert np.allclose(passage_quality.encode_passages(text), plain_features(text), atol=1e-5)
    docs, labels = corpus(spark, 60)
    model = passage_quality.train(docs, labels)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {x.doc_id: x.s for x in rows.select("doc_id", passage_quality.score_texts(F.col("text"), model).alias("s")).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx([plain_score(model, plain_features(t)) for t in texts], abs=1e-4)
