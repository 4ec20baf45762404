"""Fill-in-the-middle against a pattern over code points, one text at a time."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from llm_fixtures import empty_documents, odd_documents
from pyspark.sql import functions as F

from turnscale.llm import fill_in_middle as fim


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def brute_force(text, doc_id, rate=50, spm=80):
    text, own = text or "", units(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(own) + 1), h2 % (len(own) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (own[:a], own[a:b], own[b:]))
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= rate:
        return len(own), "plain", None, None, text
    if h4 % 100 < spm:
        return len(own), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(own), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(3)
    letters = ["a", "Z", "é", "퟿", "🙂", "\u0000", "\u0085", " ", " ", "\x1c", "<", "P>", ">", " ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", "\r\n"]
    out = ["", " ", "a", "a ", " a", "é", "　", "x" * 8, "x" * 7 + " ", " " * 8, " " * 9 + "y", "<P> in it", "it ends in <", "S>P>M>", "a<S"]
    return out + ["".join(r.choices(letters, k=n)) for n in range(1, 60) for _ in range(6)]


def test_cut_after_any_number_of_units():
    every = texts()
    for n in range(0, 12):
        made = fim.Units(fim.views(pa.array(every)))
        own = [units(t) for t in every]
        assert made.n.tolist() == [len(u) for u in own]
        at, chars = made.cut(made.n * 0 + [min(n, len(u)) for u in own])
        want = ["".join(u[:n]) for u in own]
        assert chars.tolist() == [len(w) for w in want] and at.tolist() == [len(w.encode()) for w in want]


def test_views_of_slices_and_blocks(monkeypatch):
    every = texts()
    for kind in (pa.string(), pa.large_string()):
        part = pa.array([None, *every], kind).slice(5, 40)
        assert [bytes(v).decode() for v in fim.views(part)] == every[4:44]
    monkeypatch.setattr(fim, "BLOCK", 3)
    made = fim.Units(fim.views(pa.array(every)))
    assert made.n.tolist() == [len(units(t)) for t in every]
    assert made.cut(made.n)[0].tolist() == [len(t.encode()) for t in every]
    assert fim.Units([]).n.tolist() == []


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_whole_tables(spark, rate, spm):
    docs = odd_documents(spark).select("doc_id", "text", "n_chars", F.lit("x").alias("cut"), F.lit("x").alias("N"))
    more = spark.createDataFrame([(1000 + i, t, 0, "x", "x") for i, t in enumerate(texts())], docs.schema)
    rows = docs.unionByName(more).cache()
    done = fim.fill_in_middle(rows.drop("N"), rate, spm)
    assert done.columns == ["doc_id", "n_chars", "cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect())
    assert found == Counter((r.doc_id, *brute_force(r.text, r.doc_id, rate, spm)) for r in rows.collect())
    back = done.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((r.doc_id, r.text or "") for r in rows.collect())
    rows.unpersist()


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"wörd{i} and  more" for i in range(200_000)) + " "
    rows = spark.createDataFrame([(i, long) for i in range(6)], "doc_id long, text string")
    for r in fim.fill_in_middle_digest(rows).collect():
        n, form, a, b, output = brute_force(long, r.doc_id)
        hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(r) == (r.doc_id, n, form, a, b, hashed(output), hashed(long))
    assert fim.fill_in_middle(empty_documents(spark)).count() == 0


def test_sentinels_of_ones_own(spark):
    rows = spark.createDataFrame([(i, f"<S one two{i} three <" + "|" * i) for i in range(40)], "doc_id long, text string")
    own = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    done = fim.fill_in_middle(rows, 100, 50, sentinels=own)
    assert {r.form for r in done.collect()} == {"psm", "spm"}
    assert {r.t for r in done.select(fim.restore(F.col("output"), F.col("form"), own).alias("t")).collect()} == {r.text for r in rows.collect()}
    for wrong in (("<P>", "<P>", "<M>"), ("aPa", "b", "c"), ("", "b", "c"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(rows, sentinels=wrong)
