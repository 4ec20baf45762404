"""Every registered query with SQL gives the same rows in Spark and in DuckDB; the one without is held against brute force."""

import math
import os
import re
from collections import Counter

import pytest

from turnscale.operators import signals
from turnscale.plans import registry, scalar_queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}" if isinstance(value, float) or value != int(value) else str(int(value))
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    number = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e9 else plain(v)
    return sorted(columns), sorted(tuple(number(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(registry.ORACLE_SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert mine == want


def test_all_have_sql():
    assert [n for n in registry.QUERIES if n not in registry.ORACLE_SQL] == ["word_diffs"]


def common_words(a, b):
    """The length of the longest common subsequence, white space being words too."""
    a, b = ([t for t in re.split(r"(\s+)", s) if t] for s in (a, b))
    best = [0] * (len(b) + 1)
    for x in a:
        before, best = best, [0]
        for j, y in enumerate(b):
            best.append(before[j] + 1 if x == y else max(before[j + 1], best[j]))
    return best[-1]


def test_word_diffs(spark, con):
    """The segments make both texts, keep as many words as any diff can, and add up to the query's characters."""
    sizes = Counter()
    for row in signals.word_diff(scalar_queries.word_pairs(spark, SF)).collect():
        made = lambda *kinds: "".join(s["text"] for s in row["diff"] if s["type"] in kinds)  # noqa: B023, E731
        assert made("unchanged", "removed") == row["original"] and made("unchanged", "added") == row["rewritten"]
        kept = sum(len([t for t in re.split(r"(\s+)", s["text"]) if t]) for s in row["diff"] if s["type"] == "unchanged")
        assert kept == common_words(row["original"], row["rewritten"])
        for kind in ("added", "removed", "unchanged"):
            sizes[row["provider"], kind] += len(made(kind))
    found = registry.QUERIES["word_diffs"](spark, SF).collect()
    got = {(r["provider"], kind): r[f"chars_{kind}"] for r in found for kind in ("added", "removed", "unchanged")}
    assert got == dict(sizes)
