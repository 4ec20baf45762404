"""Worked examples."""

import ast
import datetime as dt
import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from turnscale.functions import filters, text
from turnscale.operators import contract, corpus, embedding, history, packs, retrieval, rollups, savings, signals, state
from turnscale.sources import readers, writers

T0 = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).head()[0]


TURN = "id long, session_id string, message_id string, chat_session_id string, client_source string, provider string, model string, project_id string, role string, text string, actual_input_tokens long, actual_output_tokens long, baseline_no_context long, baseline_full_repo long, baseline_naive_rag long, injected boolean, cache_hit_estimated boolean, baseline_period boolean, recorded_at timestamp"


def turn(n, **over):
    base = {"id": n, "session_id": "s", "message_id": f"m{n}", "chat_session_id": "cs", "client_source": "chat", "provider": "p", "model": "m", "project_id": "pr", "role": "user", "text": f"text {n}",
            "actual_input_tokens": 2500, "actual_output_tokens": 100, "baseline_no_context": None, "baseline_full_repo": None, "baseline_naive_rag": None, "injected": False, "cache_hit_estimated": False, "baseline_period": False, "recorded_at": T0 + dt.timedelta(minutes=n)}
    return tuple((base | over).values())


def turns(spark, *rows):
    return spark.createDataFrame(list(rows), TURN)


def test_tokens_saved(spark):
    first = [turn(0, injected=True, actual_input_tokens=6000, baseline_no_context=1000)] + [turn(i, cache_hit_estimated=True) for i in (1, 2, 3)]
    assert rollups.tokens_saved_total(turns(spark, *first)).head()[0] == 15000
    second = [turn(i, injected=True, actual_input_tokens=t, baseline_no_context=1000) for i, t in enumerate((8000, 9000))] + [turn(i, cache_hit_estimated=True) for i in range(2, 7)]
    assert rollups.tokens_saved_total(turns(spark, *second)).head()[0] == 37500
    four = [turn(10 * n, chat_session_id=f"c{n}", injected=True, actual_input_tokens=o + 500, baseline_no_context=500) for n, o in enumerate((3000, 5000, 2000, 4000))]
    four += [turn(10 * n + i + 1, chat_session_id=f"c{n}", cache_hit_estimated=True) for n, h in enumerate((4, 2, 5, 3)) for i in range(h)]
    assert rollups.tokens_saved_total(turns(spark, *four)).head()[0] == 44000


@pytest.mark.parametrize(("baselines", "want"), [((10000, None, None), 0.075), ((20000, 4000, 500), 0.175), ((None, 8000, 500), 0.055)])
def test_input_savings(spark, baselines, want):
    full, rag, none = baselines
    prices = spark.createDataFrame([("p", "m", 10.0, 50.0, None, 1.0, "live")], "provider string, model string, input_per_m double, output_per_m double, cache_write_per_m double, cache_read_per_m double, origin string")
    cohort = spark.createDataFrame([("pr", 300.0)], "project_id string, baseline_avg_output_tokens double")
    rows = turns(spark, turn(1, injected=True, baseline_full_repo=full, baseline_naive_rag=rag, baseline_no_context=none), turn(2, cache_hit_estimated=True, model="m-20240101"), turn(3, actual_output_tokens=400), turn(4, baseline_period=True, injected=True, baseline_full_repo=9999), turn(5, provider="q"))
    got = {r.id: r for r in savings.turn_savings(rows, prices, cohort).collect()}
    assert got[1].saved_input_cost_usd == pytest.approx(want) and got[1].saved_output_cost_usd == pytest.approx(0.01)
    assert got[2].saved_cache_cost_usd == pytest.approx(2500 * 9 / 1e6) and got[2].measurement_basis == "output_cohort_measured"
    assert got[3].saved_output_cost_usd == 0 and got[3].measurement_basis == "input_measured"
    assert all(got[i].saved_input_cost_usd == got[i].saved_output_cost_usd == 0 for i in (4, 5))


def test_scores_and_ages(spark):
    now = F.lit(T0 + dt.timedelta(days=3)).cast("timestamp")
    assert spark.range(1).select(retrieval.recency(F.lit(T0), now)).head()[0] == pytest.approx(0.5)
    assert spark.range(1).select(retrieval.final_score(F.lit(0.8), F.lit(T0), now)).head()[0] == pytest.approx(0.7 * 0.8 + 0.3 * 0.5)
    ages = {59: "just now", 60: "1 minute ago", 7199: "1 hour ago", 7200: "2 hours ago", 86400: "1 day ago", -5: "just now", 260000: "3 days ago"}
    for seconds, want in ages.items():
        assert spark.range(1).select(text.age_human(F.lit(T0), F.lit(T0 + dt.timedelta(seconds=seconds)))).head()[0] == want


def test_budget_skips_what_does_not_fit(spark):
    rows = [("d", 1, 0.9, 0.1, 60, 100), ("d", 2, 0.8, 0.1, 50, 100), ("d", 3, 0.7, 0.1, 40, 100), ("e", 4, 0.7, 0.1, 101, 100)]
    scored = spark.createDataFrame(rows, "draft_id string, id long, final_score double, distance double, cost long, token_budget int")
    assert sorted(r.id for r in retrieval.fit_to_budget(scored).collect()) == [1, 3]


def test_scalars(spark):
    assert not one(spark, filters.draft_usable(F.col("x")), x=" 123456789 ") and one(spark, filters.draft_usable(F.col("x")), x="1234567890")
    for value, valid in {"a" * 256: True, "a" * 257: False, "a b": False, "a'b": False, "a/b": False, "é": False, "a.b_c-1": True, "a\n": False, "": False}.items():
        assert one(spark, text.is_valid_external_session_id(F.col("x")), x=value) is valid
    same = {one(spark, text.stable_hash(F.col("x")), x=x) for x in ("a\nb", "a  \r\nb\t", "\n\na \nb\n\n")}
    assert same == {hashlib.sha256(b"a\nb").hexdigest()} and one(spark, text.stable_hash(F.col("x")), x="a\n\nb") not in same
    assert one(spark, text.djb2(F.col("x")), x="") == 5381
    h = 5381
    for unit in (0x61, 0xD83D, 0xDE42):
        h = (h * 33 ^ unit) & 0xFFFFFFFF
    assert one(spark, text.djb2(F.col("x")), x="a🙂") == h
    vector = one(spark, text.hash_embedding(F.col("x"), 40), x="hello")
    assert vector == pytest.approx(embedding.hash_embedder(40)(["hello"])[0])
    assert one(spark, text.clean_turn_text(F.col("x")), x="\u00a0a\t\r b\n\n\n\nc ") == "a  b\n\nc"
    for x, artifact in {"▋": True, " ": True, "…x": False, "👍": False, "はい": False, "": True}.items():
        assert one(spark, text.is_streaming_artifact(F.col("x")), x=x) is artifact
    assert one(spark, text.file_suffix(F.col("x")), x="a/B.Tar.GZ") == ".gz" and one(spark, text.file_suffix(F.col("x")), x="a/.env") == ""
    assert one(spark, text.per_token_to_per_million(F.col("x")), x="0.0000125") == 12.5 and one(spark, text.per_token_to_per_million(F.col("x")), x="-1") is None


def test_votes(spark):
    rows = [("a", "x", 0.9, 1, 1), ("a", "x", 0.6, 2, 2), ("a", "y", 0.4, 1, 3), ("b", "x", 0.6, 1, 4)]
    df = spark.createDataFrame(rows, "node string, detector string, confidence double, ts_ms long, event_id long")
    assert {r.node: (r.confidence, r.promoted) for r in rollups.detector_vote(df).collect()} == {"a": (0.76, True), "b": (0.6, False)}


def test_resent_turns(spark):
    schema = "id long, session_id string, message_id string, text string, role string, client_source string, arrival_seq long"
    rows = [(1, "s", "m", "a", "user", "chat", 1), (2, "s", "m", "b", "x", None, 2), (3, "s", "", "c", "user", None, 3), (4, "s", None, "d", "user", None, 4), (5, "s", "", "e", "user", None, 5)]
    got = sorted((r.id, r.text, r.role, r.client_source) for r in state.upsert_turns(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "b", "user", "chat"), (3, "c", "user", None), (4, "d", "user", None), (5, "e", "user", None)]
    sessions = rollups.build_chat_sessions(turns(spark, turn(1), turn(2, message_id="m1"), turn(3, message_id=None), turn(4, message_id=None)).withColumn("external_session_id", F.lit("x")))
    assert [r.turn_count for r in sessions.collect()] == [3]


def test_chunks(spark):
    files = spark.createDataFrame([("p", "a.py", "import x\n\n@deco\nclass A:\n    def f(self):\n        pass\n\nclass B:\n    def g(self):\n        return 1\n\ndef h():\n    return 2\n"), ("p", "b.py", "x = = 1"), ("p", "c.md", "\n".join(f"l{i}" for i in range(120))), ("p", "d.py", "")], "project_id string, path string, content string")
    got = {(r.file_path, r.entity_kind, r.entity_name, r.line_start, r.line_end) for r in corpus.chunk_entities(files).collect()}
    want = {("a.py", "class", "A", 3, 6), ("a.py", "class", "B", 8, 10), ("a.py", "method", "g", 9, 10), ("a.py", "function", "h", 12, 13), ("b.py", "file", None, 1, 1), ("c.md", "file_window", "window_0", 1, 100), ("c.md", "file_window", "window_1", 101, 120)}
    assert got == want
    old = corpus.chunk_entities(files)
    edited = files.withColumn("content", F.regexp_replace("content", "return 2", "return 3"))
    changes = [r.change for r in corpus.diff_chunks(corpus.chunk_entities(edited), old).collect()]
    assert (changes.count("add"), changes.count("remove")) == (1, 1)
    words = "word " * 900
    cut = lambda t: one(spark, corpus.cut_text(F.col("x")), x=t)
    pieces = cut("  " + words)
    assert "".join(pieces).replace(" ", "") == words.replace(" ", "") and all(1800 < len(p) <= 2000 for p in pieces[:-1])
    assert cut("x" * 4100) == ["x" * 2000, "x" * 2000, "x" * 100] and cut(" \n ") == []


def test_sweep(spark):
    schema = "project_id string, path string, content string, length long"
    row = lambda path, body: ("p", path, body, len(body))
    before = spark.createDataFrame([row("a.py", "def f():\n    pass\n"), row("gone.py", "def g():\n    pass\n"), row("same.py", "x = 1\n")], schema)
    after = spark.createDataFrame([row("a.py", "def f():\n    pass\n\ndef h():\n    pass\n"), row("same.py", "x = 1\n"), row("new.py", "y = 2\n"), row("node_modules/z.py", "z = 3\n")], schema)
    chunks, summary = corpus.sweep(after, before, corpus.chunk_entities(before))
    got = summary.head().asDict()
    assert {k: got[k] for k in got if k != "project_id"} == {"files_new": 2, "files_modified": 1, "files_deleted": 1, "files_unchanged": 1, "chunks_added": 2, "chunks_removed": 1, "chunks_unchanged": 1}
    assert {(r.file_path, r.entity_name) for r in chunks.collect()} == {("a.py", "f"), ("a.py", "h"), ("same.py", None), ("new.py", None)}


def test_packs(spark):
    files = spark.createDataFrame([("p", f"f{i}.py", "h", 900) for i in range(6)] + [("p", f"d{i}.md", "h", 700) for i in range(3)] + [("q", "big.py", "h", 5000), ("z", "x.md", "h", 1)], "project_id string, path string, sha1 string, token_count long")
    chosen = [(r.path, r.eff) for r in packs.select_files(packs.rank_files(files)).orderBy("project_id", "place").collect()]
    assert chosen == [("d0.md", 700), ("d1.md", 700), ("f0.py", 900), ("f1.py", 900), ("big.py", 1000), ("x.md", 1)]
    chunks = spark.createDataFrame([("q", "big.py", i, f"part{i}", 600) for i in range(3)] + [("z", "x.md", 0, "tiny", 1)], "project_id string, path string, chunk_idx int, text string, token_count long")
    got = {r.project_id: r for r in packs.context_pack_files(files.filter("project_id != 'p'"), chunks).collect()}
    assert got["q"].block_text == '# Project context: q\n# Files included: 1 of 1 (~1000 tokens)\n\n<file path="big.py">\npart0\n# ... (file truncated to fit context budget)\n</file>\n'
    assert got["z"].block_hash == hashlib.sha256(b"z\nx.md:h").hexdigest()[:16]


def test_progress(spark):
    jobs = spark.createDataFrame([("parse", 10, 5, 0, 0, T0)], "phase string, files_total long, files_processed long, entities_total long, entities_embedded long, started_at timestamp")
    got = state.progress_snapshot(jobs, F.lit(T0 + dt.timedelta(seconds=10)).cast("timestamp")).head()
    assert got.files_pct == 0.5 and got.entities_pct == 0 and 5 <= got.eta_seconds <= 20 and not got.is_paused


def test_rolling_dedup(spark):
    kept, _ = signals.keep_unseen([0, *range(1, 51), 0], 50)
    assert all(kept)
    kept, recent = signals.keep_unseen([0, 0, *range(1, 50), 0], 50)
    assert kept[1] is False and kept[-1] is False and len(recent) == 50


def test_word_diff():
    diff = signals.word_diff_segments
    assert diff("a b c", "a x c") == [("unchanged", "a "), ("removed", "b"), ("added", "x"), ("unchanged", " c")]
    assert diff("", "") == [] and diff("", "a") == [("added", "a")] and diff("a b", "") == [("removed", "a b")] and diff("a b", "a b") == [("unchanged", "a b")]
    for a, b in (("one two two three", "two one three two"), ("x  y", "x y"), ("p q r s", "q s p")):
        parts = diff(a, b)
        assert "".join(t for k, t in parts if k != "added") == a and "".join(t for k, t in parts if k != "removed") == b


def test_sources(spark, tmp_path):
    feed = {"data": [{"id": "anthropic/m", "pricing": {"prompt": "0.00001", "completion": "0.00005", "input_cache_read": "0.000001", "input_cache_write": "0.0000125", "cache_read": "9"}}, {"id": "x-ai/a/b", "pricing": {"prompt": "1", "completion": "1"}}, {"id": "none/m", "pricing": {"prompt": "1", "completion": "1"}}, {"id": "openai/free", "pricing": {"prompt": "0", "completion": "1"}}, {"id": "plain"}]}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    got = [tuple(r) for r in readers.read_price_feed(spark, str(tmp_path / "feed.json")).orderBy("provider").collect()]
    assert got == [("anthropic", "m", 10, 50, 12.5, 1), ("xai", "a/b", 1e6, 1e6, None, None)]
    (tmp_path / "list.json").write_text(json.dumps(feed["data"]))
    assert readers.read_price_feed(spark, str(tmp_path / "list.json")).count() == 2
    (tmp_path / "matrix.json").write_text(json.dumps({"providers": {"a": {"m": {"input_per_m": 1, "output_per_m": 2}, "n": {"input_per_m": 3, "output_per_m": 4, "cache_read_per_m": 0.5}}}}))
    assert sorted(map(tuple, readers.read_price_matrix(spark, str(tmp_path / "matrix.json")).collect()), key=str) == [("a", "m", 1, 2, None, None), ("a", "n", 3, 4, None, 0.5)]
    for body, want in (({"observations": [{"d": "2026-01-02", "FXUSDCAD": {"v": "1.5"}}]}, (1.5, "2026-01-02", "observed")), ({"observations": []}, (1.36, "2026-06-13", "fallback")), ({"observations": [{"d": "x", "FXUSDCAD": {"v": "-1"}}]}, (1.36, "2026-06-13", "fallback"))):
        (tmp_path / "fx.json").write_text(json.dumps(body))
        spark.catalog.clearCache()
        assert tuple(readers.read_fx(spark, str(tmp_path / "fx.json")).head()) == want
    (tmp_path / "hints.json").write_text(json.dumps({"providers": {"h.com": {"provider_id": "p", "debounce_ms": 1500, "url_session_pattern": "^/c/([a-f0-9-]+)"}, "g.com": {"provider_id": "g", "path_filter": "/copilot/"}}}))
    hints = readers.read_provider_hints(spark, str(tmp_path / "hints.json"))
    urls = spark.createDataFrame([("https://h.com/c/ab-1?x", "h.com"), ("https://h.com/d/ab", "h.com"), ("https://g.com/copilot/x", "g.com")], "url string, host string").join(hints, "host")
    assert sorted((r.url, r.s) for r in urls.select("url", text.url_session(F.col("url"), F.col("url_session_pattern"), F.col("path_filter")).alias("s")).collect()) == [("https://g.com/copilot/x", None), ("https://h.com/c/ab-1?x", "ab-1"), ("https://h.com/d/ab", None)]
    tree = tmp_path / "tree"
    for name, body in {"README.md": "hi", "src/main.py": "x = 1", "node_modules/a.js": "1", "yarn.lock": "", "a.png": "p", "big.py": "x" * 1_000_001}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    found = readers.read_source_tree(spark, str(tree), "p")
    assert sorted(r.path for r in found.collect()) == ["README.md", "src/main.py"]
    rows, chunks = corpus.ingest_corpus(found, spark.createDataFrame([("p", "README.md", hashlib.sha1(b"hi").hexdigest())], "project_id string, path string, sha1 string"))
    assert {r.path: r.status for r in rows.collect()} == {"README.md": "skipped", "src/main.py": "ingested"} and [r.text for r in chunks.collect()] == ["x = 1"]
    (tmp_path / "turns").mkdir()
    (tmp_path / "turns/a.json").write_text(json.dumps({"session_id": "s", "turn_id": 1, "text": "abc"}) + "\n")
    got = readers.read_turns(spark, str(tmp_path / "turns")).head()
    assert got.injected is False and got.char_count == 3
    path = str(tmp_path / "table")
    writers.write_table(spark.range(3), path)
    writers.write_table(spark.read.parquet(path).filter("id > 0"), path)
    writers.write_table(spark.range(7, 8), path, "append")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 7]


def test_contract_and_rules(spark):
    rows = spark.createDataFrame([(1, "s", 0, None, "openai", 5, True, "b", True, "z")], "id long, session_id string, turn_id long, project_id string, provider string, actual_input_tokens long, tokens_estimated boolean, block_hash string, injected boolean, extra string")
    assert contract.validate_contract(rows, [*contract.FIELDS, "id"]).head().violations == ["missing:project_id", "minimum:turn_id", "unknown:extra"]
    for rule, hits, misses in (("*.log", ["a.log", "d/b.log"], ["a.logs"]), ("/top", ["top", "top/x"], ["d/top"]), ("dir/", ["dir/x", "a/dir/x"], ["dir"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("f?o.[x", ["fao.[x"], ["foo.x"])):
        pattern = re.compile(filters.glob_to_regex(rule))
        assert all(pattern.search(x) for x in hits) and not any(pattern.search(x) for x in misses)
    assert filters.glob_to_regex("# c") is None and filters.glob_to_regex("  ") is None


def test_embedding_results(spark):
    def embedder(texts):
        if "down" in texts:
            raise ConnectionError("no server")
        return [[1.0] * (3 if t == "short" else 4) for t in texts]

    rows = spark.createDataFrame([(1, "ok"), (2, " "), (3, "short"), (4, "down"), (5, None)], "timeline_id long, text string").coalesce(1)
    results = embedding.embed(rows, embedder, dim=4, batch=1)
    assert {r.timeline_id: r.status for r in results.collect()} == {1: "ok", 2: "blank", 3: "wrong_dim", 4: "unavailable", 5: "blank"}
    before = spark.createDataFrame([(4, 1, False, None)], "timeline_id long, attempts int, completed boolean, last_error string")
    vectors, attempts = state.apply_embed_results(before, results, 4)
    assert [r.timeline_id for r in vectors.collect()] == [1]
    assert {r.timeline_id: (r.attempts, r.completed, r.last_error) for r in attempts.collect()} == {1: (0, True, None), 2: (0, True, None), 3: (1, False, "3 values"), 4: (2, False, "unavailable"), 5: (0, True, None)}


def test_state_changes(spark):
    sessions = spark.createDataFrame([("a", "register", 1), ("a", "close", 2), ("b", "register", 1), ("c", "close", 1), ("a", "register", 5)], "session_id string, kind string, ts long")
    assert sorted(map(tuple, state.session_registry(sessions).collect())) == [("a", 1, 2), ("b", 1, None)]
    old = spark.createDataFrame([("/a", "pending", 1)], "project_path string, state string, ts long")
    new = spark.createDataFrame([("/a", "opted_in", 2), ("/a", "maybe", 3), ("/b", "opted_out", 1)], old.schema)
    assert sorted((r.project_path, r.state) for r in state.record_opt_in(old, new).collect()) == [("/a", "opted_in"), ("/b", "opted_out")]
    prices = spark.createDataFrame([("p", "m", 1.0, 2.0, 1), ("p", "n", 1.0, 2.0, 1)], "provider string, model string, input_per_m double, output_per_m double, fetched_at long")
    fresh = spark.createDataFrame([("p", "m", 3.0, 4.0, 2), ("p", "x", None, 4.0, 2)], prices.schema)
    assert sorted((r.model, r.input_per_m) for r in state.upsert_pricing(prices, fresh).collect()) == [("m", 3.0), ("n", 1.0)]
    with pytest.raises(ValueError):
        state.upsert_pricing(prices, fresh.filter("model = 'x'"))
    hashes = spark.createDataFrame([("p", "a", "1", 1), ("p", "b", "1", 1)], "project_id string, file_path string, content_hash string, last_seen long")
    changed = spark.createDataFrame([("p", "a", "2", 2), ("p", "c", "3", 2)], hashes.schema)
    assert sorted((r.file_path, r.content_hash, r.last_seen) for r in state.upsert_file_hashes(hashes, changed).collect()) == [("a", "2", 2), ("b", "1", 1), ("c", "3", 2)]
    rewrites = spark.createDataFrame([("r1", "x", "p", None)], "rewrite_id string, external_session_id string, provider_id string, chat_session_id string")
    known = spark.createDataFrame([("cs1", "x", "p")], "id string, external_session_id string, provider_id string")
    stored = state.record_rewrites(rewrites.filter("false"), rewrites, known)
    assert [(r.rewrite_id, r.chat_session_id) for r in state.record_rewrites(stored, rewrites, known).collect()] == [("r1", "cs1")]
    kept, counts = state.forget_all({"t": prices})
    assert kept["t"].count() == 0 and counts.head().deleted == 2
    assert state.evolve_schema(prices, {"model": "string", "note": "string"}).columns[-1] == "note"


def test_context_and_search(spark):
    rows = turns(spark, *[turn(i, text=f"line {i} needle" if i % 2 else "same") for i in range(6)])
    sessions = spark.createDataFrame([("cs", "p", "ext"), ("none", "p", "other")], "id string, provider_id string, external_session_id string")
    got = {r.external_session_id: r for r in history.get_context(rows, sessions, n=2).collect()}
    assert got["ext"].context == "[USER] same\n\n[USER] line 5 needle" and got["other"].token_count == 0
    assert [r.id for r in history.search_turns(rows, "NEEDLE", 2).orderBy("rank").collect()] == [5, 3]
    assert history.search_turns(rows, "  ").count() == 0
    assert history.get_context(rows.withColumn("client_source", F.lit(None).cast("string")), sessions, "project", 1).head().context == "[USER] line 5 needle"


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
    for name, sql in __spark_entry__.oracle_sql().items():
        assert name in __spark_entry__.queries() and sql.strip()


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "turnscale")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name)).read())
                used = [getattr(n, "module", None) or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not any("llm" in u.split(".") for u in used)


def test_a_task_lists_many_folders(spark, tmp_path):
    from turnscale.sources import readers

    for n in range(100):
        (tmp_path / "tree" / f"d{n}").mkdir(parents=True)
        (tmp_path / "tree" / f"d{n}" / "a.py").write_text("x" * (n + 1))
    context, before = spark.sparkContext, spark.conf.get(readers.LISTING, None)
    context.setJobGroup("tree", "tree")
    rows = readers.read_source_tree(spark, f"file://{tmp_path}/tree", "p")
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for job in tracker.getJobIdsForGroup("tree") for s in tracker.getJobInfo(job).stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism
    assert spark.conf.get(readers.LISTING, None) == before
    assert sorted(map(tuple, rows.select("path", "length").collect())) == sorted((f"d{n}/a.py", n + 1) for n in range(100))


def test_trees_of_packs_are_not_all_on_disk_at_once(spark, tmp_path, monkeypatch):
    from turnscale.plans import composite_queries as queries

    rows = [(n, "a" * (n % 90), f"s{n % 3}") for n in range(0, 2400, 20)] + [(n, "d" * 30_000, "s2") for n in (5, 805, 1605)]
    rows += [(None, "b", "s0"), (7, None, "s1"), (8, "c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want, sizes, base = {}, [], f"{tmp_path}/scratch"
    for n, text, source in rows:
        if text is not None and source is not None:
            pack = "__HIVE_DEFAULT_PARTITION__" if n is None else n // 100
            folder = f"source={source}/pack={pack}"
            want[folder] = want.get(folder, 0) + (len(text) + 1) * (40 if n is not None and pack % 8 == 0 else 1)
    read = queries.readers.read_source_tree

    def measured(spark, root, project_id):
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "scratch").rglob("*.txt")))
        return read(spark, root, project_id)

    monkeypatch.setattr(queries, "scratch", lambda spark, name: f"file://{base}")
    monkeypatch.setattr(queries, "TREES", 6, raising=False)
    monkeypatch.setattr(queries, "TREE_BYTES", 1000, raising=False)
    monkeypatch.setattr(queries.readers, "read_source_tree", measured)
    found = queries.QUERIES["read_source_tree_of_packs"](spark, str(tmp_path))
    assert dict(map(tuple, found.collect())) == {k: v for k, v in want.items() if v <= 1_000_000}
    assert found.count() == len(want) - 3 and sum(sizes) == sum(want.values())
    assert max(sizes) < 0.7 * sum(want.values())
    assert not [*(tmp_path / "scratch").rglob("*.txt")]
