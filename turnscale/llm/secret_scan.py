"""Secret scan: candidates in texts, and a random forest that tells secrets from false positives.

DataFrame and SQL functions and the DataFrame-based forest only; no Python runs on executors.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A candidate: a whole run of 20 or more of the characters that keys are made of; `=` only ends one, as padding.
RUN = "A-Za-z0-9_+/-"
LONG = 20
CANDIDATE = f"(?<![{RUN}])[{RUN}]{{{LONG},}}={{0,2}}"
#: Characters of context on either side.
CONTEXT = 64
ALPHABET = "abcdefghijklmnopqrstuvwxyz0_"
DICTIONARY_LENGTHS = (3, 4, 5, 6)
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|secret|token|api_?key|access_?key|private_?key|auth|credential|bearer)"
#: A candidate, too: 8 or more characters of a password where a credential's name is assigned a value. What leads to one is
#: looked for from the nearest sign back, so that most places are done with after a character or two.
SHORT = rf"(?<=[=:]\s{{0,2}}[\"']?)(?<={CREDENTIAL}[\w.-]{{0,4}}[\"']?\]?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[\w+/@!#$%^&*.:~?-]{{7,}}[\w+/@!#$%^&*~?-]"
ANY_CANDIDATE = f"{CANDIDATE}|{SHORT}"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test)"
#: What tells of a candidate's context that it is a secret. Weak labels come from these signs, so that a forest on such labels
#: must not see them, nor the number of words before, in which an assignment counts.
CONTEXT_SIGNS = ["near_credential", "near_assignment", "near_quote"]
HIDDEN = [*CONTEXT_SIGNS, "n_words_before"]
FEATURES = ["n_chars", "share_digits", "share_upper", "n_distinct", "transitions", "coverage", "path_depth", "path_test", "near_credential", "near_assignment", "near_quote", "near_placeholder", "n_words_before"]


def find_candidates(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, path, place, start, value, before, after) for every candidate of the whole text; place counts from 0, start
    is the candidate's first character in the text, from 0. The value is as long as n_chars says."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.transform(F.split(text, ANY_CANDIDATE), lambda p: F.struct(F.right(p, F.lit(CONTEXT)).alias("end"), F.left(p, F.lit(CONTEXT)).alias("start"), F.length(p).alias("chars")))
    rows = documents.select("doc_id", F.col(f"`{path}`").cast("string").alias("path"), F.regexp_extract_all(text, F.lit(ANY_CANDIDATE), F.lit(0)).alias("values"), pieces.alias("pieces"))
    rows = rows.filter(F.size("values") > 0)
    # What comes before each candidate is the pieces and values before it.
    lengths = F.zip_with("pieces", "values", lambda p, v: p["chars"] + F.coalesce(F.length(v), F.lit(0)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("lengths", first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])
    rows = rows.withColumn("lengths", lengths).withColumn("starts", starts)
    found = F.arrays_zip(F.col("values"), F.col("pieces").alias("left"), F.slice("pieces", 2, F.size("values")).alias("right"), F.col("starts"))
    rows = rows.select("doc_id", "path", F.posexplode(found).alias("place", "f")).filter("f.values is not null")
    start = (F.col("f.starts") + F.col("f.left.chars")).alias("start")
    return rows.select("doc_id", "path", "place", start, F.col("f.values").alias("value"), F.coalesce(F.col("f.left.end"), F.lit("")).alias("before"), F.coalesce(F.col("f.right.start"), F.lit("")).alias("after"))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): the lower-case ASCII words of all texts, shorter than a long candidate, with their counts; saved."""
    words = documents.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return saved(words.filter(F.length("word").between(2, LONG - 1)).groupBy("word").agg(F.count("*").alias("n")), "vocabulary")


def common_words(words: DataFrame, size: int) -> list[str]:
    """The `size` commonest words of dictionary lengths; ties by the word."""
    fit = words.filter(F.length("word").between(min(DICTIONARY_LENGTHS), max(DICTIONARY_LENGTHS)))
    return [r[0] for r in fit.orderBy(F.desc("n"), "word").limit(size).select("word").collect()]


def transition_table(words: DataFrame) -> list[float]:
    """Log likelihood of each next character after each other in the vocabulary, each word once, with one added to
    every count: a table of the alphabet's size squared."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, 2))
    rows = words.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()
    counts = {r["pair"]: r["n"] for r in rows}
    totals = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
    return [math.log((counts.get(a + b, 0) + 1) / (totals[a] + len(ALPHABET))) for a in ALPHABET for b in ALPHABET]


def characters(value: Column) -> Column:
    """The value's characters, lower-cased, as an array: a column of it is walked through once, whatever its length."""
    return F.filter(F.split(F.lower(value), ""), lambda c: c != "")


def mean_transition(chars: Column, table: list[float]) -> Column:
    """Mean log likelihood of the pairs of these characters; digits are one character, and so are all others but letters."""
    code = lambda c: F.when(c.between("0", "9"), ALPHABET.index("0")).when(c.between("a", "z"), F.ascii(c) - ord("a")).otherwise(ALPHABET.index("_"))
    codes = F.transform(chars, code)
    pairs = F.zip_with(codes, F.slice(codes, 2, F.size(chars)), lambda a, b: a * len(ALPHABET) + b)
    known = F.array(*[F.lit(x) for x in table])
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(known, i), F.lit(0.0))) / (F.size(chars) - 1)


def dictionary_coverage(chars: Column, words: list[str]) -> Column:
    """Share of the characters that lie in dictionary words, taking the longest word that starts at each."""
    if not words:
        return F.lit(0.0)
    word = lambda i, n: F.array_join(F.slice(chars, i, n), "")
    longest = lambda i: F.coalesce(*[F.when(word(i, n).isin(words) & (i + n - 1 <= F.size(chars)), F.lit(n)) for n in sorted(DICTIONARY_LENGTHS, reverse=True)], F.lit(0))

    def step(state: Column, i: Column) -> Column:
        end = F.greatest(state["end"], i + longest(i))
        return F.struct((state["covered"] + F.when(end > i, 1).otherwise(0)).alias("covered"), end.alias("end"))

    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda s: s["covered"] / F.size(chars))


def with_features(candidates: DataFrame, words: list[str], table: list[float]) -> DataFrame:
    """Add FEATURES, as doubles. A null path has depth 0."""
    candidates, chars = candidates.withColumn("_chars", characters(F.col("value"))), F.col("_chars")
    value, before = F.col("value"), F.col("before")
    path = F.coalesce(F.col("path"), F.lit(""))
    share = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)
    columns = {
        "n_chars": F.length(value),
        "share_digits": share("0-9"),
        "share_upper": share("A-Z"),
        "n_distinct": F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))),
        "transitions": mean_transition(chars, table),
        "coverage": dictionary_coverage(chars, words),
        "path_depth": F.size(F.split(path, "/")) - 1,
        "path_test": path.rlike(r"(?i)(^|[/_.-])(tests?|examples?|docs?|mocks?|fixtures?)([/_.-]|$)"),
        "near_credential": before.rlike(CREDENTIAL + r"[^\n]{0,12}$"),
        "near_assignment": before.rlike(r"(=|:)\s*[\"']?$"),
        "near_quote": before.rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']"),
        "near_placeholder": (F.concat_ws(" ", before, value, "after")).rlike(PLACEHOLDER),
        "n_words_before": F.size(F.split(F.trim(before), r"\s+")),
    }
    return candidates.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()}).drop("_chars")


def weak_labels(findings: DataFrame) -> DataFrame:
    """(doc_id, place, value_sha256, label) where the context is plain, for tables that come without labelled findings.

    1: assigned in quotes to a credential's name. 0: none of these signs. The value, the path and the other words are not
    looked at, so that what a forest learns of them from these labels holds where there is no such context. Candidates
    of fewer than LONG characters have no weak label: they are only found where there are such signs.
    """
    signs = sum((F.col(c) for c in CONTEXT_SIGNS), F.lit(0.0))
    label = F.when(signs == len(CONTEXT_SIGNS), 1).when(signs == 0, 0)
    findings = findings.filter(F.col("n_chars") >= LONG)
    return findings.select("doc_id", "place", "value_sha256", label.alias("label")).filter("label is not null")


def train_forest(findings: DataFrame, labels: DataFrame, features: list[str], sample: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 1) -> PipelineModel | None:
    """A forest on these features, fitted on `sample` labelled findings at most of either label, those of least hash.

    labels has doc_id, place, value_sha256 and label (0, 1). Null when there is just one label, or none.
    """
    keys = ["doc_id", "place", "value_sha256"]
    rows = findings.join(labels.select(*keys, F.col("label").cast("double").alias("label")).distinct(), keys)
    place = F.xxhash64(F.lit("train"), *keys)
    parts = [rows.filter(F.col("label") == x).orderBy(place, *features).limit(sample) for x in (0.0, 1.0)]
    chosen = saved(parts[0].unionByName(parts[1]).select("label", *features), "labelled-findings")
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(chosen)


def with_score(findings: DataFrame, model: PipelineModel | None) -> DataFrame:
    """findings with the share of the forest's vote for a secret; null without a forest."""
    if model is None:
        return findings.withColumn("score", F.lit(None).cast("double"))
    return model.transform(findings).select(*findings.columns, vector_to_array("probability")[1].alias("score"))


def out_of_fold(findings: DataFrame, labels: DataFrame, features: list[str], folds: int = 4, **options) -> DataFrame:
    """findings with score, by a forest that was fitted without the labels of the same value's fold.

    Folds go by the value's hash, so that copies of a finding share one. Where the other folds lack one of the labels,
    the forest of all labels scores; where all do, score is null.
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), "value_sha256"), F.lit(folds))
    labels, everyone, parts = saved(labels.select("doc_id", "place", "value_sha256", "label"), "labels"), None, []
    for n in range(folds):
        model = train_forest(findings, labels.filter(fold != n), features, **options)
        if model is None:
            model = everyone = everyone or train_forest(findings, labels, features, **options)
        parts.append(with_score(findings.filter(fold == n), model))
    return functools.reduce(DataFrame.unionByName, parts)


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def scan_secrets(documents: DataFrame, path: str = "source", labels: DataFrame | None = None, dictionary: int = 2000, threshold: float = 0.5, folds: int = 1, **options) -> DataFrame:
    """doc_id, place, start, n_chars, value_sha256, FEATURES, score, secret of every candidate in every text.

    Candidates come from all texts, and so do vocabulary, dictionary (its `dictionary` commonest words) and
    transitions. score is the share of the forest's vote for a secret, secret whether it reaches threshold; the rest
    are the false positives to drop. labels are labelled findings (doc_id, place, value, label) on which the forest has
    all FEATURES. Without them, weak_labels of these candidates are used, and the forest has the FEATURES that they
    aren't made of. With folds over 1, each value is scored by a forest that hasn't seen it (out_of_fold); if they don't have both labels, score is null and every candidate stays a secret. No value is
    returned or written anywhere, only its hash.

    Null texts have no candidates; a null path is an empty one; rows that repeat a doc_id are scanned each; a null
    doc_id can't be labelled. Other columns of documents are not read.
    """
    words = vocabulary(documents)
    found = with_features(find_candidates(documents, path), common_words(words, dictionary), transition_table(words))
    found = saved(found.select("doc_id", "place", "start", digest(F.col("value")).alias("value_sha256"), *FEATURES), "findings")
    if labels is None:
        given, features = weak_labels(found), [f for f in FEATURES if f not in HIDDEN]
    else:
        given, features = labels.withColumn("value_sha256", digest(F.col("value"))), FEATURES
    scored = out_of_fold(found, given, features, folds, **options) if folds > 1 else with_score(found, train_forest(found, given, features, **options))
    secret = F.coalesce(F.col("score") >= threshold, F.lit(True))
    return scored.select("doc_id", "place", "start", "value_sha256", *FEATURES, "score", secret.alias("secret"))
