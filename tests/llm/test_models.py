import numpy as np
import pandas as pd
import pytest
from llm_cases import clashing, docs, odd_rows, words
from pyspark.sql import functions as F

from selenogrid.llm import grading, secrets, toxicity
from selenogrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(y, s):
    ranks, positive = pd.Series(s).rank().to_numpy(), int(y.sum())
    return (ranks[y == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(y) - positive))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).toPandas().set_index("doc_id")


def test_held_out_quality(spark, labels):
    got = QUERIES["op7_ordinal_quality"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.p_tail.between(0, 1).all() and got.expected_grade.between(0, 2).all()
    held = got[got.held_out].join(labels, how="inner")
    assert auc(held.quality.to_numpy(), held.p_tail.to_numpy()) > 0.98
    assert (held.kept == (held.quality == 1)).mean() > 0.97


def test_held_out_toxicity(spark, labels):
    got = QUERIES["op8_toxicity"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].join(labels, how="inner")
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.88
    assert held.predicted[held.toxic == 1].mean() > 0.75 and held.predicted[held.toxic == 0].mean() < 0.03


def test_thresholds_are_ordered_and_fit():
    r = np.random.default_rng(0)
    grades = r.integers(0, 4, 400)
    rows = [(np.array([1, 2 + g]), np.array([1.0, 1.0])) for g in grades]
    w, t = grading.fit(rows, grades, 4)
    assert (np.diff(t) > 0).all() and len(t) == 3
    tail = [1 / (1 + np.exp(t - v @ w[i])) for i, v in rows]
    assert (np.round([x.sum() for x in tail]) == grades).mean() > 0.95


def test_gradient_of_the_ordinal_model():
    """One step from the same start must not raise the loss for small rates: the signs of all gradients are right."""
    r = np.random.default_rng(1)
    grades = r.integers(0, 3, 60)
    rows = [(np.array([0, 1 + i % 5]), r.random(2)) for i in range(60)]

    def loss(w, t):
        out = 0.0
        for (i, v), g in zip(rows, grades):
            tail = np.concatenate([[1], 1 / (1 + np.exp(t - v @ w[i])), [0]])
            out -= np.log(tail[g] - tail[g + 1])
        return out

    losses = [loss(*grading.fit(rows, grades, 3, rounds=n, rate=0.01)) for n in (1, 20, 100, 300)]
    assert losses == sorted(losses, reverse=True)


def test_no_ratings_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, grade int, toxic int")
    w, t = grading.train(docs(spark), none)
    got = grading.grades(clashing(docs(spark)), w, t).collect()
    assert len(got) == len(odd_rows()) and all(abs(r.expected_grade - 1) < 1e-9 for r in got)
    assert grading.grades(docs(spark, []), w, t).count() == 0
    model = toxicity.character_model(docs(spark, []))
    assert toxicity.train(docs(spark), none, model) == {}
    assert {r.score for r in toxicity.scores(clashing(docs(spark)), model, {}).collect()} == {0.0}


@pytest.fixture(scope="module")
def disguised(spark):
    clean = [" ".join(words(30, i).translate(str.maketrans("0123456789", "aeioulnrst")).split()) for i in range(300)]
    bad = ["stupid", "moron", "pathetic"]
    rows = [(i, f"{t} {bad[(i // 3) % 3]} {t[:20]} {bad[(i // 9) % 3] if i % 2 else ''}" if i % 3 == 0 else t + " the people are sorted into parties and pathways", "en", "s", 1) for i, t in enumerate(clean)]
    table = docs(spark, rows)
    given = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.character_model(table)
    return model, toxicity.train(table, given, model)


@pytest.mark.parametrize("text,toxic", [
    ("you st0pid", False), ("a stup1d thing", True), ("so $tup1d!", True), ("a m0r0n here", True), ("p.a.t.h.e.t.i.c", True), ("moooooron", True), ("you m o r o n now", True),
    ("MORON!!", True), ("more on parties", False), ("", False), (None, False), ("call 555 2010 at 10:30", False), ("stu", False)])
def test_disguised_words_are_restored(spark, disguised, text, toxic):
    model, strength = disguised
    got = toxicity.scores(docs(spark, [(1, text, "en", "s", 1)]), model, strength).first()
    assert bool(got.predicted) == toxic


@pytest.mark.parametrize("text", ["so 5tupid", "stup1d5", "a moron5 here", "$tupid!", "@ pathe7ic", "m" + "o" * 90 + "ron"])
def test_signs_at_edges_and_long_tokens_are_restored(spark, disguised, text):
    model, strength = disguised
    assert toxicity.scores(docs(spark, [(1, text, "en", "s", 1)]), model, strength).first().predicted == 1


def test_edge_signs_may_be_letters_or_punctuation():
    tokens = toxicity.Tokens(np.zeros((28, 28, 28)), lambda w: w)
    for token, word in (("a55", "ass"), ("a$$", "ass"), ("idio7", "idiot"), ("idio+", "idiot"), ("!diot", "idiot"), ("loser5", "losers"), ("idio7!", "idiot"), ("moron!!", "moron")):
        assert word in tokens.words(token), token
    assert tokens.words("10:30") == [] and len(tokens.words("abc." * 5_000)) >= 1


def test_words_written_in_signs_and_numbers():
    counts = toxicity.trigram_counts(["the ass and the asses " * 30]).reshape(28, 28, 28) + 0.1
    tokens = toxicity.Tokens(np.log(counts / counts.sum(2, keepdims=True)), lambda w: w)
    assert "ass" in tokens.words("4$$") and "ass" in tokens.words("@$$") and "asses" in tokens.words("(@$$3$)")
    for number in ("455", "10:30", "2010", "1,234.50", "4-5-5"):
        assert tokens.words(number) == []


def test_long_edges_take_linear_work():
    import time

    tokens = toxicity.Tokens(np.zeros((28, 28, 28)), lambda w: w)
    for token in ("!$" * 50_000 + "a", "a" + "$!" * 50_000, "!$" * 50_000 + "moron" + "$!" * 50_000, "@$5" * 40_000, "$" + "ab.c" * 20_000 + "$"):
        at = time.perf_counter()
        found = tokens.words(token)
        assert time.perf_counter() - at < 60 and sum(map(len, found)) < 60 * len(token)
    assert "moron" in tokens.words("!$" * 500 + "moron" + "$!" * 500)


def test_viterbi_finds_the_best_of_all_paths():
    import itertools
    import re

    r = np.random.default_rng(5)
    for _ in range(40):
        model = np.log(r.dirichlet(np.ones(28), (28, 28)))
        token = "".join(r.choice(list("ab1$0.-!xx")) for _ in range(r.integers(1, 8)))
        runs = [(m.group()[0], len(m.group()), False) for m in re.finditer(r"(.)\1*", token)]

        def score(parts):
            total, x, y = 0.0, 0, 0
            for letters, cost in parts:
                total += cost
                for letter in letters:
                    z = toxicity._fold(ord(letter))
                    if not (y == z == 0):
                        total += model[x, y, z]
                        x, y = y, z
            return total + (model[x, y, 0] if y else 0.0)

        paths = {}
        for parts in itertools.product(*[toxicity._choices(*run) for run in runs]):
            spelling = "".join(p[0] for p in parts)
            paths[spelling] = max(paths.get(spelling, -np.inf), score(parts))
        (found,) = toxicity._paths(runs, len(runs), model)
        assert abs(paths[found] - max(paths.values())) < 1e-9


def test_spaced_words_come_out_one_by_one():
    text = ["you moron now " * 40]
    counts = toxicity.trigram_counts(text).reshape(28, 28, 28) + 0.1
    tokens = toxicity.Tokens(np.log(counts / counts.sum(2, keepdims=True)), lambda w: w)
    assert {"you", "moron", "now"} <= set(tokens(" ".join("youmoronnow")))
    assert {"you", "moron", "now"} <= set(tokens(" ".join("youmoronnow" * 9)))


def test_long_text_counts_its_last_word(spark, disguised):
    model, strength = disguised
    got = toxicity.scores(docs(spark, [(1, "the people " * 60_000 + "m0ron", "en", "s", 1)]), model, strength).first()
    assert got.predicted == 1
    counts = toxicity.trigram_counts(["ab " * 700_000])
    assert counts.sum() == 2_100_000


def test_secrets_are_found_and_redacted(spark):
    import random

    r = random.Random(8)
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(120)]
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    rows = []
    for i in range(120):
        t = words(20, i)
        rows.append((1000 + i, [f"{t} token = \"{hexes[i]}\" {t}", f"{t} {keys[i]} {t}", f"{t} order 45{i:04d}9918177755 {t}", f"{t} build abcdefabcdef{i:04d}zzzzzz {t}"][i % 4], "en", f"src{i % 3}", 1))
    rows += odd_rows()[:11] + [(900, f"twice {keys[1]} and {keys[1]}", "en", None, 7), (900, f"twice {keys[1]} and {keys[1]}", "en", None, 7)]
    table = clashing(docs(spark, rows))
    got = secrets.scan(table).toPandas()
    real = got.value.str.match(r"^AKIA|^[0-9a-f]{40}$")
    assert (got.is_secret == real).mean() > 0.97 and len(got) >= 120
    for r in got.itertuples():
        assert any(x[0] == r.doc_id and (x[1] or "")[r.start : r.start + len(r.value)] == r.value for x in rows if x[0] == r.doc_id or r.doc_id != r.doc_id)
    out = secrets.redact(table, secrets.scan(table))
    assert out.columns == table.columns and out.count() == len(rows)
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert text[900] == ("twice [SECRET] and [SECRET]", 27) and keys[5] not in text[1005][0] and text[1002][0] == rows[2][1] and text[1002][1] == rows[2][4]


def test_secret_labels_may_be_given_or_all_alike(spark):
    rows = [(i, f"x number 45{i:04d}9918177755 y", "en", "s", 1) for i in range(8)]
    assert {r.is_secret for r in secrets.scan(docs(spark, rows)).collect()} == {False}
    labels = spark.createDataFrame([(i, 9, 1.0) for i in range(8)], "doc_id long, start long, label double")
    assert {r.is_secret for r in secrets.scan(docs(spark, rows), labels).collect()} == {True}
    assert secrets.scan(docs(spark, [])).count() == 0 and secrets.redact(docs(spark, []), secrets.scan(docs(spark, []))).count() == 0


def test_coverage_takes_the_longest_word_first():
    assert secrets.covered("passwordXYkey1", {"pass", "password", "word"}, 8) == 8 / 14
    assert secrets.candidates("my api_key=abcdef1234567890abcd; x") == [(11, "abcdef1234567890abcd", "my api_key=", ["my"], ["x"])]
    far = secrets.candidates("a " + "w" * 5_000 + " token: abcdef1234567890abcd " + "z" * 9_000)
    assert far[0][3:] == (["a", "w" * 5_000], ["z" * 9_000])
    assert secrets.candidates(None) == [] and secrets.candidates("password: hunter2x")[0][1] == "hunter2x"
