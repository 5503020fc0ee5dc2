import math

import pytest

from lumentext.operators import vocab


def runs(spark, *texts):
    return vocab.run_counts(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_substring_counts(spark):
    counts = {r.piece: r.freq for r in vocab.substring_counts(runs(spark, "hello", "world", "hello world"), 3).collect()}
    assert len(counts) == 22 and sum(counts.values()) == 49
    assert (counts["l"], counts["o"], counts[" "], counts["hel"]) == (6, 4, 1, 2)


def test_case_and_spaces(spark):
    counts = {r.piece: r.freq for r in vocab.substring_counts(runs(spark, "A b  C"), 8).collect()}
    assert "a b" in counts and "  " in counts and "b " not in counts and "A" not in counts


def test_candidates_break_ties_by_piece(spark):
    df = spark.createDataFrame([("bb", 2), ("aa", 2), ("cc", 1), ("z", 1)], "piece string, freq long")
    assert [r.piece for r in vocab.candidates(df, 1).collect()] == ["aa", "z"]


def test_initial_probabilities(spark):
    df = spark.createDataFrame([("a", 30), ("b", 10)], "piece string, freq long")
    assert {r.piece: r.prob for r in vocab.initial_probabilities(df).collect()} == {"a": 0.75, "b": 0.25}


def test_viterbi_prefers_the_probable_piece():
    logs = {c: math.log(0.01) for c in "helo"} | {"hello": math.log(0.96)}
    assert vocab.viterbi("hello", logs, 5)[0] == ["hello"]
    del logs["o"], logs["hello"]
    assert vocab.viterbi("hello", logs, 5) is None
    assert vocab.viterbi("", logs, 5) == ([], 0.0)


P = {"a": 0.4, "b": 0.3, "ab": 0.2, "ba": 0.1}


def test_em_step(spark):
    found = vocab.segmented(runs(spark, "ab", "aba", "abab"), P)
    assert {r.run: r.pieces for r in found.collect()} == {"ab": ["ab"], "aba": ["ab", "a"], "abab": ["ab", "ab"]}
    new = vocab.em_step(found, spark.createDataFrame(list(P.items()), "piece string, prob double"))
    assert {r.piece: round(r.prob, 9) for r in new.collect()} == {"ab": 0.8, "a": 0.2, "b": 0.0, "ba": 0.0}
    assert vocab.corpus_metrics(found).first().perplexity == pytest.approx(4.352753, abs=1e-6)


@pytest.mark.parametrize(("texts", "p", "expected"), [(["aa", "bb"], {"a": 0.5, "b": 0.5}, 2), (["ab"], {"a": 0.8, "b": 0.2}, 2.5)])
def test_perplexity(spark, texts, p, expected):
    assert vocab.corpus_metrics(vocab.segmented(runs(spark, *texts), p)).first().perplexity == pytest.approx(expected)


def test_uncovered_characters_count(spark):
    row = vocab.corpus_metrics(vocab.segmented(runs(spark, "ab cd"), {"a": 0.5, "b": 0.4, " ": 0.1})).first()
    assert row.oov == pytest.approx(2 / 5) and row.coverage == pytest.approx(3 / 5)


def test_soft_probabilities():
    total, soft = vocab.soft_probabilities("aba", P, 2)
    assert total == pytest.approx(math.log(0.168))
    assert {(i, u): round(q, 6) for i, u, q in soft} == {(0, "a"): 0.52381, (0, "ab"): 0.47619, (1, "b"): 0.285714, (1, "ba"): 0.238095, (2, "a"): 0.761905}
    assert sum(q * len(u) for _, u, q in soft) == pytest.approx(3)


def test_pruning_agrees_with_full_passes():
    corpus, p = [("abab", 3), ("aba", 2), ("ab", 5)], {"a": 0.3, "b": 0.2, "ab": 0.4, "ba": 0.05, "aba": 0.05}

    def metrics(q):
        logs = {u: math.log(x) for u, x in q.items()}
        found = [(vocab.viterbi(r, logs, 3), m) for r, m in corpus]
        return math.exp(-sum(f[1] * m for f, m in found) / sum(len(f[0]) * m for f, m in found))

    left, ppl, now = dict(p), metrics(p), metrics(p)
    for u in [u for u in p if p[u] < 0.1]:
        q = {v: x for v, x in left.items() if v != u}
        total = sum(q.values())
        new = metrics({v: x / total for v, x in q.items()})
        if new - now < 0.5:
            left, now = q, new
    order, got = vocab.prune(corpus, list(p), p, ppl, 0.1, 0.5, 0.001)
    assert order == list(left) and got == pytest.approx(now)


def test_induction_is_deterministic(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), ("the dog",)], "text string")
    (a, s), (b, t) = (vocab.induce(docs, m=20, iterations=2) for _ in range(2))
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()] and s == t and s["oov_rate"] == 0


def test_validation(spark):
    good = spark.createDataFrame([("h", 0.5), ("hello", 0.5)], "piece string, prob double")
    assert vocab.validate_probabilities(good).first().valid
    assert not vocab.validate_probabilities(good.limit(0)).first().valid
    row = vocab.structure(good).first()
    assert (row.total, row.single, row.multi, row.avg_length) == (2, 1, 1, 3.0)


def test_long_runs_and_guards(spark):
    p = {c: 1 / 2000 for c in "abcd"}
    total, cells = vocab.soft_probabilities("abcd" * 1250, p, 1)
    assert total == pytest.approx(5000 * math.log(1 / 2000)) and len(cells) == 5000 and all(q == pytest.approx(1) for _, _, q in cells)
    assert vocab.soft_probabilities("abx", p, 1) == (-math.inf, [])
    rows = spark.createDataFrame([("a", 1, ["a"], -600.0)], "run string, mult long, pieces array<string>, score double")
    assert vocab.corpus_metrics(rows).first().perplexity == 1e6
    assert vocab.corpus_metrics(rows.limit(0)).first().perplexity == math.inf


def test_substring_counts_in_wide_alphabets(spark):
    from collections import Counter

    runs = [("".join(chr(0x4E00 + i) for i in range(400)), 2), ("aab", 3), ("日本日本", 1)]
    expected = Counter()
    for run, mult in runs:
        for i in range(len(run)):
            for n in range(1, min(8, len(run) - i) + 1):
                expected[run[i : i + n]] += mult
    got = vocab.substring_counts(spark.createDataFrame(runs, "run string, mult long").coalesce(1)).collect()
    assert {r.piece: r.freq for r in got} == expected and len(got) == len(expected)


def test_side_by_side_is_one_by_one(spark):
    """Segmentations of many runs at once against those of single ones: ties, runs that can't be made, long ones, characters of no piece."""
    import random

    rng = random.Random(3)
    p = {"a": 0.25, "b": 0.25, "ab": 0.0625, "ba": 0.1, "aba": 0.05, "\U0001d7d8": 0.1, "é": 0.05, "aéb": 0.01, "z": 0.0}
    words = ["".join(rng.choice("aab\U0001d7d8éz" if k % 5 == 0 else "abé") for _ in range(k % 9 + 1)) for k in range(200)] + ["ab" * 4000, "zz"]
    logs = {u: math.log(q) for u, q in p.items() if q > 0}
    df = spark.createDataFrame([(w, 1) for w in words], "run string, mult long")
    got = sorted((r.run, r.pieces, r.score) for r in vocab.segmented(df, p).collect())
    assert got == sorted((w, *(vocab.viterbi(w, logs, 3) or (None, None))) for w in words)
    for table in (vocab.Trie(logs), mock_wide(logs)):
        pieces, score = vocab._segmented(table, logs, words)
        assert pieces.to_pylist() == [f[0] if f else None for w in words for f in [vocab.viterbi(w, logs, 3)]]


def mock_wide(logs):
    """The trie of an alphabet that is too wide for a table."""
    from unittest import mock

    with mock.patch.object(vocab, "TABLE", 0):
        return vocab.Trie(logs)


def test_pruning_fetches_only_what_can_change(spark):
    """Pruning over a table gives what it gives over all runs on the driver, and fetches only the runs that use a rare piece."""
    words = [("abab", 50), ("cd", 40), ("abcd", 30), ("xyx", 1), ("zxy", 2), ("ab", 500), ("dc", 300)]
    p = {"ab": 0.5, "cd": 0.2, "a": 0.05, "b": 0.05, "c": 0.06, "d": 0.06, "x": 0.02, "y": 0.02, "z": 0.02, "xy": 0.015, "yx": 0.005}
    order = sorted(p, key=lambda u: -p[u])
    df = spark.createDataFrame(words, "run string, mult long")
    for eps, delta in ((0.018, 0.001), (0.018, 0.0), (0.03, 0.5)):
        assert vocab.prune(df, order, p, 9.0, eps, 0.5, delta) == vocab.prune(words, order, p, 9.0, eps, 0.5, delta)
    some, _, rest, chars, letters = vocab._prunable(df, p, ["xy", "yx"])
    assert some == [("xyx", 1), ("zxy", 2)] and letters == set("abcdxyz") and chars == sum(len(w) * m for w, m in words) and rest[2] == 0


def test_soft_probabilities_side_by_side(spark):
    """Cells, masses and sums of many runs at once against those of single ones; no cell is shuffled by its run."""
    import random

    rng = random.Random(5)
    p = {"a": 0.25, "b": 0.25, "ab": 0.0625, "ba": 0.1, "aba": 0.05, "\U0001d7d8": 0.1, "aéb": 0.01, "z": 0.0}
    words = ["".join(rng.choice("aab\U0001d7d8éz" if k % 5 == 0 else "ab") for _ in range(k % 7 + 1)) for k in range(80)] + ["ab" * 3000]
    df = spark.createDataFrame([(w, 1 + k % 3) for k, w in enumerate(words)], "run string, mult long")
    alone = {w: vocab.soft_probabilities(w, p, 3) for w in words}
    for r in vocab.forward_backward(df, p).collect():
        total, cells = alone[r.run]
        assert r.log_total == pytest.approx(total, rel=1e-12) and [(c.pos, c.piece) for c in r.soft] == [c[:2] for c in cells]
        assert [c.p for c in r.soft] == pytest.approx([c[2] for c in cells], rel=1e-9)
    mass, best, whole = {}, {}, {}
    for k, w in enumerate(words):
        for i, u, q in alone[w][1]:
            mass[u] = mass.get(u, 0) + (1 + k % 3) * q
            best[k, i], whole[k, i] = max(best.get((k, i), 0), q), whole.get((k, i), 0) + q
    assert {r.piece: r.mass for r in vocab.piece_masses(df, p).collect()} == pytest.approx(mass)
    made = vocab.soft_sums(df, p)
    assert "Exchange hashpartitioning(run" not in made._jdf.queryExecution().toString()
    rows = made.collect()
    got = {c: sum(r[c] for r in rows) for c in vocab._SUMS}
    weight = lambda f: sum((1 + k[0] % 3) * f(v) for k, v in best.items())
    assert got["n"] == sum((1 + k % 3) * len(w) for k, w in enumerate(words)) and got["places"] == weight(lambda q: 1)
    assert (got["best"], got["low"], got["high"]) == pytest.approx((weight(lambda q: q), weight(lambda q: q < 0.1), weight(lambda q: q > 0.8)))
    assert got["row_sum"] == pytest.approx(sum((1 + k[0] % 3) * q for k, q in whole.items())) and max(r.top for r in rows) == pytest.approx(max(best.values()))
