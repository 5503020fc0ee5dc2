import hashlib
from functools import reduce

import brute
import pytest
from pyspark.sql import functions as F

from lumentext.llm import neardup, pii, quality, suffix
from lumentext.llm.scratch import stored


def test_pii_base_spans(spark, clashing):
    hard = [
        None, "", "a@b.c_d@e.f.g x@y z@@q@r.s", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3", "4111 1111-1111 1111 4111  1111 12 x4111111111111111y",
        "+1 (232) 555-1234- +22 3 +1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7", "é😀 a@b.co 4111111111111111😀+12345678 9", "a" * 3000, "1" * 3000, "1 " * 3000, "a@" * 2000, "+1" * 2000, "1." * 600, "a.b-" * 900 + "@x.y",
    ]
    rows = [*enumerate(hard), (2, hard[2]), (None, "me@home.org")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = pii.detect(df).select("doc_id", "n_ip", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        assert r.b == ",".join(f"{k}:{s}:{e}" for k, s, e in brute.pii(by[r.doc_id])) and r.s == r.b


def test_pii_bootstraps_contexts(spark):
    numbers = ["4111111111111111", "4917945544862443", "4929348385146306", "5500005555555559", "4111111111111112"]
    rows = [(i, f"hello my card number is {x} ok") for i, x in enumerate(numbers)] + [(100 + i, f"my card number was {i} here 4111111111111113") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detect(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(got[i] == "card:24:40" for i in range(5)) and not any(got[100 + i] for i in range(3))
    assert {r.text for r in pii.redact(df).where("doc_id < 5").collect()} == {"hello my card number is <card> ok"}
    assert pii.detect(df.limit(0)).count() == 0


def test_pii_contexts_of_fewer_words_and_long_tokens(spark):
    cards = ["4111111111111111", "4917945544862443", "4929348385146306", "5500005555555559"]
    unknown, long = "4111111111111112", "9" * 70 + "x1"
    rows = [(i, f"{w} acct: {x}") for i, (w, x) in enumerate(zip(["so this", "the", "a new", "his own"], cards, strict=True))]
    rows += [(10, f"acct: {unknown}"), (11, f"other text acct: {long} end"), (12, "one two three 4111111111111113")]
    rows += [(20 + i, f"{'v' * 90} {'u' * 90} w{i} pay{' ' * 90}to {x}") for i, x in enumerate([*cards, unknown])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detect(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert got[10] == "card:6:22" and got[11] == "card:17:89" and not got[12]
    assert got[24].startswith("card:")
    assert pii.redact(df).where("doc_id = 11").first().text == "other text acct: <card> end"


def test_pii_found_identifiers_seed_further_contexts(spark):
    cards = ["4111111111111111", "5500005555555559", "4929348385146306"]
    codes = [f"zq{k}81{k}52" for k in range(7)]
    rows = [(i, f"note {i}: the card number is {x} now") for i, x in enumerate([*cards, *codes[:6]])]
    rows += [(20 + i, f"entry {i}; see the member code {x} too") for i, x in enumerate(codes)] + [(40, "a plain year 2024001 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detect(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(got[i] for i in range(9)) and all(got[20 + i] for i in range(7)) and not got[40]
    first = stored(pii.edges_of(stored(pii.searched(df), "found")), "edges")
    assert pii.bootstrap(df, first, generations=1).count() < pii.bootstrap(df, first).count()


def test_pii_of_long_and_repeated_rows(spark, clashing):
    long = "word " * 200_000 + "me@home.org" + " x" * 100_000
    df = clashing(spark.createDataFrame([(1, long), (1, "me@home.org"), (1, "me@home.org"), (None, None)], "doc_id long, text string"))
    made = pii.redact(df)
    assert made.columns == df.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in made.collect()) == [(0, 0), (1, 7), (1, 7), (1, len(long) - 4)]


def test_pii_uses_leave_a_text_only_for_patterns(spark, docs, texts, monkeypatch):
    words = [(t or "").lower().split() for t in texts]
    all_words = docs.where("text IS NOT NULL").select(F.expr(f"regexp_extract_all(lower(text), r'[^{pii.SPACE}]+', 0)").alias("w"))
    every = {k: all_words.where(F.size("w") >= k).select(pii._key(F.col("w"), F.lit(0), k).alias("pattern")) for k in (1, 2, 3)}
    patterns = stored(reduce(lambda a, b: a.union(b), [d.distinct().select(F.lit(k).alias("k"), "pattern") for k, d in every.items()]), "patterns")
    made = pii.pattern_uses(docs, patterns)
    got = sorted(map(tuple, made.collect()))
    starts = [{tuple(w[:k]) for w in words if len(w) >= k} for k in (1, 2, 3)]
    assert sorted(n for _, n in got) == sorted(sum(tuple(w[i : i + k]) == s for w in words for i in range(len(w))) for k in (1, 2, 3) for s in starts[k - 1])
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()  # which would meet all words of the corpus, gathered first
    monkeypatch.setattr(pii, "LISTED", 2)
    assert sorted(map(tuple, pii.pattern_uses(docs, patterns).collect())) == got


def test_quality(spark, docs, clashing):
    got = quality.judge(clashing(docs.union(docs.where("doc_id = 11")))).collect()
    by = {r.doc_id: r for r in docs.collect()}
    assert len(got) == len(by) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(by[r.doc_id].text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_removes_frequent_lines(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(i, line + ("\nown words %d" % i if i < 12 else ""), "h") for i in range(14)] + [(100 + i, f"w{i} a b c d e f g h i j k", "h") for i in range(30)] + [(200, line, "other"), (201, None, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i].kept for i in range(14)) and all(got[100 + i].kept for i in range(30)) and got[200].kept
    assert got[0].n_removed_words == 11 and not got[0].base_failed


def test_quality_counts_a_repeated_row_once(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, line, "h")] * 25 + [(2, line, "h")] + [(10 + i, f"w{i} a b c d e f g h i j k", "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.frequent_lines(df).count() == 0
    got = quality.judge(df).collect()
    assert len(got) == len(rows) and all(r.kept and r.n_removed_words == 0 for r in got)


def test_near_duplicates(docs, texts, clashing):
    got = neardup.near_duplicates(clashing(docs)).collect()
    expected = brute.components(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v[1] for v in expected.values()}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_through_a_third(spark):
    """Links that no neighbour or first member shows: a crowd with a common passage, and pairs within it."""
    import numpy as np

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 80))
    rows = []
    for k in range(40):
        own = passage + list(rng.choice(words, 60))
        rows.append(" ".join(own))
        if k % 4 == 0:
            own[-1] = "changed"
            rows.append(" ".join(own[:10] + ["x"] + own[11:]))
    rows = list(enumerate(rows))
    got = neardup.near_duplicates(spark.createDataFrame([*rows, (None, "a b c d e f"), (3, rows[3][1])], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute.components(rows)
    assert len(got) == len(rows) + 2


def test_links_of_a_dense_region(monkeypatch):
    """Most pairs are similar by their signatures, few by their sets: a text's set is made once, not for each tree or pair."""
    import numpy as np

    rng = np.random.default_rng(2)
    passage = [f"p{i}" for i in range(100)]
    texts = [" ".join(passage + [f"w{w}" for w in rng.integers(0, 10**9, 45)]) for _ in range(60)]
    texts += [" ".join(t.split()[:-k]) for k, t in enumerate(texts[:20], 1)]
    keys, size = neardup.shingled(texts)
    sets = np.split(keys, np.cumsum(size)[:-1])
    assert all((a == neardup.shingles_of(t)).all() for a, t in zip(sets, texts, strict=True))
    sig = np.array([[((k * h) >> np.uint64(32)).min() for h in neardup._HASH] for k in sets]).astype(">u4")
    made = []
    monkeypatch.setattr(neardup, "shingles", lambda data, ends, f=neardup.shingles: made.append(len(ends) - 1) or f(data, ends))
    got = list(neardup.links(np.arange(len(texts)), np.arange(len(texts)), size, sig, texts))
    assert sum(made) == len(texts) and all(neardup.similar(sets[a], sets[b]) for a, b in got)
    part = list(range(len(texts)))
    for a, b in sorted(got, key=max):
        part[b] = part[a]
    assert part == [brute.components(list(enumerate(texts)))[i][1] for i in range(len(texts))]
    monkeypatch.setattr(neardup, "AT_ONCE", 10)
    assert list(neardup.links(np.arange(len(texts)), np.arange(len(texts)), size, sig, texts)) == got


def test_repeated_passages(spark, docs, texts, clashing):
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digests(clashing(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == brute.repeats(texts)
    cleaned = suffix.cleaned(docs)
    assert cleaned.columns == docs.columns
    by = {r.doc_id: r.text for r in cleaned.collect()}
    assert by[0] is None and by[1] == "" and by[6] == "" and by[10] == "" and by[3] == "a b c"
    assert suffix.digests(docs.limit(0)).count() == 0


def test_repeated_passages_at_edges(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    w = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    a, b = w(250), w(199)
    rows = [a + w(100), w(50) + a, b + w(9), b, "a" * 1000, "b" + "a" * 250, "xy" * 300, "c" * 200, "abc" * 100 + w(50) + "abc" * 90, a[:210] + "zz", "a" * 3000 + w(300) + "a" * 900, "q" * 199, "q" * 199]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digests(df).collect()}
    assert [got[i] for i in range(len(rows))] == brute.repeats(rows)


def test_suffix_sort_is_a_sort():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    starts, block = rng.permutation(450)[:200], np.repeat([0, 1, 2], [50, 149, 1])
    order = suffix.suffix_sort(suffix.Hashes(data), starts, block, 40)
    for k in range(3):
        mine = [bytes(data[s : s + 40]) for s in starts[order[block[order] == k]]]
        assert mine == sorted(mine)
    assert (block[order] == block).all()


@pytest.mark.parametrize("text", ["a b c d e f a b c d e", "Ab aB", "\t\n", "é " * 9])
def test_shingles(text):
    assert len(neardup.shingles_of(text)) == len(brute.shingles(text))


def test_sha(docs):
    row = suffix.digests(docs.where("doc_id = 3")).first()
    assert row.kept_sha256 == hashlib.sha256(b"a b c").hexdigest()


def test_hashes_of_long_buffers(monkeypatch):
    """Memory of a chunk besides the sums, whatever the length; parts that are equal have equal hashes wherever the tables end."""
    import tracemalloc

    import numpy as np

    data = np.random.default_rng(5).integers(97, 100, 3_000_000).astype(np.uint8)
    suffix._powers.clear()
    tracemalloc.start()
    suffix.Hashes(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * len(data)
    long = data[:5000].copy()
    long[4000:4300] = long[100:400]
    starts, whole = np.arange(4700), suffix.Hashes(long)
    expected = whole.of(starts, 300)
    found = suffix.anchors(long, np.array([0, 2500]), np.array([2500, 5000]))
    monkeypatch.setattr(suffix, "CHUNK", 64)
    monkeypatch.setattr(suffix, "TABLE", 256)
    suffix._powers.clear()
    parted = suffix.Hashes(long)
    assert len(parted.tables) > 1 and (parted.of(starts, 300) == expected).all() and (parted.sums == whole.sums).all()
    assert parted.of(np.array([100]), 300) == parted.of(np.array([4000]), 300) and parted.common(np.array([100]), np.array([4000]), 300) == 300
    assert all((x == y).all() for x, y in zip(found, suffix.anchors(long, np.array([0, 2500]), np.array([2500, 5000])), strict=True))
