import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentext.functions import text as T
from lumentext.operators import embed, judge, segments, spans, store
from lumentext.sources import records, sinks


def test_split_and_merge():
    assert segments.split_sentences("brief", 9) == ["brief"]
    assert segments.split_sentences("Go on. Rivers run down to seas? ok", 14) == ["Go on.", "Rivers run", "down to seas?", "ok"]
    assert segments.split_sentences("k" * 23, 9) == ["k" * 9, "k" * 9, "k" * 5]
    assert segments.split_sentences("\t" * 700) == []
    assert segments.split_code("x=1\ny\n" + "z" * 11, 6) == ["x=1\ny", "zzzzzz", "zzzzz"]
    m = segments.Merger(12, 60)
    assert [*m.feed("Wind", "p"), *m.feed("and waves", "p"), *m.end()] == [("Wind and waves", "p")]
    m = segments.Merger(12, 60)
    assert [*m.feed("Wind", "p"), *m.feed("sea", "q"), *m.end()] == [("Wind", "p"), ("sea", "q")]


def test_merge_on_frames(spark):
    rows = [("p", 1, "Wind"), ("p", 2, "over the bay"), ("p", 3, "m" * 44), ("q", 1, "\t"), ("q", 2, "k")]
    made = segments.merge(spark.createDataFrame(rows, "source string, n int, text string"), "source", ["n"], "text", 15)
    assert sorted((r.source, r.position, r.segment) for r in made.collect()) == [("p", 0, "Wind over the bay"), ("p", 1, "m" * 44), ("q", 0, "k")]


def test_readers_find_and_check_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,b\none,1\n")
    (tmp_path / "b.csv").write_text("b,text\n2,two\n")
    (tmp_path / "c.csv").write_text("other\nx\n")
    assert sorted(tuple(r) for r in records.read_segments(spark, str(tmp_path)).collect()) == [("one", "a.csv"), ("two", "b.csv")]
    for path, error in ((tmp_path / "none", FileNotFoundError), (tmp_path, FileNotFoundError), (tmp_path / "a.csv", ValueError)):
        with pytest.raises(error):
            records.discover(spark, str(path))


def test_judging_asks_again(spark):
    def judge_(texts, number):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [{"score": 0.2 if "low" in t else 0.9, "status": "keep", "type": "natural", "reason": "r"} for t in texts]

    rows = spark.createDataFrame([("a", "fine"), ("b", "bad one"), ("c", "!!!!!!!!!!!!"), ("d", "low")], "k string, text string").coalesce(1)
    got = {r.k: (r.score, r.status) for r in judge.judge_all(rows, "k", judge_, 2).collect()}
    assert got == {"a": (0.9, "keep"), "b": (0.0, "discard"), "c": (0.1, "discard"), "d": (0.2, "discard")}


def test_convolution_against_the_plain_sum():
    import math

    x = np.linspace(-4, 4, 41)
    assert np.allclose(embed.erf(x), [math.erf(v) for v in x], atol=2e-7)
    encoder, rng = embed.ConvEncoder(4, (3,), (2,)), np.random.default_rng(1)
    seeds = rng.normal(size=(6, 4)).astype(np.float32)
    (w, bias), = encoder.conv
    plain = np.zeros((6, 4))
    for t in range(6):
        for k in range(3):
            if 0 <= (at := t + (k - 1) * 2) < 6:
                plain[t] += seeds[at] @ w[k]
    plain = plain + bias
    plain = plain * 0.5 * (1 + np.vectorize(math.erf)(plain / math.sqrt(2)))
    h = plain @ encoder.out[0] + encoder.out[1] + seeds
    assert np.allclose(encoder(seeds), (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5), atol=1e-4)


def test_text_expressions(spark):
    rows = [" cat", "", "  ", "a, b", "the cat", "e c", ", b c,"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    assert [r[0] for r in df.select(T.is_whole_phrase(F.col("x"))).collect()] == [True, False, False, False, True, True, True]
    df = spark.createDataFrame([("https://h.org/owner/repo.git", "a/b/x.PY", " x "), ("x", "Makefile", "")], "u string, p string, t string")
    assert [tuple(r) for r in df.select(T.repo_name(F.col("u")), T.file_language(F.col("p")), T.strip(F.col("t"))).collect()] == [("owner__repo", "python", "x"), ("x", "unknown", "")]
    df = spark.createDataFrame([("a\0b",), ("\x01" * 200,), ("ok " * 100,), ("\x01" * 50,)], "x string")
    assert [r[0] for r in df.select(T.is_likely_binary(F.col("x"))).collect()] == [True, True, False, False]


def test_judge(spark):
    replies = ["**Score:** 0.9 **Status:** Keep\nType: code Reason: fine ", "score: 1 status: maybe type: x reason: y", "nothing"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(r,) for r in replies], "x string").select(judge.parse(F.col("x"))).collect()]
    assert got == [(0.9, "keep", "code", "fine"), (1.0, "discard", "natural", "y"), (0.5, "discard", "natural", "unparseable")]
    votes = spark.createDataFrame([(1, 0, 0.7, "keep", "code", "b"), (1, 1, 0.7, "discard", "natural", "a"), (1, 2, 0.7, "keep", "natural", "b")], "id int, judge int, score double, status string, type string, reason string")
    assert tuple(judge.consensus(votes, "id").first()) == (1, 0.7, "natural", "keep", "b / a / b")
    assert tuple(judge.resolve(votes, "id").first()) == (1, 0.7, "keep", "natural", "a / b")
    voted = judge.judged(spark.createDataFrame([("plain text",)], "text string"), judge.heuristic_judge, 2)
    assert [r.status for r in voted.collect()] == ["keep", "keep"]


def test_span_statistics(spark):
    sp = spark.createDataFrame([(1, 0, 3), (1, 0, 7), (1, 4, 7), (1, 2, 5)], "seq_id long, start int, end int")
    n = spark.createDataFrame([(1, 9)], "seq_id long, n int")
    assert [r.depth for r in spans.depth(sp, n).orderBy("pos").collect()] == [2, 2, 3, 2, 3, 2, 2, 0, 0]
    assert [(r.start, r.end) for r in spans.gaps(sp, n).collect()] == [(7, 9)]
    assert spans.coverage(sp, n).first().covered == 7
    row = spans.hierarchy(sp).first()
    assert (row.pairs, row.max_depth, row.roots, row.leaves) == (3, 1, 1, 3)
    assert spans.overlaps(sp).first().pairs == 4


def test_span_candidates(spark):
    p = {"the": 0.1, "cat": 0.08, "dog": 0.07, "a": 0.05, " ": 0.2, "e": 0.03, "t": 0.04}
    table = spark.createDataFrame(list(p.items()), "piece string, prob double")
    seqs = spark.createDataFrame([(1, "the cat"), (2, "a, b c")], "seq_id long, text string")
    got = spans.candidates(seqs, table, p, 10, 0.05, 1e-4).groupBy("seq_id").count().collect()
    assert {r.seq_id: r["count"] for r in got} == {1: 28, 2: 16}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    corr = np.corrcoef(x)[np.triu_indices(20, 1)]
    row = embed.row_correlation(df).first()
    assert (row.mean_corr, row.std_corr) == (pytest.approx(corr.mean(), abs=1e-6), pytest.approx(corr.std(), abs=1e-6))
    with pytest.raises(ValueError):
        embed.similarity(F.col("a"), F.col("b"), "other")
    with pytest.raises(ValueError):
        embed.receptive_fields((2,), (1,))
    assert (3, 1, 1, 3) in embed.receptive_fields() and (7, 4, 12, 25) in embed.receptive_fields()
    made = embed.ConvEncoder(8)(rng.normal(size=(5, 8)))
    assert made.shape == (5, 8) and np.allclose(made.mean(axis=1), 0, atol=1e-6) and np.array_equal(made, embed.ConvEncoder(8)(np.zeros((5, 8)) + made) * 0 + made)


def test_records(spark, tmp_path):
    lines = ['{"raw": " ok "}', "{broken", '{"type": "x"}', '{"raw": 5}', '{"raw": "gone", "meta": {"status": "discard"}}', '{"raw": "  "}', '{"raw": "' + "x" * 600 + '"}', '{"raw": "fine", "id": null}', '{"raw": "bad", "meta": null}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = {r["class"]: r.n for r in records.scan_stats(records.read_jsonl(spark, str(tmp_path))).collect()}
    assert got == {"valid": 2, "invalid": 5, "discarded": 1, "too_long": 1}
    (tmp_path / "v.json").write_text('{"piece": "a", "prob": 0.5}\n{"piece": "b", "probability": 0.2}\n{"piece": "a", "prob": 0.3}\n{"piece": "c", "prob": 2}\n')
    assert {r.piece: r.prob for r in records.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {"a": 0.3, "b": 0.2}
    (tmp_path / "s.csv").write_text('text,other\n" one ",1\n,2\n"two\nlines",3\n')
    assert sorted(r.text for r in records.read_segments(spark, str(tmp_path / "s.csv")).collect()) == ["one", "two\nlines"]


def test_code_files_and_pages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, content in (("src/a.py", "x = 1"), ("src/b.png", "x"), ("src/c.txt", "  "), ("node_modules/d.js", "y"), ("src/e.rs", "fn")):
        (tmp_path / name).write_text(content)
    got = records.read_code(spark, str(tmp_path)).collect()
    assert sorted((r.file_path.rsplit("/", 1)[1], r.language, r.size_chars) for r in got) == [("a.py", "python", 5), ("e.rs", "rust", 2)]
    files = spark.createDataFrame([("a", 450), ("b", 30)], "path string, pages int")
    assert sorted(tuple(r) for r in records.page_ranges(files).collect()) == [("a", 0, 199), ("a", 200, 399), ("a", 400, 449), ("b", 0, 29)]


def test_numbering_and_sample(spark):
    df = spark.createDataFrame([(k,) for k in (5, 20_001, 7, 999_999)], "k long")
    assert [(r.k, r.seq_id) for r in records.numbered(df, "k").orderBy("k").collect()] == [(5, 1), (7, 2), (20_001, 3), (999_999, 4)]
    assert sinks.sample(df, "k", 2).collect() == sinks.sample(df, "k", 2).collect()


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(1, 26).select(F.col("id").alias("seq_id"), F.lit(3).alias("n"))
    store.write(rows.where("seq_id not in (4, 5, 13)"), path, 10)
    assert [tuple(r) for r in store.islands(store.missing(rows, spark.read.parquet(path))).orderBy("start_id").collect()] == [(4, 5, 2), (13, 13, 1)]
    assert [r.chunk_id for r in store.integrity(spark.read.parquet(path).drop("chunk_id"), store.manifest(rows, 10), 10).where("not intact").orderBy("chunk_id").collect()] == [1, 2]
    store.repair(spark, path, rows, lambda gone: gone, 10)
    assert store.missing(rows, spark.read.parquet(path)).count() == 0
    assert store.load(spark, path, 13, 10).count() == 1 and store.load_chunk(spark, path, 3).count() == 5


def test_streaming(spark, tmp_path):
    from lumentext.streaming import ingest

    src = str(tmp_path / "in")
    spark.range(1, 26).select(F.col("id").alias("seq_id"), F.lit(3).alias("n")).write.parquet(src)
    stream = spark.readStream.schema("seq_id long, n int").option("maxFilesPerTrigger", 1).parquet(src)
    out, buffer = str(tmp_path / "out"), str(tmp_path / "buffer")
    ingest.store_stream(stream, out, buffer, str(tmp_path / "check"), 10).awaitTermination()
    assert sorted({r.chunk_id for r in spark.read.parquet(out).collect()}) == [1, 2]
    ingest.flush(spark, out, buffer, 10)
    assert spark.read.parquet(out).count() == 25


def test_spans_are_counted_without_being_formed(spark):
    """Totals and pieces against every span, one by one, with odd spaces, characters beyond 16 bits, digits and marks."""
    from lumentext.functions import text as T

    p = {"the": 0.1, "cat": 0.08, "a": 0.05, " ": 0.2, "e": 0.03, "t": 0.04, ",": 1e-3, "b": 1e-5, "\U0001d7d8": 0.02}
    rng = np.random.default_rng(1)
    texts = ["the cat", "a, b c", " ", ".", "\u00a0a\u2003 b\t", "x" * 30, *("".join(rng.choice(list("ate  b,.\t\n\u00a0\u00e9\U0001d7d8\u0301"), 40)) for _ in range(12))]
    table = spark.createDataFrame(list(p.items()), "piece string, prob double")
    seqs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, text string")
    by = lambda df: sorted(map(tuple, df.groupBy("seq_id").agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).collect()))
    for w_max in (1, 7, 25, 60):
        every = spans.enumerate_spans(seqs, w_max)
        whole = every.where(T.is_whole_phrase(F.col("span")))
        assert sorted(map(tuple, spans.phrase_counts(seqs, w_max).collect())) == by(whole)
        made = {s for t in texts for i in range(len(t)) for j in range(i + 1, min(len(t), i + w_max) + 1) if p.get(s := t[i:j], 0) >= 0.02 or (len(s) <= 20 and spans.best_product(s, p, 3) >= 1e-6)}
        wanted = whole.union(every.where(F.col("span").isin(made))).distinct()
        assert sorted(map(tuple, spans.candidate_counts(seqs, table, p, w_max, 0.02, 1e-6).collect())) == by(wanted)
        assert sorted(spans.candidates(seqs, table, p, w_max, 0.02, 1e-6).collect()) == sorted(wanted.collect())
        assert sorted(spans.pieces_in(seqs, table, w_max, 0.02).collect()) == sorted(spans.aligned(every, table, 0.02).drop("span").collect())


def test_strip_is_linear_and_takes_what_the_pattern_takes(spark):
    """Every character of 16 bits is stripped or kept as the pattern says; white space inside a text costs nothing."""
    import time

    from lumentext.functions import text as T

    chars = spark.range(1, 0x10000).where("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    told = chars.select("c", T.strip(F.concat("c", F.lit("x"), "c")).alias("s"), T.is_blank(F.col("c")).alias("blank"), F.col("c").rlike(f"^[{T.STRIP}]$").alias("wanted"))
    assert told.where("wanted <> blank OR wanted <> (s = 'x')").count() == 0 and told.where("wanted").count() == len(T.STRIPPED)
    began = time.perf_counter()
    text = F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b"))
    assert spark.range(1).select(F.length(T.strip(text)).alias("n")).first().n == 300_002
    assert time.perf_counter() - began < 20


def test_encoding_of_texts_together_is_that_of_each_alone(spark):
    """Runs that texts share are encoded once; norms are those of the vectors; a fault stays in its row."""
    p = {"a": 0.3, "b": 0.3, "ab": 0.2, " ": 0.2}
    given = [(1, "ab ab a"), (2, "b"), (3, "ab  ab c " * 9), (4, "ab ab a"), (5, "")]
    df = spark.createDataFrame(given, "seq_id long, text string")
    whole = {r.seq_id: r for r in embed.encode(df, p, width=16, partitions=1).collect()}
    encoder = embed.ConvEncoder(16)
    for i, text in given:
        seed, context = np.array(whole[i].seed, np.float32).reshape(-1, 16), np.array(whole[i].context, np.float32).reshape(-1, 16)
        assert len(seed) == len(text) and np.allclose(encoder(seed), context, atol=1e-5)
    assert whole[1].context == whole[4].context and whole[1].soft == whole[4].soft
    length = lambda x: np.linalg.norm(np.array(x, np.float64), axis=1).mean()
    for r in embed.encode(df.where("seq_id < 5"), p, True, width=16, partitions=1).collect():
        assert (r.seed_norm, r.context_norm) == (pytest.approx(length(whole[r.seq_id].seed)), pytest.approx(length(whole[r.seq_id].context)))
    bad = embed.encode(spark.createDataFrame([(1, "ab"), (2, None)], "seq_id long, text string").select("seq_id", F.coalesce("text", F.lit("b")).alias("text")), {"a": 0.5, "b": -1.0, "ab": 0.2}, True, width=4, partitions=1)
    assert {r.seq_id: r.error for r in bad.collect()} == {1: None, 2: None}


def test_pairs_of_spans_on_a_grid_and_in_blocks(spark, monkeypatch):
    """Containers, children and crossings against all pairs; equal and empty spans too. No join is planned."""
    rng = np.random.default_rng(4)
    for grid in (1 << 22, 50):
        monkeypatch.setattr(spans, "GRID", grid)
        for n in (1, 2, 40):
            start = rng.integers(0, 9, n)
            end = start + rng.integers(0, 6, n)
            s, e, mult, over, under, cross, reach = spans._pairs(start, end)
            assert mult.sum() == n
            for a, b, *got in zip(s, e, over, under, cross, reach, strict=True):
                crossing = (start < a) & (a < end) & (end < b)
                assert got == [((start <= a) & (end >= b)).sum() - 1, ((start >= a) & (end <= b)).sum() - 1, crossing.sum(), end[crossing].sum()]
    sp = spark.createDataFrame([(1, 0, 3), (1, 0, 7), (1, 4, 7), (1, 2, 5), (2, 0, 1)], "seq_id long, start int, end int")
    for made in (spans.hierarchy(sp), spans.overlaps(sp), spans.containers(sp)):
        assert "Join" not in made._jdf.queryExecution().toString()
    assert [tuple(r) for r in spans.overlaps(sp).collect()] == [(1, 4, 4, 1.0)]
    assert sorted((r.seq_id, r.start, r.end, r.depth, r.children) for r in spans.containers(sp).collect()) == [(1, 0, 3, 1, 0), (1, 0, 7, 0, 3), (1, 2, 5, 1, 0), (1, 4, 7, 1, 0), (2, 0, 1, 0, 0)]


def test_splitting_gives_out_as_it_goes(spark, monkeypatch):
    """No batch of segments is larger than its bound, however many texts come at once; the segments are the same."""
    import pyarrow as pa

    texts = ["One. " * n + "end" for n in range(0, 4000, 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    given = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, *a: given.append(f))
    segments.split(df, "doc_id", "text")
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    monkeypatch.setattr(segments, "HELD", 5000)
    made = list(given[0](iter([batch])))
    assert len(made) > 10 and max(b.num_rows for b in made) <= 5000 // 64 + 1 and max(sum(map(len, b.column(2).to_pylist())) for b in made) <= 5000 + 512
    wanted = [(i, k, s) for i, t in enumerate(texts) for k, s in enumerate(segments.split_sentences(t))]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == wanted
    assert sorted(map(tuple, segments.split(df, "doc_id", "text").collect())) == wanted


def test_quantiles_in_ranges(spark, monkeypatch):
    """Against numpy, with ties, an outlier that leaves all others in one range, and a single number."""
    monkeypatch.setattr(embed, "VALUES", 10)
    rng = np.random.default_rng(6)
    for x in (rng.normal(size=501), np.r_[rng.integers(0, 4, 200), 1e12], np.r_[np.zeros(50), rng.normal(size=50) * 1e-9], np.array([2.5])):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        assert embed.quantiles(df, len(x), float(x.min()), float(x.max()), (0.25, 0.75)) == pytest.approx([np.quantile(x, 0.25), np.quantile(x, 0.75)], rel=1e-12, abs=1e-300)
