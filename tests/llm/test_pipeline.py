import os

import brute
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark):
    import corpus_pipeline as C

    from lumentext.llm.scratch import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in C.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), f"test-{name}"))
        if name != "packing":
            assert seen[-1].columns == columns and seen[-1].dtypes == docs.dtypes
    language, near, repeats, private, packed = [{r.doc_id: r for r in x.collect()} for x in seen[1:]]
    assert len(language) >= 0.98 * docs.count()
    parts = brute.components([(i, r.text) for i, r in language.items()])
    assert set(near) == {c for _, c in parts.values()}
    expected = brute.repeats([near[i].text for i in near])
    for i, (n, gone, runs, _) in zip(near, expected, strict=True):
        kept = len(repeats[i].text.encode())
        assert n - gone - 6 * runs <= kept <= n - gone and repeats[i].n_chars == len(repeats[i].text)
    assert set(private) == set(repeats) and not any(brute.pii(r.text) for r in private.values())
    assert set(packed) == set(private)


def test_empty(spark):
    import corpus_pipeline as C

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_nulls_repeats_and_clashing_names(spark, clashing):
    """Each stage on rows that are hard: null ids and texts, repeated rows, further columns named like those used inside."""
    import corpus_pipeline as C
    from pyspark.sql import functions as F

    prose = ["the ship lay in the harbour and the men went down to the water with ropes and lamps", "das schiff lag im hafen und die leute gingen mit lampen und seilen an das wasser hinunter"]
    rows = [(i, f"{prose[i % 2]} number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", ("en", "de")[i % 2], "s", 1) for i in range(60)]
    rows += [(3, rows[3][1], "de", "s", 1), (None, rows[3][1] + " und mehr", None, None, None), (None, "a clean text that stands alone in the whole table of documents here", "en", "s", 1), (70, None, "en", "s", 1), (71, "", None, "s", 0), (72, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = clashing(docs).withColumns({c: F.lit("clash") for c in ("rejected", "score", "lang_pred", "_h1", "_kept", "placed_id", "key", "row", "own", "k1", "n", "place")})
    seen = {}
    for name, stage in C.STAGES[:4]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns
        seen[name] = made.collect()
    assert all(r.text for r in seen["language"]) and len(seen["language"]) >= 60
    near = seen["near_duplicates"]
    assert sum(r.doc_id == 3 for r in near) <= 1 and any((r.text or "").startswith("a clean text") for r in near)
    assert {r.doc_id for r in near} >= {70, 71} and len(seen["repeats"]) == len(seen["personal_data"]) == len(rows)
    assert sum(r.length for r in C.pack(spark, docs, "").collect()) > len(rows)


def test_stages_begin_with_lean_workers(spark):
    import corpus_pipeline as C

    from lumentext.llm import packing, scratch

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)

    def served(operator):
        def run(batches):
            for b in batches:
                last = scratch._turn[0]
                scratch.turn(operator, packing.forget)
                yield b.from_pydict({"last": [last] * b.num_rows})

        return {r.last for r in spark.range(0, 64, 1, 16).mapInArrow(run, "last string").collect()}

    try:
        spark.conf.set(rows, "10000")
        served("before")
        assert C._lean(lambda spark, docs, sf: docs)(spark, "docs", SF) == "docs"
        assert int(spark.conf.get(rows)) == C.BATCH
        assert "before" not in served("after")
    finally:
        spark.conf.set(rows, before)


def test_personal_data_runs_no_python(spark, monkeypatch):
    """Neither its own rows nor the clearing up before it; the stage before leaves workers that hold nothing."""
    import corpus_pipeline as C

    from lumentext.llm import scratch

    docs = spark.createDataFrame([(1, "write to ann@example.org at once", "en", "s", 1), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(C.STAGES)
    docs = scratch.stored(stages["repeats"](spark, docs, ""), "test-lean")
    last = lambda batches: (b.from_pydict({"last": [scratch._turn[0]] * b.num_rows}) for b in batches)
    assert "suffix" not in {r.last for r in spark.range(0, 64, 1, 16).mapInArrow(last, "last string").collect()}
    frame, used = type(docs), []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, name, lambda *a, f=getattr(frame, name), **b: (used.append(1), f(*a, **b))[1])
    private = {r.doc_id: r.text for r in stages["personal_data"](spark, docs, "").collect()}
    assert private == {1: "write to <email> at once", 2: None} and not used
