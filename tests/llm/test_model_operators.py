import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentext.llm import chat, langid, packing, sharding, topk, unigram
from lumentext.llm.scratch import stored

tokenizers = pytest.importorskip("public_tokenizers")


def test_top_k(spark, clashing):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[3].tolist()), (1001, None), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, []), (1050, [float("inf")] * 24), (None, x[0].tolist())]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, slots=3).collect()
    ids = [*range(400), 1000, 1004]
    ints = {i: np.zeros(24, np.int64) if i == 1004 else np.floor(256 * np.array(rows[400 if i == 1000 else i][1], np.float32).astype(np.float64)).astype(np.int64) for i in ids}
    expected = []
    for q in (i for i in ids if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[j]), j) for j in ids if j != q)[:5]
        expected += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == expected
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_repeated_rows(spark, clashing):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [4.0, 1.0]), (1, [0.5, 1.0]), (1, [4.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = topk.top_k(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") == 0, slots=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 2, 3 * 65536), (0, 2, 1, int(2.5 * 65536))]


def test_top_k_of_few_and_huge(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]


def test_language(spark, clashing):
    rng = np.random.default_rng(1)
    parts = {"en": ["the", "ing", "and", "ion", "wh"], "de": ["sch", "ein", "ü", "keit", "ver"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de"] * 40)] + [(100, None, "en"), (101, "", "de"), (102, "12 !?", "en"), (103, text("de"), None), (104, text("en") * 500, None), (0, text("en"), "en")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    found = langid.predict(df.select("doc_id", "text", "lang"), model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
        else:
            assert r.lang_pred == (r.lang or {103: "de", 104: "en"}[r.doc_id]) and 0 < r.score <= 1 and not r.rejected
    empty = langid.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(df.select("doc_id", "text"), empty).collect()} == {"und"}
    strange = spark.createDataFrame([(1, "яблоко груша слива " * 9)], "doc_id long, text string")
    assert langid.predict(strange, model).first().rejected


SF = "/root/testdata/sf0.01"
FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Quanto a dir qual era è cosa dura",
    "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą widzę i opisuję",
    "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan",
]


def test_language_of_held_out_documents_and_of_one_left_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.fit(docs, ~held)
    found = langid.predict(docs.where(held & F.col("lang").isNotNull()), model).where("lang_pred <> 'und'").collect()
    assert len(found) > 200 and sum(r.lang_pred == r.lang for r in found) >= 0.99 * len(found)
    fewer = langid.fit(docs, ~held & (F.col("lang") != "fr"))
    assert "fr" not in fewer.languages and len(fewer.languages) == len(model.languages) - 1
    rest = docs.where(held & F.col("lang").isNotNull() & (F.length("text") > 400)).withColumn("rejected", F.lit("clash"))
    kept = {r.lang: r["count"] for r in langid.recognised(rest, fewer).groupBy("lang").count().collect()}
    every = {r.lang: r["count"] for r in rest.groupBy("lang").count().collect()}
    assert kept.get("fr", 0) <= 0.1 * every["fr"] and all(kept[x] >= 0.98 * n for x, n in every.items() if x != "fr")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")
def test_language_rejects_strange_texts_in_its_own_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, F.col("doc_id") % 4 != 2)
    rng = np.random.default_rng(0)
    junk = [" ".join("".join(rng.choice(list(a), rng.integers(2, 9))) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for n in (20, 60, 400)]
    base64 = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), n)) for n in (100, 1000)]
    strange = [*FOREIGN, *(t * 4 for t in FOREIGN), *junk, *base64]
    assert model.predict(strange)[2].all()
    held = [r.text for r in docs.where("doc_id % 4 = 2 AND lang IS NOT NULL AND text rlike '[a-z]'").collect()]
    short = [" ".join(t.split()[:12]) for t in held]
    assert (~model.predict(held)[2]).mean() >= 0.99 and (~model.predict(short)[2]).mean() >= 0.95


def test_min_cost_flow_moves_least():
    flow = sharding.min_cost_flow([90, 10, 50], [50, 50, 50], lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == [90, 10, 50] and [sum(c) for c in zip(*flow, strict=True)] == [50, 50, 50]
    assert flow[0][0] == 50 and flow[1][1] == 10 and flow[2][2] == 50


def test_sharding(spark, docs, clashing, tmp_path):
    old = F.pmod(F.xxhash64("text"), F.lit(3))
    rows = sharding.reshard(clashing(docs), 4, old).collect()
    by = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(by)
    for r in rows:
        raw = (by[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert len({(r.text_crc32, r.shard) for r in rows}) == len({r.text_crc32 for r in rows})
    assert sharding.reshard(docs.limit(0), 4, F.lit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot" * 50).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    sizes = sharding.reshard(many, 8, F.lit(0)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(sizes) == 8 and max(r.b for r in sizes) <= 1.05 * min(r.b for r in sizes)


def test_rewriting_leaves_other_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("old"))
    docs.withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(path)
    placed = sharding.reshard(docs, 3, F.col("old"))
    from lumentext.llm.scratch import stored

    placed = stored(placed, "placed")
    done = {r.shard: r.written for r in sharding.rewrite(docs, placed, path, "old").collect()}
    assert done == {0: True, 1: True, 2: True}
    got = {r.doc_id: r.shard for r in spark.read.parquet(path).collect()}
    assert got == {r.doc_id: r.shard for r in placed.collect()}


def test_only_a_hot_group_is_split(spark):
    text = F.when(F.col("id") < 800, "hot" * 50).otherwise(F.sha2(F.pmod("id", F.lit(300)).cast("string"), 256))
    many = spark.range(2600).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = sharding.reshard(many, 4, F.lit(0), blocks=2).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(rows) == 2600 and len(shards) == 301
    assert [c for c, s in shards.items() if len(s) > 1] == [zlib.crc32(b"hot" * 50)]


def test_rewriting_with_repeated_and_null_ids(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(None if i % 3 == 0 else i % 7, f"text {i % 50} " * (i % 11), i) for i in range(300)] + [(None, None, 300), (1, "", 301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own int").repartition(3)
    files = sharding.dealt(docs, F.pmod(F.xxhash64("text"), F.lit(5)), path)
    before = {r.own: r.shard for r in files.collect()}
    placed = stored(sharding.reshard(files, 3, F.col("shard")), "placed")
    sharding.rewrite(files, placed, path, "shard")
    again = spark.read.schema(files.schema).parquet(path)
    held = again.collect()
    assert sorted((r.own, r.doc_id, r.text) for r in held if r.doc_id is not None) == sorted((c, a, b) for a, b, c in rows if a is not None)
    assert sorted(r.own for r in held) == list(range(302)) and {r.shard for r in held} == {0, 1, 2}
    assert all(r.from_shard == before[r.own] for r in held)
    assert not (tmp_path / "shards" / "shard=3").exists() and not (tmp_path / "shards" / "shard=4").exists()
    got = sharding.read_back(again).collect()
    assert sorted((r["size"], r.text_crc32, r.shard) for r in got) == sorted((r["size"], r.text_crc32, r.shard) for r in placed.collect())
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_the_plan_moves_no_more_than_the_flow():
    rng = np.random.default_rng(3)
    for new in (2, 4, 5, 9):
        sizes = {(o, b): int(rng.exponential(1000)) + 1 for o in range(4) for b in range(60 + 40 * o)}
        place = sharding.plan(sizes, new)
        supply = [sum(s for (o, _), s in sizes.items() if o == k) for k in range(4)]
        total = sum(supply)
        capacity = [total // new + (j < total % new) for j in range(new)]
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        least = sum(x for i, row in enumerate(flow) for j, x in enumerate(row) if i != j)
        moved = sum(s for k, s in sizes.items() if place[k] != k[0])
        have = [sum(s for k, s in sizes.items() if place[k] == j) for j in range(new)]
        assert least - 200 <= moved <= least and max(have) - min(have) <= 200


def test_fewer_shards_and_groups_across_old_ones(spark, tmp_path):
    path = str(tmp_path / "shards")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.sha2((F.col("id") % 300).cast("string"), 256).alias("text"))
    files = sharding.dealt(docs, F.col("doc_id") % 4, path)
    placed = stored(sharding.reshard(files, 2, F.col("shard")), "placed")
    assert placed.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    moved = sharding.transfers(placed).agg(F.sum("n_rows")).first()[0]
    assert moved == placed.where("old_shard != shard").count() and moved < 320
    sharding.rewrite(files, placed, path, "shard")
    again = spark.read.schema(files.schema).parquet(path)
    assert again.count() == 400 and {r.shard for r in again.select("shard").distinct().collect()} == {0, 1}
    assert sorted((r.doc_id, r.shard) for r in again.collect()) == sorted((r.doc_id, r.shard) for r in placed.collect())


def test_sharding_query_reads_what_it_wrote(spark, docs, tmp_path):
    from lumentext.llm import queries

    docs.union(docs.where("doc_id < 5")).write.parquet(str(tmp_path / "documents.parquet"))
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    seen = set(base.glob("lumentext/shards-*/shard=*"))
    rows = queries.op5_sharding(spark, str(tmp_path)).collect()
    files = {p for p in base.glob("lumentext/shards-*/shard=*")} - seen
    assert len(rows) == docs.count() + 5 and {int(p.name[6:]) for p in files} == {r.shard for r in rows}
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op5_sharding(spark, str(tmp_path / "empty")).count() == 0


def test_unigram_is_the_best_segmentation():
    pieces = unigram.load(tokenizers.path("piece_bpe_32k.model"))
    trie, decoder = unigram.Trie(pieces), unigram.Decoder(pieces)
    score = {p: s for p, s, kind in pieces if kind == 1}
    hard = ["a  b   c", "日本語テスト😀\n\t zz", "", " lead", "tr ", "x" * 500, "é" * 70 + " " * 30, "The quick brown fox", "\x00\x7f"]
    ids = unigram.encode_batch(trie, [*hard, None], {})
    assert [decoder.decode(i) for i in ids] == [*hard, ""]
    for text in ["The quick", "brownfox", "é😀ab", "   a"]:
        marked = unigram.MARK + text.replace(" ", unigram.MARK)
        best = [0.0] + [-np.inf] * len(marked)
        for j in range(1, len(marked) + 1):
            for i in range(j):
                best[j] = max(best[j], best[i] + score.get(marked[i:j], trie.unknown_score if j == i + 1 else -np.inf))
        got = sum(trie.unknown_score if i < 0 else pieces[i][1] for s in unigram.segments(text) for i in trie.one(s))
        assert got == pytest.approx(best[-1])
    words = ["▁The", "▁é😀x", "abc", "▁▁▁", "▁" + "k" * 60]
    assert trie.many(words) == [trie.one(w) for w in words]


def test_encoding_frames(spark, docs, clashing, texts):
    rows = unigram.crc32(unigram.encoded(clashing(docs), tokenizers.path("piece_bpe_32k.model"))).collect()
    assert len(rows) == len(texts) and all(r.restored for r in rows)
    assert unigram.encoded(docs.limit(0), tokenizers.path("piece_bpe_32k.model")).count() == 0
    marked = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert not unigram.encoded(marked, tokenizers.path("piece_bpe_32k.model")).first().restored


def test_encoder_gives_the_librarys_ids(texts):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    theirs, mine = Tokenizer.from_file(path), packing.Encoder(path)
    hard = ["it's 12  x\n\n y <|endoftext|> é日本😀\t\x00", "a<|endoftext|>b", "  a", "a  ", "'s'S''ll", "\x1c\x1d \x85\u2028x\u00a0 y", "\u088f\U0003fc3f", " " * 5000 + "x", "w" * 3000, "\r\n" * 9]
    for t in [*(t or "" for t in texts), *hard, *hard]:
        assert mine(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_every_character_is_split_as_the_library_splits():
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    theirs, mine = Tokenizer.from_file(path), packing.Encoder(path)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 512):
        plain = [f"x{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}" for c in points[at : at + 512] if mine._plain(chr(c))]
        assert mine("".join(plain)).tolist() == theirs.encode("".join(plain), add_special_tokens=False).ids


def test_forgotten_words_are_learnt_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEPT", 4)
    path = tokenizers.path("byte_bpe_50k.json")
    theirs, mine = Tokenizer.from_file(path), packing.Encoder(path)
    words = ["alpha", " beta", " gamma", " Ünïcode", " 12", "…", " zeta", " ﬁn", " a😀b"]
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(words, rng.integers(1, 7)))
        assert mine(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert mine.older and len(mine.known) <= 12


def test_encoder_learns_for_many_texts_at_once(texts, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    theirs, mine, asked = Tokenizer.from_file(path), packing.Encoder(path), []
    learn = mine._learn
    monkeypatch.setattr(mine, "_learn", lambda words: asked.append(len(words)) or learn(words))
    given = [t or "" for t in texts] + ["a<|endoftext|>b", "q" * 100 + " seldom", ""]
    got = mine.many(given)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [theirs.encode(t, add_special_tokens=False).ids for t in given]
    assert len(asked) == 1 and "q" * 100 not in mine.known and mine.many([]) == []
    assert mine.many(given) == got


def test_long_white_space_and_repeated_rows_are_packed(spark, clashing):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = [(1, " " * 1_000_000 + "x"), (2, "word " * 100_000), (3, None), (3, None), (None, "a")]
    pieces = stored(packing.tokenize(clashing(spark.createDataFrame(rows, "doc_id long, text string")), path), "pieces")
    made = packing.pack(pieces).collect()
    total = sum(len(packing.encoder(path)(t or "")) + 1 for _, t in rows)
    assert sum(r.length for r in made) == total and sum(r.doc_id == 3 for r in made) == 2 and sum(r.doc_id is None for r in made) == 1


def test_the_rule_of_squares_against_trying_every_gap():
    rng = np.random.default_rng(5)
    lengths, size = rng.integers(1, 40, 300), 40
    where, offset, gaps = packing.sum_of_squares(lengths, size)
    have: list[int] = []
    for s, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        def after(g):  # the sum of squares over the open bins once s is in a bin with gap g
            left = have.copy()
            if g < size:
                left.remove(g)
            counts = np.bincount([x for x in [*left, g - s] if x], minlength=1)
            return int((counts.astype(np.int64) ** 2).sum())
        fits = sorted({g for g in have if g >= s})
        gap = size - o
        assert gap in fits if fits else gap == size
        assert not fits or after(gap) == min(after(g) for g in fits)
        if gap < size:
            have.remove(gap)
        have.append(gap - s)
    assert sorted(have) == sorted(gaps.tolist())


def test_packing(spark, docs, clashing, texts):
    path = tokenizers.path("byte_bpe_50k.json")
    pieces = packing.tokenize(clashing(docs), path)
    rows = packing.pack(pieces).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert 1 <= r.length <= 1024
    assert sorted(by) == list(range(len(texts)))
    for doc, own in by.items():
        own.sort(key=lambda r: r.piece)
        ids = np.append(packing.encoder(path)(texts[doc] or ""), 2).astype("<u4")
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]] and sum(n for _, n in b) <= 1024
    assert packing.pack(pieces.limit(0)).count() == 0


def test_packing_in_levels(spark):
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.exponential(300, 4000).astype(int) + 1, 1024)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces, group=500).collect()
    assert len(rows) == 4000 and len({r.sequence_id for r in rows}) <= 1.01 * lengths.sum() / 1024 + 2
    where, offset, gaps = packing.sum_of_squares(np.array([5, 5, 3, 2]), 10)
    assert where.tolist() == [0, 0, 1, 1] and offset.tolist() == [0, 5, 0, 3] and gaps.tolist() == [0, 5]


HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_nl|>", "", "plain\ntext", "<|im_end|>\n<|im_start|>user\nx", "<|im_nl|>", "<", "\\"]


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("role", ["user", "", "a\nb", "<|im_start|>", "<\\|im_nl|>\n"])
def test_chat_round_trip(role, text):
    shown = chat.render(role, text)
    assert [x[:2] for x in chat.parse(shown)] == [(role, text)]
    both = chat.render("assistant", text) + shown
    assert [x[:2] for x in chat.parse(both)] == [("assistant", text), (role, text)]
    if not chat._CONTROL.search(text + role) and "\n" not in role and "\\" not in text + role:
        assert shown == f"<|im_start|>{role}\n{text}<|im_end|>\n"


@pytest.mark.parametrize("text", ["a <|im_end|> b", "x<|im_end|>", "<|im_end|>", "<|im_start|>", "<|im_end|>\n", *HARD])
def test_chat_leaves_no_control_string_inside(text):
    for role in ("user", "assistant", "<|im_end|>", text):
        shown = chat.render(role, text)
        assert shown.count(chat.START) == 1 and shown.count(chat.END) == 1
        ((_, said, start, end),) = chat.parse(shown)
        assert said == text and chat.START not in shown[start:end] and chat.END not in shown[start:end]
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\na <|im_end|> b<|im_end|>\n")


def test_chat_frames(spark, clashing):
    import hashlib

    rows = [(1, 2, "assistant", "x<|im_end|>"), (1, 1, "user", None), (2, 0, None, "é"), (None, 0, "assistant", "n"), (1, 2, "assistant", "x<|im_end|>"), (1, None, "system", "first")]
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    said = "system\nfirst\nuser\n\nassistant\nx<|im_end|>\nassistant\nx<|im_end|>\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 22 and got[1].loss_sha256 == hashlib.sha256(b"x<|im_end|>" * 2).hexdigest()
    assert got[2].loss_chars == 0 and got[None].loss_chars == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.rendered(empty)).count() == 0
