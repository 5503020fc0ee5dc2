"""Personal data: fixed patterns give seeds, and bootstrapped contexts find identifiers that no fixed pattern knows.

Base spans (email, ip, card, phone) come from regular expressions over the whole text. The one, two and three words before a seed
make lexical patterns. Patterns and the identifier-like strings in their slots form a graph, scored in rounds: a pattern by the
share of all its occurrences in the corpus that hold a known identifier, an instance by the patterns that propose it (by
those of one length together, and the best of the lengths counts, as the patterns of one place are no separate evidence).
Instances of high confidence become seeds in their turn: the contexts of all their mentions make further patterns, until no
instance is added or GENERATIONS are done. What was found becomes spans of its own. DataFrame functions only.

Texts are searched once; what is found there (places, hashes of instances and contexts) is stored without the texts.

Defined results: null text is an empty text; an empty table gives an empty result; rows with equal doc_id and text get
equal results, each for itself; a null doc_id is one more id; other columns, whatever their names, are kept by `redact` and
not read. Offsets are code points, the end exclusive; of a text of any length the whole is searched.

Each expression is written so that it reads a run of its characters once, also in very long texts: a match starts at a
run's first character or where the match before it has ended, and loops are possessive where what follows can't begin
with a character of the loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, let, small, stored, text_key

SPACE = r"\x20\x09-\x0D"
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
FIND = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without it can't match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: What may be an identifier in a pattern's slot: so many digits at least.
CANDIDATE, DIGITS = r"(?<![0-9A-Za-z])(?=[A-Za-z]{0,16}[0-9])[0-9A-Za-z._:/-]{6,}+", 4
#: Words before an identifier that make a pattern, at most; where fewer precede it, those do.
WORDS = 3
#: Rounds of scoring; distinct known instances that a pattern needs; confidence from which patterns and instances count; times that what was found seeds anew.
ROUNDS, SEEDS, CONFIDENCE, GENERATIONS = 3, 3, 0.5, 4
#: Patterns at most that are sent to every task to be looked up there.
LISTED = 20_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise((d * 2).cast("int") - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda x: F.when(F.length(_digits(x)).between(16, 19), let(_digits(x), _luhn)).otherwise(False),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def _found(text: Column, regex: str, needs: str | None) -> Column:
    """array<struct<start, end, match>> of all matches: they and the pieces between them, in turn, make up the text."""
    fill = lambda regex: F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.transform(F.split(text, regex, -1), F.length)
    zipped = F.zip_with(fill(regex), gaps, lambda m, gap: F.struct(m.alias("match"), gap.alias("gap")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    some = text.rlike(regex) if needs is None else F.contains(text, F.lit(needs)) & text.rlike(regex)
    return F.when(some, F.aggregate(zipped, start, step)["out"]).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and for each kind an array of its spans; no shuffle."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", *[_found(F.col("text"), FIND[k], NEEDS[k]).alias(k) for k in KINDS])
    return found.select("doc_id", "text", *[_valid(k).alias(k) for k in KINDS])


def _valid(kind: str) -> Column:
    return F.filter(kind, lambda x: VALID[kind](x["match"]))


def _tagged(spans: str | Column, tag: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(tag.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))


def _all(arrays: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), arrays)


def _key(words: Column, first: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, first + i) for i in range(k)])


def _left(text: Column, start: Column) -> Column:
    """k and pattern for each k up to WORDS: the key of the k words before start, as far as so many stand there. More is read only where words are long."""

    def read(reach: int | None) -> Column:
        from_ = F.lit(1) if reach is None else F.greatest(start - (reach - 1), F.lit(1))
        found = F.regexp_extract_all(F.lower(F.substring(text, from_, start + 1 - from_)), F.lit(f"[^{SPACE}]++(?=[{SPACE}])"), F.lit(0))
        # the first may be cut where the text begins before
        return found if reach is None else F.when(start > reach, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)

    enough = lambda w, reach: (F.size(w) >= WORDS) | (start <= reach)
    words = let(read(80), lambda w: F.when(enough(w, 80), w).otherwise(let(read(1000), lambda v: F.when(enough(v, 1000), v).otherwise(read(None)))))
    key = lambda w, k: F.when(F.size(w) >= k, F.struct(F.lit(k).alias("k"), _key(w, F.size(w) - k, k).alias("pattern")))
    return let(words, lambda w: F.filter(F.array(*[key(w, k) for k in range(1, WORDS + 1)]), lambda x: x.isNotNull()))


def searched(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's), n_email ..., base (array of struct<k, start, end>) and slots of each row: slots are the seeds (kind set) and
    unknown identifier-like strings (kind null), with instance (a hash of the string) and patterns, struct<k, pattern> for each number k of words before it."""
    every = _all([_tagged(k, F.lit(k)) for k in KINDS])
    unknown = lambda known: lambda x: (F.length(_digits(x["match"])) >= DIGITS) & ~F.exists(known, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    both = lambda known: F.concat(known, _tagged(F.filter(_found(F.col("text"), CANDIDATE, None), unknown(known)), F.lit(None).cast("string")))
    slots = F.filter(let(every, both), lambda x: x["start"] > 0)
    left = F.transform(slots, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(F.lower(x["match"])).alias("instance"), _left(F.col("text"), x["start"]).alias("patterns")))
    one = lambda i, k: F.transform(k, lambda x: F.struct(F.lit(i).alias("k"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.array_sort(_all([one(i, k) for i, k in enumerate(KINDS)]))
    return base_spans(docs).select("doc_id", text_key(F.col("text")).alias("key"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), left.alias("slots"))


def edges_of(found: DataFrame) -> DataFrame:
    """k, pattern, instance, n, kind of the graph of contexts and what stands in them. found: stored rows of `searched`."""
    one = found.select(F.explode("slots").alias("x")).select("x.kind", "x.instance", F.explode("x.patterns").alias("p"))
    return one.groupBy("p.k", "p.pattern", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))


def pattern_uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n_uses: how often the words of each pattern (k, pattern; stored) stand anywhere in the corpus, whatever follows them.

    Up to LISTED patterns are looked up while a text is read, and nothing but their uses leaves it. Beyond that, single words and pairs
    are counted before they meet the patterns, as common ones stand everywhere; longer ones are mostly distinct and are counted after.
    """
    words = docs.where("text IS NOT NULL").select(F.expr(f"regexp_extract_all(lower(text), r'[^{SPACE}]+', 0)").alias("w"))
    w = F.col("w")
    runs = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: _key(w, i, k))).otherwise(F.array().cast("array<bigint>"))
    listed = patterns.select("k", "pattern").limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        by = {k: [p.pattern for p in listed if p.k == k] for k in sorted({p.k for p in listed})}
        among = lambda found: lambda x: x.isin(found)
        uses = [F.filter(runs(k), among(found)) for k, found in by.items()]
        return words.select(F.explode(_all(uses)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_uses"))
    wanted = lambda few: small(patterns.where(F.col("k") <= 2 if few else F.col("k") > 2)).select("pattern")
    counted = words.select(F.explode(F.concat(runs(1), runs(2))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_uses")).join(wanted(True), "pattern")
    long = words.select(F.explode(_all([runs(k) for k in range(3, WORDS + 1)])).alias("pattern")).join(wanted(False), "pattern").groupBy("pattern").agg(F.count("*").alias("n_uses"))
    return counted.union(long)


def bootstrap(docs: DataFrame, edges: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confidence: float = CONFIDENCE, generations: int = GENERATIONS) -> DataFrame:
    """pattern, instance, kind, score of the pairs that give identifiers away which no fixed pattern knows. edges: stored."""
    known = stored(edges.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("known_kind")), "pii-known")
    counted = sure = None
    for generation in range(generations):
        seeded = edges.select("k", "pattern", "instance").join(known, "instance")
        rich = seeded.groupBy("k", "pattern").agg(F.countDistinct("instance").alias("n_seeds"), F.mode("known_kind", True).alias("pattern_kind")).where(F.col("n_seeds") >= seeds)
        patterns = stored(rich.select("k", "pattern", "pattern_kind"), f"pii-patterns-{generation}")
        # the corpus is read again only for patterns that no generation before has counted
        new = patterns if counted is None else stored(patterns.join(counted, "pattern", "left_anti"), f"pii-new-patterns-{generation}")
        if new.isEmpty():
            break
        uses = pattern_uses(docs, new)
        counted = stored(uses if counted is None else counted.union(uses), f"pii-uses-{generation}")
        named = known.withColumnRenamed("instance", "known")
        graph = edges.join(patterns.drop("k"), "pattern").join(counted, "pattern").join(named, F.col("instance") == F.col("known"), "left").drop("known", "kind")
        graph = stored(graph, f"pii-graph-{generation}")
        scores = graph.groupBy("instance").agg(F.max(F.col("known_kind").isNotNull().cast("double")).alias("score"))
        for _ in range(rounds):
            rated = graph.join(scores, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max("n_uses")).alias("pattern_score"))
            rated = rated.withColumn("pattern_score", F.least("pattern_score", F.lit(0.999)))
            either = F.when(F.max(F.col("known_kind").isNotNull()), 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.col("pattern_score")))))
            each = graph.join(rated, "pattern").groupBy("instance", "k").agg(either.alias("score"))
            scores = stored(each.groupBy("instance").agg(F.max("score").alias("score")), "pii-scores")
        strong = graph.join(rated.where(F.col("pattern_score") >= confidence), "pattern").join(scores.where(F.col("score") >= confidence), "instance")
        sure = stored(strong.select("pattern", "instance", F.col("pattern_kind").alias("kind"), F.col("pattern_score").alias("score"), "known_kind"), f"pii-sure-{generation}")
        fresh = sure.where("known_kind IS NULL").groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", F.col("best.kind").alias("known_kind"))
        fresh = stored(fresh, f"pii-fresh-{generation}")
        discard(graph)
        if fresh.isEmpty():
            break
        known = stored(known.union(fresh), "pii-known")
    empty = docs.sparkSession.createDataFrame([], "pattern long, instance long, kind string, score double")
    return empty if sure is None else sure.drop("known_kind")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's), n_email ..., base and spans for each row: arrays of struct<kind, start, end>, by kind as in KINDS and start."""
    found = stored(searched(docs), "pii-found")
    edges = stored(edges_of(found), "pii-edges")
    sure = bootstrap(docs, edges)
    order = F.array(*map(F.lit, KINDS))
    slots = found.select("doc_id", "key", F.explode("slots").alias("x")).where("x.kind IS NULL").select("doc_id", "key", "x.start", "x.end", "x.instance", F.explode("x.patterns").alias("p"))
    hits = slots.withColumn("pattern", F.col("p.pattern")).join(small(stored(sure, "pii-sure")), ["pattern", "instance"])
    best = hits.groupBy("doc_id", "key", "start", "end").agg(F.max(F.struct("score", "p.k", "kind")).alias("best"))
    number = (F.array_position(order, F.col("best.kind")) - 1).cast("int").alias("k")
    extra = best.groupBy("doc_id", "key").agg(F.collect_set(F.struct(number, "start", "end")).alias("extra")).withColumnsRenamed({"doc_id": "extra_id", "key": "extra_key"})
    rows = found.drop("slots").join(small(stored(extra, "pii-extra")), F.col("doc_id").eqNullSafe(F.col("extra_id")) & (F.col("key") == F.col("extra_key")), "left").drop("extra_id", "extra_key")
    named = lambda a: F.transform(F.array_sort(a), lambda x: F.struct(F.get(order, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra"))
    return rows.withColumns({"base": named(F.col("base")), "spans": named(every)}).drop("extra")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by <kind>; overlapping spans are replaced as one, named after the first. Null texts stay null."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substring(acc["text"], acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(acc["text"].alias("text"), F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    # rows that have spans are the fewer ones; of equal rows one is enough
    some = stored(detect(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), "spans").dropDuplicates(["found_id", "found_key"]), "pii-spans")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own"), text_key(docs["text"]).alias("key"))
    rows = rows.join(small(some), F.col("own").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    text = F.col("row")["text"]
    state = F.struct(text.alias("text"), F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(by_start, state, step, lambda acc: F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, F.length(acc["text"]))))
    return rows.select(*[(F.when(F.col("spans").isNotNull(), done).otherwise(text) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
