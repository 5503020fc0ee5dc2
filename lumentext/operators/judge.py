"""Judging segments: filters before the judge, parsing of its replies, consensus over several votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
FILTERS = [r"^[\s]*$", r"^[^a-zA-Z0-9]{10,}$"]
REPLY = r"(?is)(?:\*\*score:\*\*|score:)\s*([0-9.]+)\s*(?:\*\*status:\*\*|status:)\s*(\w+)\s*(?:\*\*type:\*\*|type:)\s*(\w+)\s*(?:\*\*reason:\*\*|reason:)\s*(.+)"
THRESHOLD, DISCARD_BELOW = 0.69, 0.25


def filtered(text: Column) -> Column:
    """Whether a text is discarded without a judge."""
    return text.rlike(FILTERS[0]) | text.rlike(FILTERS[1])


def parse(reply: Column) -> Column:
    """struct<score, status, type, reason> of a judge's reply; what can't be read is discarded with score 0.5; a score alone that is no number counts as 0.5."""
    part = lambda k: F.regexp_extract(reply, REPLY, k)
    status, kind = F.lower(part(2)), F.lower(part(3))
    found = reply.rlike(REPLY)
    return F.struct(
        F.when(found, F.coalesce(part(1).try_cast("double"), F.lit(0.5))).otherwise(0.5).alias("score"),
        F.when(found & status.isin("keep", "discard"), status).otherwise("discard").alias("status"),
        F.when(found & kind.isin("natural", "code", "mixed"), kind).otherwise("natural").alias("type"),
        F.when(found, T.strip(part(4))).otherwise("unparseable").alias("reason"),
    )


def thresholded(votes: DataFrame, below: float = DISCARD_BELOW) -> DataFrame:
    return votes.withColumn("status", F.when(F.col("score") < below, "discard").otherwise(F.col("status")))


def _most_common(column: str) -> Column:
    return F.mode(column, True)


def consensus(votes: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, score (mean), type (most common, ties by name), status (kept from the threshold on), reason (all, in order of the judges)."""
    by = votes.groupBy(key).agg(F.avg("score").alias("score"), _most_common("type").alias("type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("judge", "reason"))), lambda x: x["reason"]), " / ").alias("reason"))
    return by.select(key, F.round("score", 6).alias("score"), "type", F.when(F.col("score") >= threshold, "keep").otherwise("discard").alias("status"), "reason")


def resolve(votes: DataFrame, key: str) -> DataFrame:
    """key, score (mean to 3 digits), status and type (most common), reason (distinct, sorted)."""
    return votes.groupBy(key).agg(F.round(F.avg("score"), 3).alias("score"), _most_common("status").alias("status"), _most_common("type").alias("type"), F.array_join(F.sort_array(F.collect_set("reason")), " / ").alias("reason"))


def judged(segments: DataFrame, judge, judges: int = 5) -> DataFrame:
    """segment columns with judge, score, status, type, reason: judge(list of texts, judge's number) -> list of dicts, called for batches on the executors."""
    names = segments.columns

    def work(frames):
        for f in frames:
            for n in range(judges):
                out = f[names].copy()
                votes = judge(f["text"].tolist(), n)
                out["judge"] = n
                for k in ("score", "status", "type", "reason"):
                    out[k] = [v.get(k, "natural" if k == "type" else None) for v in votes]
                yield out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return segments.mapInPandas(work, f"{ddl}, judge int, score double, status string, type string, reason string")


def heuristic_judge(texts: list[str], judge: int) -> list[dict]:
    """A judge without a model: the share of letters and spaces."""
    out = []
    for t in texts:
        share = sum(c.isalpha() or c.isspace() for c in t) / max(1, len(t))
        out.append({"score": round(share, 3), "status": "keep" if share >= THRESHOLD else "discard", "type": "natural" if share > 0.9 else "mixed", "reason": f"letters {share:.2f}"})
    return out


def judge_all(segments: DataFrame, key: str, judge, judges: int = 5, retries: int = 3, below: float = DISCARD_BELOW, threshold: float = THRESHOLD) -> DataFrame:
    """key, score, type, status, reason of each segment (key, text): filtered ones are discarded with 0.1 unseen; the others get their votes,
    a batch that fails is asked again; low votes are discards; votes make a consensus. What keeps failing is a vote of 0 that tells its error."""

    def stubborn(texts: list[str], number: int) -> list[dict]:
        fault: Exception | None = None
        for _ in range(retries):
            try:
                return judge(texts, number)
            except Exception as e:  # asked again
                fault = e
        if len(texts) > 1:  # one text's fault is not its neighbours'
            return [v for t in texts for v in stubborn([t], number)]
        return [{"score": 0.0, "status": "discard", "type": "natural", "reason": f"error: {fault}"}]

    rows = segments.select(key, "text").where("text IS NOT NULL")
    out = rows.where(filtered(F.col("text"))).select(key, F.lit(0.1).alias("score"), F.lit("natural").alias("type"), F.lit("discard").alias("status"), F.lit("filtered").alias("reason"))
    votes = thresholded(judged(rows.where(~filtered(F.col("text"))), stubborn, judges), below)
    return consensus(votes, key, threshold).unionByName(out)
