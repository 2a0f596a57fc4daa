"""Mixing sources to target weights by distributed prefix sums over hash-random keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_rank
from tidemark.llm.common import WORD, materialise, words


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source_rank, source, n, source_size, target): weights repeat over the sources by code point, null last.

    Water-filling: a target stops at cap times its source's size and the excess is shared again by weight.
    Each round is one aggregate over the sources' own totals; the driver sees two sums, never the sources.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = with_rank(totals, [F.col("source").isNull(), F.col("source")], "source_rank", materialise)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    size, total_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (size or 0)
    level = budget / total_weight if total_weight else 0.0
    while True:
        over = F.col("most") <= F.lit(float(level)) * F.col("weight")
        capped, rest = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        new = (budget - capped) / rest if rest else level
        if new <= level:
            break
        level = new
    share_of = F.lit(float(level)) * F.col("weight")
    return ranked.withColumn("target", F.when(F.col("most") <= share_of, F.col("most").cast("double")).otherwise(share_of)).drop("weight", "most")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, text, source; other columns are ignored. Returns doc_id, size, source, source_size, target, taken,
    one row per input row. Keys are the MD5 of seed and doc_id. Within a source, documents are range-sorted by key
    into about sqrt(n) key ranges of about sqrt(n) documents; totals of the ranges and prefix sums inside each give
    every document's position, so no task holds a source. The source's whole epochs take every document; the rest of
    the budget cuts at the exact word, so the last document may be taken in part.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null doc_id: key of the empty id.
    Repeated rows: each counts. Ties in key: by doc_id, then size. Empty table: empty result.
    """
    return _taken(docs.select("doc_id", "source", "text"), weights, share, cap, seed).select("doc_id", "size", "source", "source_size", "target", "taken")


def _taken(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix", also: tuple[str, ...] = ()) -> DataFrame:
    """See mix; docs has the columns doc_id, source, text and those of `also`, which are kept."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialise(docs.select("doc_id", "source", *also, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")), "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, cap), "mix-targets")
    ranges = F.ceil(F.sqrt("n"))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * ranges)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(sized["source"]).withColumn("range", at)
    starts = rows.groupBy("source_rank", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source_rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source_rank", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source_rank", "range").orderBy("key", "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_rank", "range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.withColumn("taken", taken.cast("long"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, with docs' own columns: each row as often as whole epochs take it, and once more, cut
    to the words the budget still reaches, where it is taken in part. Rows of which nothing is taken go, but rows
    without words stay once, as they cost nothing.

    The rows are numbered and kept, and each is judged by its number, so that repeated and null ids are rows like others and a source's budget
    is met exactly; equal rows are taken in the order of their numbers. Other columns may have any name.
    """
    numbered = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "mix-rows")
    taken = _taken(numbered.select("row.doc_id", "row.source", "row.text", "number"), also=("number",), **how).select("number", "taken", "size")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size")))
    rows = numbered.join(taken, "number").filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    reach, whole = F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("row.text")
    cut = F.concat_ws(" ", F.slice(words(whole), F.lit(1), F.greatest(reach, F.lit(0)).cast("int")))
    partial = (F.col("size") > 0) & (reach < F.col("size"))
    out = {"text": F.when(partial, cut).otherwise(whole)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(partial, F.length(cut).cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[(out[c] if c in out else F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::varchar, '')) AS key FROM documents),
totals AS (SELECT source, sum(size)::bigint AS source_size, count(*) AS n FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM totals),
ordered AS (SELECT *, sum(2 * source_size) OVER w AS capped, sum(weight) OVER w AS used, sum(source_size) OVER () AS every, sum(weight) OVER () AS weights,
  lead(2.0 * source_size / weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS next_ratio FROM ranked
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
levels AS (SELECT (1.5 * max(every)::double) / max(weights)::double AS level, min(2.0 * source_size / weight) AS next_ratio, 0 AS used FROM ordered
  UNION ALL SELECT (1.5 * every::double - capped::double) / (weights - used)::double, next_ratio, used FROM ordered WHERE weights > used),
level AS (SELECT arg_min(level, used) AS level FROM levels WHERE next_ratio > level),
targets AS (SELECT source, source_size, CASE WHEN 2 * source_size <= level * weight THEN (2 * source_size)::double ELSE level * weight END AS target FROM ranked, level),
placed AS (SELECT s.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::bigint AS size, source, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::bigint // source_size * size + greatest(0, least(size, floor(target)::bigint % source_size - start)) END)::bigint AS taken
FROM placed
"""
