"""Quality rules of documents, and verdicts on their hosts from failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, spread_join
from tidemark.llm.tokens import WORD_BYTES, Texts, by_bytes, codes, strings

#: Bytes of text that a task takes at once.
PIECE = 4 << 20
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: The rules that decide on a document by itself; all of them count for its host.
BASE = ("short", "repetitive")


def _rules() -> dict[str, Column]:
    """Rules by name; true where a document fails."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (n > 0) & ((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n)),
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def repeated_words(word: np.ndarray, distinct: int, of: np.ndarray, texts: int) -> np.ndarray:
    """How many words of each text lie in a window of three words that the text has twice or more."""
    whole = of[2:] == of[:-2]
    first, second, third = word[:-2][whole], word[1:-1][whole], word[2:][whole]
    pair = np.unique(first * distinct + second, return_inverse=True)[1] if distinct >= 1 << 21 else first * distinct + second
    name, text, at = pair * distinct + third, of[:-2][whole], np.flatnonzero(whole)
    order = np.lexsort((name, text))
    same = (name[order][1:] == name[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = at[order][np.r_[same, False][: len(order)] | np.r_[False, same][: len(order)]]
    covered = np.zeros(len(word), bool)
    for i in range(3):
        covered[twice + i] = True
    return np.bincount(of[covered], minlength=texts)


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each whole text."""
    texts = Texts.of(column)
    raw, n = texts.raw, len(texts.starts) - 1
    inside = WORD_BYTES[raw]
    found, of = texts.runs(WORD_BYTES)
    word, distinct = codes(found)
    plain = raw != 0x0A
    starts = np.sort(np.r_[texts.starts[:-1], np.flatnonzero(~plain) + 1])  # the last of equal places is the one with text
    before, letters = np.r_[0, np.cumsum(plain)], np.r_[0, np.cumsum(inside)]
    full = letters[np.r_[starts[1:], len(raw)]] > letters[starts] if n else np.zeros(0, bool)
    line, kinds = codes(strings(raw[plain], before[starts]).filter(pa.array(full)))
    owner = texts.owner(starts[full])
    n_lines = np.bincount(owner, minlength=n)
    return {
        "n_words": np.bincount(of, minlength=n), "word_chars": texts.totals(inside & ((raw & 0xC0) != 0x80)), "n_symbols": texts.totals(_SYMBOL[raw]), "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(np.unique(owner * max(1, kinds) + line) // max(1, kinds), minlength=n), "n_repeat_words": repeated_words(word, distinct, of, n),
    }


def counted(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and COUNTS of each row of docs."""
    kind = dict(docs.dtypes)

    def run(batches):
        for b in by_bytes(batches, "text", PIECE):
            told = counts_of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *(pa.array(told[c], pa.int64()) for c in COUNTS)], ["doc_id", "host", *COUNTS])

    rows = docs.select("doc_id", F.col(f"`{host}`").alias("host"), "text")
    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, host {kind[host]}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Prior:
    """A beta prior of a failure rate."""

    mean: float
    strength: float  # alpha + beta

    def shrunk(self, failures: Column, n: Column) -> Column:
        return (failures + F.lit(self.mean * self.strength)) / (n + F.lit(self.strength))


def prior(failures: int, n: int, hosts: int, squares: float, sizes: float, least: float = 1e-6) -> Prior:
    """The beta prior whose mean and between-host variance match the hosts' rates, by moments of the beta-binomial.

    squares: sum of failures^2 / n over hosts; sizes: sum of n^2. The overdispersion is kept within [least, 1 - least]: hosts that vary
    no more than chance explains are drawn to the mean.
    """
    if not n:
        return Prior(0.0, 1.0)
    mean = failures / n
    noise, spread = mean * (1 - mean), squares - failures * mean
    room = noise * (n - sizes / n - (hosts - 1))
    phi = (spread - noise * (hosts - 1)) / room if room > 0 else least
    phi = min(max(phi, least), 1 - least)
    return Prior(mean, 1 / phi - 1)


def host_verdicts(rows: DataFrame, most: float = 0.5) -> DataFrame:
    """host, n, a shrunk failure rate `rate_<rule>` for each rule, and host_failed: whether one of them is above `most`.

    rows: host and COUNTS. Failures are summed by host, with partial sums, so a hot host is no single task's work. A null host is a
    host of its own. Only one row of sums reaches the driver for each rule's prior.
    """
    rules = _rules()
    by_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(fails).alias(r) for r, fails in rules.items()])
    by_host = materialise(by_host, "rules-hosts")
    moments = [x for r in rules for x in (F.coalesce(F.sum(r), F.lit(0)).alias(r), F.coalesce(F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")), F.lit(0.0)).alias(f"{r}_squares"))]
    every = by_host.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("sizes"), *moments).first()
    rates = {f"rate_{r}": prior(every[r], every["n"], every["hosts"], every[f"{r}_squares"], every["sizes"]).shrunk(F.col(r), F.col("n")) for r in rules}
    return by_host.withColumns(rates).withColumn("host_failed", F.greatest(*rates) > most).drop(*rules)


def judge(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """Judge each document by two rules of its own and by its host's verdict.

    docs: doc_id, text and the host's column; other columns are ignored. Returns a row for each row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, and n_lines (lines with a word), host_failed. A document fails by itself below
    50 words or with more than half its words in repeated windows of three; its host fails if a rule's failure rate, shrunk by the prior
    fitted over all hosts, is above `most`. kept: neither failed.

    Texts are counted whole, some megabytes at a time; one text takes about 60 bytes of memory a byte. Null text: as an empty one, short. Null
    host: a host like others. Null and repeated doc_ids, repeated rows: each row is judged and counts for its host. Empty table:
    empty result.
    """
    rows = materialise(counted(docs, host).withColumns({"host_null": F.col("host").isNull()}), "rules-counts")
    verdicts = host_verdicts(rows, most).select(F.col("host").isNull().alias("host_null"), "host", "n", "host_failed")
    total = rows.count()
    known = F.coalesce(F.col("host").cast("string"), F.lit(""))
    joined = spread_join(rows.withColumn("host", known), verdicts.withColumn("host", known), ["host", "host_null"], "n", total)
    own = F.lit(False)
    for r in BASE:
        own = own | _rules()[r]
    shown = [c for c in COUNTS if c != "n_lines"]
    return joined.select("doc_id", *shown, own.alias("base_failed"), (~own & ~F.col("host_failed")).alias("kept"), "n_lines", "host_failed")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
c AS (SELECT d.k, d.doc_id, d.source, len(ws)::bigint AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_dup, 0)::bigint AS n_dup_lines, coalesce(covered.n, 0)::bigint AS n_repeat_words
  FROM d JOIN w ON d.k = w.k LEFT JOIN covered ON d.k = covered.k LEFT JOIN lines ON d.k = lines.k),
failed AS (SELECT k, source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, n_words > 0 AND NOT word_chars BETWEEN 3 * n_words AND 10 * n_words, 10 * n_symbols > n_words,
    10 * n_dup_lines > 3 * n_lines]) AS fails, unnest([1, 2, 3, 4, 5]) AS rule FROM c),
hosts AS (SELECT source, rule, count(*) AS n, count_if(fails) AS f FROM failed GROUP BY source, rule),
sums AS (SELECT rule, sum(f)::double AS f, sum(n)::double AS n, count(*)::double AS h, sum(f::double * f / n) AS squares, sum(n::double * n) AS sizes FROM hosts GROUP BY rule),
moments AS (SELECT rule, f / n AS mean, (f / n) * (1 - f / n) AS noise, squares - f * (f / n) AS spread, (f / n) * (1 - f / n) * (n - sizes / n - (h - 1)) AS room, h FROM sums),
priors AS (SELECT rule, mean, 1 / least(greatest(CASE WHEN room > 0 THEN (spread - noise * (h - 1)) / room ELSE 1e-6 END, 1e-6), 1 - 1e-6) - 1 AS strength FROM moments),
verdicts AS (SELECT source, bool_or((f + mean * strength) / (n + strength) > 0.5) AS host_failed FROM hosts JOIN priors USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept, n_lines, host_failed
FROM c JOIN verdicts ON c.source IS NOT DISTINCT FROM verdicts.source
"""
