"""Quality rules of documents, and of the hosts that they come from.

Every document is measured on its whole text.  Base rules fail a document alone: fewer
than 50 words, or over 50 % of its words in 3-word windows that the text holds twice or
more.  Further rules (symbols, repeated lines, word length) count towards its host:
failures of each rule are summed by host, and a host's rate is shrunk by a beta prior
fitted to all hosts' rates (method of moments), so that a host with few documents isn't
judged by them alone.  A host fails if a rule's shrunk rate exceeds the rule's limit;
its verdict is joined back, and ``kept`` is false for base failures and failed hosts.

Words are ``[^\\x20\\x09-\\x0D]+``.  Only DataFrame and SQL functions.  A null text has no
words; a null host is a host of its own; empty table: no rows.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rules:
    """Document limits, and the greatest shrunk rate of failures that a host may have, by rule."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 10  # symbols by 100 words
    dup_line_percent: int = 30  # repeated lines by 100 lines
    word_chars: tuple[float, float] = (2.0, 12.0)  # mean word length
    host_limits: tuple[tuple[str, float], ...] = (("base", 0.6), ("symbols", 0.5), ("lines", 0.5), ("length", 0.5))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), one row per document."""
    # no text is held twice: lists of words become hashes at once, and hashes (hash, place) in order
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", "host", "text", F.expr(f"filter(split(text, r'{SPACE}+'), w -> w <> '')").alias("w"), F.expr(f"filter(split(text, r'\\n'), l -> l RLIKE r'[^\\x20\\x09-\\x0D]')").alias("lines"))
    df = df.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), F.char_length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # windows of three words by place, sorted by hash; a window recurs if a neighbour in that order is equal
    windows = F.when(F.size("h") >= 3, F.expr("sort_array(transform(slice(h, 1, size(h) - 2), (x, i) -> struct(xxhash64(x, h[i + 1], h[i + 2]) AS k, i AS i)))"))
    df = df.withColumn("g", windows)
    again = "array_sort(transform(filter(g, (x, j) -> (j > 0 AND g[greatest(j - 1, 0)].k = x.k) OR (j + 1 < size(g) AND g[least(j + 1, size(g) - 1)].k = x.k)), x -> x.i))"
    df = df.withColumn("p", F.expr(again))
    covered = "aggregate(p, named_struct('n', 0L, 'last', -3), (s, i) -> named_struct('n', s.n + least(3, i - s.last), 'last', i), s -> s.n)"
    return df.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def failures(m: DataFrame, rules: Rules) -> DataFrame:
    """Adds a boolean fail_<rule> for each rule."""
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return m.withColumns({
        "fail_base": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")),
        "fail_symbols": 100 * F.col("n_symbols") > rules.symbol_percent * F.col("n_words"),
        "fail_lines": 100 * F.col("n_dup_lines") > rules.dup_line_percent * F.col("n_lines"),
        "fail_length": (F.col("n_words") > 0) & ((mean < rules.word_chars[0]) | (mean > rules.word_chars[1])),
    })


def host_verdicts(failed: DataFrame, rules: Rules) -> DataFrame:
    """(host, n, rate_<rule>, host_failed): rates shrunk by a beta prior fitted to all hosts."""
    names = [r for r, _ in rules.host_limits]
    hosts = failed.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in names])
    hosts = c.stored(hosts, "hosts")
    rate = lambda r: F.col(f"k_{r}") / F.col("n")
    prior = hosts.agg(*[x for r in names for x in ((F.sum(f"k_{r}") / F.sum("n")).alias(f"m_{r}"), F.coalesce(F.var_pop(rate(r)), F.lit(0.0)).alias(f"v_{r}"))], F.avg(1 / F.col("n")).alias("inv"))
    row = prior.first()  # one row of moments
    out = hosts
    for r, _ in rules.host_limits:
        mean, var = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        spread = mean * (1 - mean)
        # variance between hosts beyond what binomial counts alone give; its inverse is the prior's strength
        between = max(var - spread * (row["inv"] or 0.0), 1e-4 * max(spread, 1e-9), 1e-12)
        strength = min(max(spread / between - 1, 1.0), 1000.0) if spread > 0 else 1.0
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + mean * strength) / (F.col("n") + strength))
    over = F.lit(False)
    for r, limit in rules.host_limits:
        over = over | (F.col(f"rate_{r}") > limit)
    return out.select("host", "n", *[f"rate_{r}" for r in names], over.alias("host_failed"))


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """All measures, failures, the host's verdict and ``kept`` of each document."""
    m = failures(c.stored(measured(docs, id_col, text_col, host_col), "measures"), rules)
    verdicts = host_verdicts(m, rules)
    return c.heavy_join(m, verdicts.select("host", "n", "host_failed"), ["host"], "n", m.count()).drop("n").withColumn("kept", ~F.col("fail_base") & ~F.col("host_failed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("fail_base").alias("base_failed"), "kept")


ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM doc, unnest(range(1, len(w) - 1)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM again, unnest([i, i + 1, i + 2]) AS t(p) GROUP BY r),
m AS (SELECT r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM doc LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 10 * n_words AS f2, 100 * n_dup_lines > 30 * n_lines AS f3,
    n_words > 0 AND (word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 12) AS f4 FROM m),
h AS (SELECT host, rule, lim, count(*) AS n, sum(CAST(bad AS INT)) AS k FROM (SELECT host, unnest([f1, f2, f3, f4]) AS bad, unnest([1, 2, 3, 4]) AS rule, unnest([0.6, 0.5, 0.5, 0.5]) AS lim FROM f) GROUP BY ALL),
prior AS (SELECT rule, sum(k) / sum(n) AS mean, var_pop(k / n) AS var, avg(1 / n) AS inv FROM h GROUP BY rule),
strength AS (SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 THEN
    least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-4 * greatest(mean * (1 - mean), 1e-9), 1e-12) - 1, 1), 1000) ELSE 1 END AS s FROM prior),
verdict AS (SELECT host, bool_or((k + mean * s) / (n + s) > lim) AS failed FROM h JOIN strength USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, NOT f1 AND NOT failed AS kept FROM f JOIN verdict USING (host)
"""
