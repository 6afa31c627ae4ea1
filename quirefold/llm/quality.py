"""Quality rules with host-level verdicts (operator 6, DataFrame functions only).

Per document: word, symbol, duplicate-line and repeated-window counts over the whole text, and the base rule. Per
host: the failure rate of its documents is shrunk towards the mean over all documents by a beta prior whose strength
is fitted to the hosts by moments; a host whose shrunk rate exceeds ``max_rate`` is rejected with all its documents.

Plan: the texts are read once; the counts (a few dozen bytes a document) are written to the shared folder, because
both the host sums and the final rows need them. Host sums are partially aggregated before the shuffle, so a hot
host costs one row per task; verdicts are joined back by host, where only the rejected hosts are sent.

Windows of eight words are compared by a 64-bit hash of eight 64-bit word hashes within one document.

Defined results: null text counts as empty (0 everywhere, base_failed); null host: its documents get no host
verdict; empty table: no rows; repeated rows: each counted; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import written

#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, size: int = 8) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more; an array column in, long out."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _let(pairs, lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return _let(at, lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(a, i + 1) - p, F.lit(size)))), F.lit(0).cast("long"), lambda s, x: s + x))

    def count(hashes: Column) -> Column:
        return _let(windows(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), count))


def document_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc key, host, the counts and base_failed, one row per input row, without a shuffle."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_verdicts(rules: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected. The prior's mean and strength come from the moments over hosts."""
    hosts = rules.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    r = F.col("failed") / F.col("n")
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.var_pop(r).alias("spread"),
        F.avg(1 / F.col("n")).alias("noise"),
    ).first()
    if not moments["hosts"]:
        return hosts.select("host", "n", "failed", F.lit(0.0).alias("rate"), F.lit(False).alias("rejected"))
    m = moments["mean"]
    # between-host variance = observed variance of the rates less the binomial noise; strength = m(1-m)/var - 1
    between = max(moments["spread"] - m * (1 - m) * moments["noise"], 1e-6)
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4)
    rate = (F.col("failed") + m * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, host_rejected and kept, one row per input row."""
    rules = written(document_rules(docs, key, text, host), "rules")
    bad = host_verdicts(rules, max_rate).where("rejected").select(F.col("host").alias("bad_host"))
    out = rules.join(bad, rules["host"] == bad["bad_host"], "left")
    rejected = F.col("bad_host").isNotNull()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))
