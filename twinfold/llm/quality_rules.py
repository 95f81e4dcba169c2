"""Quality rules with host verdicts, in DataFrame functions alone.

Each text is measured in its own row: no word or line leaves the row, so nothing but a few numbers is shuffled. The
failures of each rule are summed by host (documents.source), a host's failure rate in a rule is shrunk towards a beta
prior whose two parameters are fitted to all hosts' rates in that rule by moments, and the verdict on the host, which
falls with any of its rates, is joined back to its documents. Two rules fail a document by themselves; the others speak
through the host alone. A hot host is one row in the summed table; the join back is left to the planner, which may
broadcast the table if its measured size is small and splits a skewed partition otherwise.

Defined results: a null text has no words, so it fails; a null source is a host of its own; repeated rows are each
judged and each counted; an empty table gives an empty result; other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, words

#: A document needs so many words; repeats may cover such a share of its words, symbols come to such a share of them and
#: lines repeat such a share of all lines; a host fails from such a shrunk rate on.
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT, HOST_RATE = 50, 50, 10, 30, 0.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(tokens: Column, span: int = 3) -> Column:
    """Words that lie in windows of ``span`` words found twice or more, the first finding included.

    Candidates come from one sort of hashes with positions in their low bits; windows are then compared as text.
    """

    def count(w: Column) -> Column:
        low = F.lit(1 << 28)  # positions within a text
        key = lambda i: F.shiftleft(F.shiftright(F.xxhash64(*(w[i + k] for k in range(span))), 28), 28) + i
        same = lambda s, i: ((i > 0) & (F.shiftright(s[i], 28) == F.shiftright(s[F.greatest(i - 1, F.lit(0))], 28))) | (F.shiftright(s[i], 28) == F.shiftright(F.get(s, i + 1), 28))
        sorted_keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - span), lambda i: key(i.cast("long"))))
        near = let(sorted_keys, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i), F.pmod(x, low).cast("int"))), lambda p: p.isNotNull()))
        exact = F.sort_array(F.transform(near, lambda p: F.struct(*(w[p + k].alias(f"w{k}") for k in range(span)), p.alias("p"))))
        equal = lambda a, b: F.coalesce(F.reduce(F.array(*(a[f"w{k}"] == b[f"w{k}"] for k in range(span))), F.lit(True), lambda x, y: x & y), F.lit(False))
        found = let(exact, lambda s: F.filter(F.transform(s, lambda x, i: F.when(((i > 0) & equal(x, s[F.greatest(i - 1, F.lit(0))])) | equal(x, F.get(s, i + 1)), x["p"])), lambda p: p.isNotNull()))
        covered = F.reduce(F.sort_array(found), F.struct(F.lit(-span).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(span))).alias("n")))
        return covered["n"]

    return F.when(F.size(tokens) > span, let(tokens, count)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", text.alias("text")).withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    measured = base.select(
        "doc_id",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return measured.select("*", F.col("lines.all").alias("n_lines"), F.col("lines.repeated").alias("n_dup_lines")).drop("lines")


def rules() -> dict[str, Column]:
    """Name and failure condition of each rule; those in ``BASE`` fail a document by themselves."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * F.col("n_lines"),
    }


BASE = ("short", "repeats")


def host_rates(measured: DataFrame) -> DataFrame:
    """source, docs and, for each rule, failures and rate_: the failure rate shrunk by an empirical beta prior.

    A prior's mean is the failure rate of all documents and its strength comes from the spread of the hosts' rates
    (weighted by documents, less what sampling alone would give); hosts that do not differ get one common rate.
    """
    hosts = cut(measured.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(failed.cast("long")).alias(name) for name, failed in rules().items())))
    sums = [f for name in rules() for f in (F.sum(name).alias(f"f_{name}"), F.sum(F.col(name) * F.col(name) / F.col("docs")).alias(f"ff_{name}"))]
    total = hosts.agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("h"), F.sum(F.col("docs").cast("double") * F.col("docs")).alias("nn"), *sums)
    priors = []
    for name in rules():
        f, ff = F.col(f"f_{name}"), F.col(f"ff_{name}")
        mean, between = f / F.col("n"), ff - f * f / F.col("n")
        within = mean * (1 - mean)
        # Expectation of ``between`` is within * (h - 1) plus the hosts' variance times (n - nn / n) less their share of it.
        variance = (between - within * (F.col("h") - 1)) / F.nullif(F.col("n") - F.col("nn") / F.col("n") - (F.col("h") - 1), F.lit(0.0))
        strength = F.when((variance > 0) & (within > variance), within / variance - 1).when(variance >= within, F.lit(1e-3)).otherwise(F.lit(1e6))
        priors += [F.coalesce(mean, F.lit(0.0)).alias(f"mean_{name}"), F.coalesce(strength, F.lit(1e6)).alias(f"strength_{name}")]
    row = total.select(*priors).first()
    return hosts.withColumns({f"rate_{name}": (F.lit(row[f"mean_{name}"] * row[f"strength_{name}"]) + F.col(name)) / (F.lit(row[f"strength_{name}"]) + F.col("docs")) for name in rules()})


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, host rate (the highest of its rules) and final verdict of every document."""
    failed = F.lit(False)
    for name in BASE:
        failed = failed | rules()[name]
    measured = cut(measure(docs).withColumn("base_failed", failed))
    hosts = host_rates(measured).select(F.col("source").alias("_host"), F.greatest(*(f"rate_{name}" for name in rules())).alias("host_rate"))
    joined = measured.join(hosts, measured["source"].eqNullSafe(hosts["_host"]), "left")
    return joined.select(*measured.columns, "host_rate", (~F.col("base_failed") & (F.col("host_rate") < HOST_RATE)).alias("kept"))
