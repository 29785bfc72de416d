"""Quality rules whose cutoffs are certified on labelled documents, with DataFrame functions only.

Each rule rejects a document whose score reaches its stratum's cutoff. Cutoffs come from a fixed
grid. A cutoff counts as certified if, among the labelled good documents of the stratum that pass the
base rules, so few reach it that a true false-rejection rate of ``risk`` / number of rules would
show so few with a probability of at most ``error`` / number of tests (exact binomial tail, Bonferroni
over strata, rules and cutoffs). The lowest certified cutoff is used; a rule without one rejects
nothing there. So with probability 1 - ``error`` no stratum loses more than ``risk`` of its good
documents to the rules. Null strata are one stratum; null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.session import settle_table

SPACES = r"[\x20\x09-\x0D]+"
NGRAM = 5
RISK, ERROR = 0.05, 0.05
#: Strata up to which the cutoffs are sent to every task; beyond, they are joined by shuffle.
SENT_STRATA = 10_000

#: rule: (score, cutoffs). A document is rejected from the cutoff on.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [0.1, 0.2, 0.3, 0.5, 0.8]),
    "repeats": ("n_repeat_words / n_words", [0.05, 0.1, 0.15]),
    "dup_lines": ("n_dup_lines / n_words", [0.01, 0.02, 0.05, 0.1]),
    "shouts": ("n_shouts / n_words", [0.1, 0.2, 0.5, 1.0]),
    "long_words": ("word_chars / n_words", [6.5, 7.0, 8.0, 10.0, 15.0]),
}


def _repeat_words(h: Column) -> Column:
    """Words in windows of ``NGRAM`` found twice or more, from the hash of each window."""
    by_hash = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["v"] == F.get(s, k - 1)["v"]) | (x["v"] == F.get(s, k + 1)["v"]))
        return F.transform(twice, lambda x: x["i"])

    # A one-element array holds the sorted windows, so that they are sorted once.
    places = F.array_sort(F.flatten(F.transform(F.array(by_hash), covered)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("last"))
    walk = F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(NGRAM), p - s["last"])).alias("n"), p.alias("last")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), walk["n"]).otherwise(F.lit(0))


def measure(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``row`` (struct of the carried columns), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_shouts, base_failed for every whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.struct(*carry).alias("row"), t.alias("t"), F.array_remove(F.split(t, SPACES, -1), "").alias("w"))

    def without(chars: str) -> Column:
        return F.octet_length("t") - F.octet_length(F.regexp_replace("t", chars, ""))

    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select(
        "row", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"), (F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    grams = F.when(F.size("h") >= NGRAM, F.transform(
        F.sequence(F.lit(0), F.size("h") - NGRAM), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(NGRAM)]))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("g", grams)
    out = step.select(
        "row", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("g")).cast("long").alias("n_repeat_words"), "n_shouts")
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 20 on."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p); 1 where k is at or above the mean. Terms are added from k
    downwards, each from the one before, until they cannot matter (ten deviations and more)."""
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(10 * F.sqrt(n * p) + 50)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * F.aggregate(steps, start, add)["total"])


def certified(measured: DataFrame, stratum: str, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum: its name and, for each rule, the lowest certified cutoff or null.
    ``measured`` has doc_id, the stratum and the measures; ``labels`` has doc_id, quality."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    tests = [(r, c) for r, (_, cuts) in RULES.items() for c in cuts]
    held = measured.where("NOT base_failed").join(good, "doc_id")
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"), *[F.count_if(F.expr(RULES[r][0]) >= c).alias(f"k{i}") for i, (r, c) in enumerate(tests)])
    strata = measured.select(F.col(stratum).alias("stratum")).distinct()
    total = F.greatest(F.lit(1), F.lit(strata.count())) * len(tests)
    share = risk / len(RULES)

    def lowest(rule: str) -> Column:
        ok = [F.when(binomial_tail(F.col(f"k{i}"), F.col("n"), share) <= error / total, F.lit(c)) for i, (r, c) in enumerate(tests) if r == rule]
        return F.array_min(F.array(*ok)).alias(f"cut_{rule}")

    return counts.select("stratum", *[lowest(r) for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, carry: list[str], stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Measures and ``kept`` of every row of ``docs``, with ``row`` (the carried columns). The
    measures are written to the shared folder once: the cutoffs need all of them first."""
    own = docs.select(F.struct(*carry).alias("row"), "doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    measured = measure(own, ["row", "doc_id", "stratum"])
    measured = settle_table(measured.select("row.row", "row.doc_id", "row.stratum", *measured.columns[1:]), "measures")
    # A few numbers per stratum: written, counted, and sent only if few.
    cuts = settle_table(certified(measured.drop("row"), "stratum", labels, risk, error), "cutoffs")
    cuts = F.broadcast(cuts) if cuts.count() <= SENT_STRATA else cuts
    judged = measured.join(cuts, "stratum", "left")
    rejected = [F.coalesce(F.expr(score) >= F.col(f"cut_{r}"), F.lit(False)) for r, (score, _) in RULES.items()]
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.when(F.col("base_failed"), F.lit(False)).otherwise(reduce(lambda a, b: a | b, rejected))).drop(
        *[f"cut_{r}" for r in RULES])


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row."""
    return judge(docs, labels, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_shouts")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return judge(docs, labels, docs.columns).where("kept").select("row.*")
