"""Quality rules (operator 3) with risk-controlled thresholds; DataFrame functions only.

Every rule is a statistic of a text that is high for bad texts. The labelled good texts
of a stratum are its holdout. For a candidate cutoff of a rule the number of good texts
above it is a binomial count, and its exact (Clopper-Pearson) upper bound says what share of
good texts the cutoff may reject at most. A cutoff is allowed only if that bound stays under the rule's share of the permitted risk.

The candidates of a rule in a stratum are tested in a fixed sequence, from lenient to strict,
each at the full error of that sequence, and the first that fails ends it; so only the number
of sequences (rules x strata) divides the error, and the chance of any false claim is at
most ``ERROR``. Only texts that pass the base rules are counted: the others go anyway, and
would make the shares look smaller than they are among the texts that the cutoffs judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import written

#: White space of the contract: space and U+0009 to U+000D.
SPACE = "[ \\t\\n\\u000B\\f\\r]+"
SYMBOLS = "[^#*$%&|<>]+"
#: Words in a repeated window.
WINDOW = 8
#: Good texts of a stratum that may be rejected by all rules together, and the error of that claim.
RISK, ERROR = 0.05, 0.05
#: Candidate cutoffs of each rule, from strict to lenient (fixed before labels are seen).
CANDIDATES = {
    "symbol_ratio": (0.05, 0.1, 0.2),
    "dup_line_ratio": (0.1, 0.25, 0.5),
    "repeat_ratio": (0.05, 0.1, 0.2),
    "long_word_ratio": (0.02, 0.05, 0.1),
    "upper_ratio": (0.3, 0.5, 0.8),
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def repeated_words(words: Column) -> Column:
    """Words that stand in an 8-word window which the text has twice or more.

    Windows are compared by the hash of their words' hashes. Only texts with a repeated
    window sort theirs: neighbours with equal hashes give the places, and each place adds
    the words up to the next one, 8 at most.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words) - (WINDOW - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def counted(h: Column) -> Column:
        windows = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

        def of(w: Column) -> Column:
            pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def repeated(s: Column) -> Column:
                same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
                at = F.sort_array(F.transform(same, lambda x: x["i"]))
                return _with(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

            return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_with(pairs, repeated))

        return _with(windows, of)

    return F.coalesce(_with(hashes, counted), F.lit(0)).cast("long")


def _with(value: Column, f) -> Column:
    """f(value) with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the contract's counts and the rules' statistics to each row; no shuffle.

    A null text has no words and counts of 0. Adds n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, the columns of CANDIDATES and base_failed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    words = F.col("_words")
    df = df.withColumn("_glued", F.array_join(words, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    df = df.withColumn("_lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length("_glued").cast("long"),
            "n_symbols": F.length(F.regexp_replace("_glued", SYMBOLS, "")).cast("long"),
            "_n_lines": F.size("_lines"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(words),
            "_letters": F.length(F.regexp_replace("_glued", "[^A-Za-z]+", "")),
            "_upper": F.length(F.regexp_replace("_glued", "[^A-Z]+", "")),
            "_long": F.size(F.filter(words, lambda w: F.length(w) > 30)),
        }
    )
    return df.withColumns(
        {
            "symbol_ratio": _share(F.col("n_symbols"), F.col("word_chars")),
            "dup_line_ratio": _share(F.col("n_dup_lines"), F.col("_n_lines")),
            "repeat_ratio": _share(F.col("n_repeat_words"), F.col("n_words")),
            "long_word_ratio": _share(F.col("_long"), F.col("n_words")),
            "upper_ratio": _share(F.col("_upper"), F.col("_letters")),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    ).drop("_words", "_glued", "_lines", "_n_lines", "_letters", "_upper", "_long")


STRATA = 3


def stratum(n_words: str = "n_words") -> Column:
    """Strata by length: statistics of short texts scatter more."""
    n = F.col(n_words)
    return F.when(n < 150, "short").when(n < 500, "medium").otherwise("long")


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 10, brought down by the product of the ten factors between."""
    z = x + 10.0
    series = (z + 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    for i in range(1, 11):
        series = series - F.log(x + i)
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial with k <= n p, to double precision, from its largest term down.

    A term follows from the one above by i / (n - i + 1) * (1 - p) / p, at most 1 here. Terms that
    lie forty times the root of k below are under e^-700 of the first, so as many are summed.
    """
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 * F.sqrt(k)) + 50).cast("int")
    odds = F.lit((1 - p) / p)
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) / (n - k + j + 1) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return first * F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), state, add, lambda acc: acc["total"])).otherwise(1.0)


def thresholds(labelled: DataFrame, good_col: str = "quality", stratum_col: str = "stratum", candidates=None, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, tail): the strictest certified cutoff of each rule.

    The upper confidence bound of the rejected share is at most p exactly if P(X <= k) for
    that p is at most the error, so the test needs no search for the bound. ``risk`` is split
    over the rules and ``error`` over the sequences of tests. A stricter cutoff rejects more, so
    its tail is larger: the strictest with a small tail is the last of its sequence to hold. A stratum
    in which no candidate of a rule is certified (too few good labels) has no row for it: the
    rule is off there. Rows with ``base_failed`` are not counted.
    """
    candidates = candidates or CANDIDATES
    p = risk / len(candidates)
    alpha = error / (STRATA * len(candidates))
    good = labelled.where(F.col(good_col) == 1)
    if "base_failed" in labelled.columns:
        good = good.where(~F.col("base_failed"))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).cast("long").alias("hit")) for r, cs in candidates.items() for c in cs])
    counted = good.select(F.col(stratum_col).alias("stratum"), F.explode(tests).alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(F.count("*").alias("n_good"), F.sum("t.hit").alias("n_rejected"))
    # beyond the expected number no bound can hold: those are dropped before the sum is made
    able = counted.where(F.col("n_rejected") <= F.col("n_good") * p).withColumn("tail", binomial_tail(F.col("n_good"), F.col("n_rejected"), p))
    return able.where(F.col("tail") <= alpha).groupBy("stratum", "rule").agg(F.min_by(F.struct("cutoff", "n_good", "n_rejected", "tail"), "cutoff").alias("t")).select("stratum", "rule", "t.*")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``failed_rules`` and ``kept``: no failed base rule and no certified cutoff exceeded.

    ``cutoffs`` has at most one row per stratum and rule, 3 x 5, so it is broadcast.
    """
    maps = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    df = measured.withColumn("stratum", stratum()).join(F.broadcast(maps), "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col("_cutoffs")[r], r) for r in CANDIDATES]))
    df = df.withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cutoffs")


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality") -> DataFrame:
    """Measure every text, certify cutoffs on the labelled ones and judge all.

    Rows without a label are judged like the others, texts of any length whole. Null texts fail
    the base rules; an empty table gives no rows; columns beside id and text are not read. Rows
    that repeat are judged one by one; labels that repeat are counted once (the lowest). With
    no good labels no cutoff is certified and only the base rules reject.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lab = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(good_col).alias("quality"))
    # each text is measured once; a few numbers a row, not the texts, meet the labels
    measured = written(measure(docs).drop("text"), "measured")
    held = measured.join(lab, "doc_id").dropDuplicates().withColumn("stratum", stratum())
    return judge(measured, thresholds(held))
