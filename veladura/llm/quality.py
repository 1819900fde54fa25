"""Quality rules with risk-controlled cutoffs.

Each signal grows as a text gets worse.  For every stratum (language) and every cutoff
of a fixed grid, documents that are labelled good and that the cutoff would reject are
counted on the labelled holdout.  A cutoff may be used if an exact (Clopper-Pearson)
bound says that it rejects at most its share of the stratum's good documents: with k of
n good ones rejected, P(Binomial(n, r) <= k) <= alpha / tests.  The share r is ``RISK``
divided by the number of signals, so all signals together stay below ``RISK`` in every
stratum.  Within a signal the cutoffs are tried from lenient to strict up to the first
that fails, which needs no further correction; ``tests`` is the number of such
sequences, strata times signals (Bonferroni).  Of the cutoffs that pass, the one that
rejects the most bad over good labelled documents is used, and none if no cutoff
rejects more bad ones.  The grid is not fitted to the holdout, so all labelled rows
serve as holdout.

One pass reads the texts and leaves one small row each, which is written to the shared
folder; everything after works on numbers.

Edge cases: a null or empty text has no words and fails the base rules; a null stratum
is a stratum of its own; labels that contradict each other for a document, and null
labels, are ignored; repeated rows are judged like single ones and count once in the
holdout; without labels only the base rules decide; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import cut, map_batches, ship

ship(__name__)

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

#: Signals and their cutoffs, from strict to lenient; a value above the cutoff rejects.
GRID = {
    "symbols_per_char": (0.02, 0.03, 0.05, 0.08, 0.12, 0.2),
    "dup_line_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "repeat_word_share": (0.05, 0.1, 0.15, 0.2, 0.25),
    "bangs_per_word": (0.05, 0.1, 0.2, 0.3, 0.5),
    "upper_share": (0.15, 0.2, 0.3, 0.5, 0.7),
}
RISK, ALPHA = 0.05, 0.05

_COUNTS = (
    "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_bangs n_upper n_cased"
).split()
_SYMBOL_TABLE = np.isin(np.arange(256), list(SYMBOLS))


def _repeated(words: list[bytes]) -> int:
    """Words covered by a window of eight words that the text holds twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # windows of 2, 4, 8 words by numbering pairs of the windows before: exact, no hashing
    level = ids
    for width in (1, 2, 4):
        pairs = level[: len(level) - width] * (n + 1) + level[width:]
        distinct, level = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(level):
            return 0
    twice = np.bincount(level)[level] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``_COUNTS`` of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes, this splits at [\x20\x09-\x0D] only
    blanks = len(data) - sum(map(len, words))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.encode().split():
            lines += 1
            dups += line in seen
            seen.add(line)
    codes = np.frombuffer(data, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    return (
        len(words),
        len(text) - blanks,
        int(_SYMBOL_TABLE[codes].sum()),
        lines,
        dups,
        _repeated(words),
        text.count("!"),
        upper,
        upper + lower,
    )


def quality_counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts of every whole text."""
    given = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    schema = given.select("doc_id", "stratum").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def prepare():
        def run(columns):
            counts = list(zip(*map(text_counts, columns["text"])))
            out = {"doc_id": columns["doc_id"], "stratum": columns["stratum"]}
            return out | dict(zip(_COUNTS, counts or [[]] * len(_COUNTS)))

        return run

    return map_batches(given, fields + "".join(f", {c} bigint" for c in _COUNTS), prepare)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def with_signals(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counts.withColumns(
        {
            "base_failed": failed,
            "symbols_per_char": _share("n_symbols", "word_chars"),
            "dup_line_share": _share("n_dup_lines", "n_lines"),
            "repeat_word_share": _share("n_repeat_words", "n_words"),
            "bangs_per_word": _share("n_bangs", "n_words"),
            "upper_share": _share("n_upper", "n_cased"),
        }
    )


def binomial_tail(k: int, n: int, risk: float) -> float:
    """P(Binomial(n, risk) <= k), exact, summed from the largest term."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(risk), math.log1p(-risk)
    base = math.lgamma(n + 1)
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if i < n * risk and term < total * 1e-17:
            break
    return min(total, 1.0)


def select_cutoffs(
    signals: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA
) -> DataFrame:
    """``stratum, signal, cutoff, n_good, n_rejected, n_caught, p_value`` of the chosen cutoffs."""
    agreed = (
        labels.filter("quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select("doc_id", F.col("low").alias("quality"))
    )
    known = (
        signals.filter(~F.col("base_failed"))
        .select("doc_id", "stratum", *GRID)
        .dropDuplicates(["doc_id"])
        .join(agreed, "doc_id")
    )
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    trials = [(s, c) for s, cs in GRID.items() for c in cs]
    sums = known.groupBy("stratum").agg(
        F.count_if(good).alias("n_good"),
        *[F.count_if(good & (F.col(s) > c)).alias(f"k{i}") for i, (s, c) in enumerate(trials)],
        *[F.count_if(bad & (F.col(s) > c)).alias(f"b{i}") for i, (s, c) in enumerate(trials)],
    )
    counted = cut(
        sums.select(
            "stratum",
            "n_good",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(s).alias("signal"),
                            F.lit(c).alias("cutoff"),
                            F.col(f"k{i}").alias("n_rejected"),
                            F.col(f"b{i}").alias("n_caught"),
                        )
                        for i, (s, c) in enumerate(trials)
                    ]
                )
            ).alias("trial"),
        ).select("stratum", "n_good", "trial.*"),
        "quality-trials",
    )
    share = risk / len(GRID)
    sequences = counted.count() // len(trials) * len(GRID)
    level = alpha / max(sequences, 1)

    def prepare():
        def run(columns):
            tails = [
                binomial_tail(k, n, share)
                for k, n in zip(columns["n_rejected"], columns["n_good"])
            ]
            return columns | {"p_value": tails}

        return run

    tested = map_batches(
        counted, "stratum string, n_good bigint, signal string, cutoff double, n_rejected bigint, "
        "n_caught bigint, p_value double", prepare, rows=10_000,
    )
    # stricter cutoffs reject more, so the ones that pass are those before the first that fails
    gain = F.col("n_caught") - F.col("n_rejected")
    passed = tested.filter((F.col("p_value") <= level) & (gain > 0)).withColumn("gain", gain)
    best = passed.groupBy("stratum", "signal").agg(
        F.max_by(
            F.struct("cutoff", "n_good", "n_rejected", "n_caught", "p_value"),
            F.struct("gain", "cutoff"),
        ).alias("best")
    )
    return best.select("stratum", "signal", "best.*")


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, signals, ``base_failed``, ``reasons`` and ``kept`` of every document."""
    counts = cut(quality_counts(docs, stratum), "quality-counts", docs.count(), gather=True)
    signals = with_signals(counts)
    chosen = select_cutoffs(signals, labels)
    wide = cut(
        chosen.groupBy("stratum").agg(
            *[F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"{s}_cutoff") for s in GRID]
        ),
        "quality-cutoffs",
    )
    named = wide.withColumnRenamed("stratum", "of")
    judged = signals.join(named, signals["stratum"].eqNullSafe(named["of"]), "left")
    reasons = F.filter(
        F.array(
            F.when(F.col("base_failed"), F.lit("base")),
            *[F.when(F.col(s) > F.col(f"{s}_cutoff"), F.lit(s)) for s in GRID],
        ),
        lambda r: r.isNotNull(),
    )
    return judged.withColumn("reasons", reasons).select(
        *signals.columns, "reasons", (F.size("reasons") == 0).alias("kept")
    )
