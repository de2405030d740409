"""Host-level quality rules: document failures shrunk by an empirical beta prior per host.

A document fails by itself when it has too few words or repeats itself too much. Failures are
counted per host, the hosts' rates are shrunk towards the rate of all hosts, and documents of a
host whose shrunk rate is too high go as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.common import bind, stored, words_of

# Fixed values of the contract.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

MAX_HOST_RATE = 0.5


def windows_of(hashes: str, width: int = WINDOW) -> Column:
    """One hash per run of ``width`` words, from the array of word hashes."""
    words = F.col(hashes)
    starts = F.when(
        F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def covered_words(windows: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more: sort, keep equal neighbours, add up."""

    def repeated(found: Column) -> Column:
        return F.filter(
            found,
            lambda e, i: F.coalesce(F.get(found, i - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(found, i + 1)["h"] == e["h"], F.lit(False)),
        )

    def total(starts: Column) -> Column:
        gaps = F.transform(
            starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width)))
        )
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    found = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    starts = bind(found, lambda s: F.sort_array(F.transform(repeated(s), lambda e: e["p"])))
    return bind(starts, total)


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per row of ``docs``: the key columns and the measures the document rules look at.

    Null and empty texts have no words and fail. Every row is measured by itself, so repeated
    rows are kept and columns other than the keys are not looked at.
    """
    lines = F.filter(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )
    rows = docs.select(
        *keys,
        words_of(text).alias("_words"),
        lines.alias("_lines"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *keys,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    rows = rows.withColumn("_windows", windows_of("_hashes")).drop("_hashes")
    all_differ = F.size(F.array_distinct("_windows")) == F.size("_windows")
    rows = rows.withColumn(
        "n_repeat_words", F.when(all_differ, 0).otherwise(covered_words(F.col("_windows"))).cast("long")
    ).drop("_windows")
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def beta_prior(groups: DataFrame, events: str = "failed", trials: str = "n") -> tuple[float, float]:
    """Mean and strength of the beta distribution the groups' rates come from, by moments.

    ``groups`` holds counts of events and trials. Without spread beyond chance, or with a single
    group, the prior is so strong that every group gets the common rate; with no trial at all it
    is even.
    """
    n, f = F.col(trials).cast("double"), F.col(events).cast("double")
    s = groups.where(n > 0).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(f).alias("f"),
        F.sum(n * n).alias("nn"),
        F.sum(f * f / n).alias("ffn"),
    ).first()
    if not s["n"]:
        return 0.5, 2.0
    p = s["f"] / s["n"]
    chance = p * (1.0 - p)
    room = s["n"] - s["nn"] / s["n"] - (s["k"] - 1)
    if chance <= 0.0 or room <= 0.0:
        return p, 1e6
    rho = (s["ffn"] - s["n"] * p * p - chance * (s["k"] - 1)) / (chance * room)
    rho = min(max(rho, 1e-6), 0.999)
    return p, 1.0 / rho - 1.0


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Document measures, the documents' own verdict and the verdict of their host.

    Returns one row per row of ``docs`` (repeated rows stay): ``doc_id``, the measures,
    ``base_failed``, ``host_rate`` (shrunk failure rate of the host, null without host) and
    ``kept``. A document without host is judged by itself. An empty table gives no rows.

    The measures are written once, as they feed both the counts per host and the join; counts
    are reduced before the shuffle, and the join of the verdicts is a plain left join whose
    crowded hosts Spark splits.
    """
    measures = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    measures = stored(measure(measures, ["doc_id", "_host"], "_text"), "quality")
    hosts = (
        measures.where(F.col("_host").isNotNull())
        .groupBy("_host")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("base_failed").cast("int")).alias("failed"),
        )
    )
    hosts = stored(hosts, "hosts")
    mean, strength = beta_prior(hosts)
    rates = hosts.select("_host", ((F.col("failed") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    judged = measures.join(rates, "_host", "left")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate)).alias("kept"),
        "host_rate",
    )
