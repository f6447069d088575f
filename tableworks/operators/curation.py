"""Operators that describe, select and clean the documents of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pii as P
from ..functions import text as T
from ..functions.repeats import repeated_share
from .ordering import fail_on_null

def words(text: Column) -> Column:
    """Lower-case words and numbers in order; a null text has none."""
    return F.coalesce(T.words(text), F.array().cast("array<string>"))


# --- exact duplicates and labels ---------------------------------------------------------------


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def exact_dedup(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, kept_id, n_copies, kept) of every row: ``kept_id`` is the smallest key among the rows of one normalised text.

    Texts are compared by their SHA-256. The minimum is built in each task before the shuffle, and comes back by a join that adaptive
    execution splits, so a text may fill a third of the table. A null text is a text of its own row; rows with a null key count as copies,
    but are kept only where no row of the text has a key. Repeated keys each get the row.
    """
    hashed = df.select(key, F.sha2(normalised(F.col(text)), 256).alias("_h"))
    groups = hashed.where("_h IS NOT NULL").groupBy("_h").agg(F.min(key).alias("kept_id"), F.count("*").alias("n_copies"))
    found = hashed.join(groups, "_h", "left")
    kept = F.coalesce("kept_id", F.col(key))
    return found.select(key, kept.alias("kept_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), kept.eqNullSafe(F.col(key)).alias("kept"))


def safety_filter(df: DataFrame, labels: DataFrame, *, key: str, flag: str) -> DataFrame:
    """Rows of ``df`` without those that any row of ``labels`` flags (1); rows without a label stay."""
    flagged = labels.where(F.col(flag) == 1).select(key).distinct()
    return df.join(flagged, key, "left_anti")


def safety_rates(df: DataFrame, labels: DataFrame, *, key: str, flag: str, by: str) -> DataFrame:
    """(by, n_rows, n_labelled, n_flagged, flagged_share): the share of flagged rows among labelled ones, null where none is labelled."""
    known = labels.groupBy(key).agg(F.max(flag).alias("_f"))
    rows = df.join(known, key, "left").groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count("_f").alias("n_labelled"), F.coalesce(F.sum((F.col("_f") == 1).cast("long")), F.lit(0)).alias("n_flagged")
    )
    return rows.withColumn("flagged_share", F.when(F.col("n_labelled") > 0, F.col("n_flagged") / F.col("n_labelled")))


# --- personal data -----------------------------------------------------------------------------


def pii_detect(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, kind, start, size) of every span of personal data, in characters from 0.

    Spans never overlap: kinds are looked for in the order of their priority, each in what earlier ones left. A row number of its own
    keeps rows with one key apart. Only the spans' lengths are shuffled, not texts. Null and empty texts have none.
    """
    spans = df.withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", F.posexplode(P.pieces(P.masked(F.col(text)))).alias("_i", "_p"))
    before = Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_p.gap") + F.col("_p.size")).over(before), F.lit(0)) + F.col("_p.gap")
    return spans.select(key, F.col("_p.kind").alias("kind"), start.alias("start"), F.col("_p.size").alias("size"))


def pii_redact(df: DataFrame, *, col: str) -> DataFrame:
    """Each span of personal data becomes the name of its kind in brackets. Nothing is shuffled; a null text stays null."""
    return df.withColumn(col, P.redacted(P.masked(F.col(col))))


# --- quality rules -----------------------------------------------------------------------------

#: Rules of quality_filter: a row fails where the measure is below the first or above the second number.
QUALITY_RULES = {
    "n_words": (5, None), "mean_word": (1.5, 12.0), "symbol_share": (None, 0.1), "repeated_line_share": (None, 0.3), "repeated_gram_share": (None, 0.3),
    "stop_share": (0.02, None),
}


def quality_measures(text: Column, stop_words: list[str], n: int = 5) -> dict[str, Column]:
    """Measures of a text; those that divide by nothing are 0."""
    whole = F.coalesce(text, F.lit(""))
    found = words(whole)
    count = F.size(found)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.trim(x)) > 0)
    letters = F.length(F.regexp_replace(whole, r"[\s]+", ""))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return {
        "n_words": count.cast("long"),
        "mean_word": share(F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)), count),
        "symbol_share": share(F.length(F.regexp_replace(whole, r"[\p{L}\p{N}\s.,;:!?'\"()-]+", "")), letters),
        "repeated_line_share": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "repeated_gram_share": repeated_share(n)(whole),
        "stop_share": share(F.size(F.filter(found, lambda w: w.isin(stop_words))), count),
    }


def quality_filter(df: DataFrame, *, text: str, stop_words: list[str], rules: dict = QUALITY_RULES) -> DataFrame:
    """Adds the measures, ``failed`` (names of the rules a row fails, in their order) and ``passed``. Null texts count as empty ones."""
    out = df.withColumns(quality_measures(F.col(text), stop_words))
    checks = []
    for name, (low, high) in rules.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        checks.append(F.when(bad, F.lit(name)))
    out = out.withColumn("failed", F.array_compact(F.array(*checks)))
    return out.withColumn("passed", F.size("failed") == 0)


# --- statistics by language and source -----------------------------------------------------------


def partition_stats(df: DataFrame, *, by: list[str], text: str, log2_k: int = 12) -> DataFrame:
    """Rows, characters, words and distinct texts for every level of ``rollup(by)``, exact and sketched.

    One pass builds a row per group with sums and a mergeable sketch of the texts; the levels above are merged from those rows
    alone. (by..., level, n_rows, n_null, n_chars, n_words, max_chars, distinct_sketch); ``level`` counts the columns rolled up, so a null
    value and a total are told apart.
    """
    col = F.col(text)
    groups = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(col.isNull().cast("long")).alias("n_null"), F.coalesce(F.sum(F.length(col)), F.lit(0)).alias("n_chars"),
        F.sum(F.size(words(col))).cast("long").alias("n_words"), F.max(F.length(col)).cast("long").alias("max_chars"),
        F.hll_sketch_agg(F.xxhash64(col), log2_k).alias("sketch"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_chars", "n_words")]
    rolled = groups.rollup(*by).agg(
        F.grouping_id().alias("_g"), *sums, F.max("max_chars").alias("max_chars"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_sketch")
    )
    return rolled.withColumn("level", F.bit_count("_g").cast("int")).drop("_g")


# --- nested samples ------------------------------------------------------------------------------


def scale_sample(df: DataFrame, *, key: str, sizes: dict[str, int], by: list[str] | None = None, digits: int = 5) -> DataFrame:
    """Adds ``sample`` (the smallest of the named sizes that holds the row) and ``probability`` (that of being in it); other rows go.

    Samples are nested: each takes the rows with the smallest MD5 of their key, per stratum ``by``, exactly as many as its size or all.
    The table is never sorted: rows are counted by leading digits of the hash, which tells for each stratum and size where the last
    row lies; ranks are taken only inside those buckets. Equal keys are ordered by nothing else, so keys have to be unique; a null key stops the job.
    """
    by = list(by or [])
    work = fail_on_null(df, key).withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, digits))
    counts = work.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.select(
        *by, "_b", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total")
    )
    ordered = sorted(sizes.items(), key=lambda x: x[1])
    edges = edges.where(F.col("_off") < ordered[-1][1])
    inside = [((F.col("_off") < n) & (F.col("_off") + F.col("_n") > n)) for _, n in ordered]
    split = inside[0]
    for x in inside[1:]:
        split = split | x
    edges = edges.withColumn("_cut", split)
    matched = _null_safe(work, edges, [*by, "_b"])
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h"))
    whole = matched.where("NOT _cut").withColumn("_r", F.col("_off") + 1)
    cut = matched.where("_cut").withColumn("_r", F.col("_off") + rank)
    rows = whole.unionByName(cut)
    sample, probability = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, n in reversed(ordered):
        sample = F.when(F.col("_r") <= n, name).otherwise(sample)
        probability = F.when(F.col("_r") <= n, F.least(F.lit(1.0), F.lit(float(n)) / F.col("_total"))).otherwise(probability)
    rows = rows.withColumns({"sample": sample, "probability": probability})
    return rows.where("sample IS NOT NULL").drop("_h", "_b", "_n", "_off", "_total", "_cut", "_r")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in on])
