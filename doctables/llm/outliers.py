"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Every document gets a vector of transformed statistics. Per language and source the minimum-covariance-
determinant estimate of their centre and scatter is found by concentration steps (Rousseeuw and Van Driessen,
"A Fast Algorithm for the Minimum Covariance Determinant Estimator", 1999) from a deterministic start
(medians and median deviations): take the share H of the documents that are nearest in Mahalanobis distance, estimate
from these, again. After a final reweighting, documents too far from their group are rejected.

A step is two aggregations over the narrow table of vectors: the H-quantile of the distances per group, and the
moments of what is below it; both are combined before the shuffle, so a group with a third of
all rows costs no more than its share. Groups have one row of parameters each; their matrices are inverted in
column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, written
from .registry import query

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Share of a group that the estimate is taken from, and how often it is concentrated.
H, STEPS = 0.75, 3
#: Smaller groups are estimated with the other small ones of their language, those with all others.
LEAST_ROWS = 120
#: Rejected is what a multivariate normal would exceed with this probability, in a vector with at least the resolution.
TAIL = 1e-6
#: Features and the least spread each is taken to have: differences below are no sign of quality. Each is small enough for
#: the feature alone to pass the limit within its range: repeated lines from 58 %, repeated words from 40 % on at the least.
FEATURES = {"log_word_length": 0.06, "log_words": 0.6, "symbol_angle": 0.03, "dup_line_angle": 0.14, "repeat_angle": 0.11, "upper_angle": 0.06}


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def angle(part: Column, whole: Column) -> Column:
    """A share on a scale where equal steps are about equally likely."""
    return F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))


def once(frame: DataFrame, name: str, result: Column) -> Column:
    """``result`` has a lambda over the array column ``name``; a second use keeps that computed once."""
    return F.when(F.size(frame[name]) >= 0, result)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and
    n_upper of the whole text (null: empty)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
    kept = [c for c in docs.columns if c != text and c not in names]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(*kept, body.alias("_text"))
    length = F.length("_text").cast("long")
    df = df.select(
        *kept, F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        F.regexp_count("_text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("_lines"))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_lines", F.size("_lines").cast("long")).withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Windows of three words by a 64-bit hash; n - 2 of them.
    windows = F.slice(
        F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    df = df.withColumn("_windows", once(df, "_words", windows)).drop("_words", "_lines")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, d: F.coalesce(x["h"] == F.get("_sorted", i + d)["h"], F.lit(False))
    found = F.filter("_sorted", lambda x, i: (same(x, i, -1) & (i > 0)) | same(x, i, 1))
    df = df.withColumn("_found", once(df, "_sorted", found)).drop("_windows", "_sorted")
    df = df.withColumn("_at", F.sort_array(F.transform("_found", lambda x: x["i"]))).drop("_found")
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(once(df, "_at", covered), F.lit(0)).cast("long")).drop("_at")


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and the features."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    features = {
        "log_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), "log_words": F.log(words.cast("double")),
        "symbol_angle": angle(F.col("n_symbols"), F.col("word_chars")), "dup_line_angle": angle(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_angle": angle(F.col("n_repeat_words"), F.col("n_words")), "upper_angle": angle(F.col("n_upper"), F.col("word_chars")),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumns(features)


def grouped(df: DataFrame, folder: str, lang: str, source: str, least: int) -> DataFrame:
    """``df`` with its group: language and source, or a wider one where too few rows pass the base rules."""
    narrow = F.concat(F.lit("2"), F.to_json(F.struct(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))))
    middle = F.concat(F.lit("1"), F.to_json(F.struct(F.col(lang).cast("string").alias("lang"))))
    df = df.withColumn("_cell", narrow).withColumn("_lang", middle)
    cells = df.groupBy("_cell", "_lang").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("_n"))
    rest = cells.where(F.col("_n") < least).groupBy("_lang").agg(F.sum("_n").alias("_rest"))
    named = cells.join(rest, "_lang", "left").select("_cell", F.when(F.col("_n") >= least, F.col("_cell")).when(F.col("_rest") >= least, F.col("_lang")).otherwise("0").alias("group"))
    # Tables of one row per group are stored, so that their size is known and no row moves to join a small one.
    return df.join(written(named, folder, "groups"), "_cell").drop("_cell", "_lang")


def factored(moments: DataFrame, names: list[str], scale: float) -> DataFrame:
    """Centre and Cholesky factor of each group from the sums of its rows, as columns m_i and l_i_j.

    ``scale`` makes the covariance of a central part consistent; the resolution of each feature is added on the
    diagonal, which also keeps groups with constant features regular."""
    p = len(names)
    df = moments.select("group", "n", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(p)], *[
        F.col(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])
    df = df.select("group", "n", *[f"m_{i}" for i in range(p)], *[
        ((F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale + (FEATURES[names[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}")
        for i in range(p) for j in range(i + 1)])
    for j in range(p):  # one column of the factor a time
        square = F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(square, F.lit(1e-12))))
        df = df.withColumns({
            f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}")
            for i in range(j + 1, p)})
    return df.select("group", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def with_distance(rows: DataFrame, parameters: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance d2 to the centre of their group."""
    p = len(names)
    df = rows.join(parameters, "group", "left")
    for i in range(p):
        done = sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y_{i}", (F.col(names[i]) - F.col(f"m_{i}") - done) / F.col(f"l_{i}_{i}"))
    square = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(p)), F.lit(0.0))
    return df.select(*rows.columns, square.alias("d2"))


def moments(rows: DataFrame, names: list[str]) -> DataFrame:
    p = len(names)
    return rows.groupBy("group").agg(
        F.count("*").alias("n"), *[F.sum(names[i]).alias(f"s_{i}") for i in range(p)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])


def mcd(rows: DataFrame, folder: str, names: list[str], h: float = H, steps: int = STEPS) -> DataFrame:
    """The reweighted estimate of every group of ``rows`` (group and the features): m_i and l_i_j."""
    p = len(names)
    middle = written(rows.groupBy("group").agg(*[F.percentile_approx(n, 0.5, 10_000).alias(f"m_{i}") for i, n in enumerate(names)]), folder, "middle")
    apart = rows.join(middle, "group").groupBy("group").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"a_{i}") for i, n in enumerate(names)])
    parameters = apart.select("group", *[f"m_{i}" for i in range(p)], *[
        (F.sqrt((1.4826 * F.col(f"a_{i}")) ** 2 + FEATURES[names[i]] ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}")
        for i in range(p) for j in range(i + 1)])
    parameters = written(parameters, folder, "start")
    consistent = h / chi2_cdf(chi2_quantile(h, p), p + 2)
    for step in range(steps):
        near = with_distance(rows, parameters, names)
        edge = written(near.groupBy("group").agg(F.percentile_approx("d2", h, 10_000).alias("edge")), folder, f"edge-{step}")
        inside = near.join(edge, "group").where(F.col("d2") <= F.col("edge"))
        parameters = written(factored(moments(inside, names), names, consistent), folder, f"step-{step}")
    edge = 0.975
    inside = with_distance(rows, parameters, names).where(F.col("d2") <= chi2_quantile(edge, p))
    return written(factored(moments(inside, names), names, edge / chi2_cdf(chi2_quantile(edge, p), p + 2)), folder, "final")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_ROWS, tail: float = TAIL,
           keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all other columns of ``docs`` by default) with the statistics, base_failed, d2 and kept for every row.

    A null text is empty and fails the base rules, as all with under 50 words or over half of their words in repeated
    windows do; null languages and sources are groups of their own; repeated rows count and are judged each.
    Estimates are taken from rows that pass the base rules; a row without an estimate is kept if it passes."""
    folder = shared_folder(docs.sparkSession)
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    names = list(FEATURES)
    stats = statistics(docs.select(*[F.col(c).alias(f"_k_{c}") for c in kept], F.col(lang).alias("_l"), F.col(source).alias("_s"), F.col(text).alias("text")))
    # Stored before it is grouped: the counts per group and the rows read the vectors, not the texts again.
    rows = grouped(written(vectors(stats), folder, "vectors"), folder, "_l", "_s", least)
    rows = written(rows, folder, "grouped")
    parameters = mcd(rows.where(~F.col("base_failed")).select("group", *names), folder, names)
    limit = chi2_quantile(1 - tail, len(names))
    out = with_distance(rows, parameters, names)
    return out.select(
        *[F.col(f"_k_{c}").alias(c) for c in kept], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"), "d2", *names)


@query("op2_robust_outliers")
def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
