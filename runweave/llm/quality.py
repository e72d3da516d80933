"""Quality rules with risk-controlled cutoffs: rejecting good documents is bounded per stratum, with given confidence.

**Rules.** Four values between 0 and 1 of each document: symbols per character, repeated lines per line, words inside
repeated three-word windows per word, and mean word length (a twentieth of it). A rule rejects from a cutoff on, one of 40 steps.

**Cutoffs.** On labelled holdouts, for each stratum (language), rule and step: of n good documents k would be
rejected. If the true rate were `RISK / rules` or more, k or fewer would come with probability P(Binomial(n, RISK /
rules) <= k), computed exactly as a sum of its terms. Steps at which that is at most `DELTA / (strata x rules x steps)`, Bonferroni's share, are safe: with
confidence 1 - DELTA every stratum loses at most `RISK` of its good documents, all rules together. Of the safe steps a rule takes the one that gains most (bad minus
good share rejected), the mildest of equals. A stratum with too few good labels for any safe step rejects nothing.

**Scale.** DataFrame functions only, each text in its own row: sorted hashes of windows, no rows per word. Labels meet statistics
in one join of small rows; counts per step are pre-aggregated, so a hot language is no single task's group; the table of cutoffs has at most four rows a stratum.

**Cases.** A null text has no words (base_failed). A null language is a stratum of its own. Labels other than 0 and 1 are left out;
repeated labels of an id count each. An empty labels table gives no cutoffs: the base rules alone decide. Copies get the
same verdict in the same stratum. Other columns are kept by `judged`; a statistic takes the place of a column of its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.columns import without
from runweave.llm.storage import checkpointed

RISK, DELTA, STEPS = 0.02, 0.05, 40
RULES = ("symbols", "dup_lines", "repeats", "long_words")
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
FEW = 64
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept")


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words of `_words`: words in three-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes of their words. Sorted hashes show which occur again; where those are few, the
    windows are looked up among them, else windows are sorted with their places.
    """
    df = df.withColumn("_tri", F.expr(
        "CASE WHEN size(_words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE "
        "transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"))
    df = df.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_tri)) = size(_tri) THEN NULL ELSE sort_array(_tri) END"))
    df = df.withColumn("_again", F.expr(
        "CASE WHEN _sorted IS NULL THEN NULL ELSE array_distinct(filter(_sorted, (x, j) -> j > 0 AND _sorted[j - 1] = x)) END"))
    df = df.withColumn("_placed", F.expr(
        f"CASE WHEN size(_again) > {FEW} THEN sort_array(transform(_tri, (h, i) -> struct(h AS h, i AS i))) END"))
    df = df.withColumn("_at", F.expr(f"""CASE WHEN _again IS NULL THEN NULL
        WHEN size(_again) <= {FEW} THEN filter(sequence(0, size(_tri) - 1), i -> array_contains(_again, _tri[i]))
        ELSE sort_array(transform(filter(_placed, (x, j) -> (j > 0 AND _placed[j - 1].h = x.h)
            OR (j < size(_placed) - 1 AND _placed[j + 1].h = x.h)), x -> x.i)) END"""))
    total = F.expr("""CASE WHEN _at IS NULL THEN 0 ELSE aggregate(_at, named_struct('e', 0, 'n', 0L),
        (a, p) -> named_struct('e', p + 3, 'n', a.n + (p + 3 - greatest(a.e, p)))).n END""")
    return df.withColumn("n_repeat_words", total.cast("bigint"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    docs = without(docs, *STATISTICS, "_words", "_tri", "_sorted", "_again", "_placed", "_at", "_lines", "_text")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    trimmed = F.trim("_text", F.lit(BLANK))
    words = F.when(trimmed == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_words", words)
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(BLANK)) != ""))
    df = _repeat_words(df)
    long = lambda c: c.cast("bigint")
    left = lambda chars: F.length(F.translate("_text", chars, ""))
    df = df.select(
        *docs.columns, long(F.size("_words")).alias("n_words"), long(left(BLANK)).alias("word_chars"),
        long(F.length("_text") - left(SYMBOLS)).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), long(F.size("_lines")).alias("n_lines"),
        "n_repeat_words")
    return df.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def steps() -> dict[str, str]:
    """SQL of the step (0 to STEPS) of each rule's value."""
    value = {
        "symbols": "n_symbols / greatest(1, word_chars)", "dup_lines": "n_dup_lines / greatest(1, n_lines)",
        "repeats": "n_repeat_words / greatest(1, n_words)", "long_words": "word_chars / (20 * greatest(1, n_words))"}
    return {rule: f"CAST(floor(least({STEPS}, {STEPS} * ({value[rule]}))) AS INT)" for rule in RULES}


def cutoffs(stats: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality",
            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cut of the rules that have a safe step.

    stats: statistics of all documents; rows that the base rules reject anyway are left out.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("good")).filter("good IN (0, 1) AND _key IS NOT NULL")
    rows = stats.filter("NOT base_failed").join(known, F.col(key) == F.col("_key")).withColumn("stratum", F.coalesce(stratum, F.lit("none")))
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(sql).alias("step")) for r, sql in steps().items()))
    counted = rows.select("stratum", "good", F.explode(pairs).alias("x")).groupBy("stratum", "x.rule", "x.step").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    # every step, also those without a document, and what would be rejected from there on
    strata = counted.select("stratum", "rule").distinct()
    grid = strata.select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step"))
    full = grid.join(counted, ["stratum", "rule", "step"], "left").na.fill(0, ["good", "bad"])
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.desc("step"))
    full = full.select(
        "stratum", "rule", "step", F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("b"),
        F.sum("good").over(group).alias("n"), F.sum("bad").over(group).alias("m")).filter("step > 0")
    full = full.crossJoin(F.broadcast(strata.select(F.count_distinct("stratum").alias("strata"))))
    a = risk / len(RULES)
    tail = F.expr(f"""CASE WHEN k > n * {a!r}D THEN 1D ELSE exp(aggregate(sequence(0L, k),
        named_struct('t', 0D, 's', -1D / 0), (x, i) -> named_struct(
          't', CASE WHEN i = 0 THEN n * ln(1 - {a!r}D) ELSE x.t + ln(n - i + 1) - ln(i) + ln({a!r}D / (1 - {a!r}D)) END,
          's', CASE WHEN i = 0 THEN n * ln(1 - {a!r}D)
               ELSE x.s + log1p(exp(x.t + ln(n - i + 1) - ln(i) + ln({a!r}D / (1 - {a!r}D)) - x.s)) END)).s) END""".replace("-1D / 0", "CAST('-Infinity' AS DOUBLE)"))
    safe = full.filter(tail <= F.lit(delta) / (F.col("strata") * len(RULES) * STEPS))
    gain = F.expr("b / greatest(1, m) - k / greatest(1, n)")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("step"))
    return (safe.withColumn("gain", gain).filter("gain > 0").withColumn("r", F.row_number().over(best)).filter("r = 1")
            .select("stratum", "rule", F.col("step").alias("cut")))


def judged(stats: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """All columns of stats and `kept`."""
    wide = cuts.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut")).withColumnsRenamed({r: f"_cut_{r}" for r in RULES} | {"stratum": "_stratum"})
    out = stats.join(wide, F.coalesce(F.col(stratum), F.lit("none")) == F.col("_stratum"), "left")
    over = [F.coalesce(F.expr(f"{sql} >= _cut_{rule}"), F.lit(False)) for rule, sql in steps().items()]
    rejected = over[0] | over[1] | over[2] | over[3]
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).select(*stats.columns, "kept")


def digest(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    stats = checkpointed(statistics(docs.select(key, "lang", "text")).drop("text"))
    out = judged(stats, cutoffs(stats, labels, key))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
