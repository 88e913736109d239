"""Operator 8 [native]: quality rules and a hashed n-gram log-likelihood ratio.

Base rules are counts over the whole text.  Documents that pass are judged by
``sum over grams of log(p_target(bucket) / p_raw(bucket)) / number of grams``: grams are
the runs of letters, digits and signs and their neighbours in pairs, hashed into
``buckets``; p_raw is the multinomial of all documents, p_target that of trusted ones.
Log ratios are rounded to 1/1000, so sums are integers and every document gets the
same verdict in every run.  Only DataFrame functions; counts are combined map-side into
``buckets`` numbers.  Trusted documents are all that the labels trust, found by a join on
the id.  That join shuffles the text once, by the same plan at every size (a hash join
of ids: texts are not sorted).

Defined cases: a null or empty text has no words and fails the base rules; with
no trusted document the ratios are 0 and the base rules alone decide; repeated
rows are judged alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
GRAM = r"[\p{L}]+|[\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
BUCKETS, SMOOTHING, SCALE = 16_384, 1.0, 1_000
#: A document is kept if its mean ratio (times SCALE) is at least this.
THRESHOLD = -150
WINDOW = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def following(a: Column, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a), F.lit(0)))


def base_counts(rows: DataFrame) -> DataFrame:
    """Counts of ``_text`` (not null): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    r = rows.withColumn("_w", words(F.col("_text")))
    r = r.withColumn("n_words", F.size("_w").cast("long"))
    r = r.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    r = r.withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    r = r.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    r = r.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    r = r.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w", "_lines")
    # neighbours meet in zip_with, never by an index into an outer array: the optimizer may
    # copy a column's expression into a lambda, which would then cost a whole array per element
    reach = 1
    while reach < WINDOW:                                  # hashes of 2, 4, 8 words from each word on
        r = r.withColumn("_h", F.zip_with("_h", following(F.col("_h"), reach), lambda a, b: F.xxhash64(a, b)))
        reach *= 2
    r = r.withColumn("_win", F.when(F.size("_h") >= WINDOW, F.slice("_h", F.lit(1), F.size("_h") - (WINDOW - 1))))
    r = r.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(
        F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with("_sorted", following(F.col("_sorted"), 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"])
    return (r.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_sorted").isNotNull(), covered), F.lit(0)).cast("long"))
             .drop("_h", "_win", "_sorted"))


def grams(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``_grams``: buckets of the single grams and of the pairs of neighbours in ``_text``."""
    r = rows.withColumn("_g", F.transform(F.regexp_extract_all("_text", F.lit(GRAM), 0), lambda x: F.xxhash64(x)))
    one = F.transform("_g", lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.zip_with("_g", following(F.col("_g"), 1),
                     lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int"))
    return r.withColumn("_grams", F.concat(one, two)).drop("_g")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Occurrences by bucket over all ``rows``: at most ``buckets`` numbers reach the driver."""
    out = [0] * buckets
    # explode_outer: explode would add a filter on the array's size, which works the array out twice
    for r in grams(rows, buckets).select(F.explode_outer("_grams").alias("b")).groupBy("b").count().collect():
        if r["b"] is not None:
            out[r["b"]] = r["count"]
    return out


def log_ratios(target: list[int], raw: list[int], smoothing: float = SMOOTHING, scale: int = SCALE) -> list[int]:
    """Rounded log(p_target / p_raw) by bucket; all 0 without a target."""
    from math import log
    t, r, n = sum(target), sum(raw), len(raw)
    if not t:
        return [0] * n
    base = log(r + smoothing * n) - log(t + smoothing * n)
    return [round(scale * (log(a + smoothing) - log(b + smoothing) + base)) for a, b in zip(target, raw)]


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All ids with quality 1 that are not toxic."""
    return (labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
                          & F.col(id_col).isNotNull())
                  .select(F.col(id_col).alias("_id")).distinct())


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text: str = "text",
          buckets: int = BUCKETS, threshold: int = THRESHOLD, scale: int = SCALE) -> DataFrame:
    """Per row: id, the base counts, base_failed, kept, and the ratio (``llr``, null without grams).

    ``trusted`` holds ids in ``_id``, as many as there are (``trusted_ids``).
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    raw = bucket_counts(rows.select("_text"), buckets)
    target = bucket_counts(rows.join(trusted.hint("shuffle_hash"), rows[id_col] == F.col("_id"), "left_semi")
                               .select("_text"), buckets)
    ratios = log_ratios(target, raw, scale=scale)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")   # folded to a constant
    judged = base_counts(grams(rows, buckets))
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    judged = judged.withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams") / scale)).drop("_grams")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.coalesce(F.col("llr"), F.lit(0.0)) * scale >= threshold)).alias("kept"), "llr")
