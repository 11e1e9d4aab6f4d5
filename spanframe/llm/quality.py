"""Quality rules: base rules and a hashed n-gram log-likelihood ratio.

DataFrame functions only: no Python, pandas or RDD code runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import words

#: Hash buckets of the multinomials; the fitted table has this many entries.
BUCKETS = 1 << 16
#: The trusted target is fitted on at most this many labelled documents, those
#: with the smallest hashes of their ids; the raw side counts all documents.
TRUSTED_MAX = 20_000
#: Strength of the prior that a bucket is as likely in trusted text as in raw text:
#: so many n-grams are added to its expected and its observed count.
PRIOR = 2.0
#: A document is kept from this mean log-likelihood ratio per n-gram on.
THRESHOLD = -0.2
#: Base rules: fewer words, or a larger share (%) of words in repeated windows, fail.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _with_hashes(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_words`` and ``_hashes``, a 64-bit hash of each word."""
    return docs.withColumn("_words", words(F.col(text))).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _grams() -> Column:
    """Buckets of the words and word pairs of ``_hashes``, as array<int>."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    last = F.size("_hashes") - 1
    pairs = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda i: bucket(F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1)))))
    return F.concat(F.transform("_hashes", bucket), F.coalesce(pairs, F.array().cast("array<int>")))


def fit_ratios(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", trusted_max: int = TRUSTED_MAX) -> list[float]:
    """log p(bucket | trusted) - log p(bucket | raw) for each bucket.

    Raw counts cover all documents. Trusted documents are those labelled
    quality 1 and not toxic. Without any, all ratios are 0. The trusted
    multinomial is shrunk towards the raw one by PRIOR, so that buckets too rare
    to be expected in the trusted sample say little, however small that is.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").where(F.col(key).isNotNull()).select(key).distinct()
    trusted = good.orderBy(F.xxhash64(key), key).limit(trusted_max).withColumn("_trusted", F.lit(1))
    t = docs.select(key, text).join(F.broadcast(trusted), key, "left")  # at most trusted_max ids
    t = _with_hashes(t, text).select("_trusted", F.explode(_grams()).alias("bucket"))
    counts = t.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("trusted")).collect()  # at most BUCKETS rows
    raw, trusted_n = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row.bucket], trusted_n[row.bucket] = row.raw, row.trusted
    if not (n_trusted := sum(trusted_n)):
        return [0.0] * BUCKETS
    expected = [n_trusted * n / sum_ for sum_ in [sum(raw)] for n in raw]
    shrunk = [(c + PRIOR) / (e + PRIOR) for c, e in zip(trusted_n, expected)]  # p(trusted) / p(raw), up to the total
    total = sum(e * x for e, x in zip(expected, shrunk)) / n_trusted
    return [round(math.log(x / total), 6) if n else 0.0 for x, n in zip(shrunk, raw)]


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and
    base_failed, and the helpers ``_words`` and ``_hashes``.

    Everything is computed inside the row; nothing is shuffled. Windows are
    compared by 64-bit hashes of their words' hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.col("n_words")
    t = _with_hashes(docs, text)
    t = t.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
    })
    at = lambda i, k: F.get("_hashes", i + k)
    windows = F.transform(F.sequence(F.lit(0), (n - WINDOW).cast("int")), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    t = t.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_windows": F.when(n >= WINDOW, windows)})
    # few texts have repeated windows; only those sort theirs
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    t = t.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.get("_sorted", k)["h"] == x["h"]
    places = F.transform("_sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    t = t.withColumn("_places", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    covered = F.transform("_places", lambda p, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("_places", j - 1))))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, c: a + c), F.lit(0)).cast("long"))
    t = t.withColumn("base_failed", (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT))
    return t.drop("_lines", "_windows", "_sorted", "_places")


#: The columns that ``judge`` adds.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, ratios: list[float], *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the base statistics, ``score`` (mean ratio of the words and word pairs,
    0 without any) and ``kept``: neither failed by the base rules nor below
    ``threshold``.

    Nulls and empty texts have no words and fail the base rules. Repeated rows
    are judged alike, an empty table gives an empty result, and other columns
    stay; columns with the names of new ones are replaced.
    """
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # a constant of BUCKETS numbers
    # own columns travel as one struct, so that none is taken for a helper of the same name
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in JUDGED)).alias("_own")
    t = base_stats(docs.select(own, F.col(text).alias("_text")), "_text").withColumn("_grams", _grams())
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    t = t.withColumn("score", F.when(F.size("_grams") > 0, F.round(total / F.size("_grams"), 9)).otherwise(F.lit(0.0)))
    return t.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select("_own.*", *JUDGED)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on ``docs`` and ``labels`` and judge every document of ``docs``."""
    return judge(docs, fit_ratios(docs, labels), **options)


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Those travel as one struct, so that none is taken for a new column of the same
    name. The row number keeps the optimizer from moving the filter below the
    columns that it is made of, which would compute each of them again for every use.
    """
    ratios = fit_ratios(docs, labels, text=text)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own"), F.col(text).alias("_text"))
    judged = judge(own, ratios, text="_text", **options).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("_own.*")
