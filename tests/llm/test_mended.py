"""Names that clash with helpers, hashes that collide, captions that rows close."""

import random

from pyspark.sql import functions as F

from spanframe.llm import decontam, html_text, mixing, quality, sharding, substring

NAMES = ["_n", "_rank", "_source", "_hash", "_cell", "_z", "_p", "_tie", "_part", "_at", "_total", "_own", "_size", "_key", "_words", "_hashes", "_grams", "_text", "_lines", "_before", "_row"]


def table(spark, n=40):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "ab"[i % 2], 30) for i in range(n)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    return t.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES))


def own(df):
    return {r.doc_id: tuple(r[c] for c in NAMES) for r in df.collect()}


def test_callers_names_stay(spark):
    t = table(spark)
    want = own(t)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    for out in (sharding.interleave(t, 3), mixing.mix(t, "size"), quality.quality(t, labels)):
        assert own(out) == want and set(t.columns) <= set(out.columns)
    plain = t.drop(*NAMES)
    for f in (lambda x: sharding.interleave(x, 3).select("doc_id", "shard"), lambda x: mixing.mix(x, "size").select("doc_id", "copies"), lambda x: quality.quality(x, labels).select("doc_id", "score")):
        spread = lambda x: len({r[1] for r in x.collect()})
        assert spread(f(t)) >= 1 and f(t).count() == f(plain).count() == 40


def test_columns_of_new_names_are_replaced(spark):
    t = table(spark).withColumns({c: F.lit("old") for c in ("shard", "slot", "copies", "taken", "score", "kept", "n_words")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {type(r.shard) for r in sharding.interleave(t, 3).collect()} == {type(r.copies) for r in mixing.mix(t, "size").collect()} == {int}
    judged = quality.quality(t, labels)
    assert {type(r.n_words) for r in judged.collect()} == {int} and judged.columns.count("score") == 1


def test_texts_that_share_a_hash_are_no_copies(spark):
    rows = [(1, 7, 100), (2, 7, 200), (3, 7, 100), (4, 8, 100)]
    copies, _ = substring.later_copies(spark.createDataFrame(rows, "d long, t long, u long"))
    assert [tuple(r) for r in copies.collect()] == [(3, 7)]


def test_segments_that_share_a_hash_do_not_meet(spark):
    parts = spark.createDataFrame([(5, 1, 0, 9, 77, bytearray(b"a" * 65)), (6, 2, 3, 9, 77, bytearray(b"b" * 65)), (7, 3, 0, 8, 77, bytearray(b"a" * 65))], "d long, t long, start int, key long, sid long, words binary")
    owner = parts.where("d = 5").select("key", "sid", substring.proof(), F.lit(1).cast("long").alias("first"), F.array().cast(substring.SPANS).alias("spans"))
    assert [r.d for r in substring.meet(parts, owner).collect()] == [5]


def test_rows_close_captions():
    for after in ("<tr><td>1", "<td>1", "<th>1", "<col><tr><td>1", "<colgroup><tr><td>1", "<tbody><tr><td>1"):
        assert html_text.render(f"<table><caption>cap{after}</table>").split() == ["cap", "1"], after
    assert html_text.render("<div>a</div><div popover>b</div><p>c").split() == ["a", "c"]


def test_leaks_in_capital_letters_are_found(spark):
    """A copy in other case is a copy."""
    item = "nothing of the kind is said in this other item about the sea and the shore"
    bench = spark.createDataFrame([(2, item, "x")], "item_id long, text string, doc_id string")
    t = spark.createDataFrame([(8, item.upper()), (9, "a clean text")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.changed) for r in decontam.find_leaks(t, bench).collect()] == [(8, 2, False)]
