"""Clashing columns, long headers, members inside members, foreign records."""

import hashlib
import random
import zlib

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from spanframe.llm import decontam, jaccard, mixing, quality, warc
from spanframe.llm.common import scratch, shared_dir


def test_own_columns_keep_their_values(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "ab"[i % 2], 77.5, "mine", 9.0, 5) for i in range(20)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, kept string, target double, n_words int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    kept = quality.accepted(t, labels)
    assert kept.columns == t.columns and {(r.score, r.kept, r.n_words) for r in kept.collect()} == {(77.5, "mine", 5)}
    mixed = mixing.emit(t.withColumn("copies", F.lit("c")), size=F.lit(3))
    assert {(r.target, r.copies) for r in mixed.collect()} == {(9.0, "c")}


def test_shared_dir_has_a_scheme(spark):
    assert shared_dir(spark).startswith("file:///")


def member(data):
    s = zlib.compressobj(0, zlib.DEFLATED, 31)
    return s.compress(data) + s.flush()


def record(i, payload):
    return warc.record(i, "u", payload, hashlib.sha1(payload).hexdigest(), len(payload), None)


def test_long_headers_are_read_back(spark):
    pages = spark.createDataFrame([(1, "http://x/" + "a" * 600_000, "<p>x")], "page_id long, url string, html string")
    assert [r.page_id for r in warc.round_trip(spark, pages, scratch(spark, "warc")).collect()] == [1]


def test_members_inside_a_member_are_no_records(tmp_path):
    inner = b"".join(member(record(i, b"%d" % i * 700)) for i in range(100, 140))
    data = member(record(1, b"a" * 50)) + member(record(2, inner)) + member(record(3, b"c" * 50)) + b"damage" + member(record(4, b"d"))
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    fs, p = pafs.FileSystem.from_uri(path.as_uri())
    for step in (len(data), 5000, 301):
        with fs.open_input_file(p) as f:
            got = [warc.parse_record(d)[0] for a in range(0, len(data), step) for d in warc.owned_records(f, a, a + step)]
        assert got == [1, 2, 3, 4]


def test_foreign_records():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\n"
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    sha = hashlib.sha1(b"abc").hexdigest()
    plain = head + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    assert warc.parse_record(plain) == (None, "u", "response", None, 3, sha, b"abc")
    for digest in (b"sha1:" + sha.encode(), b"sha256:00", b"sha1:" + b"0" * 40):
        assert warc.parse_record(plain.replace(b"WARC-Target", b"WARC-Payload-Digest: " + digest + b"\r\nWARC-Target"))[5] == sha
    assert warc.parse_record(head.replace(b"response", b"revisit") + b"\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n") == (None, "u", "revisit", None, None, None, b"")


def test_leaks_with_other_names_at_a_start_and_other_units(spark):
    bench = spark.createDataFrame([(1, "Tom bought twelve apples at the store near home."), (2, "The tank holds ninety litres of water after two hours of rain.")], "item_id long, text string")
    rows = [
        (1, "Ann bought nine apples at the store near home."), (2, "It is so. Ann bought forty-two apples at the store near home."), (3, "The tank holds 20 gal of water after three days of rain."),
        (4, "Ann bought nine pears at the store near town."), (5, "So the tank holds ninety-one kB of water after twenty minutes of rain."),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.changed) for r in decontam.find_leaks(t, bench).collect()} == {(1, 1, True), (2, 1, True), (3, 2, True), (5, 2, True)}


def test_leaks_equal_a_plain_search(spark):
    """Every verbatim copy in any case, and nothing in unrelated text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(25)]
    rows = []
    for i in range(150):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            k = rng.randint(0, len(body))
            body[k:k] = rng.choice((str.upper, str.lower, str.title))(rng.choice(items)).split()
        rows.append((i, " ".join(body)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(t, bench).collect()}

    def holds(text, item, n):
        text, item = text.lower().split(), item.lower().split()
        n = min(n, len(item))
        spans = {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}
        return any(tuple(item[k : k + n]) in spans for k in range(len(item) - n + 1))

    assert got == {(i, k) for i, x in rows for k, item in enumerate(items) if holds(x, item, decontam.WINDOW)}


def test_jaccard_of_short_sets_and_repeated_ids(spark):
    from test_operators import brute_components

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        a = rng.randrange(20)
        w = base[a : a + rng.randint(1, 40)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(base)
        rows.append((i, " ".join(w)))
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (70, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(t, words=2, percent=percent).collect()}
        assert got == brute_components(rows, 2, percent)
    # rows of one id are one document with several texts
    joined = spark.createDataFrame([(i // 2, x) for i, x in rows], "doc_id long, text string")
    brute = brute_components(rows, 2, 85)
    up = {i: i for i in range(75)}
    for _ in range(75):
        for i, (_, c) in brute.items():
            low = min(up[i // 2], up[c // 2])
            up[i // 2] = up[c // 2] = low
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(joined, words=2, percent=85).collect()} == set(up.items())
