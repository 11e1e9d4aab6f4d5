"""Benchmark decontamination by template windows with typed slots."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import give_back, hash_grams, hash_words, in_slices, join_sized, materialize, worker_memory
from spanframe.llm.hash_memo import HashMemo

#: Template tokens in a window; items with fewer (but MIN_WINDOW at least) form one window of their length.
WINDOW = 8
MIN_WINDOW = 5
#: A window needs this many words that are not placeholders.
MIN_LITERALS = 4
#: Forms of a window: its template, its case-folded words (hashed alike, so that
#: forms without slots meet), and those of an item without a template window,
#: which is found by all its words, hashed apart.
TEMPLATE, FOLDED, WHOLE = 0, 1, 2
_WHOLE_SALT = np.uint64(0x5851F42D4C957F2D)
#: Bits of the filter that goes to every task before the join; a window whose
#: hash hits none of the benchmark's is not sent. It is as large for any benchmark.
FILTER_BITS = 1 << 26
#: Up to this many benchmark windows are broadcast to the documents' windows.
BROADCAST_WINDOWS = 300_000
#: Up to this many contaminated ids are broadcast to drop their documents.
DROP_BROADCAST_MAX = 500_000
#: Words that a worker remembers.
MEMO = 1_000_000

#: Number words: units, teens, tens (with a unit behind a hyphen), multiples, as
#: cardinals, ordinals or plurals.
_ONES = "one|two|three|four|five|six|seven|eight|nine|first|third|fourth|fifth|sixth|seventh|eighth|ninth"
_TENS = "(?:twen|thir|for|fif|six|seven|eigh|nine)t(?:y|ies|ieth)"
_TEENS = "(?:thir|four|fif|six|seven|eigh|nine)teen(?:th)?|ten(?:th)?|eleven(?:th)?|twel(?:ve|fth)|zero|half"
_NUMERAL = re.compile(rf"(?:(?:{_TENS}|{_TEENS}|{_ONES}|(?:hundred|thousand|[mbtr]{{1,2}}illion|dozen)(?:s|th)?|and|a)-?\b)+")
#: Unit words, metric ones with any prefix, and unit signs (case matters).
_UNIT_WORD = re.compile(
    r"(?:kilo|centi|milli|micro|nano|mega|giga|tera|deci|hecto)?(?:met(?:er|re)|gram(?:me)?|lit(?:er|re)|watt|volt|byte|bit|joule|pascal|newton|calorie|ampere|ohm)s?|(?:kilo|mega|giga)?hertz"
    r"|(?:inch(?:es)?|foot|feet|fahrenheit|celsius|kelvin|percent|mph|kmh|rpm|fps|lbs?|oz|ft|yds?|gal|tsps?|tbsps?|hrs?|mins?|secs?)"
    r"|(?:yard|mile|pound|ounce|ton|tonne|gallon|pint|quart|cup|acre|hectare|tablespoon|teaspoon|second|minute|hour|day|week|month|year|decade|dollar|cent|euro|degree|franc|yen|rupee|peso|kilo)s?"
)
_UNIT_SIGN = re.compile(r"(?:[kMGmcdnµu](?:m|g|l|L|W|V|Hz|N|Pa|J|eV|Wh|bps)|[kMGT][Bb]|[mg]|Hz|km/h|m/s|°[CF])[²³23]?")
_EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,/:]*%?(?:st|nd|rd|th)?")
_QUANTITY = re.compile(r"[$€£]?[+-]?\d[\d.,/:]*-?[^\W\d_]+")
_STOP = re.compile(r"[.!?…:][\"')\]»”’]*$")


def _placeholder(core: str, low: str) -> str | None:
    """The type of a number, quantity or unit."""
    if not low.isalpha():
        if _NUMBER.fullmatch(low) or "-" in low and _NUMERAL.fullmatch(low):
            return "<number>"
        if _QUANTITY.fullmatch(low):
            return "<quantity>"
    elif low not in ("and", "a") and _NUMERAL.fullmatch(low):
        return "<number>"
    if len(core) < 6 and _UNIT_SIGN.fullmatch(core) or _UNIT_WORD.fullmatch(low):
        return "<unit>"
    return None


def template_token(word: str, starts: bool) -> tuple[str, str | None]:
    """The template form of a word ("" for bare punctuation) and, if that is a
    placeholder, the slot's value. A capitalised word is a name unless it
    starts a sentence; one with capitals inside it always is."""
    core = word if word.isalnum() else _EDGES.sub("", word)
    low = core.lower()
    if not low:
        return "", None
    if kind := _placeholder(core, low):
        return kind, low
    if core != low and (not starts and core[0].isupper() or core[1:] != low[1:] and not core.isupper()):
        return "<name>", low
    return low, None


def _properties(word: str) -> tuple[int, int, bool, int]:
    """What Templates keeps of a word."""
    core = word if word.isalnum() else _EDGES.sub("", word)
    low = core.lower()
    plain = xxhash.xxh64_intdigest(low) or 1
    folded = plain if low.isascii() and low else xxhash.xxh64_intdigest((core or word).casefold())
    ends = word[-1] not in core[-1:] and _STOP.search(word) is not None
    if not low:
        return 0, 0, ends, folded
    if core == low:
        inside = start = _type_hash(kind) if (kind := _placeholder(core, low)) else plain
    else:
        inside, start = (plain if token == low else _type_hash(token) for token in (template_token(core, False)[0], template_token(core, True)[0]))
    return inside, start, ends, folded


@lru_cache
def _type_hash(kind: str) -> int:
    return xxhash.xxh64_intdigest(kind)


class Templates:
    """What a worker remembers of words: hashes of the template token inside and
    at the start of a sentence (0: none), whether the word ends one, and the
    hash of the case-folded word without punctuation at its edges (bare
    punctuation is kept)."""

    def __init__(self):
        self.memo = HashMemo(MEMO, inside=np.uint64, start=np.uint64, ends=bool, folded=np.uint64)

    def tokens(self, texts: list[bytes]):
        """Of all words of the texts in order: their four properties, whether each
        starts a sentence, and the bounds of the texts."""
        hashes, bounds = hash_words(texts)

        def learn(first):
            owner = np.searchsorted(bounds, first, side="right") - 1
            words, now, split = [""] * len(first), None, []
            for k in np.argsort(first).tolist():
                if owner[k] != now:
                    now, split = owner[k], texts[owner[k]].split()
                words[k] = split[first[k] - bounds[now]].decode("utf-8", "replace")
            inside, start, ends, folded = zip(*map(_properties, words))
            return {"inside": np.array(inside, dtype=np.uint64), "start": np.array(start, dtype=np.uint64), "ends": ends, "folded": np.array(folded, dtype=np.uint64)}

        rows = self.memo.rows(hashes, learn) if len(hashes) else np.zeros(0, dtype=np.int64)
        inside, start, ends, folded = (self.memo[c][rows] for c in ("inside", "start", "ends", "folded"))
        starts = np.concatenate([[True], ends[:-1]])[: len(rows)]
        starts[bounds[:-1][bounds[:-1] < len(rows)]] = True
        return inside, start, folded, starts, bounds


WINDOWS = "id long, row long, form int, at int, size int, need int, hash long, slots array<string>"


def _slots(words: list[str], starts, apart: bool) -> tuple[list, int]:
    """Slots of a window as "type:value", and its number of literals; ``apart``
    takes words at the start of a sentence as such, else as names if capitalised."""
    forms = [template_token(w, bool(s) and apart) for w, s in zip(words, starts)]
    slots = [f"{kind}{value}" for kind, value in forms if value is not None]
    return slots, len(words) - len(slots)


class Slice:
    """The windows of some texts: of the words that are no bare punctuation, read
    with sentence starts apart, without, and case-folded; and of all words."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.inside, start, self.folded, self.starts, self.bounds = worker_memory("templates", Templates).tokens(texts)
        self.real = np.flatnonzero(self.inside)
        tokens = np.where(self.starts, start, self.inside)
        self.forms = [x[self.real] for x in (tokens, self.inside, self.folded)]
        self.split = {}

    def _within(self, places: np.ndarray, n: int) -> np.ndarray:
        """Which runs of n of the words at ``places`` lie in one text."""
        text = np.searchsorted(self.bounds, places, side="right")
        return text[: max(len(places) - n + 1, 0)] == text[n - 1 :]

    def windows(self, n: int):
        """(form, sentence starts apart, starts of windows, their hashes); a form
        of a window that equals an earlier form of it is left out."""
        good = self._within(self.real, n)
        made = []
        for form, apart, tokens in zip((TEMPLATE, TEMPLATE, FOLDED), (True, False, False), self.forms):
            grams = hash_grams(tokens, n) ^ np.uint64(n)
            new = good.copy()
            for before in made:
                new &= grams != before
            made.append(grams)
            at = np.flatnonzero(new)
            yield form, apart, at, grams[at]

    def whole(self, n: int):
        """The same of all words, case-folded."""
        at = np.flatnonzero(self._within(np.arange(len(self.folded)), n))
        return at, (hash_grams(self.folded, n) ^ np.uint64(n) ^ _WHOLE_SALT)[at]

    def place(self, at: int, whole: bool) -> tuple[int, int]:
        """Text of a window and its place among the text's tokens or words."""
        text = int(np.searchsorted(self.bounds, at if whole else self.real[at], side="right")) - 1
        first = self.bounds[text]
        return text, int(at - (first if whole else np.searchsorted(self.real, first)))

    def slots(self, at: int, n: int, apart: bool) -> tuple[list, int]:
        places = self.real[at : at + n]
        text = int(np.searchsorted(self.bounds, places[0], side="right")) - 1
        if text not in self.split:
            self.split = {text: self.texts[text].split()}
        words = [self.split[text][i - self.bounds[text]].decode("utf-8", "replace") for i in places]
        return _slots(words, self.starts[places], apart)


def _windows(table: DataFrame, key: str, text: str, windows_of) -> DataFrame:
    """The WINDOWS rows that windows_of gives for a Slice: of each the text's
    number, form, place, size, need, hash and slots."""

    def run(batches):
        for batch in batches:
            rows = [(k.as_py(), t.as_py() or b"") for k, t in zip(batch.column(0), batch.column(1))]
            for some in in_slices(rows, lambda r: len(r[1])):
                hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in some]
                out = [(some[t][0], hashes[t], *f) for t, *f in windows_of(Slice([t for _, t in some]))]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                    names = ["id", "row", "form", "at", "size", "need", "hash", "slots"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        give_back()

    return table.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, WINDOWS)


def item_windows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of template tokens of the items: id, row (a hash of the text),
    form, position, size, hash, slot values. A window whose words at the start of
    sentences may be names has a second template, and a third form is its
    case-folded words. An item without a window of MIN_WINDOW tokens and
    MIN_LITERALS literals has all windows of its case-folded words instead (form
    WHOLE), of which a copy holds ``need``: all."""

    def windows_of(some: Slice):
        for t in range(len(some.texts)):
            one = Slice(some.texts[t : t + 1])
            n, good = min(WINDOW, len(one.real)), set()
            for form, apart, at, grams in one.windows(n) if n >= MIN_WINDOW else ():
                for i, gram in zip(at.tolist(), grams.view(np.int64).tolist()):
                    slots, literals = one.slots(i, n, apart)
                    if form == TEMPLATE and literals >= MIN_LITERALS:
                        good.add(i)
                        yield t, form, i, n, 0, gram, slots
                    elif form == FOLDED and i in good:
                        yield t, form, i, n, 0, gram, []
            if not good and len(one.folded):
                n = min(WINDOW, len(one.folded))
                at, grams = one.whole(n)
                for i, gram in zip(at.tolist(), grams.view(np.int64).tolist()):
                    yield t, WHOLE, i, n, len(at), gram, []

    return _windows(benchmark, key, text, windows_of)


def window_filter(items: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, as uint64 words: those at the hashes of the windows."""
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    words = items.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def document_windows(docs: DataFrame, key: str, text: str, sizes: dict[int, list[int]], known: np.ndarray) -> DataFrame:
    """The same of documents, in all forms, for the window sizes of each form and
    as far as ``known`` (see window_filter) has their hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def passed(at, grams):
        bit = grams & np.uint64(FILTER_BITS - 1)
        hit = (sent.value[bit >> np.uint64(6)] >> (grams & np.uint64(63))) & np.uint64(1) == 1
        return zip(at[hit].tolist(), grams[hit].view(np.int64).tolist())

    def windows_of(some: Slice):
        for n in sizes.get(TEMPLATE, ()):
            for form, apart, at, grams in some.windows(n):
                for i, gram in passed(at, grams):
                    t, place = some.place(i, False)
                    yield t, form, place, n, 0, gram, some.slots(i, n, apart)[0] if form == TEMPLATE else []
        for n in sizes.get(WHOLE, ()):
            for i, gram in passed(*some.whole(n)):
                t, place = some.place(i, True)
                yield t, WHOLE, place, n, 0, gram, []

    return _windows(docs, key, text, windows_of)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of documents and benchmark items that they contain, literally or
    with other numbers, names or units: doc_id, item_id, n_windows, n_slots,
    changed (some slot has another value).

    Template windows are joined by hash, and so are their case-folded words, so
    that literal copies are found in any case. Windows of a document and an item that
    lie on one diagonal (document place - item place) are one occurrence; it
    counts if its slots are consistent: one item value always stands for one
    document value, and different names stay different.

    Items that are too short for a template window, or whose windows are nearly
    all placeholders, are found where all their words occur in order, whatever
    their case and the punctuation at words' edges; so an item of one word is
    in every document that has this word.

    Nulls and empty texts have no windows; a null id is reported as null (such
    rows as one document). Repeated rows add to n_windows. Empty tables give an
    empty result. Other columns play no part.
    """
    items = materialize(item_windows(benchmark, item, text), "benchmark-windows")
    sizes = {}
    for form, size in sorted(items.select("form", "size").distinct().collect()):  # at most 2 * WINDOW
        sizes.setdefault(form, []).append(size)
    windows = document_windows(docs, key, text, sizes, window_filter(items))
    right = items.select(F.col("id").alias("item_id"), F.col("row").alias("_item_row"), F.col("form").alias("_item_form"), F.col("at").alias("_item_at"), F.col("need").alias("_need"), "hash", F.col("slots").alias("_item_slots"))
    pairs = join_sized(windows, right, ["hash"], "inner", BROADCAST_WINDOWS).withColumn("_diagonal", F.col("at") - F.col("_item_at"))
    slots = F.transform(F.arrays_zip("_item_slots", "slots"), lambda s: F.struct(s["_item_slots"].alias("a"), s["slots"].alias("b")))
    # a window that meets in several forms is one
    forms = F.concat("form", "_item_form")
    met = pairs.groupBy(F.col("id").alias("doc_id"), "item_id", "_diagonal", "at", "row", "_item_row", "_need", forms.alias("_forms"), (F.col("form") == WHOLE).alias("_whole")).agg(
        F.count(F.lit(1)).alias("n"), F.flatten(F.collect_set(slots)).alias("s")
    )
    place = ["doc_id", "item_id", "_diagonal", "row", "_item_row", "_need", "_whole"]
    met = met.groupBy(*place, "at").agg(F.max("n").alias("n"), F.flatten(F.collect_set("s")).alias("s"))
    own = [F.when(F.col("_whole"), F.col(c)).alias(c) for c in ("row", "_item_row")]  # a copy of all words lies in one text
    at = met.groupBy("doc_id", "item_id", "_diagonal", "_need", "_whole", *own).agg(
        F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("s"))).alias("s"), F.size(F.collect_set(F.when(F.col("_whole"), F.col("at")))).alias("_found")
    )
    side = lambda pairs, x: F.size(F.array_distinct(F.transform(pairs, lambda s: s[x])))
    names = F.filter("s", lambda s: s["a"].startswith("<name>"))
    at = at.where((side(F.col("s"), "a") == F.size("s")) & (side(names, "b") == F.size(names)) & (F.col("_found") == F.col("_need")))
    found = at.groupBy("doc_id", "item_id").agg(
        F.sum("n").alias("n_windows"), F.max(F.size("s")).cast("long").alias("n_slots"), F.max(F.exists("s", lambda s: s["a"] != s["b"])).alias("changed")
    )
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that contain a benchmark item. Rows
    without an id cannot be named and stay."""
    leaks = materialize(find_leaks(docs, benchmark, key=key).select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct(), "leaks")
    return join_sized(docs, leaks, [key], "left_anti", DROP_BROADCAST_MAX)
