"""Label documents: one JSON file a labelling pass, read, checked and written.

``<video>.json`` is a video's primary pass, ``<video>.<name>.json`` another one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.vocabulary import FAMILIES, STATES, TARGETS
from spanframe.sources.files import write_files

FIGHTERS = ("red", "blue")

#: A document as it is stored.
DOCUMENT = (
    "video string, fps int, frame_count int, labeler string, labeled_at string, notes string,"
    " rounds array<struct<start:long,end:long,round:int,seeded:boolean>>,"
    " excluded array<struct<start:long,end:long,reason:string>>,"
    " states array<struct<start:long,end:long,state:string>>,"
    " strikes array<struct<frame:long,fighter:string,family:string,target:string,landed:boolean>>,"
    " corner_swaps array<struct<start:long,end:long>>,"
    " takedowns array<struct<frame:long,fighter:string>>"
)
NAMES = ("video", "fps", "frame_count", "labeler", "labeled_at", "notes", "rounds", "excluded", "states", "strikes", "corner_swaps", "takedowns")
#: Lists that a written document has in order, and by what.
SORTED = {"strikes": "frame", "states": "start", "rounds": "start", "excluded": "start", "takedowns": "frame"}


# ---------------------------------------------------------------- reading


def _filled(documents: DataFrame) -> DataFrame:
    """What a document leaves out, by default."""
    c = {n: F.col(n) for n in NAMES}
    empty = {n: F.coalesce(c[n], F.array().cast(documents.schema[n].dataType)) for n in ("rounds", "excluded", "states", "strikes", "corner_swaps", "takedowns")}
    span = lambda r: (r["start"].alias("start"), r["end"].alias("end"))
    return documents.withColumns({
        **{n: F.coalesce(c[n], F.lit("")) for n in ("labeler", "labeled_at", "notes")}, "frame_count": F.coalesce(c["frame_count"], F.lit(0)),
        "rounds": F.transform(empty["rounds"], lambda r: F.struct(*span(r), F.coalesce(r["round"], F.lit(1)).alias("round"), F.coalesce(r["seeded"], F.lit(False)).alias("seeded"))),
        "excluded": F.transform(empty["excluded"], lambda r: F.struct(*span(r), F.coalesce(r["reason"], F.lit("")).alias("reason"))),
        "states": F.transform(empty["states"], lambda r: F.struct(*span(r), F.coalesce(r["state"], F.lit("STRIKING")).alias("state"))),
        **{n: empty[n] for n in ("strikes", "corner_swaps", "takedowns")},
    })


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The documents under ``path`` (a folder, file or pattern), one row each: ``name`` (the
    file's, without .json) and NAMES, with defaults for what is left out. A file that is
    no JSON document fails."""
    t = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    file = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))
    return _filled(t.select(F.regexp_replace(file, r"\.json$", "").alias("name"), *NAMES))


def passes(documents: DataFrame, videos: DataFrame, video: str = "video_name") -> DataFrame:
    """Every pass of each video: the video, ``place`` (0: the primary one, then by name) and
    the document. ``videos`` holds the names of files without their ending. Documents
    meet videos by all beginnings of their name that end at a point, never by a scan of
    pairs."""
    parts = F.split("name", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    t = documents.withColumn(video, F.explode(starts)).join(videos.select(video).distinct(), video)
    # the primary name comes first, as it is the shortest
    earlier = F.struct(F.col("name") != F.col(video), "name")
    order = F.array_sort(F.collect_list(earlier))
    ranks = t.groupBy(video).agg(order.alias("_all"))
    return t.join(ranks, video).withColumn("place", F.array_position("_all", earlier).cast("int") - 1).drop("_all")


# ---------------------------------------------------------------- checking


def quoted(text: Column) -> Column:
    """A text in quotes, as messages show it; null as None."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.isNull(), "None").when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)


def _place(i: Column, part: str) -> Column:
    return F.concat(F.lit(f"{part}["), i.cast("string"), F.lit("]: "))


def _unknown(value: Column, what: str, known: tuple[str, ...]) -> tuple[Column, Column]:
    message = F.concat(F.lit(f"{what} "), quoted(value), F.lit(f" not in {known}"))
    return ~F.coalesce(value.isin(*known), F.lit(False)), message


def _first_based(frame: Column) -> tuple[Column, Column]:
    return frame < 1, F.concat(F.lit("frame "), frame.cast("string"), F.lit(" is not 1-based"))


def _turned(s: Column) -> tuple[Column, Column]:
    return s["end"] < s["start"], F.concat(F.lit("end "), s["end"].cast("string"), F.lit(" before start "), s["start"].cast("string"))


def errors(documents: DataFrame) -> Column:
    """All problems of a document (NAMES), in order, as an array of messages."""

    def each(part: str, rules) -> Column:
        def found(x: Column, i: Column) -> Column:
            return F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), F.concat(_place(i, part), message)) for wrong, message in rules(x))))

        return F.flatten(F.transform(part, found))

    states = F.array_sort(F.transform("states", lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"))))
    after = lambda i: F.get(states, i + 1)
    text = lambda s: F.concat(F.lit("["), s["start"].cast("string"), F.lit(","), s["end"].cast("string"), F.lit("]"))
    overlaps = F.array_compact(F.transform(states, lambda s, i: F.when(after(i)["start"] <= s["end"], F.concat(F.lit("state spans overlap: "), text(s), F.lit(" and "), text(after(i))))))
    fps = F.array_compact(F.array(F.when(F.col("fps") <= 0, F.concat(F.lit("fps must be positive, got "), F.col("fps").cast("string")))))
    return F.concat(
        fps,
        each("strikes", lambda s: (_first_based(s["frame"]), _unknown(s["fighter"], "fighter", FIGHTERS), _unknown(s["family"], "family", FAMILIES), _unknown(s["target"], "target", TARGETS))),
        each("takedowns", lambda t: (_first_based(t["frame"]), _unknown(t["fighter"], "fighter", FIGHTERS))),
        each("states", lambda s: (_unknown(s["state"], "state", STATES), _turned(s))),
        overlaps,
        each("rounds", lambda r: (_turned(r),)),
        each("corner_swaps", lambda c: (_turned(c),)),
    )


def verdict(video: Column, problems: Column) -> Column:
    """The one message of a document with problems; else null."""
    return F.when(F.size(problems) > 0, F.concat(F.size(problems).cast("string"), F.lit(" problem(s) in labels for "), video, F.lit(":\n  "), F.array_join(problems, "\n  ")))


def checked(documents: DataFrame) -> DataFrame:
    """The documents; a job that reads one with problems fails with all of them."""
    message = verdict(F.col("video"), errors(documents))
    return documents.withColumn("video", F.when(message.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("video")))


# ---------------------------------------------------------------- writing


def ordered(documents: DataFrame) -> DataFrame:
    """The lists of SORTED in order; what ties stays as it was. Corner swaps stay."""
    in_order = lambda name, by: F.transform(F.array_sort(F.transform(name, lambda x, i: F.struct(x[by].alias("by"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    return documents.withColumns({name: in_order(name, by) for name, by in SORTED.items()})


def write_labels(documents: DataFrame, folder: str) -> int:
    """Write each document as ``<name>.json`` (two spaces of indent, null as null) into
    ``folder``; returns their number."""
    whole = F.to_json(F.struct(*NAMES), {"ignoreNullFields": "false"})
    return write_files(ordered(documents).select("name", whole.alias("text")), folder, ".json", lambda text: json.dumps(json.loads(text), indent=2))
