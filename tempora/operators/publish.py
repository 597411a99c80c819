"""Subtitle documents for publication: headers scaled to the frame, files by mode, canonical rewrites, the gate before release."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cue_lines, format_timestamp, sanitize_line, sanitize_name
from ..sources.sinks import cut
from .intervals import event_defects
from .journal import document_drift, parse_documents

# The frame that the style is made for, the modes with their file suffixes, and the sections of a document.
FRAME = (1920, 1080)
SUFFIXES = {"source": ".source.ass", "translated": ".translated.ass"}
INFO = "[Script Info]\nScriptType: v4.00+\nPlayResX: %d\nPlayResY: %d\nWrapStyle: 0\nScaledBorderAndShadow: yes\nYCbCr Matrix: None\n\n"
STYLES = (
    "[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, "
    "BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,sans-serif,%d,&H00FFFFFF,&H000000FF,&H00000000,&H7F000000,0,0,0,0,100,100,0,0,1,%s,%s,2,%d,%d,%d,1\n\n"
)
BY_TIME = ["start_ms", "end_ms", "name", "place"]
EVENTS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def document_header(width: Column, height: Column) -> Column:
    """The header of a document for a frame: type and outline follow the narrower axis, margins their own axis."""
    scale = F.least(width / FRAME[0], height / FRAME[1])
    short = lambda value: F.regexp_replace(F.format_string("%.2f", F.round(scale * value, 2)), r"\.?0+$", "")
    whole = lambda value: F.rint(value).cast("bigint")
    side = whole(width * 60 / FRAME[0])
    style = F.format_string(STYLES, F.greatest(F.lit(1), whole(scale * 64)), short(3.0), short(1.5), side, side, whole(height * 40 / FRAME[1]))
    return F.concat(F.format_string(INFO, width, height), style, F.lit(EVENTS))


def _assemble(rows: DataFrame, texts: dict[str, str], frames: DataFrame, order: list[str] = BY_TIME) -> DataFrame:
    """(track_id, mode, document) of rows (track_id, start_ms, end_ms, name, place, a text for each mode) in the order of time, name and place, or another one;
    ``texts`` names the column of each mode.

    Rows are sorted by Spark, which spills; the fold puts lines together and holds the texts of one track. Its header goes before them, so that no
    document is joined, shuffled or sorted.
    """
    size = [F.coalesce(c, F.lit(d)) for c, d in zip(("width", "height"), FRAME, strict=True)]
    columns = list(texts.values())
    headers = frames.select("track_id", document_header(*size).alias("header"))
    both = rows.select("track_id", *BY_TIME, *columns).unionByName(headers, allowMissingColumns=True)
    head = F.concat(F.lit("Dialogue: 0,"), format_timestamp(F.col("start_ms")), F.lit(","), format_timestamp(F.col("end_ms")), F.lit(",Default,"), "name", F.lit(",0,0,0,,"))
    sorted_ = both.repartition("track_id").sortWithinPartitions("track_id", F.col("header").isNull(), *order).select("track_id", "header", head.alias("head"), *columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, parts, out = None, [], {}, []

        def done() -> Iterator[tuple]:
            for mode, pieces in parts.items():
                body = b"".join(pieces)
                for header in found or [None]:
                    yield at[0], header, mode, body

        def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            keys, headers, modes, bodies = zip(*rows, strict=True)
            columns = [pa.array(keys, kind), pa.array(headers, pa.string()), pa.array(modes, pa.string()), pa.array(bodies, pa.binary()).view(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["track_id", "header", "mode", "body"])

        for batch in batches:
            keys, kind = batch["track_id"].to_pylist(), batch["track_id"].type
            edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True):
                if hi == lo:
                    continue
                if [keys[lo]] != at:
                    out += done()
                    at, found, parts = [keys[lo]], [], {}
                    if sum(len(row[3]) for row in out) > 1 << 23 or len(out) > 1_000:
                        yield table(out, kind)
                        out = []
                headers = batch["header"].slice(lo, hi - lo)
                first = lo + len(headers) - headers.null_count
                found += headers.slice(0, first - lo).to_pylist()
                if first < hi:
                    begin = batch["head"].slice(first, hi - first)
                    for mode, column in texts.items():
                        lines = pc.binary_join_element_wise(begin, batch[column].slice(first, hi - first), "\n", "").cast(pa.binary())
                        parts.setdefault(mode, []).append(b"".join(lines.to_pylist()))
        out += done()
        if out:
            yield table(out, kind)

    shape = T.StructType([rows.schema["track_id"]]).add("header", "string").add("mode", "string").add("body", "string")
    usual = document_header(F.lit(FRAME[0]), F.lit(FRAME[1]))
    return sorted_.mapInArrow(fold, shape).select("track_id", "mode", F.concat(F.coalesce("header", usual), "body").alias("document"))


def publish_documents(cues: DataFrame, frames: DataFrame, modes: list[str], source_language: str | None = None, target_language: str | None = None) -> DataFrame:
    """(track_id, mode, file, document): each track's cues in each mode, under the name of its file. Tracks without cues give no row."""
    modes = ["source", "translated", "bilingual"] if modes == ["all"] else modes
    if "bilingual" in modes and not (source_language and target_language):
        raise ValueError("a bilingual file needs both languages")
    text = {m: F.array_join(F.transform(cue_lines(F.col("source"), F.col("translated"), m), sanitize_line), "\\N") for m in modes}
    texts = {m: f"text_{m}" for m in modes}
    rows = cues.select("track_id", "start_ms", "end_ms", sanitize_name(F.col("speaker")).alias("name"), F.col("ordinal").alias("place"), *[text[m].alias(c) for m, c in texts.items()])
    suffix = F.coalesce(*[F.when(F.col("mode") == m, F.lit(s)) for m, s in SUFFIXES.items()], F.lit(f".{source_language}-{target_language}.ass"))
    return _assemble(rows, texts, frames).select("track_id", "mode", F.concat(F.col("track_id").cast("string"), suffix).alias("file"), "document")


def canonical_documents(documents: DataFrame, frames: DataFrame, finer: bool = False) -> DataFrame:
    """(track_id, canonical): documents rewritten with the header of their frame and sorted events; null for those that
    are so already, have no events or hold a line that can't be read.

    Events are sorted by start, end and name as the document has them, in hundredths. With ``finer``, those that start in the same hundredth stay in
    the document's order: it was put in order by times finer than those it shows, as this library's own are.
    """
    parsed = parse_documents(documents)
    sound = parsed.groupBy("track_id").agg(F.count("problem").alias("bad")).where("bad = 0")
    text = F.array_join(F.transform("lines", sanitize_line), "\\N")
    rows = parsed.join(sound, "track_id", "left_semi").select("track_id", "start_ms", "end_ms", sanitize_name(F.col("name")).alias("name"), F.col("line_no").alias("place"), text.alias("text"))
    new = _assemble(rows, {"": "text"}, frames, ["start_ms", "place"] if finer else BY_TIME).select("track_id", F.col("document").alias("canonical"))
    return documents.join(new, "track_id", "left").select("track_id", F.when(F.col("canonical") != F.col("document"), F.col("canonical")).alias("canonical"))


def document_defects(documents: DataFrame) -> DataFrame:
    """(track_id, line_no, kind): lines that can't be read or are empty, and defects of the order and times of the others."""
    return parsed_defects(parse_documents(documents))


def parsed_defects(parsed: DataFrame) -> DataFrame:
    """``document_defects`` of lines that ``parse_documents`` has read."""
    events = parsed.where("problem IS NULL").select("track_id", F.col("line_no").alias("id"), F.col("line_no").alias("ordinal"), "start_ms", "end_ms", F.col("name").alias("speaker"))
    return parsed.where("problem IS NOT NULL").select("track_id", "line_no", F.col("problem").alias("kind")).unionAll(event_defects(events))


def publish_gate(own: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(track_id, mode, kind): why reviewed documents (track_id, mode, document) are refused.

    A kind of defect that the library's ``own`` rendering of the same file has too is tolerated; a file without events (empty) and one whose
    events differ from those of the track's first mode (drift) are not.
    """
    # documents are read once and never stored: what is used several times below are their lines, without the texts, and a mark for each
    keyed = lambda df: df.select(F.struct("track_id", "mode").alias("track_id"), "document")
    lines = lambda df, name, mark=False: cut(parse_documents(keyed(df), mark).select("track_id", "line_no", "start_ms", "end_ms", "name", "problem"), name)
    kinds = lambda parsed: parsed_defects(parsed).select("track_id", "kind").distinct()
    marked = lines(reviewed, "reviewed-lines", True)
    parsed, reviewed = marked.where("line_no >= 0"), marked.where("line_no < 0").select("track_id.track_id", "track_id.mode")
    found = kinds(parsed).join(kinds(lines(own, "own-lines")), ["track_id", "kind"], "left_anti")
    parsed = parsed.where("problem IS NULL")
    names = reviewed.select(F.struct("track_id", "mode").alias("track_id"))
    empty = names.join(parsed, "track_id", "left_anti").select("track_id", F.lit("empty").alias("kind"))
    first = reviewed.groupBy("track_id").agg(F.min("mode").alias("mode"))
    event = parsed.select("track_id", F.col("line_no").alias("ordinal"), "start_ms", "end_ms", F.col("name").alias("speaker"))
    leading = event.join(first.select(F.struct("track_id", "mode").alias("track_id")), "track_id", "left_semi").withColumn("t", F.col("track_id.track_id")).drop("track_id")
    others = reviewed.join(first, ["track_id", "mode"], "left_anti").select(F.struct("track_id", "mode").alias("track_id"), F.col("track_id").alias("t"))
    drift = document_drift(leading.join(others, "t").drop("t"), event.join(others.drop("t"), "track_id", "left_semi")).select("track_id", F.lit("drift").alias("kind"))
    return found.unionByName(empty).unionByName(drift).select("track_id.track_id", "track_id.mode", "kind")
