"""Records of delimited text whose quoted fields hold line breaks, read by many tasks.

Where a record begins depends on the quotes before it, so a block of a file
does not know by itself whether its first line goes on inside a field. It
can tell, though, how it ends in either case, which is a function of two values
to two values. These functions are composed along each file, a block per row,
and give every block its start. Then every block assembles its own records, and only
the pieces at its edges, at most two per block, are brought together.

Whether a line ends inside a field is decided as the reader's own grammar does: a
quote opens a field at its beginning only, doubled quotes stand for one, and
after a closing quote anything up to the delimiter belongs to the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Blocks that may start inside a field; beyond that files are read whole.
MOST_BLOCKS = 100_000
#: Bytes of records that a task gives out at once.
CHUNK = 4_000_000

BLOCKS = ("file string, start long, end_out boolean, end_in boolean, head binary, tail_out binary, tail_in binary, lone boolean")


def closed_lines(delimiter: str, trim: bool) -> tuple[str, str]:
    """Patterns of whole lines that end outside quotes: of those that begin outside, and inside a quoted field.

    All repeats are possessive, so a line is read once.
    """
    d = re.escape(delimiter)
    rest = f"[^{d}]*+"
    blank = "" if not trim else r"[\x00-\x20]*+" if delimiter > " " else r"[\x00-\x08\x0a-\x20]*+" if delimiter == "\t" else r"[\x00-\x1f]*+"
    until = '(?:[^"]++|"")*+"' + rest
    field = f'{blank}(?:"{until}|(?!"){rest})'
    more = f"(?:{d}{field})*+"
    return field + more, until + more


def lines_of(spark: SparkSession, path, line_sep: str) -> DataFrame:
    """(value, file, start): the lines of the files, with the block that holds their beginning."""
    lines = spark.read.option("lineSep", line_sep).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def is_open(line: Column, delimiter: str, trim: bool) -> Column:
    """Whether a line that begins outside quotes ends inside a field."""
    return F.contains(line, F.lit('"')) & ~line.rlike(rf"\A(?:{closed_lines(delimiter, trim)[0]})\z")


class _Track:
    """How the lines of a block go if it starts outside or inside a field."""

    def __init__(self, inside: bool, rules: tuple[re.Pattern, re.Pattern]) -> None:
        self.inside, self.in_head, self.rules = inside, inside, rules
        self.head: list[bytes] = []
        self.open: list[bytes] = []

    def plain(self, lines: list[bytes]) -> None:
        """Lines without a quote leave everything as it is."""
        if self.inside:
            (self.head if self.in_head else self.open).extend(lines)

    def quoted(self, line: bytes) -> list[bytes] | None:
        """A line with quotes; the lines of the record that it ends, if that began in this block."""
        self.inside, was_head = self.rules[self.inside].fullmatch(line) is None, self.in_head
        (self.head if was_head else self.open).append(line)
        if self.inside:
            return None
        self.in_head = False
        ended, self.open = self.open, []
        return None if was_head else ended


def _rules(delimiter: str, trim: bool) -> tuple[re.Pattern, re.Pattern]:
    outside, inside = (re.compile(p.encode()) for p in closed_lines(delimiter, trim))
    return outside, inside


def block_ends(lines: DataFrame, delimiter: str, trim: bool, line_sep: str) -> DataFrame:
    """Per block: whether it ends inside a field if it starts outside and if it starts inside, and the pieces at its edges.

    `head` goes up to the line that closes the field in which the block starts, or is all of it; the tails begin with the
    record that is open at its end. `lone` tells of carriage returns that no line feed follows.
    """
    join, names = line_sep.encode(), [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, block = _rules(delimiter, trim), None

        def row() -> pa.RecordBatch:
            out, last = tracks[0], tracks[-1]  # one track is left where both have met outside
            tails = [join.join(t.open) if t.inside and not t.in_head else None for t in (out, last)]
            values = [*block[:2], out.inside, last.inside, join.join(first_inside.head), *tails, lone]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for here, values, quoted in _parts(batches):
            if here != block:
                if block is not None:
                    yield row()
                block, lone = here, False
                tracks = [_Track(False, rules), _Track(True, rules)]
                first_inside = tracks[1]
            lone = lone or join == b"\n" and any(b"\r" in v[:-1] for v in values)
            at = 0
            for i in quoted:
                for track in tracks:
                    track.plain(values[at:i])
                    track.quoted(values[i])
                if len(tracks) == 2 and not tracks[0].inside and not tracks[1].inside:
                    tracks.pop()
                at = i + 1
            for track in tracks:
                track.plain(values[at:])
        if block is not None:
            yield row()

    return lines.select("file", "start", F.lit(False).alias("inside"), F.col("value").cast("binary").alias("value")).mapInArrow(work, BLOCKS)


def starts(blocks: DataFrame) -> DataFrame:
    """The blocks with `inside`: whether each starts inside a field."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("end_out") == F.col("end_in")  # ends alike however it starts
    since = Window.partitionBy("file", "__fixed").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("end_out") & ~F.col("end_in")).cast("int")).over(since), F.lit(0)) % 2 == 1
    known = F.coalesce(F.last(F.when(fixed, F.col("end_out")), ignorenulls=True).over(before), F.lit(False))
    numbered = blocks.withColumns({"__fixed": F.coalesce(F.sum(fixed.cast("int")).over(before), F.lit(0)), "__known": known})
    return numbered.withColumn("inside", F.col("__known") != swaps).drop("__fixed", "__known")


def edge_records(blocks: DataFrame, line_sep: str) -> DataFrame:
    """(file, value) of the records that lie in several blocks, from their pieces."""
    tail = F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out"))
    pieces = F.array(F.struct(F.lit(0).alias("order"), F.when(F.col("inside"), F.col("head")).alias("text")),
                     F.struct(F.lit(1).alias("order"), tail.alias("text")))
    rows = blocks.select("file", "start", F.inline(pieces)).where("text IS NOT NULL")
    so_far = Window.partitionBy("file").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("record", F.sum("order").over(so_far))  # a tail begins a record
    joined = rows.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "order", F.col("text").cast("string").alias("text")))).alias("all"))
    return joined.select("file", F.concat_ws(line_sep, F.col("all.text")).alias("value"))


def inner_records(lines: DataFrame, delimiter: str, trim: bool, line_sep: str, skip_first: bool) -> DataFrame:
    """(file, value binary) of the records that lie in one block, from lines (file, start, inside, value) in the order of the scan."""
    join = line_sep.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, block, out, size = _rules(delimiter, trim), None, [], 0

        def records() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block[0]] * len(out), pa.string()), pa.array(out, pa.binary())], ["file", "value"])

        for here, values, quoted in _parts(batches):
            if here != block:
                if out:
                    yield records()
                block, out, size = here, [], 0
                track, skip = _Track(here[2], rules), skip_first and here[1] == 0
            begin, at = len(out), 0
            for i in [*quoted, len(values)]:
                if track.inside:
                    track.plain(values[at:i])
                else:
                    out += values[at:i]
                if i < len(values):
                    ended = track.quoted(values[i])
                    if ended:
                        out.append(join.join(ended))
                at = i + 1
            if skip and len(out) > begin:
                del out[begin]
                skip = False
            size += sum(map(len, out[begin:]))
            if size > CHUNK:
                yield records()
                out, size = [], 0
        if out:
            yield records()

    return lines.select("file", "start", "inside", F.col("value").cast("binary").alias("value")).mapInArrow(work, "file string, value binary")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, bool], list[bytes], list[int]]]:
    """(block, lines, those with a quote) of batches (file, start, inside, value); a block may come in several parts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, start = batch.column(0), batch.column(1)
        change = [0]
        if n > 1:
            same = pc.and_(pc.equal(file.slice(1), file.slice(0, n - 1)), pc.equal(start.slice(1), start.slice(0, n - 1)))
            change += [i + 1 for i in pc.indices_nonzero(pc.invert(same)).to_pylist()]
        for first, last in zip(change, [*change[1:], n], strict=True):
            values = batch.column(3).slice(first, last - first)
            yield ((file[first].as_py(), start[first].as_py(), batch.column(2)[first].as_py()), values.to_pylist(),
                   pc.indices_nonzero(pc.match_substring(values, '"')).to_pylist())


def quoted_records(spark: SparkSession, path, delimiter: str, trim: bool, line_sep: str, skip_first: bool, charset: str) -> DataFrame | None:
    """(file, value) of every record, or None where the files have to be read whole.

    That is where a carriage return alone may end lines, and where more than MOST_BLOCKS blocks start inside a field.
    `skip_first` leaves out the first record of each file, which must end in the file's first block.
    """
    lines = lines_of(spark, path, line_sep)
    blocks = written(starts(written(block_ends(lines, delimiter, trim, line_sep), "csv-blocks")), "csv-starts")
    look = blocks.agg(F.count_if("inside").alias("inside"), F.max("lone").alias("lone")).first()
    if look["lone"] or look["inside"] > MOST_BLOCKS:
        return None
    inside = blocks.where("inside").select("file", "start", "inside")
    lines = lines.join(F.broadcast(inside), ["file", "start"], "left")  # streams the lines in their order
    inner = inner_records(lines.withColumn("inside", F.coalesce("inside", F.lit(False))), delimiter, trim, line_sep, skip_first)
    value = F.col("value").cast("string") if charset == "UTF-8" else F.decode("value", charset)
    edges = edge_records(blocks, line_sep).select("file", F.col("value").cast("binary").alias("value"))
    records = inner.unionByName(edges).withColumn("value", value)
    if line_sep != "\n":
        return records
    # line ends within fields become line feeds, as the reader of whole files makes them
    return records.withColumn("value", F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\r\z", ""))
