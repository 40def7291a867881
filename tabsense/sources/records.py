"""Records of delimited files whose quoted cells may hold line breaks, read by many tasks per file.

Where a record starts depends on all quotes before it. A run of lines, though, is only a
function of one bit: given whether it begins inside a quoted cell, does it end inside one?
Lines go into chunks, each chunk is written with the two values of its function, and a
window over these bits composes them in file order, which tells every chunk how it begins.
Chunks are then cut into records on their own; only the record at each edge is put together
from pieces of neighbouring chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store

CHUNK_BYTES = 1_000_000
SNIFF_LINES = 50
PLACE = ["file", "block"]

Line = tuple[str, int, bytes]  # file, block, content


def patterns(delimiter: str) -> tuple[Callable, Callable]:
    """Whether a line that begins outside, or inside, a quoted cell ends outside of one.

    A quote opens a cell only where the cell begins, and two of them inside stand for one.
    """
    d = re.escape(delimiter.encode())
    rest = rb'(?:[^"%b][^%b]*+)?+' % (d, d)
    quoted = rb'[^"]*+(?:""[^"]*+)*+"' + rest
    cell = rb'(?:"%b|%b)' % (quoted, rest)
    more = rb"(?:%b%b)*+\Z" % (d, cell)
    return re.compile(cell + more, re.DOTALL).match, re.compile(quoted + more, re.DOTALL).match


def lines_of(spark, path: str) -> DataFrame:
    """file, block (where the split begins) and content of every line, in file order inside a split."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Neighbouring lines of one split of one file."""
    for batch in batches:
        blocks, files = batch["block"].to_pylist(), batch["file"].to_pylist()
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or blocks[i] != blocks[start] or files[i] != files[start]:
                yield files[start], blocks[start], batch["line"].slice(start, i - start)
                start = i


def _valid(lines: pa.Array) -> bool:
    try:
        lines.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _files(sniff: Callable[[list[str]], str], delimiter: str | None):
    """Per task and file: whether all lines are UTF-8, whether there is a quote, and from the first split the delimiter and the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        valid: dict[str, bool] = {}
        quotes: dict[str, bool] = {}
        heads: dict[str, list[bytes]] = {}
        for file, block, lines in _runs(batches):
            valid[file] = valid.get(file, True) and _valid(lines)
            quotes[file] = quotes.get(file, False) or bool(pc.any(pc.match_substring(lines, '"')).as_py())
            if block == 0 and len(heads.setdefault(file, [])) < SNIFF_LINES:
                # split(b"\r") serves files whose lines end with that alone
                heads[file] += [part for line in lines[: 2 * SNIFF_LINES].to_pylist() for part in line.rstrip(b"\r").split(b"\r")[:SNIFF_LINES] if part.strip(b" \xef\xbb\xbf")]
        rows = []
        for file in valid:
            head = heads.get(file, [])[:SNIFF_LINES]
            d = (delimiter or sniff([line.decode("utf-8", "replace") for line in head])) if head else None
            rows.append((file, valid[file], quotes[file], d, _first_record(head, d) if head else None))
        if rows:
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "valid", "quotes", "delimiter", "header"])

    return run


def _first_record(lines: list[bytes], delimiter: str) -> bytes:
    closed, _ = patterns(delimiter)
    for n in range(1, len(lines) + 1):
        record = b"\n".join(lines[:n])
        if closed(record):
            return record.removeprefix(b"\xef\xbb\xbf")
    return lines[0].removeprefix(b"\xef\xbb\xbf")


def file_facts(lines: DataFrame, sniff: Callable[[list[str]], str], delimiter: str | None) -> DataFrame:
    """One row per file that has a line with content; one scan."""
    found = lines.mapInArrow(_files(sniff, delimiter), "file string, valid boolean, quotes boolean, delimiter string, header binary")
    return found.groupBy("file").agg(F.bool_and("valid").alias("valid"), F.bool_or("quotes").alias("quotes"), F.max("delimiter").alias("delimiter"), F.max("header").alias("header")).where("header is not null")


def _open(delimiter: str):
    """Files with a line that ends inside a quoted cell if it begins outside of one.

    Without such a line every line begins outside, by induction from the first; with one,
    the first of them does begin outside. So the file's state need not be known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed, _ = patterns(delimiter)
        found: set[str] = set()
        for file, _, lines in _runs(batches):
            if file not in found:
                some = lines.filter(pc.match_substring(lines, '"'))
                if not all(closed(line) for line in some.to_pylist()):
                    found.add(file)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found))], ["file"])

    return run


def files_with_open_lines(lines: DataFrame, delimiter: str) -> list[str]:
    return [r["file"] for r in lines.mapInArrow(_open(delimiter), "file string").distinct().collect()]


def _chunks(delimiter: str, chunk_bytes: int):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed, closes = patterns(delimiter)
        place: tuple[str, int] | None = None
        n, size, held, ends = 0, 0, [], [False, True]

        def chunk() -> pa.RecordBatch:
            values = (*place, n, b"\n".join(held), *ends)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [*PLACE, "n", "body", "from_outside", "from_inside"])

        for file, block, lines in _runs(batches):
            if place != (file, block):
                if held:
                    yield chunk()
                place, n, size, held, ends = (file, block), 0, 0, [], [False, True]
            for line in lines.to_pylist():
                held.append(line)
                size += len(line) + 1
                if b'"' in line:
                    ends = [not (closes if inside else closed)(line) for inside in ends]
                if size >= chunk_bytes:
                    yield chunk()
                    n, size, held, ends = n + 1, 0, [], [False, True]
        if held:
            yield chunk()

    return run


def _begins(chunks: DataFrame) -> DataFrame:
    """Adds inside: whether the chunk begins inside a quoted cell.

    Of the functions before a chunk, the last constant one fixes the bit, and the swaps
    since then turn it; without a constant one the file's beginning does, which is outside.
    """
    before = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("from_outside") == F.col("from_inside")
    swaps = F.col("_swaps")
    told = chunks.withColumn("_swaps", F.sum(F.when(~constant & F.col("from_outside"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(constant, F.struct(F.col("from_outside").cast("int").alias("bit"), swaps.alias("at"))), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("_swaps").over(before), F.lit(0))
    return told.withColumn("inside", (F.coalesce(last["bit"] + turned - last["at"], turned) % 2 == 1))


def _cut(delimiter: str):
    """Records of each chunk. ``edge`` is 0 for a whole one, 1 for the rest of a record begun before, 2 for the beginning of one."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed, closes = patterns(delimiter)
        for batch in batches:
            for file, block, n, body, inside in zip(*(batch[c] for c in (*PLACE, "n", "body", "inside"))):
                at = (file.as_py(), block.as_py(), n.as_py())
                rows, held, edge, now = [], [], 1 if inside.as_py() else 0, inside.as_py()
                first = at[1:] == (0, 0)
                for line in body.as_py().split(b"\n"):
                    if not now and not line.strip(b"\r"):
                        continue  # an empty line between records
                    held.append(line)
                    if b'"' in line:
                        now = not (closes if now else closed)(line)
                    if not now:
                        rows.append((*at, edge, first, b"\n".join(held)))
                        held, edge, first = [], 0, False
                if held:  # a chunk inside one record gives a piece with edge 1
                    rows.append((*at, edge or 2, first, b"\n".join(held)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*PLACE, "n", "edge", "first", "record"])

    return run


def split_records(lines: DataFrame, delimiter: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """file, record (bytes) and first (the file's first record) of all records.

    An unclosed cell goes to the end of its file. Empty lines between records are left out.
    """
    chunks = store(lines.mapInArrow(_chunks(delimiter, chunk_bytes), "file string, block long, n long, body binary, from_outside boolean, from_inside boolean"), "chunks")
    begins = _begins(chunks.drop("body")).select(*PLACE, "n", "inside")
    cut = chunks.select(*PLACE, "n", "body").join(begins, [*PLACE, "n"]).mapInArrow(_cut(delimiter), "file string, block long, n long, edge int, first boolean, record binary")
    pieces = store(cut, "records")
    order = Window.partitionBy("file").orderBy("block", "n", "edge")
    whole = F.struct("block", "n", "edge", "first", "record")
    edges = pieces.where("edge > 0").withColumn("number", F.sum(F.when(F.col("edge") == 2, 1).otherwise(0)).over(order)).groupBy("file", "number").agg(F.sort_array(F.collect_list(whole)).alias("p"))
    joined = edges.select("file", F.array_join(F.transform("p", lambda x: F.hex(x["record"])), "0A").alias("hex"), F.exists("p", lambda x: x["first"]).alias("first"))
    return pieces.where("edge = 0").select("file", "first", "record").unionByName(joined.select("file", "first", F.unhex("hex").alias("record")))


def decoded(column: str, encoding: str) -> Column:
    """Text of a record without its carriage return."""
    return F.regexp_replace(F.decode(F.col(column), encoding), "\\r\\z", "")
