"""Delimited text in splits of any size, though values may hold line breaks.

Spark deals a file's lines into splits. Whether a split begins inside a quoted
value depends on all text before it, but there are only two ways to begin: each
task finds where its split ends for both (outside or inside quotes), and the
splits' answers, composed in order, tell each split its own beginning. Records
are then cut where a line ends outside quotes. What a split holds of a record
that another split begins or ends is joined apart: two pieces a split at most.

Values are parsed by Arrow, a batch of whole records at a time, and every column
gets the narrowest type that fits the values of all batches.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import InputError
from ..session import fixed

# fixed values: texts that stand for a missing value, as pandas documents them
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_BOM = b"\xef\xbb\xbf"
_CODECS = {"utf-8-sig": "utf-8", "gbk": "gb18030", "latin-1": "latin-1"}
#: Kinds of values as bits, so that the kinds of batches are combined by or.
BOOLEAN, WHOLE, FRACTION, DATE, TIME, TEXT = (1 << i for i in range(6))
_TYPES = {BOOLEAN: T.BooleanType(), WHOLE: T.LongType(), FRACTION: T.DoubleType(), WHOLE | FRACTION: T.DoubleType(), DATE: T.DateType(), TIME: T.TimestampNTZType(), DATE | TIME: T.TimestampNTZType()}


@dataclass(frozen=True)
class Layout:
    """How a text is written: names of its columns, separator and encoding."""

    names: tuple[str, ...]
    sep: str
    encoding: str


def header(text: str, sep: str) -> list[str]:
    """Trimmed names of the first record; empty ones are numbered, repeated ones too."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader(io.StringIO(text.lstrip("﻿"), newline=""), delimiter=sep), [])):
        name = base = name.strip() or f"Unnamed: {i}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def layout(text: str, encoding: str, sep: str) -> Layout:
    """The layout of a text from its head; a comma separates where the other separator gives no names or no table."""
    names = header(text, sep)
    if sep != ",":
        rows = text.rsplit("\n", 1)[0] if "\n" in text else text
        try:
            parse(rows.encode(), Layout(tuple(names), sep, "utf-8-sig"))
        except InputError:
            names = []
        except pa.ArrowInvalid:  # the head ends within a value
            pass
        if all(n.startswith("Unnamed:") for n in names):
            sep = ","
            names = header(text, sep)
    return Layout(tuple(names), sep, encoding)


def quote_states(block: np.ndarray, inside: bool, sep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the quotes of a block of lines, and whether the text is inside quotes after each.

    A quote opens a value only at its beginning; inside, two quotes stand for one. Where all quotes are of this kind
    the state is their parity; else they are walked through.
    """
    at = np.flatnonzero(block == 0x22)
    before = block[at - 1] if len(at) else block[:0]
    next_to = np.diff(at, prepend=-2) == 1  # the byte before is a quote
    opens = (at == 0) | (before == sep) | (before == 0x0A)
    parity = (np.arange(1, len(at) + 1) + inside) % 2 == 1
    if (opens | next_to | ~parity).all():
        return at, parity
    out, state, pair = [], inside, False
    followed = np.r_[next_to[1:], False].tolist()
    for may_open, doubled in zip(opens.tolist(), followed):
        if pair:
            pair = False
        elif not state:
            state = may_open
        elif doubled:
            pair = True
        else:
            state = False
        out.append(state)
    return at, np.array(out, bool)


class Records:
    """Cuts the lines of one split into whole records. ``head`` and ``held``: what belongs to a record of an earlier or later split."""

    def __init__(self, sep: str, inside: bool = False, skips: bool = False):
        """``skips``: the first record is the header of a file."""
        self.sep, self.inside, self.skips = ord(sep), inside, skips
        self.head: list[bytes] = []
        self.held: list[bytes] = []
        self.headless = inside or skips

    def feed(self, lines: bytes) -> bytes:
        """The records that these lines complete."""
        block = np.frombuffer(lines, np.uint8)
        at, after = quote_states(block, self.inside, self.sep)
        breaks = np.flatnonzero(block == 0x0A)
        state = np.r_[self.inside, after][np.searchsorted(at, breaks)]
        ends = breaks[~state] + 1
        if len(after):
            self.inside = bool(after[-1])
        first = 0
        if self.headless:
            if not len(ends):
                self.head.append(lines)
                return b""
            first = int(ends[0])
            self.head.append(lines[:first])
            self.headless = False
        last = int(ends[-1]) if len(ends) else first
        if last == first:
            self.held.append(lines[first:])
            return b""
        found = b"".join([*self.held, lines[first:last]])
        self.held = [lines[last:]]
        return found


def _options(layout: Layout, size: int, types: dict | None, wrong, only: list[str] | None = None) -> dict:
    kinds = ({"column_types": types} if types else {}) | ({"include_columns": only} if only else {})
    return {
        "read_options": arrow_csv.ReadOptions(column_names=list(layout.names), use_threads=False, block_size=max(size + 1, 1 << 10)),
        "parse_options": arrow_csv.ParseOptions(delimiter=layout.sep, newlines_in_values=True, ignore_empty_lines=True, invalid_row_handler=wrong),
        "convert_options": arrow_csv.ConvertOptions(null_values=MISSING, strings_can_be_null=True, true_values=["true", "True", "TRUE"], false_values=["false", "False", "FALSE"], **kinds),
    }


def parse(block: bytes, layout: Layout, types: dict | None = None, aside: list[str] | None = None, only: list[str] | None = None) -> list[pa.Table]:
    """Whole records as tables of these Arrow types, or of those that the values suggest; of all columns, or ``only`` some.

    Records that are short of values end in nulls (a table of their own); those with more values than the header has are
    put ``aside`` if there is such a list, else an error.
    """
    short: list[str] = []
    long: list[str] = []

    def wrong(row) -> str:
        if row.actual_columns > row.expected_columns:
            if aside is not None:
                aside.append(row.text)
                return "skip"
            long.append(f"{row.actual_columns} values for {row.expected_columns} columns: {(row.text or '')[:80]!r}")
            return "error"
        short.append(row.text + layout.sep * (row.expected_columns - row.actual_columns))
        return "skip"

    def read(data: bytes) -> pa.Table:
        try:
            return arrow_csv.read_csv(io.BytesIO(data), **_options(layout, len(data), types, wrong, only))
        except pa.ArrowInvalid as e:
            if long:
                raise InputError(f"a row has {long[0]}") from e
            try:
                data.decode()
            except UnicodeDecodeError:
                short.clear()
                if aside is not None:
                    aside.clear()
                return read(data.decode("utf-8", "replace").encode())
            raise

    found = [read(block)] if block.strip(b"\r\n") else []
    if short:
        padded, short = "\n".join(short).encode(), []
        found.append(read(padded))
    return found


def kind_of(kind: pa.DataType) -> int:
    """The bit of an Arrow type; 0 for a column without values."""
    if pa.types.is_null(kind):
        return 0
    if pa.types.is_timestamp(kind):
        return TEXT if kind.tz else TIME
    tests = ((pa.types.is_boolean, BOOLEAN), (pa.types.is_integer, WHOLE), (pa.types.is_floating, FRACTION), (pa.types.is_date, DATE))
    return next((bit for fits, bit in tests if fits(kind)), TEXT)


def _kinds(block: bytes, layout: Layout, lenient: bool = False) -> np.ndarray:
    """The kinds of values that each column of some records has."""
    found = np.zeros(len(layout.names), np.int32)
    for table in parse(block, layout, aside=[] if lenient else None):
        found |= [kind_of(f.type) for f in table.schema]
    return found


def _records(text: str, layout: Layout) -> bytes:
    """The whole records of a head of whole lines."""
    return Records(layout.sep, skips=True).feed(text.lstrip("\ufeff").encode())


def bare(text: str, layout: Layout) -> bool:
    """Whether a text is no more than a header."""
    return not _records(text if text.endswith("\n") else text + "\n", layout).strip(b"\r\n")


def guess(text: str, layout: Layout) -> np.ndarray | None:
    """The kinds of values that each column of a head has in whole records, 0 without values; None if they don't read as a table."""
    try:
        return _kinds(_records(text, layout), layout)
    except (InputError, pa.ArrowInvalid):
        return None


def broken(text: str, layout: Layout) -> bool:
    """Whether values of a head hold line breaks."""
    block = np.frombuffer(text.encode(), np.uint8)
    at, after = quote_states(block, False, ord(layout.sep))
    return bool(np.r_[False, after][np.searchsorted(at, np.flatnonzero(block == 0x0A))].any())


def _schema(layout: Layout, kinds) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES.get(int(k), T.StringType())) for n, k in zip(layout.names, kinds)])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of their splits, each with its file and where its split begins."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _splits(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, start, blocks of whole lines in UTF-8) of the splits of a task."""
    codec = _CODECS[layout.encoding]

    def segments():
        for batch in batches:
            if not batch.num_rows:
                continue
            start = np.asarray(batch.column(1))
            name = pc.dictionary_encode(batch.column(0))
            change = np.flatnonzero(np.diff(start) | np.diff(np.asarray(name.indices))) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                lines = batch.column(2).slice(a, b - a)
                block = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), lines), b"\n")[0].as_py() + b"\n"
                yield batch.column(0)[int(a)].as_py(), int(start[a]), block if codec == "utf-8" else block.decode(codec, "replace").encode()

    def blocks(parts, start):
        for k, (_, _, block) in enumerate(parts):
            yield block.removeprefix(_BOM) if not k and not start else block

    for (file, start), parts in itertools.groupby(segments(), key=lambda x: x[:2]):
        yield file, start, blocks(parts, start)


Begins = dict[str, dict[int, bool]]


def _begins_inside(begins: Begins, file: str, start: int) -> bool:
    """Whether a split begins inside quotes; files that aren't listed have no such split."""
    known = begins.get(file)
    if known is None:
        return False
    if start not in known:
        raise InputError("the files or how they are split have changed since they were first looked at; read them again")
    return known[start]


def _survey(lines: DataFrame, layout: Layout, begins: Begins, typed: bool, lenient: bool = False) -> DataFrame:
    """For each split: where it ends if it begins outside quotes (``out``: inside?) and if it begins inside (``ins``), and the kinds of its values."""

    def run(batches):
        for file, start, blocks in _splits(batches, layout):
            records = Records(layout.sep, _begins_inside(begins, file, start), start == 0)
            other, same = not records.inside, False
            kinds = np.zeros(len(layout.names), np.int32)
            for block in blocks:
                if not same:
                    after = quote_states(np.frombuffer(block, np.uint8), other, ord(layout.sep))[1]
                    other = bool(after[-1]) if len(after) else other
                found = records.feed(block)
                same = same or other == records.inside
                if typed and found:
                    kinds |= _kinds(found, layout, lenient)
            mine, theirs = records.inside, records.inside if same else other
            out, ins = (theirs, mine) if _begins_inside(begins, file, start) else (mine, theirs)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([out]), pa.array([ins]), pa.array([kinds.tolist()], pa.list_(pa.int32()))], names=["file", "start", "out", "ins", "kinds"])

    return fixed(lines.mapInArrow(run, "file string, start long, out boolean, ins boolean, kinds array<int>"))


def _torn(survey: DataFrame) -> Begins:
    """How the splits begin, of files in which a split ends inside quotes. The driver's own list of splits is as long."""
    files: dict[str, list] = {}
    for r in survey.join(survey.where("out").select("file").distinct(), "file", "left_semi").select("file", "start", "out", "ins").collect():
        files.setdefault(r["file"], []).append((r["start"], r["out"], r["ins"]))
    begins: Begins = {}
    for file, splits in files.items():
        inside = False
        for start, out, ins in sorted(splits):
            begins.setdefault(file, {})[start] = inside
            inside = ins if inside else out
    return begins


def _pieces(lines: DataFrame, layout: Layout, begins: Begins) -> DataFrame:
    """``record``: the records that lie in several splits, whole."""

    def run(batches):
        for file, start, blocks in _splits(batches, layout):
            inside = _begins_inside(begins, file, start)
            records = Records(layout.sep, inside, start == 0)
            for block in blocks:
                records.feed(block)
            pieces = [(False, records.head)] * inside + [(True, records.held)] * (records.inside and not records.headless)
            for opens, data in pieces:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([opens]), pa.array([b"".join(data)], pa.binary())], names=["file", "start", "opens", "data"])

    # a filter on file names alone would prune files, and with less text to share out Spark would split it otherwise
    found = lines.where(F.col("file").isin(list(begins)) | (F.octet_length("value") < 0)).mapInArrow(run, "file string, start long, opens boolean, data binary")
    # a piece that ends a record comes before that which begins the next; a header's pieces begin none
    numbered = found.withColumn("record", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("start", "opens"))).where("record > 0")
    whole = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "opens", "data"))).alias("p"))
    return whole.select(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("record"))


def _arrow_types(schema: T.StructType) -> dict:
    direct = set(_TYPES.values())
    return {f.name: to_arrow_type(f.dataType if f.dataType in direct else T.StringType()) for f in schema}


def _fitted(table: pa.Table, types: dict) -> pa.Table:
    """Texts as these types; what doesn't fit is null."""

    def value(x, kind):
        try:
            return x.cast(kind).as_py()
        except pa.ArrowInvalid:
            return None

    out = []
    for column, kind in zip(table.columns, types.values()):
        try:
            out.append(column.cast(kind))
        except pa.ArrowInvalid:
            out.append(pa.array([value(x, kind) for x in column], kind))
    return pa.table(out, names=table.column_names)


def _typed(block: bytes, layout: Layout, types: dict, aside: str | None = None) -> Iterator[pa.RecordBatch]:
    long: list[str] | None = [] if aside else None
    try:
        tables = parse(block, layout, types, long)
    except pa.ArrowInvalid:
        long = [] if aside else None
        tables = [_fitted(t, types) for t in parse(block, layout, dict.fromkeys(types, pa.string()), long)]
    for batch in (b for t in tables for b in t.to_batches()):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.string())], names=[*types, aside]) if aside else batch
    if long:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(long), t) for t in types.values()), pa.array(long, pa.string())], names=[*types, aside])


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    direct = set(_TYPES.values()) | {T.StringType()}
    return df.select(*[F.col(f"`{f.name}`") if f.dataType in direct else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def _parsed(schema: T.StructType) -> T.StructType:
    direct = set(_TYPES.values())
    return T.StructType([T.StructField(f.name, f.dataType if f.dataType in direct else T.StringType()) for f in schema])


def _rows(lines: DataFrame, layout: Layout, schema: T.StructType, begins: Begins, aside: str | None = None) -> DataFrame:
    """The records that lie in one split, and those that lie in several; with ``aside``, a column of that name holds records with too many values."""
    types = _arrow_types(schema)
    if aside:
        schema = T.StructType([*schema, T.StructField(aside, T.StringType())])

    def run(batches):
        for file, start, blocks in _splits(batches, layout):
            records = Records(layout.sep, _begins_inside(begins, file, start), start == 0)
            for block in blocks:
                if found := records.feed(block):
                    yield from _typed(found, layout, types, aside)

    def whole(batches):
        for batch in batches:
            for record in batch.column(0).to_pylist():
                yield from _typed(record, layout, types, aside)

    rows = lines.mapInArrow(run, _parsed(schema))
    if begins:
        rows = rows.unionByName(_pieces(lines, layout, begins).mapInArrow(whole, _parsed(schema)))
    return _cast(rows, schema)


def _kinds_of_pieces(lines: DataFrame, layout: Layout, begins: Begins, lenient: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [_kinds(record, layout, lenient).tolist() for record in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["kinds"])

    return _pieces(lines, layout, begins).mapInArrow(run, "kinds array<int>")


def read(spark: SparkSession, path: str | list[str], layout: Layout, schema: T.StructType | None = None, aside: str | None = None) -> DataFrame:
    """Delimited text of a file, a folder, a pattern or some files; every file begins with a header.

    One pass finds how splits begin and what types fit all rows (another follows only if a split begins inside a value); the
    rows themselves are read lazily. With a schema, columns go by their place, and values that don't fit are null.
    Records with more values than the header are an error, or with ``aside`` rows that have but a column of that name.
    """
    lines = _lines(spark, path)
    survey = _survey(lines, layout, {}, schema is None, bool(aside))
    begins = _torn(survey)
    if schema is not None:
        layout = Layout(tuple(schema.names), layout.sep, layout.encoding)
    else:
        kinds = survey.select("kinds")
        if begins:
            kinds = _survey(lines, layout, begins, True, bool(aside)).select("kinds").unionByName(_kinds_of_pieces(lines, layout, begins, bool(aside)))
        found = kinds.agg(*[F.bit_or(F.col("kinds")[i]).alias(f"k{i}") for i in range(len(layout.names))]).first()
        schema = _schema(layout, [k or 0 for k in found])
    return _rows(lines, layout, schema, begins, aside)


def _written(lines: DataFrame, layout: Layout, kinds: np.ndarray, begins: Begins, table: str) -> tuple[int, int, np.ndarray]:
    """Writes the rows with the types of these kinds, columns without a kind as text.

    How many splits end inside quotes unforeseen, how many tasks met values that don't fit, and the kinds with those of the columns that had none.
    """
    wrong = "wrong"
    while wrong in layout.names:
        wrong += "_"
    schema = _schema(layout, kinds)
    types = _arrow_types(schema)
    open_at = np.flatnonzero(np.asarray(kinds) == 0)
    marks = pa.list_(pa.int32())

    class Task:
        """What a task has to tell: torn splits, whether values don't fit, kinds of the open columns."""

        def __init__(self):
            self.torn = self.unfit = 0
            self.kinds = np.zeros(len(layout.names), np.int32)

        def typed(self, block):
            try:
                for t in parse(block, layout, types):
                    self.look(t, block)
                    for batch in t.to_batches():
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, marks)], names=[*layout.names, wrong])
            except (pa.ArrowInvalid, InputError):
                self.unfit = 1

        def look(self, t, block):
            some = [i for i in open_at if not self.kinds[i] & TEXT and t.column(int(i)).null_count < t.num_rows]
            if some:
                for found in parse(block, layout, only=[layout.names[i] for i in some]):
                    self.kinds[some] |= [kind_of(f.type) for f in found.schema]

        def told(self):
            if self.torn or self.unfit or self.kinds.any():
                mark = pa.array([[self.torn, self.unfit, *self.kinds[open_at].tolist()]], marks)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types.values()], mark], names=[*layout.names, wrong])

    def run(batches):
        task = Task()
        for file, start, blocks in _splits(batches, layout):
            records = Records(layout.sep, _begins_inside(begins, file, start), start == 0)
            for block in blocks:
                found = records.feed(block)
                yield from task.typed(found) if found and not task.unfit else []
            task.torn += records.inside and file not in begins
        yield from task.told()

    def whole(batches):
        task = Task()
        for batch in batches:
            for record in batch.column(0).to_pylist():
                yield from task.typed(record)
        yield from task.told()

    kind = T.StructType([*schema, T.StructField(wrong, T.ArrayType(T.IntegerType()))])
    rows = lines.mapInArrow(run, kind)
    if begins:
        rows = rows.unionByName(_pieces(lines, layout, begins).mapInArrow(whole, kind))
    seen, told = Observation(), F.col(wrong)
    counts = [F.sum(told[0]).alias("torn"), F.sum(told[1]).alias("unfit"), *[F.bit_or(told[k + 2]).alias(f"k{i}") for k, i in enumerate(open_at)]]
    rows.observe(seen, *counts).where(told.isNull()).drop(wrong).write.mode("overwrite").parquet(table)
    got = seen.get
    return got["torn"] or 0, got["unfit"] or 0, np.array([k or got.get(f"k{i}") or 0 for i, k in enumerate(kinds)], np.int32)


def ingest(spark: SparkSession, path: str, layout: Layout, kinds: np.ndarray | None, table: str, broken: bool = False) -> DataFrame:
    """Delimited text as a Parquet table, in one pass if the kinds of values of its head fit all rows and no value lies in two splits.

    Splits that end inside quotes and batches with values that don't fit are counted while the table is written. If values are
    torn (``broken``: the head has values with line breaks, so that is looked for first), the splits' beginnings are found without
    parsing, and the rows are written with the same types. If these don't fit, the text is looked at as a whole, and written again.
    The kinds of columns that are empty in the head are found while they are written as text; if they aren't text, the table is written again.
    """
    if kinds is not None:
        lines = _lines(spark, path)
        begins = _torn(_survey(lines, layout, {}, False)) if broken else {}
        torn, unfit, found = _written(lines, layout, kinds, begins, table)
        if torn and not unfit and (begins := _torn(_survey(lines, layout, {}, False))):
            torn, unfit, found = _written(lines, layout, kinds, begins, table)
        if not torn and not unfit and _schema(layout, found) != _schema(layout, kinds):
            torn, unfit, _ = _written(lines, layout, found, begins, table)
        if not torn and not unfit:
            return spark.read.parquet(table)
    read(spark, path, layout).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def read_text(spark: SparkSession, text: str, layout: Layout) -> DataFrame:
    """Delimited text that the driver has already."""
    records = Records(layout.sep, skips=True)
    whole = records.feed((text if text.endswith("\n") else text + "\n").encode())
    block = b"".join([whole, *records.held])
    schema = _schema(layout, _kinds(block, layout))
    tables = parse(block, layout, _arrow_types(schema)) or [pa.table({f.name: pa.array([], k) for f, k in zip(schema, _arrow_types(schema).values())})]
    return spark.createDataFrame(pa.concat_tables(tables))
