"""Readers: supervised and detailed CSV, triplets, dataset versions and log streams."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.operators.ordering import sample_n
from pairloom.schema import (
    LOG_SCHEMA, TRIPLET_COLUMNS, apply_null_policy, require_columns, with_row_key,
)
from pairloom.session import materialise

# Words the CSV reader treats as missing.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class NoInputFilesError(FileNotFoundError):
    """No file matches a source pattern."""


@dataclass(frozen=True)
class CsvSource:
    path: str
    names: tuple[str, ...]


def _csv_sources(spark: SparkSession, pattern: str) -> list[CsvSource]:
    """The files or folders a pattern matches, with their column names.

    Part files of a folder share their header, so one first line is read per match.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = glob.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_record(path) -> list[str]:
        stream, codec = fs.open(path), codecs.getCodec(path)
        stream = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            line = reader.readLine()
            while line is not None and not line.strip("\ufeff \t"):
                line = reader.readLine()
        finally:
            reader.close()
        return next(csv.reader([(line or "").lstrip("\ufeff")]), [])

    def describe(match) -> CsvSource:
        files = fs.listStatus(match.getPath()) if match.isDirectory() else [match]
        names: list[str] = []
        for file in files:
            if not names and not file.getPath().getName().startswith(("_", ".")):
                names = first_record(file.getPath())
        return CsvSource(match.getPath().toString(), tuple(name.strip() for name in names))

    with ThreadPoolExecutor(16) as threads:
        found = threads.map(describe, fs.globStatus(glob) or [])
        return [source for source in found if source.names]


# One field: quoted, with what follows its closing quote; or plain, where quotes are ordinary
# letters; or empty. Possessive, so that long values need no stack.
_CLOSED = '"[^"]*+(?:""[^"]*+)*+"'
_FIELD = f'(?:{_CLOSED}[^,]*+|[^",][^,]*+|)'
_WHOLE = f"\\A{_FIELD}(?:,{_FIELD})*+\\z"
_ENDS = f'\\A[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+\\z'
_STRICT_FIELD = '(?:"[^"\r]*+(?:""[^"\r]*+)*+"|[^",\r][^,\r]*+|)'
_STRICT = f"\\A{_STRICT_FIELD}(?:,{_STRICT_FIELD})*+\r?\\z"
_ANY_FIELD = f',({_CLOSED}[^,]*+|"[^"]*+(?:""[^"]*+)*+|[^",][^,]*+|)'
_BLANK = "\\A[ \t\r]*+\\z"


def record_values(record: Column, places: Column, names: Sequence[str]) -> Column:
    """An array of one struct: the values of a CSV record at `places`, called `names`.

    A value is null where the place is, or where the record has none. A quote opens a quoted
    value only as a value's first character, two quotes in it stand for one, what follows the
    closing quote is appended. Everywhere else quotes are letters.
    """
    fields = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(record, "\r\\z", "")), F.lit(_ANY_FIELD), 1)

    def unquoted(field: Column) -> Column:
        inside = '(?s)\\A"([^"]*+(?:""[^"]*+)*+)"?(.*)\\z'
        return F.when(
            field.startswith('"'),
            F.concat(F.replace(F.regexp_extract(field, inside, 1), F.lit('""'), F.lit('"')), F.regexp_extract(field, inside, 2)),
        ).otherwise(field)

    # a lambda's argument is evaluated once, however many values are taken from it
    return F.transform(F.array(fields), lambda f: F.struct(
        *[unquoted(F.get(f, F.get(places, i))).alias(n) for i, n in enumerate(names)]
    ))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def _odd_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, bool]]:
    """(file, odd) of all files if any is odd, else nothing; files as the scan names them.

    A file is odd if one of its lines is no record of its own by the strict grammar: a value
    goes on in the next line, letters follow a closing quote, or a carriage return stands alone.
    """
    suspect = F.col("value").contains('"') | F.col("value").contains("\r")
    odd = F.coalesce(F.max(suspect & ~F.col("value").rlike(_STRICT)), F.lit(False)).alias("odd")
    files = [(r["path"], r["odd"]) for r in _lines(spark, paths).groupBy("path").agg(odd).collect()]
    return files if any(is_odd for _, is_odd in files) else []


def _read_plain(spark: SparkSession, paths: list[str], names: tuple[str, ...], wanted: list[str]) -> DataFrame:
    """Files whose lines are records: Spark's own reader, with only the wanted columns parsed."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    scan = spark.read.schema(schema).csv(paths, header=True, quote='"', escape='"', encoding="UTF-8")
    return scan.select(
        F.col("_metadata.file_path").alias("path"), *[F.col(f"c{names.index(n)}").alias(n) for n in wanted if n in names]
    )


def _flagged(lines: DataFrame) -> DataFrame:
    """Lines with the state they leave, from without and from within a quoted value.

    A carriage return within a line ends a record as a line break does, so it makes lines of
    its own; `sep` is what ended a line.
    """
    pieces = F.transform(F.array(F.split("value", "\r(?!\\z)")), lambda p: F.struct(F.size(p).alias("n"), p.alias("texts")))
    lines = lines.select("path", "start", "line", "places", F.inline(pieces)).select(
        "path", "start", "line", "places", "n", F.posexplode("texts").alias("part", "text")
    )
    quoted = F.col("text").contains('"')
    return lines.select(
        "path", "start", "line", "part", "text", "places",
        F.when(F.col("part") + 1 < F.col("n"), F.lit("\r")).otherwise(F.lit("\n")).alias("sep"),
        (quoted & ~F.col("text").rlike(_WHOLE)).alias("from_out"),
        (~quoted | ~F.col("text").rlike(_ENDS)).alias("from_in"),
    )


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, whether its end lies within a quoted value, if its start does not (`out`) and
    if it does (`into`). A split's lines follow each other in one task."""
    split, out, into = None, False, True
    for b in batches:
        from_out, from_in = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        places = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        # few lines change a state
        telling = set(np.flatnonzero(from_out | ~from_in).tolist())
        for i, place in enumerate(places):
            if place != split:
                if split is not None:
                    yield _map_row(split, out, into)
                split, out, into = place, False, True
            if i in telling:
                out, into = (bool(from_in[i] if state else from_out[i]) for state in (out, into))
    if split is not None:
        yield _map_row(split, out, into)


def _map_row(split: tuple[str, int], out: bool, into: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [split[0]], "start": [split[1]], "out": [out], "into": [into]})


def _begins(splits: pd.DataFrame) -> pd.DataFrame:
    """Whether each split of a file begins within a quoted value, and whether it begins or ends
    there (`cut`)."""
    splits, inside, begins, cut = splits.sort_values("start"), False, [], []
    for out, into in zip(splits["out"], splits["into"]):
        begins.append(inside)
        inside = bool(into if inside else out)
        cut.append(begins[-1] or inside)
    return pd.DataFrame({"path": splits["path"], "start": splits["start"], "begins": begins, "cut": cut})


_RECORDS = (
    T.StructType().add("path", "string").add("start", "long").add("places", T.ArrayType(T.IntegerType()))
    .add("record", "string").add("whole", "boolean").add("opens", "boolean")
)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines of whole splits, in order; a record that goes on from or into another
    split comes in pieces, at most two per split, with line ends."""
    schema = to_arrow_schema(_RECORDS)
    split, inside, begun, headed, held, of_split = None, False, False, False, [], []
    for b in batches:
        rows = []
        for path, start, places, text, sep, from_out, from_in, blank, begins in zip(*(c.to_pylist() for c in b.columns)):
            if (path, start) != split:
                if held:
                    rows.append((*split, of_split, "".join(held), False, begun))
                split, inside, begun, headed, held, of_split = (path, start), begins, False, False, [], places
            if inside:
                held.append(text + sep)
                inside = from_in
                if not inside:
                    rows.append((path, start, places, "".join(held)[:-1] if begun else "".join(held), begun, False))
                    held, begun = [], False
            elif not blank:
                header, headed = start == 0 and not headed, True
                inside = begun = from_out
                if inside and not header:
                    held.append(text + sep)
                elif not header:
                    rows.append((path, start, places, text, True, False))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*split, of_split, "".join(held), False, begun), schema)], schema=schema)


def _read_odd(spark: SparkSession, files: dict[tuple[str, ...], list[str]], wanted: list[str]) -> DataFrame:
    """Files in which values hold line breaks, or records are not strict; given by their names.

    A line is a map of two states (within a quoted value or not), and so is a split of a file.
    One pass over the lines learns the splits' maps, which tell where each split begins; a
    second puts the records together where the lines are read. Only what a split begins or
    ends with, of records that lie in several, is shuffled. Files that cannot be split are
    read for that only if they end within a quoted value.
    """
    def scan(files: dict[tuple[str, ...], list[str]]) -> DataFrame:
        scans = []
        for names, paths in files.items():
            places = F.array(*[F.lit(names.index(n) if n in names else None).cast("int") for n in wanted])
            scans.append(_flagged(_lines(spark, [_no_glob(path) for path in sorted(paths)]).withColumn("places", places)))
        return reduce(lambda a, b: a.unionByName(b), scans)

    def records(lines: DataFrame) -> DataFrame:
        return lines.join(F.broadcast(begins), ["path", "start"]).select(
            "path", "start", "places", "text", "sep", "from_out", "from_in", F.col("text").rlike(_BLANK).alias("blank"), "begins"
        ).mapInArrow(_records, _RECORDS)

    lines = scan(files)
    maps = lines.select("path", "start", "from_out", "from_in").mapInArrow(
        _split_maps, "path string, start bigint, out boolean, into boolean"
    )
    # a row per split
    begins = materialise(maps.groupBy("path").applyInPandas(_begins, "path string, start bigint, begins boolean, cut boolean"), "csv-splits")
    values = record_values(F.col("record"), F.col("places"), wanted)
    whole = records(lines).where("whole").select("path", "places", "record")
    cut = {_base(unquote(r["path"])) for r in begins.where("cut").select("path").distinct().collect()}
    of_cut = {names: found for names, paths in files.items() if (found := [p for p in paths if not p.endswith(".gz") or _base(p) in cut])}
    if not of_cut:
        return whole.select("path", F.inline(values))
    in_file = W.partitionBy("path").orderBy("start", "opens").rowsBetween(W.unboundedPreceding, 0)
    pieces = records(scan(of_cut)).where("NOT whole").withColumn("number", F.sum(F.col("opens").cast("int")).over(in_file))
    together = pieces.groupBy("path", "places", "number").agg(
        F.sort_array(F.collect_list(F.struct("start", "opens", "record"))).alias("pieces")
    )
    text = F.array_join("pieces.record", "")
    together = together.select("path", "places", F.substring(text, F.lit(1), F.length(text) - 1).alias("record"))
    return whole.unionByName(together).select("path", F.inline(values))


def _base(path: str) -> str:
    """A path with its scheme's slashes as Hadoop prints them."""
    return re.sub(r"^(\w+):/+(?=/)", r"\1:", path)


def read_csv_by_header(spark: SparkSession, pattern: str, wanted: list[str]) -> DataFrame:
    """The wanted columns of all matching CSV files, by name, plus `source_file`.

    Files are grouped by their header; a column a file lacks is null. Lines end with LF, CRLF
    or CR; quoted values may hold line breaks, and blank lines are skipped. A header is one
    line. One pass over the lines finds the files whose lines are not all records; the others
    go to Spark's own reader. All files are read in as many tasks as they have splits.
    """
    sources = _csv_sources(spark, pattern)
    if not sources:
        raise NoInputFilesError(f"no input files match {pattern}")
    files = _odd_files(spark, [_no_glob(source.path) for source in sources])
    plain: dict[tuple[str, ...], list[str]] = defaultdict(list)
    odd: dict[tuple[str, ...], list[str]] = defaultdict(list)
    if not files:
        for source in sources:
            plain[source.names].append(source.path)
    else:
        of = {_base(source.path): source.names for source in sources}
        for path, is_odd in files:
            place = _base(unquote(path))
            names = of[place] if place in of else of[place.rpartition("/")[0]]
            (odd if is_odd else plain)[names].append(place)
    scans = [_read_plain(spark, [_no_glob(path) for path in sorted(paths)], names, wanted) for names, paths in plain.items()]
    if odd:
        scans.append(_read_odd(spark, odd, wanted))
    anywhere = {name for source in sources for name in source.names}
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    values = [F.when(~F.col(f"`{n}`").isin(*MISSING_WORDS), F.col(f"`{n}`")).alias(n) for n in wanted if n in anywhere]
    return require_columns(out.select(*values, _source_file()), [n for n in wanted if n in anywhere])


def _no_glob(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _source_file():
    """Name of the matched file; part files count as their folder. Spark gives paths as URIs."""
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    matched = F.when(name.startswith("part-") & folder.endswith(".csv"), folder).otherwise(name)
    return F.url_decode(F.replace(matched, F.lit("+"), F.lit("%2B"))).alias("source_file")


def read_supervised(spark: SparkSession, pattern: str, negatives: int = 1) -> DataFrame:
    """All `*_supervised.csv` files of a pattern: anchor, positive, negative_1.., source_file."""
    wanted = ["anchor", "positive", *[f"negative_{i + 1}" for i in range(negatives)]]
    frame = read_csv_by_header(spark, pattern, wanted)
    return require_columns(frame, ["anchor", "positive", "negative_1"], pattern)


def read_detailed(spark: SparkSession, path: str) -> DataFrame:
    """The detailed-similarity file: anchor, original_positive, best_other_positive."""
    wanted = ["anchor", "original_positive", "best_other_positive"]
    return require_columns(read_csv_by_header(spark, path, wanted), wanted, path)


def read_triplets(
    spark: SparkSession, path: str, max_samples: int | None = None, seed: int = 42,
    fmt: str = "csv", null_policy: str = "drop",
) -> DataFrame:
    """Triplets of a split with a unique `row_key`, optionally a seeded sample of exact size.

    Rows with a missing text are dropped or keep the word `nan`, by `null_policy`;
    `schema.null_report` counts them.
    """
    if fmt == "csv":
        frame = read_csv_by_header(spark, path, list(TRIPLET_COLUMNS)).drop("source_file")
    else:
        frame = spark.read.format(fmt).load(path)
    frame = apply_null_policy(require_columns(frame, TRIPLET_COLUMNS, path), null_policy)
    if "row_key" not in frame.columns:
        frame = with_row_key(frame.select(*TRIPLET_COLUMNS)).drop("occurrence")
    if max_samples is not None:
        frame = sample_n(frame, max_samples, "row_key", seed)
    return frame


def read_version_split(spark: SparkSession, path: str, data_version: str, split: str) -> DataFrame:
    """One split of one dataset version; the filter prunes partitions."""
    frame = spark.read.parquet(path)
    require_columns(frame, ["data_version", "split"], path)
    return frame.where((F.col("data_version") == data_version) & (F.col("split") == split))


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A finished log as a batch table."""
    return spark.read.schema(LOG_SCHEMA).format(fmt).load(path)


def stream_log(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """A growing log as a stream of rolled files; a file is read once, when it appears."""
    reader = spark.readStream.schema(LOG_SCHEMA).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def number_lines(
    df: DataFrame, run: list[str], order: str, out: str = "line_no", block: int = 1 << 20
) -> DataFrame:
    """Dense line numbers 0, 1, 2.. per run for a source that only has a global order column.

    Lines are cut into blocks of at most `block` values of the unique integer `order`, so one
    window group holds at most `block` lines of a run however long it is; the counts of a
    run's earlier blocks give each block its first number.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy(*run, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*run).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    in_block = F.row_number().over(W.partitionBy(*run, "_block").orderBy(order))
    numbered = blocked.withColumn("_in_block", in_block)
    return (
        numbered.join(firsts.drop("_size"), [*run, "_block"])
        .withColumn(out, F.col("_first") + F.col("_in_block") - 1)
        .drop("_block", "_first", "_in_block")
    )
