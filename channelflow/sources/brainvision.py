"""Recordings of a text header (.vhdr), a marker file (.vmrk) and a binary data file, as a Python data source.

The header tells the number of channels, their names and resolutions, the number format and the layout; partitions are ranges of samples of the data file, each read by byte offsets, so a long
recording is many tasks and nothing but headers is read by the driver. Files are reached through pyarrow's file systems (local folders, HDFS, object stores).
"""

from __future__ import annotations

import configparser
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_A_PARTITION = 1 << 18
ROWS_A_BATCH = 1 << 13
FORMATS = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4", "IEEE_FLOAT_64": "<f8"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


@dataclass(frozen=True)
class Header:
    """What the header file says of its recording."""

    data: str
    marker: str | None
    names: tuple[str, ...]
    units: tuple[str, ...]
    resolutions: tuple[float, ...]
    kind: str
    multiplexed: bool
    interval: float  # microseconds

    @classmethod
    def parse(cls, text: str) -> Header:
        """Sections of key=value lines; lines of a [Comment] and those beginning with a semicolon say nothing. What this reader doesn't know is an error."""
        body = text[text.find("[") :]
        at = body.lower().find("[comment]")
        parser = configparser.RawConfigParser(comment_prefixes=(";",), delimiters=("=",), strict=False, interpolation=None)
        parser.read_string(body[:at] if at >= 0 else body)
        sections = {s.lower(): {k.lower(): v for k, v in parser.items(s)} for s in parser.sections()}
        common, binary, channels = (sections.get(s, {}) for s in ("common infos", "binary infos", "channel infos"))
        n = int(common["numberofchannels"])
        if common.get("dataformat", "BINARY").upper() != "BINARY":
            raise ValueError("only binary data files are read")
        kind, layout = binary.get("binaryformat", "INT_16").upper(), common.get("dataorientation", "MULTIPLEXED").upper()
        if kind not in FORMATS or layout not in ("MULTIPLEXED", "VECTORIZED"):
            raise ValueError(f"unknown data format: {kind}, {layout}")
        parts = [(channels.get(f"ch{i}", "").split(",") + [""] * 4)[:4] for i in range(1, n + 1)]
        names = tuple((p[0] or f"Ch{i}").replace("\\1", ",") for i, p in enumerate(parts, 1))
        resolutions = tuple(float(p[2]) if p[2].strip() else 1.0 for p in parts)
        marker = common.get("markerfile") or None
        return cls(common["datafile"], marker, names, tuple(p[3].strip() or "µV" for p in parts), resolutions, kind, layout == "MULTIPLEXED", float(common.get("samplinginterval", 0)))

    def beside(self, header: str, name: str) -> str:
        """A file that the header names; $b stands for the header's own name."""
        stem = posixpath.basename(header).rsplit(".", 1)[0]
        return posixpath.join(posixpath.dirname(header), name.replace("$b", stem))


def read_header(files: fs.FileSystem, path: str) -> Header:
    with files.open_input_file(path) as f:
        raw = f.read()
    try:
        return Header.parse(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return Header.parse(raw.decode("cp1252"))


def header_files(files: fs.FileSystem, path: str) -> list[str]:
    """The header files below a folder, or the one that path is."""
    info = files.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(x.path for x in found if x.path.lower().endswith(".vhdr"))


@dataclass
class SampleRange(InputPartition):
    """Samples from begin to end of one recording of `total` samples."""

    header: str
    begin: int
    end: int
    total: int


def read_range(files: fs.FileSystem, part: SampleRange, rows: int = ROWS_A_BATCH) -> Iterator[tuple[int, np.ndarray]]:
    """(first sample, samples x channels in the header's units) in pieces of at most `rows` samples."""
    header = read_header(files, part.header)
    kind, n = np.dtype(FORMATS[header.kind]), len(header.names)
    scale = np.array(header.resolutions)
    with files.open_input_file(header.beside(part.header, header.data)) as f:
        for at in range(part.begin, part.end, rows):
            count = min(rows, part.end - at)
            if header.multiplexed:
                x = np.frombuffer(f.read_at(count * n * kind.itemsize, at * n * kind.itemsize), dtype=kind).reshape(count, n)
            else:
                x = np.stack([np.frombuffer(f.read_at(count * kind.itemsize, (c * part.total + at) * kind.itemsize), dtype=kind) for c in range(n)], axis=1)
            yield at, x * scale


class BrainVisionReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[SampleRange]:
        files, path = file_system(self.path)
        out = []
        for header_path in header_files(files, path):
            header = read_header(files, header_path)
            size = files.get_file_info(header.beside(header_path, header.data)).size
            width = len(header.names) * np.dtype(FORMATS[header.kind]).itemsize
            if size is None or size % width:
                raise ValueError(f"{header_path}: the data file isn't a whole number of samples")
            total = size // width
            out += [SampleRange(header_path, b, min(total, b + self.rows), total) for b in range(0, total, self.rows)]
        return out

    def read(self, partition: SampleRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = file_system(self.path)
        subject = posixpath.basename(partition.header).rsplit(".", 1)[0]
        for begin, x in read_range(files, partition):
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([subject] * len(x)), pa.array(np.arange(begin, begin + len(x))), values], names=["subject", "t", "v"])


class BrainVision(DataSource):
    """spark.read.format("brainvision").load(path): subject (the header file's name), t, v. Option rows: samples of a partition."""

    @classmethod
    def name(cls) -> str:
        return "brainvision"

    def schema(self) -> str:
        return "subject string, t long, v array<double>"

    def reader(self, schema: object) -> DataSourceReader:
        return BrainVisionReader(self.options["path"], int(self.options.get("rows", ROWS_A_PARTITION)))


def read_brainvision(spark: SparkSession, path: str, rows: int = ROWS_A_PARTITION) -> DataFrame:
    """subject, t, v of every recording below a folder, or of one header file. Recordings without samples give no rows; files that aren't there, or hold no whole number of samples, are errors."""
    spark.dataSource.register(BrainVision)
    return spark.read.format("brainvision").option("rows", rows).load(path)


def _texts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("subject"), F.explode(F.split("value", r"\r?\n")).alias("line"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("\\1"), F.lit(","))


def brainvision_channels(spark: SparkSession, path: str) -> DataFrame:
    """subject, ch (from 0), name, resolution, unit of the headers below a folder."""
    lines = _texts(spark, path, ".vhdr").select("subject", F.regexp_extract("line", r"^Ch(\d+)=", 1).alias("ch"), F.split(F.regexp_replace("line", r"^Ch\d+=", ""), ",").alias("p")).where("ch <> ''")
    number = F.coalesce(F.try_to_number(F.trim(F.get("p", F.lit(2))), F.lit("999999999999.999999999999")).cast("double"), F.lit(1.0))
    unit = F.coalesce(F.nullif(F.trim(F.get("p", F.lit(3))), F.lit("")), F.lit("µV"))
    return lines.select("subject", (F.col("ch").cast("int") - 1).alias("ch"), unescaped(F.get("p", F.lit(0))).alias("name"), number.alias("resolution"), unit.alias("unit"))


def brainvision_markers(spark: SparkSession, path: str) -> DataFrame:
    """subject, marker, kind, description, t (from 0), length, channel (0: all) of the marker files below a folder."""
    lines = _texts(spark, path, ".vmrk").select("subject", F.regexp_extract("line", r"^Mk(\d+)=", 1).alias("marker"), F.split(F.regexp_replace("line", r"^Mk\d+=", ""), ",").alias("p")).where("marker <> ''")
    field = lambda i: F.trim(F.get("p", F.lit(i)))
    whole = lambda i: field(i).try_cast("long")
    return lines.select("subject", F.col("marker").cast("int").alias("marker"), unescaped(field(0)).alias("kind"), unescaped(field(1)).alias("description"), (whole(2) - 1).alias("t"), whole(3).alias("length"), whole(4).alias("channel"))


def marked_stretches(samples: DataFrame, markers: DataFrame, kind: str = "Stimulus", block: int = 64) -> DataFrame:
    """samples(subject, t, v) with task: the description of the recording's last marker of the kind at or before t, null before the first.

    A marker holds until the next one of its recording. It goes to the blocks of time that it touches, so a sample meets the few markers of its block, and samples aren't ordered.
    """
    w = Window.partitionBy("subject").orderBy("t", "marker", "description")
    ends = samples.groupBy("subject").agg((F.max("t") + 1).alias("_end"))
    held = markers.where((F.col("kind") == kind) & F.col("t").isNotNull()).withColumn("_next", F.lead("t").over(w)).join(ends, "subject")
    held = held.withColumn("_to", F.least(F.coalesce("_next", "_end"), "_end")).where((F.col("_to") > F.col("t")) & (F.col("_to") > 0))
    touched = F.sequence(F.floor(F.greatest("t", F.lit(0)) / block), F.floor((F.col("_to") - 1) / block))
    sets = held.withColumn("_b", F.explode(touched)).groupBy("subject", "_b").agg(F.collect_list(F.struct("t", "marker", "description")).alias("_m"))
    joined = samples.withColumn("_b", F.floor(F.col("t") / block)).join(sets, ["subject", "_b"], "left")
    last = F.array_max(F.filter("_m", lambda m: m["t"] <= F.col("t")))
    return joined.select(*samples.columns, last["description"].alias("task"))


def write_recording(folder: str, name: str, x: np.ndarray, names: list[str], interval: float = 2000, kind: str = "INT_16", multiplexed: bool = True, resolution: float = 0.1, markers: tuple = ()) -> None:
    """One recording (samples x channels) as its three files. markers: (kind, description, t, length, channel)."""
    files, folder = file_system(folder)
    files.create_dir(folder, recursive=True)
    clean = lambda s: str(s).replace(",", "\\1")
    channels = "\n".join(f"Ch{i}={clean(c)},,{resolution},µV" for i, c in enumerate(names, 1))
    header = f"""Brain Vision Data Exchange Header File Version 1.0
; written by a job
[Common Infos]
Codepage=UTF-8
DataFile=$b.eeg
MarkerFile=$b.vmrk
DataFormat=BINARY
DataOrientation={"MULTIPLEXED" if multiplexed else "VECTORIZED"}
NumberOfChannels={len(names)}
SamplingInterval={interval}
[Binary Infos]
BinaryFormat={kind}
[Channel Infos]
{channels}
[Comment]
anything = goes, here
"""
    lines = "\n".join(f"Mk{i}={clean(k)},{clean(d)},{t + 1},{length},{channel}" for i, (k, d, t, length, channel) in enumerate(markers, 1))
    values = x / resolution
    values = (np.rint(values) if kind.startswith("INT") else values).astype(FORMATS[kind])
    for suffix, content in (("eeg", (values if multiplexed else values.T).tobytes()), ("vmrk", f"[Common Infos]\nCodepage=UTF-8\nDataFile={name}.eeg\n[Marker Infos]\n{lines}\n".encode()), ("vhdr", header.encode())):
        with files.open_output_stream(f"{folder}/{name}.{suffix}") as f:
            f.write(content)
