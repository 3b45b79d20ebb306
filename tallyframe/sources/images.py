"""A data source for folders of image files, <root>/<study>/<series>/<file>: a row for each file.

    spark.dataSource.register(image_source())
    spark.read.format("image_series").schema("series string, pos array<double>").load(root)

Partitions are planned by series and size. Columns are pruned by the schema that is asked for: pixels are read only if it
has them. Filters on study and series (=, in) decide which folders are listed: given as options, or pushed down by Spark
with the option pushdown, which needs spark.sql.python.filterPushdown.enabled. A file that can't be read is a row with an
error, never a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from . import dicom

GEOMETRY = "study string, series string, no int, path string, bytes long, rows int, cols int, pos array<double>, orient array<double>, spacing array<double>, side string, slope double, intercept double, error string"
#: pixels: float32 values row by row, slope and intercept applied.
SCHEMA = f"{GEOMETRY}, pixels binary"
#: Files of a partition, and pixels of a batch, in bytes.
PARTITION, BATCH = 128 << 20, 16 << 20


@dataclass
class Part(InputPartition):
    """Places start to stop of the sorted files of each (study, series, folder)."""

    folders: list[tuple[str, str, str, int, int]]


def _file_system(root: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else fs.FileSystem.from_uri("file://" + root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def _listed(system, folder: str, kind: str) -> list:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type.name == kind and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, decode: Callable[[BinaryIO, bool], dict]):
        self.root, self.schema, self.decode = options["path"], schema, decode
        self.most = int(options.get("partitionbytes", PARTITION))
        self.only: dict[str, set[str]] = {k: set(options[k].split(",")) for k in ("study", "series") if k in options}

    def partitions(self) -> list[Part]:
        """A series stays whole unless it has more bytes than a partition may. The driver holds a row for each series."""
        system, root = _file_system(self.root)
        parts: list[list] = [[]]
        size = 0

        def wanted(kind: str, names: list) -> list:
            return [f for f in names if kind not in self.only or f.base_name in self.only[kind]]

        for study in wanted("study", _listed(system, root, "Directory")):
            for series in wanted("series", _listed(system, study.path, "Directory")):
                files = _listed(system, series.path, "File")
                total = sum(f.size for f in files)
                if parts[-1] and size + total > self.most:
                    parts.append([])
                    size = 0
                start = 0
                for i, f in enumerate(files):
                    if size + f.size > self.most and i > start:
                        parts[-1].append((study.base_name, series.base_name, series.path, start, i))
                        parts.append([])
                        start, size = i, 0
                    size += f.size
                if files:
                    parts[-1].append((study.base_name, series.base_name, series.path, start, len(files)))
        return [Part(p) for p in parts if p]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _file_system(self.root)
        names = self.schema.fieldNames()
        target = to_arrow_schema(self.schema)
        pixels = "pixels" in names
        need = set(names) - {"study", "series", "no", "path", "bytes"}
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], target.field(n).type) for n in names], schema=target)

        for study, series, folder, start, stop in partition.folders:
            for no, info in list(enumerate(_listed(system, folder, "File")))[start:stop]:
                row = {"study": study, "series": series, "no": no, "path": info.path, "bytes": info.size}
                if need:
                    try:
                        with system.open_input_file(info.path) as file:
                            row |= self.decode(file, pixels)
                        if pixels:
                            row["pixels"] = row["pixels"].tobytes()
                    except Exception as e:  # noqa: BLE001  a file that can't be read is a row
                        row["error"] = f"{type(e).__name__}: {e}"[:500]
                rows.append(row)
                held += len(row.get("pixels") or b"") + 1000
                if held >= BATCH:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class PushingReader(SeriesReader):
    """A reader that takes filters; Spark refuses it where it doesn't push any."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0].lower() if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("study", "series"):
                values = {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value if v is not None}
                self.only[name] = self.only[name] & values if name in self.only else values
            else:
                yield f


def image_source(decode: Callable[[BinaryIO, bool], dict] = dicom.read, name: str = "image_series") -> type[DataSource]:
    """The data source with a decoder: decode(file, pixels) gives the columns of SCHEMA that it knows, `pixels` as a
    float32 array; what it raises becomes the row's error."""
    given = name

    class ImageSeries(DataSource):
        @classmethod
        def name(cls) -> str:
            return given

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> SeriesReader:
            options = {k.lower(): v for k, v in self.options.items()}
            kind = PushingReader if options.get("pushdown", "").lower() == "true" else SeriesReader
            return kind(options, schema, decode)

    return ImageSeries


def image_series(spark: SparkSession, root: str, columns: list[str] | None = None, decode: Callable[[BinaryIO, bool], dict] = dicom.read, **options: str) -> DataFrame:
    """The files of a folder of studies, with some columns of SCHEMA (default: all but pixels). Options: study, series
    (names, comma-separated), partitionBytes."""
    types = dict(f.split(" ", 1) for f in SCHEMA.split(", "))
    columns = columns or [c for c in types if c != "pixels"]
    source = image_source(decode)
    spark.dataSource.register(source)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options}
    return spark.read.format(source.name()).schema(", ".join(f"{c} {types[c]}" for c in columns)).options(**options).load(root)


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files without an error, (study, series, path, error) of the others)."""
    return files.where("error is null"), files.where("error is not null").select("study", "series", "path", "error")


def write_images(files: DataFrame, root: str) -> None:
    """Write each row of (study, series, name, content) as a file <root>/<study>/<series>/<name>. A task that runs again
    writes the same files again."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(root)
        n = 0
        for batch in batches:
            for study, series, name, content in zip(*(batch.column(c) for c in ("study", "series", "name", "content")), strict=True):
                folder = f"{base}/{study.as_py()}/{series.as_py()}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name.as_py()}") as out:
                    out.write(content.as_buffer())
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    files.select("study", "series", "name", "content").mapInArrow(put, "n long").agg({"n": "sum"}).collect()
