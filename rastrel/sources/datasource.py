"""``spark.read.format("raster")``: image files of a folder as ``images`` rows, one partition for each group of files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import IMAGES, check
from . import codecs

_ENDINGS = (".ppm", ".pgm", ".png")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        check("path" in options, "a path is needed")
        self.path, self.channels = options["path"], int(options.get("channels", 0))
        self.group = int(options.get("filesPerPartition", 64))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self):
        from pyarrow import fs

        store, root = self._store()
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.lower().endswith(_ENDINGS))
        return [_Files(files[i : i + self.group]) for i in range(0, len(files), self.group)] or [_Files([])]

    def read(self, partition):
        store, _ = self._store()
        for p in partition.paths:
            with store.open_input_file(p) as f:
                yield codecs._row(codecs.path_id(p), codecs.decode(f.read(), self.channels))


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return IMAGES

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
