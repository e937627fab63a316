"""File systems: on the driver through Hadoop's API, so that any scheme Spark reads also works here; in tasks through Arrow's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def open_fs(uri: str):
    """The Arrow file system of a URI and the path in it; usable in any executor's Python."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Folder:
    """A folder on whatever file system its URI names."""

    def __init__(self, spark: SparkSession, uri: str):
        self.uri = uri.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names of the direct children, sorted; [] if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(path relative to the folder, bytes) of all data files below ``name``, in one recursive listing."""
        if not self.exists(name):
            return []
        base, out = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/"), []
        it = self._fs.listFiles(self._path(name), True)
        while it.hasNext():
            s = it.next()
            path = s.getPath().toUri().getPath()
            if not s.getPath().getName().startswith(("_", ".")):
                out.append((path[len(base) + 1 :], s.getLen()))
        return sorted(out)

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Create ``name`` with ``text``, or fail if it exists: the text goes to a side file that is
        then renamed, so that a reader sees all of it or nothing."""
        side = f"{name}.tmp-{self._jvm.java.util.UUID.randomUUID().toString()}"
        stream = self._fs.create(self._path(side), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if self.exists(name) or not self._fs.rename(self._path(side), self._path(name)):
            self._fs.delete(self._path(side), False)
            raise FileExistsError(f"{self.uri}/{name} was committed by another writer")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
