"""Files of any file system that Spark reaches, through its own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """One path, qualified by the session's default file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        raw = self._path(path)
        self.fs = raw.getFileSystem(self._conf)
        self.path = self.fs.makeQualified(raw)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def __str__(self) -> str:
        return self.path.toString()

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def listed(self) -> list[tuple[str, int]]:
        """Name and size of every entry of a folder that is not hidden, by name."""
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path)]
        return sorted(x for x in found if not x[0].startswith(("_", ".")))

    def read(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, overwrite: bool = False) -> None:
        """A small file in one go; an existing one is an error unless `overwrite`."""
        out = self.fs.create(self.path, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def replace_by(self, other: str, overwrite: bool = True) -> None:
        """Rename another path to this one, in one step; an existing one goes if `overwrite`."""
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._new_array(rename, [rename.OVERWRITE if overwrite else rename.NONE])
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self._conf)
        context.rename(self.fs.makeQualified(self._path(other)), self.path, options)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def _new_array(self, kind, values: list):
        from pyspark import SparkContext
        out = SparkContext._active_spark_context._gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    def joined_from(self, parts: list[str]) -> None:
        """This file becomes the parts one after the other, which are used up."""
        paths = [self.fs.makeQualified(self._path(p)) for p in parts]
        path_type = self._jvm.org.apache.hadoop.fs.Path
        if self.path.toUri().getScheme() == "file":
            whole = self._path(f"{self}.{parts[0].rpartition('/')[0].rpartition('-')[2]}")
            self.fs.getRaw().concat(whole, self._new_array(path_type, paths))
        else:
            whole, *rest = paths
            if rest:
                whole.getFileSystem(self._conf).concat(whole, self._new_array(path_type, rest))
        self.replace_by(whole.toString())
