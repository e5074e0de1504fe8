"""Small files and folders in any store that Spark reads: metadata, sniffed heads, originals of imports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import InputError

#: Bytes of a file that the driver reads as a whole, at most.
WHOLE = 1 << 30


class Files:
    """The few file operations that the engine needs beside Spark's readers and writers."""

    def __init__(self, spark: SparkSession):
        self.spark, self._path = spark, spark._jvm.org.apache.hadoop.fs.Path

    def _at(self, path: str):
        where = self._path(str(path))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, store = self._at(path)
        return store.exists(where)

    def make_dir(self, path: str) -> None:
        where, store = self._at(path)
        store.mkdirs(where)

    def names(self, folder: str) -> list[str]:
        where, store = self._at(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []

    def read(self, path: str, most: int | None = None) -> bytes:
        """The first ``most`` bytes; without a number the whole file, which may have a gigabyte at most."""
        where, store = self._at(path)
        if most is None and store.getFileStatus(where).getLen() > WHOLE:
            raise InputError(f"the file is too large to be read at once: {path}")
        stream = store.open(where)
        try:
            return bytes(stream.readNBytes(WHOLE if most is None else most))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """The whole file at once: readers see the old or the new one."""
        self._made(path, lambda out: out.write(data))

    def create(self, path: str, data: bytes) -> bool:
        """The whole file at once if nobody has made it before; whether it was made now.

        Stores with an atomic rename that doesn't overwrite decide by it, the local file system by a hard link.
        """
        where, store = self._at(path)
        made, _ = self._at(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
        stream = store.create(made, True)
        try:
            stream.write(data)
        finally:
            stream.close()
        jvm = self.spark._jvm
        try:
            if store.getScheme() == "file":
                local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (where, made)]
                jvm.java.nio.file.Files.createLink(*local)
                store.delete(made, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(made, where, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            store.delete(made, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

    def move(self, source: str, target: str) -> None:
        where, store = self._at(source)
        store.rename(where, self._path(target))

    def copy(self, source: str, target: str) -> None:
        a, one = self._at(source)
        b, other = self._at(target)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one, a, other, b, False, self.spark._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        where, store = self._at(path)
        store.delete(where, True)

    def size(self, path: str) -> int:
        where, store = self._at(path)
        return store.getFileStatus(where).getLen()

    def _over(self, made, where, store) -> None:
        """Put a finished file in the place of another: readers see the old or the new one."""
        jvm = self.spark._jvm
        renames = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, where, renames)

    def _copy_parts(self, folder: str, out) -> None:
        for name in self.names(folder):
            if name.startswith("part-"):
                part, store = self._at(f"{folder}/{name}")
                stream = store.open(part)
                try:
                    self.spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()

    def _made(self, path: str, fill) -> None:
        where, store = self._at(path)
        made, _ = self._at(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
        out = store.create(made, True)
        try:
            fill(out)
        except BaseException:
            out.close()
            store.delete(made, False)
            raise
        out.close()
        self._over(made, where, store)

    def join_parts(self, folder: str, path: str, head: bytes) -> None:
        """``head`` and the part files of ``folder``, in their order, as one file; the folder goes. Bytes are copied by the JVM, a block at a time."""

        def fill(out):
            out.write(head)
            self._copy_parts(folder, out)

        self._made(path, fill)
        self.delete(folder)

    def zip_parts(self, path: str, small: dict[str, bytes], large: str, head: bytes, folder: str, tail: bytes) -> None:
        """A zip archive of small files and one ``large`` one: ``head``, the part files of ``folder`` in their order, and ``tail``. The folder goes."""

        def fill(out):
            jvm = self.spark._jvm
            archive = jvm.java.util.zip.ZipOutputStream(out)
            for name, data in small.items():
                archive.putNextEntry(jvm.java.util.zip.ZipEntry(name))
                archive.write(data)
                archive.closeEntry()
            archive.putNextEntry(jvm.java.util.zip.ZipEntry(large))
            archive.write(head)
            self._copy_parts(folder, archive)
            archive.write(tail)
            archive.closeEntry()
            archive.finish()

        self._made(path, fill)
        self.delete(folder)

    def _data_files(self, path: str):
        """Files with data: ``path`` itself, those in the folder or among the matches of a pattern."""
        where, store = self._at(path)
        todo = list(store.globStatus(where) or [])
        while todo:
            status = todo.pop(0)
            if status.isFile() and status.getLen() > 0 and not status.getPath().getName().startswith(("_", ".")):
                yield status
            if status.isDirectory():
                todo += sorted(store.listStatus(status.getPath()), key=lambda s: s.getPath().getName())

    def first_data_file(self, path: str) -> str:
        """``path`` itself, or the first file with data in the folder or among the matches of a pattern."""
        return next((s.getPath().toString() for s in self._data_files(path)), str(path))

    def largest_data_file(self, path: str) -> str:
        return max(self._data_files(path), key=lambda s: s.getLen()).getPath().toString()
