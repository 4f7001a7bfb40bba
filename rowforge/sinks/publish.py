"""One file under a configured name, replaced in one step.

Tasks write the parts; the parts are joined in their order into one hidden file, where the file system can by
its own concatenation, else as a stream that holds one buffer; a rename puts it in place of the older file, which
stays readable until then. Every step leaves a mark under the run's own folder, so a publish that broke goes on
where it ended when it is called again, and one that is done changes nothing.

    <folder>/_publish/<name>/<run>/parts   what the tasks wrote
    <folder>/_publish/<name>/<run>/whole   the joined file, until the rename
    <folder>/_publish/<name>/<run>/MERGED, DONE"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession

BUFFER = 1 << 20


class Files:
    """The Hadoop file API of a session, below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.kind = self.jvm.org.apache.hadoop.fs.Path  # looked up once: each part of the name asks the JVM
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, text: str):
        return self.kind(text)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def touch(self, path: str) -> None:
        self.fs.create(self.path(path), True).close()

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def move(self, old: str, new: str) -> None:
        """Rename to a place that is free, making its folder."""
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"can't move {old} to {new}")

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(path)) if not f.getPath().getName().startswith(("_", ".")))

    def write(self, path: str, data: bytes) -> None:
        out = self.fs.create(self.path(path), True)
        out.write(data)
        out.close()

    def join(self, parts: list[str], path: str) -> None:
        """Append ``parts`` to the file at ``path`` in order."""
        sources = self.gateway.new_array(self.kind, len(parts))
        for k, part in enumerate(parts):
            sources[k] = self.path(part)
        if self.fs.getScheme() == "hdfs":
            self.fs.concat(self.path(path), sources)
            return
        head = self.path(path + ".head")
        self.fs.delete(head, False)
        self.fs.rename(self.path(path), head)
        out = self.fs.create(self.path(path), True)
        for part in [head, *sources]:
            source = self.fs.open(part)
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BUFFER, False)
            source.close()
        out.close()
        self.fs.delete(head, False)

    def replace(self, old: str, new: str) -> None:
        """Rename over whatever is there, in one step."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(self.path(old)), self.fs.makeQualified(self.path(new)), options)


def header_line(names: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(names)
    return out.getvalue().encode()


def publish(df: DataFrame, folder: str, name: str, run_id: int | str) -> str:
    """Publish ``df`` as the CSV file ``folder/name`` with a header; rows keep the order of ``df``'s partitions.

    An empty frame gives a file of the header alone. Returns the path."""
    files = Files(df.sparkSession, folder)
    own, target = f"{folder}/_publish/{name}/{run_id}", f"{folder}/{name}"
    if files.exists(f"{own}/DONE"):
        return target
    if not files.exists(f"{own}/MERGED"):
        if not files.exists(f"{own}/parts/_SUCCESS"):
            df.write.mode("overwrite").option("header", False).option("escape", '"').csv(f"{own}/parts")
        files.write(f"{own}/whole", header_line(df.columns))
        parts = [f"{own}/parts/{p}" for p in files.names(f"{own}/parts")]
        if parts:
            files.join(parts, f"{own}/whole")
        files.touch(f"{own}/MERGED")
    if files.exists(f"{own}/whole"):  # else the rename was the last thing done
        files.replace(f"{own}/whole", target)
    files.touch(f"{own}/DONE")
    files.remove(f"{own}/parts")
    return target
