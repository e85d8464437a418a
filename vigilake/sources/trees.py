"""Source trees as a batch data source, and the ignore files that stand in them.

    spark.dataSource.register(Tree)
    spark.read.format("tree").option("path", root).load()

The listing is dealt over tasks by folder: the driver opens folders from the top until there are enough, and each task walks below its own. Names that
begin with a dot are listed, links are not followed, and folders that are never read are not opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import EXCLUDED, MOST_BYTES, ignore_parts

#: Folders that are dealt to tasks, and rules of ignore files that are told to all of them.
FOLDERS, TOLD = 64, 100_000


@dataclass
class _Folder(InputPartition):
    """A folder below the root; deep tells whether what is below it belongs to it."""

    path: str
    deep: bool


class _Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.contents = options["path"].rstrip("/"), options.get("contents", "true") == "true"
        self.folders, self.most = int(options.get("folders", FOLDERS)), int(options.get("most_bytes", MOST_BYTES))

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def entries(self, folder: str) -> list[fs.FileInfo]:
        system, root = self.system()
        found = system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        if isinstance(system, fs.LocalFileSystem):
            import os

            found = [f for f in found if not os.path.islink(f.path)]
        return sorted(found, key=lambda f: f.base_name)

    def below(self, folder: str, entries: list[fs.FileInfo]) -> list[str]:
        return [f"{folder}/{f.base_name}".lstrip("/") for f in entries if f.type == fs.FileType.Directory and f.base_name not in EXCLUDED]

    def partitions(self) -> list[_Folder]:
        """Shallow folders that were opened here, and deep ones for the tasks."""
        opened, waiting = [], [""]
        while waiting and len(opened) + len(waiting) < self.folders:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting += self.below(folder, self.entries(folder))
        return [_Folder(f, False) for f in opened] + [_Folder(f, True) for f in waiting]

    def read(self, part: _Folder) -> Iterator[tuple]:
        system, _ = self.system()
        todo = [part.path]
        while todo:
            folder = todo.pop()
            entries = self.entries(folder)
            for f in entries:
                if f.type == fs.FileType.File:
                    content = None
                    if self.contents and f.size <= self.most:
                        with system.open_input_stream(f.path) as stream:
                            content = stream.read()
                    yield f"{folder}/{f.base_name}".lstrip("/"), f.size, content
            if part.deep:
                todo += self.below(folder, entries)


class Tree(DataSource):
    """path (below the root), length, content of the files below the option path. contents=false leaves contents out; those over most_bytes are null."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(dict(self.options))


def write_tree(files: DataFrame, root: str) -> None:
    """Writes each of files(path, text) below root; a task that runs again writes the same files again. Null texts are empty files."""

    def run(batches):
        system, base = _Walk({"path": root}).system()
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write((text.as_py() or "").encode())
            yield batch.slice(0, 0)

    files.select("path", "text").mapInArrow(run, "path string, text string").write.format("noop").mode("overwrite").save()


def ignore_rules(files: DataFrame, names: list[str]) -> DataFrame:
    """folder, name, line, kept, pattern, only_folders of the lines in the ignore files (of these names) among files(path, content)."""
    parsed = F.udf(lambda base, line: ignore_parts(base, line), "kept boolean, pattern string, only_folders boolean")
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    texts = files.where(name.isin(names)).select(folder.alias("folder"), name.alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    lines = texts.select("folder", "name", F.posexplode(F.split("text", "\r?\n")).alias("line", "body"))
    return lines.select("folder", "name", "line", parsed("folder", "body").alias("r")).where("r is not null").select("folder", "name", "line", "r.*")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files(path, ...) that neither they nor a folder on their way are ignored by rules of ignore_rules, which hold below their own folder.

    Of the rules that match a file or folder the last one decides: that of the deepest folder, and there of the last line. What is below an ignored folder stays ignored.
    """
    parts = F.split("path", "/")
    ways = files.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))).alias("way"))
    # each folder in which a rule for the way may stand
    above = F.split("way", "/")
    homes = F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat_ws("/", F.slice(above, F.lit(1), F.greatest(k, F.lit(1))))))
    rows = ways.select("path", "way", F.explode(homes).alias("folder"))
    few = rules.limit(TOLD + 1).count() <= TOLD
    met = rows.join(F.broadcast(rules) if few else rules, "folder").where(F.expr("way rlike pattern") & (~F.col("only_folders") | (F.col("way") != F.col("path"))))
    last = met.groupBy("path", "way").agg(F.max_by("kept", F.struct(F.length("folder"), "name", "line")).alias("kept"))
    gone = last.where("not kept").select(F.col("path").alias("__path")).distinct()
    return files.join(gone, files["path"] == gone["__path"], "left_anti")


def tree(spark: SparkSession, root: str, ignore_names: tuple[str, ...] = (".scanignore",)) -> DataFrame:
    """path, length, text of the text files below root that are not ignored: by files of ignore_names, and by .gitignore where root is a repository, so that one in an unpacked archive hides nothing.

    Files with a NUL byte or over the size limit are left out; the names of ignore files themselves are listed.
    """
    spark.dataSource.register(Tree)
    reader = spark.read.format("tree").option("path", root)
    names = [*ignore_names]
    system, base = _Walk({"path": root}).system()
    if system.get_file_info(f"{base}/.git").type != fs.FileType.NotFound:
        names.append(".gitignore")
    files = reader.load()
    kept = not_ignored(files, ignore_rules(files, names)).where("content is not null and not contains(content, X'00')")
    return kept.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
