"""Folders of files: reading them as documents with a quarantine, and writing one file for each entity with a manifest."""

from __future__ import annotations

import contextlib
import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.sources.documents import stored, stored_at, supported

#: Kinds whose bytes are text already, and the most bytes that one file may have to be read whole.
TEXTS, MOST_BYTES = (".md", ".markdown", ".txt"), 1 << 30
_ENDING = r"\.[^./]+$"
#: Files and bytes that a task reads or writes, about, and bytes that it holds before it passes them on.
FILES_OF_TASK, BYTES_OF_TASK, BYTES_OF_BATCH = 10_000, 64 << 20, 8 << 20
_MANIFEST = "path string, bytes long, sha256 string, archive string"
_NAMES = ["path", "bytes", "sha256", "archive"]
#: An archive ends after so many files or bytes; the next file begins another one.
MOST_FILES, FULL_BYTES = 50_000, 256 << 20


def _place(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _any_case(ending: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)


def _hidden(name: str) -> bool:
    """Whether Spark's own readers pass over a file or folder of that name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _opens(uri: str) -> bool:
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _listed(spark: SparkSession, uri: str) -> DataFrame:
    """(name, bytes) of the files below a folder, listed by tasks: one level of folders after the other, each folder by one task.

    A level is written to the shared folder before the next one, so that the driver sees no name, only their numbers.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        root = root.rstrip("/")
        for batch in batches:
            for within in batch.column("name").to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(f"{root}/{within}")) if not _hidden(x.base_name)]
                for i in range(0, len(found), 10_000):
                    some = found[i : i + 10_000]
                    names = pa.array([f"{within}/{x.base_name}".lstrip("/") for x in some], pa.string())
                    sizes = pa.array([None if x.type == fs.FileType.Directory else x.size for x in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([names, sizes], ["name", "bytes"])

    level, out, n = spark.createDataFrame([("",)], "name string"), None, 1
    while n:
        dealt = level.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
        seen = stored(dealt.mapInArrow(look, "name string, bytes long"), "listed")
        files = seen.where("bytes > 0")
        out = files if out is None else out.union(files)
        level = seen.where("bytes is null").select("name")
        n = level.count()
    return out


def _read_by_tasks(spark: SparkSession, uri: str, most: int) -> DataFrame:
    """(name, bytes, content) of the files below a folder, content null for those that aren't opened."""
    listed = _listed(spark, uri).withColumn("_open", F.lower(F.regexp_extract("name", _ENDING, 0)).isin(*TEXTS) & (F.col("bytes") <= most))
    files, size = listed.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_open"), F.col("bytes")))).first()
    tasks = max(files // FILES_OF_TASK, (size or 0) // BYTES_OF_TASK, spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)

        def some(rows: list[tuple], contents: pa.Array | None = None) -> pa.RecordBatch:
            names, sizes, held = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()) if contents is None else contents], ["name", "bytes", "content"])

        rows, held = [], 0
        for batch in batches:
            for name, size, opened in zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "_open")), strict=True):
                if opened and size > BYTES_OF_BATCH:  # not copied once more
                    with system.open_input_file(f"{root.rstrip('/')}/{name}") as src:
                        whole = src.read_buffer()
                    ends = pa.array([0, whole.size], pa.int32()).buffers()[1]
                    yield some([(name, size, None)], pa.Array.from_buffers(pa.binary(), 1, [None, ends, whole]))
                    continue
                content = None
                if opened:
                    with system.open_input_stream(f"{root.rstrip('/')}/{name}") as src:
                        content = src.read()
                    held += size
                rows.append((name, size, content))
                if len(rows) >= 10_000 or held >= BYTES_OF_BATCH:
                    yield some(rows)
                    rows, held = [], 0
        if rows:
            yield some(rows)

    return listed.repartition(int(tasks), "name").mapInArrow(read, "name string, bytes long, content binary")


def _read_by_spark(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """The same from a store that only Spark opens; the driver lists it."""
    root = _place(spark, folder)[1].toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    name = F.expr("substring(path, instr(path, root) + length(root))").alias("name")
    listed = files.load(folder).select("path", F.lit(root).alias("root"), "length").select(name, F.col("length").alias("bytes"))
    glob = "*{" + ",".join(_any_case(e) for e in TEXTS) + "}"
    opened = files.option("pathGlobFilter", glob).load(folder).where(F.col("length") <= most).select("path", F.lit(root).alias("root"), "content")
    return listed.join(opened.select(name, "content"), "name", "left")


def read_documents(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """(name, bytes, sha256, text, reason) of every file below folder; name is its path from there.

    reason is '' for a text that was read, else why the file stands in quarantine with a null text: `extension`
    (no kind of document), `parser` (a document whose text another engine has to recognise), `size`, or `encoding`
    (not UTF-8). Only text files are opened; their bytes are digested as they are, and a byte order mark isn't part of
    the text. Files without a byte and names that Spark hides (that begin with _ or .) aren't listed; an empty folder
    gives no rows.

    The folder is listed when this is called. Where pyarrow opens it, tasks list the folders and read the files, dealt to
    them by name in shares that follow numbers and bytes, and the driver sees no file. Another store is listed by Spark, on the
    driver, with some 0.5 KB a file twice.
    """
    system, path = _place(spark, folder)
    if not system.exists(path):
        raise FileNotFoundError(folder)
    uri = system.makeQualified(path).toUri().toString()
    met = _read_by_tasks(spark, uri, most) if _opens(uri) else _read_by_spark(spark, folder, most)
    bare = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    ending, text = F.lower(F.regexp_extract("name", _ENDING, 0)), F.when(F.is_valid_utf8(bare), bare)
    reason = (
        F.when(~supported(F.col("name")), "extension").when(~ending.isin(*TEXTS), "parser").when(F.col("bytes") > most, "size")
        .when(text.isNull(), "encoding").otherwise("")
    )
    return met.select("name", "bytes", F.sha2("content", 256).alias("sha256"), text.alias("text"), reason.alias("reason"))


def fair_path(path: Column) -> Column:
    """Whether a path stays below its folder and its names can be those of files."""
    names = F.split(path, "/", -1)
    fair = F.forall(names, lambda n: (n != "") & ~n.startswith(".") & ~n.startswith("_") & (F.octet_length(n) <= 255))
    return F.coalesce(fair & ~path.rlike(r"[\x00\\]"), F.lit(False))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256, archive) of the files that the last whole write left in the folder; archive is null for files that lie there one by one."""
    last = _versions(spark, folder)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest/{last[-1]}") if last else spark.createDataFrame([], _MANIFEST)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    system, path = _place(spark, f"{folder}/_manifest")
    found = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    done = [n for n in found if system.exists(_place(spark, f"{folder}/_manifest/{n}/_SUCCESS")[1])]
    return sorted(map(int, done))


def rendered(files: DataFrame) -> DataFrame:
    """files (path, content) in the shared folder: what several writes and comparisons read, so that they are rendered once.

    Small files hold many rows a byte, so shares stay as they were shuffled: their rows are what tasks that write them work on.
    """
    shares = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    return stored(files.select("path", F.col("content").cast("binary").alias("content")), "rendered", "zstd", shares)


def _digested(files: DataFrame) -> DataFrame:
    """files with size and digest."""
    content = F.col("content").cast("binary")
    return files.select("path", F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"), content.alias("content"))


def sync_states(files: DataFrame, folder: str) -> DataFrame:
    """(path, state): files (path, content) against what the folder's manifest says is there.

    `new`, `changed` and `same` by digest, `gone` for what is in the folder but not among the files, `refused` for
    a path that leaves the folder, is no file name, has no content, or stands in several rows.
    """
    return _states(files, manifest(files.sparkSession, folder))


def _states(files: DataFrame, there: DataFrame) -> DataFrame:
    """Paths and digests of 32 bytes meet; contents aren't shuffled."""
    want = _digested(files).select("path", F.unhex("sha256").alias("_want"))
    want = want.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    want = want.withColumn("_i", F.row_number().over(Window.partitionBy("path").orderBy("path"))).where("_i = 1")
    fair = fair_path(F.col("path")) & (F.col("_n") == 1) & F.col("_want").isNotNull()
    met = want.join(there.select("path", F.unhex("sha256").alias("_have")).hint("merge"), "path", "full")
    state = (
        F.when(F.col("_n").isNull(), "gone").when(~fair, "refused").when(F.col("_have").isNull(), "new")
        .when(F.col("_want") == F.col("_have"), "same").otherwise("changed")
    )
    return met.select("path", state.alias("state"))


def write_files(files: DataFrame, folder: str, remove: bool = False, archived: bool = False, once: bool = True) -> DataFrame:
    """Write files (path, content) below folder, one each, and return their states before the write: (path, state).

    Only new and changed files are written: under a draft name beside their place, then moved, so a reader sees the old
    file or the new one. The new manifest is written last; a write that fails midway leaves the old one, and is done
    again by the next. A task that is repeated writes the same bytes. Nothing is written where all files are the same.
    remove deletes what is gone. Tasks use pyarrow's file systems, so the folder must be one that these open.

    archived puts the files of a task together in archives _archives/<id>.tar.gz, whose members have the paths and bytes
    that the files would have: a disk gives each file some KB, however small it is, and each folder as much. The
    manifest names the archive that counts, read_archived() reads them. A folder is written in one of the two ways.

    Files are rendered first, since they are read for their digests and again to be written; once=False leaves that out for
    files that are rendered() already. Contents are shuffled only if some of the files aren't written.
    """
    spark = files.sparkSession
    rows, there = rendered(files) if once else files, manifest(spark, folder)
    states = stored_at(_states(rows, there), f"{folder}/_states/{uuid.uuid4().hex}", "zstd")
    due, gone = states.where("state in ('new', 'changed')"), states.where("state = 'gone'")
    if due.isEmpty() and (not remove or gone.isEmpty()):
        return states

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                where, _, name = f"{root}/{path}".rpartition("/")
                if where not in made:
                    system.create_dir(where, recursive=True)
                    made.add(where)
                draft = f"{where}/.{uuid.uuid4().hex}.draft"
                with system.open_output_stream(draft) as out:
                    out.write(content.as_buffer())
                system.move(draft, f"{where}/{name}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "bytes", "sha256")), pa.nulls(len(batch), pa.string())], _NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/_archives", recursive=True)
        with contextlib.ExitStack() as opened:
            name, tar, n, size = "", None, 0, 0
            for batch in batches:
                within = []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if not tar or n >= MOST_FILES or size >= FULL_BYTES:
                        opened.close()
                        name, n, size = f"_archives/{uuid.uuid4().hex}.tar.gz", 0, 0
                        out = opened.enter_context(system.open_output_stream(f"{root}/{name}", compression=None))
                        tar = opened.enter_context(tarfile.open(fileobj=out, mode="w:gz", compresslevel=6, format=tarfile.GNU_FORMAT))
                    member = tarfile.TarInfo(path)
                    member.size = len(content)
                    tar.addfile(member, io.BytesIO(content))
                    n, size = n + 1, size + len(content)
                    within.append(name)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "bytes", "sha256")), pa.array(within, pa.string())], _NAMES)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if system.get_file_info(f"{root}/{path}").type != fs.FileType.NotFound:
                    system.delete_file(f"{root}/{path}")
            yield batch

    todo = _digested(rows)
    if not states.where("state in ('same', 'refused')").isEmpty():
        todo = todo.join(due.select("path").hint("merge"), "path", "left_semi")
    kept = there.join(due.select("path").hint("merge"), "path", "left_anti")
    if remove:
        past = gone.select("path") if archived else gone.select("path").mapInArrow(delete, "path string")
        kept = kept.join(past.hint("merge"), "path", "left_anti")
    version = (_versions(spark, folder) or [-1])[-1] + 1
    tasks = {"spark.sql.files.minPartitionNum": str(max(due.count() // FILES_OF_TASK, spark.sparkContext.defaultParallelism))}
    stored_at(todo.mapInArrow(pack if archived else write, _MANIFEST).union(kept), f"{folder}/_manifest/{version}", "zstd", tasks)
    return states


def read_archived(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files in a folder's archives that its manifest says are there."""
    listed = manifest(spark, folder).where("archive is not null").select("path", "archive")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression="gzip") as src, tarfile.open(fileobj=src, mode="r|") as tar:
                    for member in tar:
                        content = tar.extractfile(member).read()
                        yield pa.RecordBatch.from_arrays([pa.array([member.name]), pa.array([name]), pa.array([content], pa.binary())], ["path", "archive", "content"])
                        tar.members = []

    found = listed.select("archive").distinct().mapInArrow(unpack, "path string, archive string, content binary")
    return found.join(listed.hint("merge"), ["path", "archive"], "left_semi").select("path", "content")


def attachments(specs: DataFrame, sources: DataFrame, chapters: DataFrame) -> DataFrame:
    """specs (attachment_id, course_id, source_id, chapter_id, text) with violations, namespace, content_hash and anchors.

    A source has to belong to the course (`source`), a chapter that is given to source and course (`chapter`). The text of
    accepted ones is cut at form feeds into pages and at blank lines into paragraphs; anchors are its places in order,
    att:<start of the hash>:p<page>:para<number>, each with its text's digest. Others have no anchors. A null text is
    empty. Map only after two joins by key.
    """
    own = sources.select("source_id", F.col("course_id").alias("_course"))
    part = chapters.select("chapter_id", F.col("source_id").alias("_source"), F.col("course_id").alias("_part_of"))
    met = specs.join(own, "source_id", "left").join(part, "chapter_id", "left")
    rules = {
        "source": F.col("_course") == F.col("course_id"),
        "chapter": F.col("chapter_id").isNull() | ((F.col("_source") == F.col("source_id")) & (F.col("_part_of") == F.col("course_id"))),
    }
    text = F.coalesce("text", F.lit(""))
    broken = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])), ",")
    digest = F.sha2(text, 256)

    def page(body: Column, p: Column) -> Column:
        paras = F.filter(F.transform(F.split(body, "\n\n", -1), lambda z: F.trim(z)), lambda z: z != "")
        at = lambda i: F.concat(F.lit("att:"), F.substring(digest, 1, 12), F.lit(":p"), p + 1, F.lit(":para"), i + 1)
        return F.transform(paras, lambda z, i: F.struct(at(i).alias("anchor"), F.sha2(z, 256).alias("sha256")))

    anchors = F.flatten(F.transform(F.split(text, "\f", -1), page))
    out = met.select("attachment_id", "course_id", "source_id", "chapter_id", broken.alias("violations"), F.substring(digest, 1, 12).alias("namespace"), digest.alias("content_hash"), anchors.alias("_anchors"))
    return out.withColumn("anchors", F.when(F.col("violations") == "", F.col("_anchors"))).drop("_anchors")
