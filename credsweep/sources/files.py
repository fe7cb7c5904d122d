"""Scanning a directory tree of text files.

Directories are listed by executors, one level of the tree at a time, and files
are read by executors, a few megabytes at a time.  Spark's own file sources pass
over names that start with ``.`` or ``_``, which is where secrets lie (``.env``),
so listing and reading go through the file system client of the Python workers.
A store that this client can't open (``viewfs``, or HDFS without its native
library) is read by Spark's own file systems: ``binaryFile`` for the names that it
lists, plain-named copies for the others.  A store that neither can open is an
error; only single files are passed over, and told on request.
Skipped directories are never listed, files that a filter drops never opened.
A file's identity is its path below the root, as it is written on disk.
"""

from __future__ import annotations

import array
import glob
import math
import os
import posixpath
import re
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# --------------------------------------------------------------------------
# FIXED VALUES: directories pruned at any depth, binary suffixes.
# --------------------------------------------------------------------------
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".gradle", "build",
             ".idea", ".vscode", ".kiro", "venv", ".venv", "dist", "target",
             ".mypy_cache", ".pytest_cache", ".tox", "egg-info")
BINARY_EXTS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".webp", ".svg",
               ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
               ".jar", ".aar", ".apk", ".aab", ".war", ".ear",
               ".so", ".dylib", ".dll", ".exe", ".class", ".dex", ".o", ".a",
               ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
               ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac",
               ".ttf", ".otf", ".woff", ".woff2", ".eot",
               ".sqlite", ".db", ".mdb", ".pyc", ".pyo", ".wasm")
# ------------------------------------------------------------------ end FIXED


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """os.path.splitext of the file name: last suffix, leading dots ignored."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def in_skipped_dir(relpath: Column) -> Column:
    """S3: a directory component (not the file name) is in the skip list."""
    parts = F.split(relpath, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS])).cast("boolean")


def parse_extensions(extensions: str) -> list[str]:
    """S4 argument: comma list, a leading dot added where missing."""
    if not extensions.strip():
        return []
    out = []
    for e in extensions.split(","):
        e = e.strip()
        out.append(e if e.startswith(".") else "." + e)
    return sorted(set(out))


def has_extension(name: Column, extensions: str) -> Column:
    """Case-sensitive suffix test on the file name (True when no filter)."""
    exts = parse_extensions(extensions)
    if not exts:
        return F.lit(True)
    out = None
    for e in exts:
        t = name.endswith(e)
        out = t if out is None else (out | t)
    return out


def is_binary(path: Column) -> Column:
    """Lower-cased suffix in the binary list."""
    return F.lower(extension(path)).isin(*BINARY_EXTS)


def keep_file(relpath: Column, extensions: str = "") -> Column:
    """S3 + S4 + S5 together."""
    return ~in_skipped_dir(relpath) & has_extension(basename(relpath), extensions) & ~is_binary(relpath)


#: Text that a task holds before it hands it on, and files.
BATCH_BYTES, BATCH_FILES = 8 << 20, 256
#: Bytes and files that one reading task is given, about.
TASK_BYTES, TASK_FILES = 64 << 20, 2_000
FILES = "path binary, rel string, size long"
ENTRIES = "path binary, rel string, is_dir boolean, size long"
TEXTS = "rel string, text string, error string"
#: Names that Spark's file sources pass over, and characters that they take for a glob.
AWKWARD, GLOB = re.compile(r"^[._]|\._COPYING_$"), "*?[]{}\\"


class _Store:
    """The few calls that a tree needs, on a worker: local paths as bytes, else the file system of a URI.

    Opening the file system fails here, for the whole store; what its calls raise is one file's or directory's.
    """

    def __init__(self, root: str | None) -> None:
        self.fs = None
        if root is not None:
            from pyarrow import fs
            self.fs, base = fs.FileSystem.from_uri(root)
            self.scheme = root[:len(root) - len(base)]

    def list(self, path: bytes) -> Iterator[tuple[bytes, bytes, bool, int]]:
        """(path, name, is a directory, size) of a directory's entries; links to directories are left out."""
        if self.fs is None:
            with os.scandir(path) as entries:
                for e in entries:
                    is_dir = e.is_dir(follow_symlinks=False)
                    if is_dir or e.is_file():
                        yield e.path, e.name, is_dir, 0 if is_dir else e.stat().st_size
        else:
            from pyarrow import fs
            for e in self.fs.get_file_info(fs.FileSelector(path.decode()[len(self.scheme):])):
                yield (self.scheme + e.path).encode(), e.base_name.encode(), e.type == fs.FileType.Directory, e.size or 0

    def read(self, path: bytes) -> bytes:
        if self.fs is None:
            with open(path, "rb") as f:
                return f.read()
        with self.fs.open_input_stream(path.decode()[len(self.scheme):], compression=None) as f:
            return f.read()


def _is_local(root: str) -> bool:
    return root.startswith("file:") or "://" not in root


def _workers_open(root: str) -> bool:
    """Whether the Python client opens the root's store; the driver's answer stands for the workers, which fail if theirs differs."""
    try:
        _Store(None if _is_local(root) else root)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _shown(name: bytes) -> str:
    """A name as text; bytes that are no UTF-8 are written as escapes."""
    return name.decode("utf-8", errors="backslashreplace")


def _roots(spark: SparkSession, root: str) -> tuple[bool, list[tuple[bytes, str, bool, int]]]:
    """(is local, [(path, relative path, is a directory, size)]) of what ``root`` names: a directory, a file, or a glob of either.

    ``~``, ``..``, ``file:`` and spaces are allowed; a name that exists is taken
    as written, even if it looks like a glob.  Relative paths count from the
    directory, from a single file's directory, or from the glob's fixed part.
    """
    local = _is_local(root)
    if local:
        path = "/" + root.split(":", 1)[1].lstrip("/") if root.startswith("file:") else os.path.abspath(os.path.expanduser(root))
        path = os.path.normpath(path)
        if os.path.isdir(path):
            return True, [(os.fsencode(path), "", True, 0)]
        if os.path.exists(path):
            return True, [(os.fsencode(path), _shown(os.fsencode(os.path.basename(path))), False, os.path.getsize(path))]
        found = glob.glob(path, include_hidden=True) if any(c in path for c in "*?[") else []
        fixed = path[:min((path.index(c) for c in "*?[" if c in path), default=len(path))].rsplit("/", 1)[0]
        out = [(os.fsencode(p), _shown(os.fsencode(os.path.relpath(p, fixed or "/"))), os.path.isdir(p), 0 if os.path.isdir(p) else os.path.getsize(p)) for p in sorted(found)]
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        statuses = [store.getFileStatus(hadoop)] if store.exists(hadoop) else list(store.globStatus(hadoop) or [])
        whole = len(statuses) == 1 and store.exists(hadoop)
        fixed = root[:min((root.index(c) for c in "*?[" if c in root), default=len(root))].rsplit("/", 1)[0]
        out = []
        for st in statuses:
            p = st.getPath().toString()
            rel = ("" if st.isDirectory() else posixpath.basename(p)) if whole else p[len(fixed):].lstrip("/")
            out.append((p.encode(), rel, st.isDirectory(), st.getLen()))
    if not out:
        raise FileNotFoundError(root)
    return local, out


def _rows(rows: list[tuple], names: list[str]):
    import pyarrow as pa
    types = {"path": pa.binary(), "rel": pa.string(), "is_dir": pa.bool_(), "size": pa.int64(), "text": pa.large_string(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)], names)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size) of every file below ``root`` outside the skipped directories, hidden ones too.

    Each round lists the directories of one level on the executors; the loop runs
    once for each level of the tree.  In a store that only Spark's file systems
    open the driver lists them, and holds LISTED files at a time; a link to a
    directory is left out if the store tells it from one.  A root whose store can't be opened is an error; a directory below it that can't
    be listed is passed over.
    """
    local, roots = _roots(spark, root)
    base = f"{checkpoint_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    delete_on_exit(spark, base)
    if not _workers_open(root):
        return _list_by_driver(spark, roots, base)
    store_root = None if local else root

    def entries(batches):
        store = _Store(store_root)
        for b in batches:
            for path, rel in zip(b.column("path").to_pylist(), b.column("rel").to_pylist()):
                out = []
                try:
                    for p, name, is_dir, size in store.list(path):
                        if not (is_dir and _shown(name) in SKIP_DIRS):
                            out.append((p, f"{rel}/{_shown(name)}" if rel else _shown(name), is_dir, size))
                        if len(out) >= 10_000:
                            yield _rows(out, ["path", "rel", "is_dir", "size"])
                            out = []
                except (OSError, ValueError):
                    if not rel:
                        raise
                yield _rows(out, ["path", "rel", "is_dir", "size"])

    found = spark.createDataFrame([(bytearray(p), r, d, s) for p, r, d, s in roots], ENTRIES)
    levels = []
    while True:
        path = f"{base}/{len(levels)}"
        found.write.parquet(path)
        found = spark.read.schema(ENTRIES).parquet(path)
        levels.append(found)
        dirs = found.where("is_dir")
        n = dirs.count()
        if not n:
            break
        # a number, as many names are few bytes, which would be put into one task
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_FILES))
        found = dirs.select("path", "rel").repartition(tasks, "rel").mapInArrow(entries, ENTRIES)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("NOT is_dir").select("path", "rel", "size")


#: Files that the driver holds before it writes them to the listing.
LISTED = 50_000


def _list_by_driver(spark: SparkSession, roots: list[tuple[bytes, str, bool, int]], base: str) -> DataFrame:
    """``list_tree`` through the session's file systems, written in parts of LISTED files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held, parts = [], 0

    def flush() -> None:
        nonlocal held, parts
        spark.createDataFrame([(bytearray(p), r, s) for p, r, s in held], FILES).write.parquet(f"{base}/{parts}")
        held, parts = [], parts + 1

    waiting = []
    for path, rel, is_dir, size in roots:
        (waiting if is_dir else held).append((path, rel, size))
    while waiting:
        path, rel, _ = waiting.pop()
        folder = jvm.org.apache.hadoop.fs.Path(path.decode())
        store = folder.getFileSystem(conf)
        try:
            entries = store.listStatusIterator(folder)
            while entries.hasNext():
                e = entries.next()
                p = e.getPath()
                name = p.getName()
                below = f"{rel}/{name}" if rel else name
                if e.isDirectory():
                    if name not in SKIP_DIRS and not e.isSymlink():
                        waiting.append((p.toString().encode(), below, 0))
                else:
                    held.append((p.toString().encode(), below, e.getLen()))
                if len(held) >= LISTED:
                    flush()
        except Py4JJavaError:
            if not rel:
                raise
    flush()
    return spark.read.schema(FILES).parquet(*[f"{base}/{i}" for i in range(parts)])


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Removes an intermediate folder when the session's file system closes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def read_tree(spark: SparkSession, root: str, extensions: str = "", paths=None, partitions: int | None = None, errors: bool = False) -> DataFrame:
    """(doc_id, filename, file, text) for every kept file under ``root``.

    ``root`` is a directory, a single file or a glob.  ``file`` is the path
    relative to the root and also the identity ``doc_id``; ``filename`` is the
    base name, which scoring looks at.  Files that can't be read are passed over,
    or with ``errors`` have a row with a NULL text (a column ``error`` tells why);
    bytes that are no UTF-8 are dropped, characters that are there stay.  A root
    whose store can't be opened is an error.

    ``paths`` replaces the listing: a list or a DataFrame with a ``path`` column
    of files, below the root or not (then ``file`` is the path itself).
    """
    local = _is_local(root)
    if paths is None:
        files = list_tree(spark, root)
    else:
        listing = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
        base = (os.path.abspath(root.split(":", 1)[1] if root.startswith("file:") else os.path.expanduser(root)) if local else root).rstrip("/") + "/"
        path = F.regexp_replace("path", "^file:/*", "/") if local else F.col("path")
        files = listing.select(path.alias("p")).select(
            F.col("p").cast("binary").alias("path"),
            F.when(F.startswith("p", F.lit(base)), F.col("p").substr(F.lit(len(base) + 1), F.length("p"))).otherwise(F.col("p")).alias("rel"), F.lit(0).cast("long").alias("size"))
    files = files.where(keep_file(F.col("rel"), extensions))
    if not _workers_open(root):
        read = _read_by_spark(spark, root, files)
    else:
        if partitions is None:
            total = files.agg(F.sum("size"), F.count(F.lit(1))).first()
            partitions = max(spark.sparkContext.defaultParallelism, math.ceil((total[0] or 0) / TASK_BYTES), math.ceil(total[1] / TASK_FILES))
        read = _read_by_workers(files.select("path", "rel").repartition(partitions, F.xxhash64("rel")), None if local else root)
    read = read.select(F.col("rel").alias("doc_id"), basename(F.col("rel")).alias("filename"), F.col("rel").alias("file"), "text", "error")
    return read if errors else read.where("error IS NULL").drop("error")


def _read_by_workers(files: DataFrame, store_root: str | None) -> DataFrame:
    """(rel, text, error) of files, read by the Python workers."""
    def texts(batches):
        store = _Store(store_root)
        for b in batches:
            out, held = [], 0
            for path, rel in zip(b.column("path").to_pylist(), b.column("rel").to_pylist()):
                try:
                    raw = store.read(path)
                    out.append((rel, raw.decode("utf-8", errors="ignore"), None))
                    held += len(raw)
                except (OSError, ValueError) as e:
                    out.append((rel, None, str(e)))
                if held >= BATCH_BYTES or len(out) >= BATCH_FILES:
                    yield _rows(out, ["rel", "text", "error"])
                    out, held = [], 0
            yield _rows(out, ["rel", "text", "error"])

    return files.mapInArrow(texts, TEXTS)


#: Paths of one ``binaryFile`` scan.
SCANNED = 10_000


def _read_by_spark(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(rel, text, error) of files in a store that only Spark's file systems open.

    ``binaryFile`` reads the files on the executors, with their paths as a list.
    It passes over names that start with ``.`` or ``_`` and takes some characters
    for a glob: such files are copied first, one after the other, to plain names
    in the shared folder.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    hadoop.Path(root).getFileSystem(conf)  # a store that can't be opened is an error, a file that can't isn't
    plain = f"{checkpoint_dir(spark).rstrip('/')}/plain-{uuid.uuid4().hex}"
    delete_on_exit(spark, plain)
    paths, listed, missed, copied = [], [], [], 0
    for row in files.select("path", "rel").toLocalIterator():
        path = hadoop.Path(bytes(row["path"]).decode())
        if AWKWARD.search(path.getName()) or any(c in row["rel"] for c in GLOB):
            copy = hadoop.Path(f"{plain}/f{copied}")
            copied += 1
            try:
                hadoop.FileUtil.copy(path.getFileSystem(conf), path, copy.getFileSystem(conf), copy, False, conf)
            except Py4JJavaError as e:
                missed.append((row["rel"], None, str(e.java_exception.getMessage())))
                continue
            path = copy.getFileSystem(conf).resolvePath(copy)
        else:
            try:
                if not path.getFileSystem(conf).exists(path):
                    raise FileNotFoundError(path.toString())
            except (Py4JJavaError, FileNotFoundError) as e:
                missed.append((row["rel"], None, str(e)))
                continue
        paths.append(path.toString())
        listed.append((path.toString(), row["rel"]))
    out = spark.createDataFrame(missed, TEXTS)
    for i in range(0, len(paths), SCANNED):
        names = spark.createDataFrame(listed[i:i + SCANNED], "path string, rel string")
        content = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths[i:i + SCANNED]).select("path", "content")
        whole = content.join(F.broadcast(names), "path").select("rel", F.col("content").alias("path"))  # at most SCANNED names

        def decoded(batches):
            for b in batches:
                texts = [x.decode("utf-8", errors="ignore") for x in b.column("path").to_pylist()]
                yield _rows([(r, t, None) for r, t in zip(b.column("rel").to_pylist(), texts)], ["rel", "text", "error"])

        out = out.unionByName(whole.mapInArrow(decoded, TEXTS))
    return out


def _opened(root: str):
    """pyarrow's file system of a root, and the root's path in it."""
    from pyarrow import fs as pafs
    if _is_local(root):
        return pafs.LocalFileSystem(), "/" + root.split(":", 1)[-1].lstrip("/") if root.startswith("file:") else root
    return pafs.FileSystem.from_uri(root)


def _put(target: str, data: bytes) -> None:
    """Writes a local file; its folders are made if it turns out that they are missing."""
    try:
        fd = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o666)
    except FileNotFoundError:
        folder = os.path.dirname(target)
        try:
            os.mkdir(folder)
        except OSError:  # there by now, or its own folder is missing
            os.makedirs(folder, exist_ok=True)
        fd = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o666)
    with open(fd, "wb") as f:
        f.write(data)


def write_tree(docs: DataFrame, root: str, invalid_every: int = 11) -> str:
    """Write (doc_id, path, text) rows as files ``root/path`` from the executors.

    Fixture helper for directory scans: every ``invalid_every``-th document
    gets two invalid UTF-8 bytes appended (S6).  ``root`` may be a local path or
    a shared-storage URI, which pyarrow's file system layer writes to.
    """
    local = _is_local(root)

    def write_part(rows):
        filesystem, base = _opened(root)
        base = base.rstrip("/")
        for r in rows:
            target = base + "/" + r["path"]
            data = (r["text"] or "").encode("utf-8")
            if invalid_every and r["doc_id"] % invalid_every == 0:
                data += b"\xff\xfe"
            if local:
                _put(target, data)
                continue
            filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with filesystem.open_output_stream(target, compression=None) as f:
                f.write(data)
    docs.select("doc_id", "path", "text").foreachPartition(write_part)
    return root


#: Linux: the calls that read and set a directory's flags, and the flag of one whose directories have nothing to do with each other.
GET_FLAGS, SET_FLAGS, UNRELATED = 0x80086601, 0x40086602, 0x20000


def spread_folders(folder: str) -> None:
    """Makes a local folder and asks its disk to place each directory below it apart.

    ext4 looks for a free entry near the parent directory and passes over those
    that were deleted in the last minutes one by one, so a tree made where another
    was just removed takes many times as long.  Elsewhere the hint is not known,
    and nothing needs it.
    """
    if not _is_local(folder):
        return
    path = _opened(folder)[1]
    os.makedirs(path, exist_ok=True)
    try:
        import fcntl
        fd = os.open(path, os.O_RDONLY)
        try:
            flags = array.array("l", [0])
            fcntl.ioctl(fd, GET_FLAGS, flags, True)
            flags[0] |= UNRELATED
            fcntl.ioctl(fd, SET_FLAGS, flags)
        finally:
            os.close(fd)
    except (ImportError, OSError):
        pass


def remove_tree(docs: DataFrame, root: str) -> None:
    """Remove what ``write_tree`` wrote: the files' directories on the executors, what is left by the driver."""
    def remove_part(rows):
        filesystem, base = _opened(root)
        for r in rows:
            try:
                filesystem.delete_dir(f"{base.rstrip('/')}/{r['dir']}")
            except OSError:  # it lay in one that is gone
                pass
    spark = docs.sparkSession
    dirs = docs.select(F.regexp_extract("path", "^(.+)/", 1).alias("dir")).where("dir <> ''").distinct()
    dirs.repartition(spark.sparkContext.defaultParallelism).foreachPartition(remove_part)  # names are short, calls are slow
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def through_tree(slices: list[DataFrame], base: str) -> DataFrame:
    """What ``read_tree`` finds in the trees that ``write_tree`` makes of ``slices``, one tree at a time.

    A file and its directory take a block of the disk each, however short the
    text is; so a tree is removed as soon as its texts are in a table.  Rows of
    one path must be in one slice.
    """
    spark = slices[0].sparkSession
    spread_folders(base)
    for i, docs in enumerate(slices):
        root = f"{base}/files-{i}"
        write_tree(docs.repartition(spark.sparkContext.defaultParallelism), root)
        read_tree(spark, root).write.parquet(f"{base}/texts/{i}")
        remove_tree(docs, root)
    return spark.read.parquet(*[f"{base}/texts/{i}" for i in range(len(slices))])
