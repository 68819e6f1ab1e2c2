"""Zip packages as a source: their members as rows, and which of them are the documents of an act.

Archives are read by Spark (``binaryFile``), so any store it knows will do; members come out of an Arrow kernel, one archive
at a time and a member at a time. What can't be read is a row with a state, not an error.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: An archive that declares more uncompressed bytes is refused (its state is ``too_large``), so a task's memory is bounded.
MOST_BYTES = 256 << 20
#: Members that leave a task at once, and bytes of them from which no more are added.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Root tags of an act's own document and of an annex, what an act holds, and wrappers that are no document.
ACT_ROOTS = ("ACT", "CONS.ACT", "CONS.DOC")
ANNEX_ROOT = "ANNEX"
TERMS = "ENACTING.TERMS"
WRAPPERS = ("DOC", "PUBLICATION")


def well_formed(data: bytes | None):
    """The root of an XML document; None if it isn't well formed or declares entities, which may expand without end."""
    if data is None or b"<!ENTITY" in data:
        return None
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return None


def _extracted(blob: bytes | None, most: int):
    """(state, place, name, data) of each file in an archive, directories left out; one row without a name if it can't be read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(blob or b""))
    except zipfile.BadZipFile:
        yield "damaged", 0, None, None
        return
    with archive:
        files = [f for f in archive.infolist() if not f.is_dir()]
        if sum(f.file_size for f in files) > most:
            yield "too_large", 0, None, None
        elif not files:
            yield "empty", 0, None, None
        else:
            for place, f in enumerate(files):
                try:
                    yield "read", place, f.filename, archive.read(f)
                except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, OSError, ValueError, zlib.error):
                    yield "damaged", place, f.filename, None


def members(archives: DataFrame, key: str, content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """(key, state, place, name, data): every member of every archive, in the archive's order, byte for byte.

    ``state`` is ``read``, or ``damaged`` (an archive or one member of it), ``too_large`` or ``empty`` (then without a name). A null
    archive is damaged.
    """
    rows = archives.select(key, F.col(content).cast("binary").alias("_blob"))
    fields = [("state", T.StringType()), ("place", T.IntegerType()), ("name", T.StringType()), ("data", T.BinaryType())]
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in fields]])
    return _each(rows, key, schema, lambda blob: _extracted(blob, most))


def _each(rows: DataFrame, key: str, schema: T.StructType, opened) -> DataFrame:
    """(key, the fields that ``opened`` gives of each archive), in batches of bounded size; the last field is bytes."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            at: list[int] = []
            held: list[tuple] = []
            size = 0

            def made():
                return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *map(pa.array, zip(*held), arrow.types[1:])], schema=arrow)

            for i, blob in enumerate(batch.column("_blob")):
                for row in opened(blob.as_py()):
                    at.append(i)
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
                        yield made()
                        at, held, size = [], [], 0
            if held:
                yield made()

    return rows.mapInArrow(run, schema)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The members of the zip files below ``path``, keyed by ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return members(files, "path")


def _shape(data: bytes | None) -> tuple[str | None, bool | None]:
    """(root tag, whether it has enacting terms) of a member; nulls if it isn't well formed."""
    root = well_formed(data)
    return (None, None) if root is None else (root.tag, root.find(f".//{TERMS}") is not None)


def _roles(files: list[tuple]) -> list[tuple]:
    """(name, place, role, data) of the documents among one archive's members (state, place, name, data)."""
    told = []
    for state, place, name, data in files:
        if name is None or state not in ("read", "damaged") or not name.lower().endswith(".xml"):
            continue
        root, terms = _shape(data)
        if root in WRAPPERS:
            continue
        kind = "unreadable" if root is None else "annex" if root == ANNEX_ROOT else "act" if root in ACT_ROOTS and terms else "other"
        told.append((name, place, kind, data))
    choice = [(kind != "act", name.encode(), place) for name, place, kind, _ in told if kind in ("act", "other")]
    first = min(choice, default=(None, None, None))[1:]
    return [(n, p, "act" if (n.encode(), p) == first else k if k in ("annex", "unreadable") else "other", d) for n, p, k, d in told]


_DOCUMENT = [T.StructField("name", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("data", T.BinaryType())]


def read_documents(archives: DataFrame, key: str, content: str = "content", most: int = MOST_BYTES, data: bool = True) -> DataFrame:
    """(key, name, place, role, data): the :func:`documents` of archives, each archive opened once and nothing shuffled; without
    ``data`` their bytes are null. ``key`` names one archive."""
    rows = archives.select(key, F.col(content).cast("binary").alias("_blob"))

    def opened(blob):
        for name, place, role, held in _roles(list(_extracted(blob, most))):
            yield name, place, role, held if data else None

    return _each(rows, key, T.StructType([rows.schema[key], *_DOCUMENT]), opened)


def documents(found: DataFrame, key: str) -> DataFrame:
    """(key, name, place, role, data): the documents among members: the act's own, then its annexes, and what couldn't be read.

    XML members count, in order of their names. The act is the first with an act's root and enacting terms, or else the first
    that is neither an annex nor a wrapper; ``role`` is ``act``, ``annex``, ``unreadable`` or, for documents not taken, ``other``.
    Of repeated names the first in the archive counts for the choice.
    """
    schema = T.StructType([found.schema[key], *_DOCUMENT])
    arrow = to_arrow_schema(schema)

    def roles(group: pa.Table) -> pa.Table:
        files = list(zip(*(group.column(c).to_pylist() for c in ("state", "place", "name", "data"))))
        told = _roles(files)
        keys = group.column(key).slice(0, 1).take(pa.array([0] * len(told), pa.int64()))
        return pa.Table.from_arrays([keys, *[pa.array([t[i] for t in told], arrow.types[i + 1]) for i in range(4)]], schema=arrow)

    return found.select(key, "state", "place", "name", "data").groupBy(key).applyInArrow(roles, schema)
