"""Vector sources and dataset directories."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ..errors import GleaneryError
from ..functions.text import glob_regex


def read_json_vectors(spark: SparkSession, path: str, id_key: str = "id", vector_key: str = "vector", lines: bool | None = None, strict: bool = True) -> DataFrame:
    """``id, vector`` of JSON objects: one a line (``.jsonl``, ``.ndjson``), else one array.

    With ``strict`` a row without one of the keys fails the query and is named.
    """
    lines = path.endswith((".jsonl", ".ndjson")) if lines is None else lines
    schema = f"`{id_key}` string, `{vector_key}` array<double>"
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=not lines)
    rows = df.select(F.col(id_key).alias("id"), F.col(vector_key).alias("vector"))
    if not strict:
        return rows
    where = F.concat(F.lit("MISSING_KEY: a row has no "), F.when(F.col("vector").isNull(), vector_key).otherwise(id_key), F.lit(": "), F.to_json(F.struct("id", "vector")))
    return rows.where(F.when(F.col("id").isNull() | F.col("vector").isNull(), F.raise_error(where)).otherwise(F.lit(True)))


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    filesystem, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = filesystem.get_file_info(root)
    infos = [info] if info.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(root, recursive=True))
    return filesystem, sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File)


#: Bytes of a matrix that one task reads at once.
RANGE_BYTES = 16 << 20


def _read_matrix(spark: SparkSession, path: str, shape) -> DataFrame:
    """``file, row, vector`` of files of equal rows, a task for each range of rows.

    ``shape(name, size, head)`` gives (bytes before the rows, bytes before a row's
    components, components, numpy type) from a file's first bytes.
    """
    filesystem, files = _files(path)
    ranges = []
    for name, size in files:
        with filesystem.open_input_file(name) as source:
            before, lead, dim, kind = shape(name, size, source.read(min(size, 4_096)))
        row = lead + dim * np.dtype(kind).itemsize
        if dim < 1 or (size - before) % row:
            raise GleaneryError("INVALID_SIZE", f"{name} is no whole number of rows")
        n, step = (size - before) // row, max(1, RANGE_BYTES // row)
        ranges += [(name, before, lead, dim, np.dtype(kind).str, at, min(step, n - at)) for at in range(0, n, step)]
    uri = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, before, lead, dim, kind, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                row = lead + dim * np.dtype(kind).itemsize
                with own.open_input_file(name) as source:
                    raw = np.frombuffer(source.read_at(n * row, before + first * row), np.uint8).reshape(n, row)
                if lead and (np.ascontiguousarray(raw[:, :lead]).view("<i4") != dim).any():
                    raise GleaneryError("DIMENSION_MISMATCH", f"{name} has rows of several dimensions")
                m = np.ascontiguousarray(raw[:, lead:]).view(kind).astype(np.float32)
                for at in range(0, n, 4_096):
                    part = m[at : at + 4_096]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, dim, dtype=np.int32)), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(first + at, first + at + len(part)), pa.int64()), vectors], ["file", "row", "vector"])

    ship(spark)
    table = spark.createDataFrame(ranges, "name string, before long, lead long, dim long, kind string, first long, n long")
    return table.repartition(max(1, len(ranges))).mapInArrow(run, "file string, row long, vector array<float>")


def read_f32_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``file, row, vector`` of raw little-endian float32 matrices."""
    return _read_matrix(spark, path, lambda name, size, head: (0, 0, dim, "<f4"))


def read_fvecs(spark: SparkSession, path: str, kind: str = "<f4") -> DataFrame:
    """``file, row, vector`` of matrices whose rows begin with their dimension (``kind`` ``<i4`` or ``u1`` for the integer forms)."""

    def shape(name: str, size: int, head: bytes) -> tuple:
        if len(head) < 4:
            raise GleaneryError("INVALID_SIZE", f"{name} has no row")
        return 0, 4, int(np.frombuffer(head[:4], "<i4")[0]), kind

    return _read_matrix(spark, path, shape)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, vector`` of two-dimensional ``.npy`` arrays."""

    def shape(name: str, size: int, head: bytes) -> tuple:
        source = io.BytesIO(head)
        version = np.lib.format.read_magic(source)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        dims, by_column, kind = read(source)
        if len(dims) != 2 or by_column or kind.kind not in "fiu":
            raise GleaneryError("INVALID_SHAPE", f"{name} must hold rows of numbers", shape=dims)
        return source.tell(), 0, dims[1], kind.str

    return _read_matrix(spark, path, shape)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{md,mdx,html,txt}", exclude: list[str] | None = None) -> DataFrame:
    """``source_path, text`` of a folder's documents, recursively, but for those that a glob of ``exclude`` matches."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = df.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    for glob in exclude or []:
        rows = rows.where(~F.col("source_path").rlike(glob_regex(glob if glob.startswith(("/", "**")) else f"**/{glob}").replace("^", "^(?:file:)?/*", 1)))
    return rows


def read_goldens(spark: SparkSession, path: str) -> DataFrame:
    """``text, expect_id, expect_title`` of stored probe queries."""
    return spark.read.schema("text string, expect_id long, expect_title string").option("mode", "FAILFAST").json(path)


def read_shelf(spark: SparkSession, path: str) -> DataFrame:
    """``name, location, identity, description, license`` of a list of datasets; paths are relative to the list."""
    pack = "struct<name:string,url:string,path:string,identity:string,description:string,license:string>"
    listed = spark.read.schema(f"packs array<{pack}>").json(path, multiLine=True).select(F.explode("packs").alias("p")).select("p.*")
    folder = path.rsplit("/", 1)[0]
    local = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(f"{folder}/"), F.col("path")))
    bad = F.col("identity").isNotNull() & ~F.coalesce(F.col("identity").rlike("^[0-9a-f]{64}$"), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("INVALID_IDENTITY: "), F.col("name")))).otherwise(F.col("identity"))
    return listed.select("name", F.coalesce("url", local).alias("location"), checked.alias("identity"), "description", "license")


def segment(df: DataFrame, column: str, low, high) -> DataFrame:
    """The rows of a window of a source; on a partition or sorted column only its files are read."""
    return df.where(F.col(column).between(low, high))


def infer_dim(df: DataFrame, vector_col: str = "vector") -> int:
    row = df.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    if row[0] is None or row[0] != row[1] or row[0] < 1:
        raise GleaneryError("DIMENSION_MISMATCH", "vectors must share one dimension", sizes=list(row))
    return row[0]


def _digest(df: DataFrame) -> tuple[str, int]:
    """An order-free digest of a table's rows, and their number, in one pass."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring("row", i, 12), 16, 10).cast("decimal(38,0)")) for i in (1, 13, 25)]
    found = df.select(row.alias("row")).agg(F.count("*"), *parts).first()
    return hashlib.sha256("|".join(map(str, found)).encode()).hexdigest(), found[0]


def digest(df: DataFrame) -> str:
    """An order-free digest of a table's rows."""
    return _digest(df)[0]


def _manifest_file(path: str):
    filesystem, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return filesystem, f"{root}/_manifest.json"


def write_dataset(tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], path: str, config: dict | None = None, linked: dict[str, dict] | None = None) -> str:
    """Write tables and a canonical manifest; returns the manifest's identity.

    A function makes its table of those that are written before it.  ``linked`` are
    entries of another manifest, with their ``location``: tables that stay where they are.
    """
    found, written = dict(linked or {}), {}
    for name, df in sorted(tables.items(), key=lambda t: (callable(t[1]), t[0])):
        df = df(written) if callable(df) else df
        if "deleted" in df.columns and df.where("deleted").limit(1).count():
            raise GleaneryError("HAS_TOMBSTONES", f"{name} must be compacted before it is written")
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        written[name] = df.sparkSession.read.parquet(f"{path}/{name}")
        of, rows = _digest(written[name])
        found[name] = {"digest": of, "rows": rows, "schema": written[name].schema.simpleString()}
    body = json.dumps({"config": config or {}, "tables": found, "version": 1}, sort_keys=True, separators=(",", ":"))
    filesystem, file = _manifest_file(path)
    with filesystem.open_output_stream(file) as out:
        out.write(body.encode())
    return hashlib.sha256(body.encode()).hexdigest()


def entries(path: str) -> dict[str, dict]:
    """The manifest's entries of a dataset's tables, with where each table lies."""
    return {name: {"location": f"{path}/{name}"} | t for name, t in _manifest(path)[0]["tables"].items()}


def _manifest(path: str) -> tuple[dict, str]:
    filesystem, file = _manifest_file(path)
    with filesystem.open_input_stream(file) as source:
        body = source.read()
    return json.loads(body), hashlib.sha256(body).hexdigest()


def open_dataset(spark: SparkSession, path: str, identity: str | None = None, expect: dict | None = None, verify: bool = False) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables).

    With ``identity`` the manifest must be that one; with ``expect`` its
    configuration must have these values; with ``verify`` every table must have its
    digest.  Schemas always have to be those that were written.
    """
    manifest, own = _manifest(path)
    if identity and own != identity:
        raise GleaneryError("IDENTITY_MISMATCH", "the manifest has another identity")
    wrong = {k: manifest["config"].get(k) for k, v in (expect or {}).items() if manifest["config"].get(k) != v}
    if wrong:
        raise GleaneryError("CONFIG_MISMATCH", "the dataset was made with another configuration", **wrong)
    tables = {name: spark.read.parquet(t.get("location", f"{path}/{name}")) for name, t in manifest["tables"].items()}
    for name, df in tables.items():
        if df.schema.simpleString() != manifest["tables"][name].get("schema", df.schema.simpleString()):
            raise GleaneryError("SCHEMA_MISMATCH", f"{name} has another schema than the manifest says")
        if verify and digest(df) != manifest["tables"][name]["digest"]:
            raise GleaneryError("DIGEST_MISMATCH", f"{name} isn't what was written")
    return manifest, tables


def inspect_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``name, rows, digest, schema`` of each table and the identity, from the manifest alone."""
    manifest, own = _manifest(path)
    rows = [(name, t["rows"], t["digest"], t.get("schema"), own, json.dumps(manifest["config"], sort_keys=True)) for name, t in sorted(manifest["tables"].items())]
    return spark.createDataFrame(rows, "name string, rows long, digest string, schema string, identity string, config string")


def verify_dataset(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether each table still has the digest in the manifest."""
    manifest, tables = open_dataset(spark, path)
    return {name: digest(df) == manifest["tables"][name]["digest"] for name, df in tables.items()}
