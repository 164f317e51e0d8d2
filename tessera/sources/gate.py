"""Gated scans: the manifest is parsed and authorised, then the digest checked, then bytes are parsed; and fresh sinks."""

from __future__ import annotations

import contextlib
import dataclasses
import hashlib
import importlib.metadata
import json
import os
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.chemistry import with_canonical, with_scope
from ..operators.refuse import finite
from ..storage import stored
from .contracts import AUXILIARY, CHECKPOINT, DATASET, Contract, Refused
from .ranges import read_columns

TARGETS = ("delta_d", "delta_p", "delta_h")
LABELLED = ("sample_id", "smiles", *TARGETS, "label_kind")
OPTIONAL = ("temperature_k", "polymer_series", "kind")
LEAST_ROWS = 12
#: Columns of the prediction table before those of the targets.
PREDICTION = ("sample_id", "smiles", "canonical_smiles", "status", "reasons", "label_kind", "units", "real_accuracy_validated", "ood", "extrapolation", "nearest_training_tanimoto")


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a local path; Hadoop writes local URIs with one slash."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def file_digest(uri: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file of any size, read in blocks."""
    fs, path = located(uri)
    total = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as f:
        while data := f.read(block):
            total.update(data)
    return total.hexdigest()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file below a folder, streamed in blocks: files may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"path": [uri], "length": pa.array([length], pa.int64()), "sha256": [file_digest(uri)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, length long, sha256 string")


def gated(uri: str, manifest: str | bytes | dict, contract: Contract, purpose: str, blocked: tuple[str, ...] = (), digest: str = "sha256") -> dict:
    """The authorised manifest of a file whose digest is the manifest's. Order: parse, authorise, name, digest."""
    record = contract.authorize(contract.parse(manifest), purpose)
    if uri.rsplit("/", 1)[-1].lower() in blocked and not record.get("restricted_asset_permission_evidence"):
        raise Refused("this named asset is blocked until its rights are reviewed")
    if file_digest(uri) != record[digest]:
        raise Refused("the file does not match its checksum")
    return record


def csv_table(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """All columns as text, by header; a byte-order mark is dropped and a missing column refused before any row is read."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if missing := set(needed) - set(df.columns):
        raise Refused(f"missing columns: {sorted(missing)}")
    return df


def labelled_table(spark: SparkSession, uri: str, manifest: str | bytes | dict, purpose: str = "train", blocked: tuple[str, ...] = ()) -> DataFrame:
    """The labelled table of a file, its structures canonical and within scope; any violation refuses all of it."""
    record = gated(uri, manifest, DATASET, purpose, blocked)
    if abs(record["temperature_k"] - 298.15) > 1e-6:
        raise Refused("temperature outside the scope")
    raw = csv_table(spark, uri, LABELLED)
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in raw.columns})
    value = {t: F.col(t).try_cast("double") for t in TARGETS}
    bad = F.coalesce(F.col("label_kind") != record["label_kind"], F.lit(True)) | F.coalesce(F.col("kind") != "molecule", F.lit(False)) | F.coalesce(F.trim("sample_id") == "", F.lit(True)) | F.coalesce(F.trim("smiles") == "", F.lit(True))
    for t in TARGETS:
        bad = bad | ~F.coalesce(finite(value[t]), F.lit(False)) | F.coalesce(value[t] < 0, F.lit(True))
    kelvin = F.coalesce(F.nullif(F.col("temperature_k"), F.lit("")).try_cast("double"), F.lit(record["temperature_k"]))
    bad = bad | (F.abs(kelvin - 298.15) > 1e-6)
    checked = raw.agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("int")).alias("bad"), F.count_distinct("sample_id").alias("ids")).first()
    if checked["bad"]:
        raise Refused(f"{checked['bad']} rows break the contract")
    if checked["ids"] != checked["rows"]:
        raise Refused("sample_id has to be unique")
    if checked["rows"] < LEAST_ROWS:
        raise Refused(f"at least {LEAST_ROWS} rows are needed")
    raw = with_scope(with_canonical(raw).drop("structure_fault"))
    if unfit := raw.where(F.col("canonical").isNull() | ~F.col("supported")).count():
        raise Refused(f"{unfit} structures cannot be read or are out of scope")
    return raw.select("sample_id", F.col("canonical").alias("smiles"), *[v.alias(t) for t, v in value.items()], "label_kind", kelvin.alias("temperature_k"), F.coalesce("polymer_series", F.lit("")).alias("polymer_series"))


def vector_table(spark: SparkSession, uri: str, size: int) -> DataFrame:
    """smiles, e0 to e(size - 1) with exactly this header, finite values and unique structures, as canonical smiles and vector."""
    names = ["smiles", *[f"e{i}" for i in range(size)]]
    df = csv_table(spark, uri, tuple(names))
    if df.columns != names:
        raise Refused("the header has to be smiles, e0, e1, ...")
    out = with_canonical(df).select(F.col("canonical").alias("smiles"), F.array(*[F.col(c).try_cast("double") for c in names[1:]]).alias("vector"))
    found = out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("smiles").alias("keys"), F.sum(F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("int")).alias("bad")).first()
    if not found["rows"] or found["bad"] or found["keys"] != found["rows"]:
        raise Refused("vectors have to be finite, one per readable structure, and there has to be one")
    return out


def column_json(spark: SparkSession, path: str, key: str, columns: str) -> DataFrame:
    """Rows of {"key": [..], "columns": {name: [..]}} in JSON files or in ZIP files of one JSON member, of any size.

    Files are read by ranges in many tasks, and only these two columns are kept, one scalar a row; positions bring them
    together: file, position, key and a map of name to value. Nonfinite tokens are null. Columns of other lengths than
    the keys', and values that are no numbers, refuse all; so do broken texts.
    """
    read = stored(read_columns(spark, path, key, columns, located), "columns")
    sizes = read.groupBy("file", "column").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("column").isNull()).alias("keyed"))
    if sizes.where("least <> most OR NOT keyed").limit(1).count():
        raise Refused("columns differ in length")
    # A row's map has as many entries as the file has columns.
    values = read.where("column IS NOT NULL").groupBy("file", "position").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "value")))).alias("value"))
    return read.where("column IS NULL").select("file", "position", F.col("text").alias("key")).join(values, ["file", "position"], "left")


class NpzSource(DataSource):
    """spark.read.format("npz").load(path): smiles, targets[n x k] and target_names[k] of a NumPy archive, without pickles.

    Rows are read in ranges (of `rows` rows), each by its own task that seeks to them; of compressed members in one task, piece by piece.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "smiles string, targets array<double>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NpzReader(self.options["path"], self.options.get("target_names"), int(self.options.get("rows", 1 << 17)))


@dataclasses.dataclass
class _Member:
    """An array of an archive: where its data begin (None: compressed), and its layout."""

    name: str
    offset: int | None
    skip: int
    dtype: object
    shape: tuple[int, ...]
    fortran: bool

    @classmethod
    def of(cls, archive: zipfile.ZipFile, f: object, name: str) -> _Member:
        import numpy as np

        info = archive.getinfo(f"{name}.npy")
        with archive.open(info) as member:
            version = np.lib.format.read_magic(member)
            read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
            if read is None:
                raise Refused(f"{name} has an unknown version")
            shape, fortran, dtype = read(member)
            skip = member.tell()
        if dtype.hasobject:
            raise Refused(f"{name} holds objects")
        offset = None
        if info.compress_type == zipfile.ZIP_STORED:
            f.seek(info.header_offset + 26)
            sizes = f.read(4)
            offset = info.header_offset + 30 + int.from_bytes(sizes[:2], "little") + int.from_bytes(sizes[2:], "little") + skip
        return cls(name, offset, skip, dtype, shape, fortran)

    def rows(self, f: object, first: int, end: int) -> object:
        """Rows first to end - 1 of a stored member."""
        import numpy as np

        width, size = self.shape[1] if len(self.shape) > 1 else 1, self.dtype.itemsize

        def read(at: int, n: int) -> object:
            f.seek(self.offset + at * size)
            return np.frombuffer(f.read(n * size), self.dtype)

        if self.fortran and width > 1:
            out = np.stack([read(c * self.shape[0] + first, end - first) for c in range(width)], axis=1)
        else:
            out = read(first * width, (end - first) * width)
        return out.reshape(-1, width) if len(self.shape) > 1 else out


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, names: str | None, rows: int):
        self.path, self.names, self.rows = path, names, rows

    def _members(self, f: object) -> tuple[zipfile.ZipFile, _Member, _Member]:
        import numpy as np

        archive = zipfile.ZipFile(f)
        smiles, targets = (_Member.of(archive, f, n) for n in ("smiles", "targets"))
        with archive.open("target_names.npy") as member:
            names = np.lib.format.read_array(member, allow_pickle=False)
        if len(smiles.shape) != 1 or names.ndim != 1 or targets.shape != (smiles.shape[0], len(names)):
            raise Refused("shapes do not agree")
        if self.names is not None and names.tolist() != self.names.split(","):
            raise Refused("target names are not those of the manifest")
        return archive, smiles, targets

    def partitions(self) -> list[InputPartition]:
        fs, path = located(self.path)
        with fs.open_input_file(path) as f:
            _, smiles, targets = self._members(f)
        n = smiles.shape[0]
        if smiles.offset is None or targets.offset is None:
            return [InputPartition(None)]
        return [InputPartition((a, min(a + self.rows, n))) for a in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import numpy as np

        fs, path = located(self.path)
        with fs.open_input_file(path) as f:
            archive, smiles, targets = self._members(f)
            if partition.value is not None:
                pieces = iter([(smiles.rows(f, *partition.value), targets.rows(f, *partition.value))])
            elif targets.fortran and targets.shape[1] > 1:
                # Columns first, and compressed: a row's values lie far apart, so the member is read whole.
                pieces = iter([tuple(np.lib.format.read_array(archive.open(f"{m.name}.npy"), allow_pickle=False) for m in (smiles, targets))])
            else:
                pieces = self._streamed(archive, smiles, targets)
            for some, values in pieces:
                for s, t in zip(some.tolist(), values.astype(float).tolist(), strict=True):
                    yield (str(s), t)

    def _streamed(self, archive: zipfile.ZipFile, smiles: _Member, targets: _Member) -> Iterator[tuple]:
        import numpy as np

        n, k = targets.shape
        with archive.open("smiles.npy") as a, archive.open("targets.npy") as b:
            a.read(smiles.skip)
            b.read(targets.skip)
            for first in range(0, n, self.rows):
                m = min(self.rows, n - first)
                yield np.frombuffer(a.read(m * smiles.dtype.itemsize), smiles.dtype), np.frombuffer(b.read(m * k * targets.dtype.itemsize), targets.dtype).reshape(m, k)


def auxiliary_table(spark: SparkSession, uri: str, manifest: str | bytes | dict) -> DataFrame:
    record = gated(uri, manifest, AUXILIARY, "train")
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("target_names", ",".join(record["target_names"])).load(uri)


def fetched(review: str | bytes | dict, folder: str, opened: Callable[[str], object] = urllib.request.urlopen) -> list[str]:
    """The files of an approved review in a new folder, each under its name once its digest is right; the only network access, on request."""
    record = CHECKPOINT.authorize(CHECKPOINT.parse(review), "fetch")
    fs, at = fresh(folder)
    fs.create_dir(at, recursive=True)
    out = []
    for name, entry in sorted(record["files"].items()):
        if "/" in name or name.startswith(".") or set(entry) != {"url", "sha256"}:
            raise Refused(f"{name} is no plain file name with a url and a digest")
        part = f"{at}/{name}.part"
        digest = hashlib.sha256()
        with opened(entry["url"]) as source, fs.open_output_stream(part, compression=None) as target:
            while data := source.read(1 << 20):
                digest.update(data)
                target.write(data)
        if digest.hexdigest() != entry["sha256"]:
            raise Refused(f"{name} does not match its checksum")
        fs.move(part, f"{at}/{name}")
        out.append(f"{at}/{name}")
    return out


def licence_inventory() -> list[dict]:
    """Installed distributions with what they declare of their licence and the digests of their licence files; nothing is approved by it."""
    out = []
    for d in importlib.metadata.distributions():
        declared = d.metadata
        texts = [f for f in d.files or [] if any(word in f.name.lower() for word in ("licen", "copying", "notice"))]
        found = {str(f): hashlib.sha256(f.locate().read_bytes()).hexdigest() for f in texts if f.locate().is_file()}
        out.append({"name": declared["Name"], "version": d.version, "expression": declared.get("License-Expression"), "classifiers": [c for c in declared.get_all("Classifier") or [] if c.startswith("License")], "files": found, "reviewed": False})
    return sorted(out, key=lambda r: (str(r["name"]).lower(), r["version"]))


# ---------------------------------------------------------------------------------------------------------------- sinks


def fresh(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = located(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise Refused(f"{path} exists; nothing is overwritten")
    return fs, at


@contextlib.contextmanager
def committed(path: str) -> Iterator[str]:
    """A path beside `path` to write to; what is there becomes `path` in one step when all is written, or nothing does.

    Of two writers of one path the first to end has it and the other is refused: local files are linked and folders renamed,
    which fails where something is; other file systems are asked once more before the move.
    """
    fresh(path)
    stage = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    fs, part = located(stage)
    _, at = located(path)
    fs.create_dir(part.rsplit("/", 1)[0], recursive=True)
    try:
        yield stage
        folder = fs.get_file_info(part).type == pafs.FileType.Directory
        if isinstance(fs, pafs.LocalFileSystem):
            try:
                (os.rename if folder else os.link)(part, at)
            except OSError as e:
                raise Refused(f"{path} exists; nothing is overwritten") from e
        else:
            fresh(path)
            fs.move(part, at)
    finally:
        kind = fs.get_file_info(part).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(part)
        elif kind == pafs.FileType.File:
            fs.delete_file(part)


def _json_at(path: str, value: object) -> None:
    text = json.dumps(value, indent=2, allow_nan=False, ensure_ascii=False) + "\n"
    fs, at = located(path)
    with fs.open_output_stream(at) as f:
        f.write(text.encode())


def write_json(path: str, value: object) -> None:
    """A new file, indented; NaN and infinities are refused."""
    with committed(path) as stage:
        _json_at(stage, value)


def write_rows(df: DataFrame, path: str, report: dict | None = None) -> None:
    """JSON lines in a new folder and a report beside them, as one commit."""
    with committed(path) as stage:
        df.write.mode("errorifexists").json(f"{stage}/observations")
        if report is not None:
            _json_at(f"{stage}/report.json", report)


def write_predictions(df: DataFrame, path: str, targets: tuple[str, ...] = TARGETS) -> None:
    """Fixed columns, then value, lower and upper of each target; reasons joined by |; refused cells are blank."""
    with committed(path) as stage:
        if not df.limit(1).count():
            raise Refused("no rows to predict")
        columns = [*PREDICTION, *[f"{t}{s}" for t in targets for s in ("", "_lower", "_upper")]]
        text = {c: F.array_join(c, "|") if c == "reasons" else F.col(c).cast("string") for c in columns}
        df.select(*[F.coalesce(v, F.lit("")).alias(c) for c, v in text.items()]).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(stage)


def write_bundle(df: DataFrame, path: str, manifest: dict, report: dict) -> None:
    """Rows with a manifest whose permissions are all withdrawn, as one commit: a second approval is needed before they are used."""
    with committed(path) as stage:
        df.write.mode("errorifexists").parquet(f"{stage}/rows")
        _json_at(f"{stage}/manifest.json", manifest | {k: False for k in manifest if k.endswith("_allowed")} | {"rights_status": "pending"})
        _json_at(f"{stage}/report.json", report)


def schema_json(df: DataFrame) -> dict:
    return json.loads(df.schema.json())
