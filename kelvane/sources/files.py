"""Matrix files: Matrix Market text, NumPy archives, MATLAB files, Parquet; and a resolver of names."""

from __future__ import annotations

import io
import os
import shutil
import tarfile
import urllib.request
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from . import generators, matlab, mtx_source

EXTENSIONS = (".npz", ".mtx", ".mat")


def read_mtx(spark: SparkSession, path: str) -> SparseMatrix:
    """Coordinate or array format; real, integer or pattern; general, symmetric or skew-symmetric. Repeated cells add up."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    if head is None:
        raise ValueError(f"{path} is no Matrix Market file")
    _, _, layout, field, symmetry = head[0].lower().split()[:5]
    if field == "complex" or symmetry == "hermitian":
        raise ValueError("complex matrices are not supported")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = body.select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("at"))
    shape = [int(x) for x in parts.orderBy("at").first()["p"]]
    rest = parts.where(F.col("at") > parts.agg(F.min("at")).first()[0])
    if layout == "coordinate":
        val = F.lit(1.0) if field == "pattern" else F.col("p")[2].cast("double")
        cells = rest.select((F.col("p")[0].cast("long") - 1).alias("row"), (F.col("p")[1].cast("long") - 1).alias("col"), val.alias("val"))
    else:  # dense, by columns: the place of a value is its rank, from counts of the partitions before
        pid = F.shiftright("at", 33)
        before, sizes = 0, {}
        for r in rest.groupBy(pid.alias("p")).agg(F.count("*").alias("n"), F.min("at").alias("lo")).orderBy("p").collect():  # a row a partition
            sizes[r["p"]] = (before - r["lo"], r["lo"])
            before += r["n"]
        shift = F.create_map(*[F.lit(x) for k, (s, _) in sizes.items() for x in (k, s)]) if sizes else F.create_map(F.lit(0), F.lit(0))
        k = F.col("at") + shift[pid]
        cells = rest.select(F.pmod(k, F.lit(shape[0])).alias("row"), F.floor(k / shape[0]).cast("long").alias("col"), F.col("p")[0].cast("double").alias("val")).where("val <> 0")
    if symmetry != "general":
        sign = -1.0 if symmetry.startswith("skew") else 1.0
        cells = cells.unionByName(cells.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))
    return SparseMatrix.of(cells, shape[0], shape[1], os.path.basename(path))


def write_mtx(m: SparseMatrix, path: str) -> None:
    """One text file, by row and column: tasks write its parts, whose bytes are copied behind the header."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    parts = f"{os.path.abspath(path)}-{uuid.uuid4().hex}"
    mtx_source.write(m, parts)
    with open(path, "wb") as out:
        for name in sorted(os.listdir(parts)):  # the header's name comes before those of the parts
            with open(f"{parts}/{name}", "rb") as f:
                shutil.copyfileobj(f, out, 1 << 24)
    shutil.rmtree(parts)


def _archive(raw: bytes) -> tuple[tuple[int, int], pd.DataFrame]:
    z = np.load(io.BytesIO(raw), allow_pickle=False)
    kind = z["format"].item()
    kind = kind.decode() if isinstance(kind, bytes) else str(kind)
    shape = tuple(int(x) for x in z["shape"])
    if kind in ("csr", "csc"):
        major = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
        row, col = (major, z["indices"]) if kind == "csr" else (z["indices"], major)
    elif kind == "coo":
        row, col = z["row"], z["col"]
    else:
        raise ValueError(f"archive format {kind} is not supported")
    return shape, pd.DataFrame({"row": row.astype(np.int64), "col": col.astype(np.int64), "val": z["data"].astype(float)})


def _read_whole(spark: SparkSession, path: str, parse) -> SparseMatrix:
    """A file that one task takes as a whole; ``parse`` makes shape and entries of its bytes."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def shapes(parts):
        for p in parts:
            for raw in p.content:
                s, _ = parse(raw)
                yield pd.DataFrame({"r": [s[0]], "c": [s[1]]})

    def cells(parts):
        for p in parts:
            for raw in p.content:
                yield parse(raw)[1]

    r, c = files.mapInPandas(shapes, "r long, c long").first()
    return SparseMatrix.of(files.mapInPandas(cells, "row long, col long, val double"), r, c, os.path.basename(path))


def read_npz(spark: SparkSession, path: str) -> SparseMatrix:
    return _read_whole(spark, path, _archive)


def read_mat(spark: SparkSession, path: str) -> SparseMatrix:
    """The first sparse or two-dimensional numeric variable of a MATLAB file of level 5 (versions 5 to 7)."""
    return _read_whole(spark, path, matlab.first_matrix)


def write_npz(m: SparseMatrix, path: str) -> None:
    """A compressed-row archive. The format is one file for one machine: the entries pass through the driver."""
    t = m.entries.orderBy("row", "col").toPandas()
    indptr = np.r_[0, np.cumsum(np.bincount(t.row, minlength=m.nrows))]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    np.savez_compressed(path, format=np.array(b"csr"), shape=np.array([m.nrows, m.ncols]), data=t.val.to_numpy(), indices=t.col.to_numpy(np.int32), indptr=indptr.astype(np.int32))


def save(m: SparseMatrix, path: str) -> str:
    if path.endswith(".mtx"):
        write_mtx(m, path)
    elif path.endswith(".parquet"):
        m.entries.withColumns({"nrows": F.lit(m.nrows), "ncols": F.lit(m.ncols)}).write.parquet(path)
    else:
        path = path if path.endswith(".npz") else path + ".npz"
        write_npz(m, path)
    return path


def unpack(archive: str, folder: str) -> str:
    """The first Matrix Market file of a ``.tar.gz`` archive, written to ``folder`` under the archive's name; gives its path.

    A file that is there already is taken as it is. Only that one member's bytes are read, whatever its path in the archive.
    """
    name = os.path.basename(archive).removesuffix(".tar.gz").removesuffix(".tgz")
    path = os.path.join(folder, name + ".mtx")
    if os.path.exists(path):
        return path
    with tarfile.open(archive, "r:gz") as tar:
        for member in tar:
            if member.isfile() and member.name.endswith(".mtx"):
                os.makedirs(folder, exist_ok=True)
                with open(path + ".part", "wb") as out:
                    shutil.copyfileobj(tar.extractfile(member), out)
                os.replace(path + ".part", path)
                return path
    raise ValueError(f"{archive}: no Matrix Market file in it")


def downloader(base_url: str, folder: str):
    """A ``fetch`` for :func:`load`: gets ``base_url`` + name + ``.tar.gz`` (any scheme, file:// as well) and unpacks it."""

    def fetch(name: str) -> str:
        path = os.path.join(folder, name + ".mtx")
        if not os.path.exists(path):
            os.makedirs(folder, exist_ok=True)
            archive = os.path.join(folder, name + ".tar.gz")
            urllib.request.urlretrieve(f"{base_url}{name}.tar.gz", archive)
            path = unpack(archive, folder)
        return path

    return fetch


def available(folder: str) -> list[str]:
    """Names of the matrices in a folder; none if there is no folder."""
    return sorted({os.path.splitext(f)[0] for f in os.listdir(folder) if f.endswith(EXTENSIONS)}) if os.path.isdir(folder) else []


def load(spark: SparkSession, name: str, folder: str = "data", fetch=None, on_missing: str = "raise") -> SparseMatrix:
    """A path, else a name in the folder, else what ``fetch(name)`` brings (a path), else a random matrix if asked for."""
    found = [name] if os.path.exists(name) else [p for e in EXTENSIONS if os.path.exists(p := os.path.join(folder, name + e))]
    if not found and fetch is not None:
        found = [fetch(name)]
    if found:
        path = os.path.abspath(found[0])
        if path.endswith(".mtx"):
            return read_mtx(spark, path)
        if path.endswith(".npz"):
            return read_npz(spark, path)
        if path.endswith(".parquet"):
            t = spark.read.parquet(path)
            r, c = t.agg(F.max("nrows"), F.max("ncols")).first()
            return SparseMatrix(t.select("row", "col", "val"), r, c, os.path.basename(path))
        if path.endswith(".mat"):
            return read_mat(spark, path)
        raise ValueError(f"{path}: not a known kind of matrix file")
    if on_missing == "generate":
        seed = spark.range(1).select(F.xxhash64(F.lit(name))).first()[0] % 2**31
        return generators.generate(spark, 200, 200, 0.05, seed=seed)
    raise FileNotFoundError(f"no matrix {name}")
