"""Question sets on disk: Parquet with geometries as WKB, and a JSON sidecar with metadata."""

from __future__ import annotations

import json
import logging
import platform
import subprocess
from datetime import datetime, timezone
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terramill.functions.wkb import rings_to_wkb, wkb_to_rings
from terramill.operators.validate import LISTS, answer_stats, frequencies, violations
from terramill.session import Scratch, delete_path
from terramill.sources.extracts import storable

FORMAT_VERSION = 1
CRS = "EPSG:2154"
log = logging.getLogger(__name__)


def _path(path: str) -> str:
    return path if path.endswith(".parquet") else f"{path}.parquet"


def _meta_path(path: str) -> str:
    return _path(path).removesuffix(".parquet") + ".meta.json"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def git_commit() -> str | None:
    """The package's commit; null outside a repository."""
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip() if out.returncode == 0 else None


def encode_geometries(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Geometries (columns that end in _geometry and hold rings or parts) as WKB, empty ones as null."""
    names = [f.name for f in rows.schema if f.name.endswith("_geometry")]
    arrays = [n for n in names if isinstance(rows.schema[n].dataType, T.ArrayType)]
    return rows.withColumns({n: rings_to_wkb(n) for n in arrays}) if arrays else rows, names


def normalise_lists(rows: DataFrame) -> DataFrame:
    """Null answer lists as empty ones."""
    return rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in LISTS if c in rows.columns})


def describe(rows: DataFrame, extra: dict | None = None) -> dict:
    """Metadata of a question set: size, columns, counts by template and category, answer sizes, provenance."""
    # The key names of the sidecar are a file format.
    stats = answer_stats(rows).first().asDict() if "results_poi_id" in rows.columns else {"n_questions": rows.count()}
    meta = {
        "format_version": FORMAT_VERSION, "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "n_questions": stats.pop("n_questions"),
        "columns": rows.columns, "geometry_columns": [c for c in rows.columns if c.endswith("_geometry")], "list_columns": [c for c in LISTS if c in rows.columns],
        "crs": CRS, "git_commit": git_commit(), "library_versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
    }
    for name, column in (("questions_by_function", "function"), ("questions_by_category", "category_query")):
        if column in rows.columns:
            meta[name] = {str(r["value"]): r["n"] for r in frequencies(rows, column).collect()}
    if stats:
        meta["answer_sizes"] = stats
    return meta | (extra or {})


def save(rows: DataFrame, path: str, *, places: DataFrame | None = None, meta: dict | None = None, validate: str | None = "warn", overwrite: bool = False, key: str = "question_id") -> str:
    """Writes the question set and its sidecar; returns the path, which gets the suffix .parquet.

    An existing path raises FileExistsError unless ``overwrite``. ``validate``:
    'raise' refuses incoherent sets, 'warn' logs a summary, None doesn't look.
    """
    if validate not in ("warn", "raise", None):
        raise ValueError(f"validate must be 'warn', 'raise' or None, not {validate!r}")
    spark, path = rows.sparkSession, _path(path)
    if exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")
    if validate:
        rows = Scratch(spark, "checked").cut(rows, "rows")
        found = violations(rows, places, key).groupBy("check").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check").collect()
        if found:
            text = ", ".join(f"{r['check']} {r['n']}" for r in found)
            if validate == "raise":
                raise ValueError(f"incoherent question set: {text}")
            log.warning("incoherent question set %s: %s", path, text)
    encoded, _ = encode_geometries(normalise_lists(storable(rows)))
    encoded.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    # described as written, so that the questions aren't made again
    write_text(spark, _meta_path(path), json.dumps(describe(spark.read.parquet(path).select(rows.columns), meta), indent=2, ensure_ascii=False))
    return path


def load(spark: SparkSession, path: str, with_meta: bool = False):
    """The question set with geometries as rings, and its metadata if asked; a newer format raises ValueError."""
    path = _path(path)
    meta = json.loads(read_text(spark, _meta_path(path))) if exists(spark, _meta_path(path)) else None
    if meta and meta.get("format_version", 0) > FORMAT_VERSION:
        raise ValueError(f"{path} has format {meta['format_version']}, this code reads up to {FORMAT_VERSION}")
    rows = spark.read.parquet(path)
    names = (meta or {}).get("geometry_columns") or [c for c in rows.columns if c.endswith("_geometry")]
    binary = [c for c in names if c in rows.columns and isinstance(rows.schema[c].dataType, T.BinaryType)]
    if binary:
        rows = rows.withColumns({c: wkb_to_rings(c) for c in binary})
    return (rows, meta) if with_meta else rows


def save_suite(sets: dict[str, DataFrame], folder: str, **options) -> dict[str, str]:
    return {name: save(rows, f"{folder}/{name}", **options) for name, rows in sets.items()}


def load_suite(spark: SparkSession, folder: str, with_meta: bool = False) -> dict:
    """Name -> question set of every .parquet in the folder, sorted; a missing folder raises FileNotFoundError."""
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        raise FileNotFoundError(folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    return {n.removesuffix(".parquet"): load(spark, f"{folder}/{n}", with_meta) for n in names if n.endswith(".parquet")}


def save_train_test(sets: DataFrame, folder: str, config: dict) -> None:
    """Training and test rows of ``semantic.train_test`` as two tables, and the configuration without its seed as JSON."""
    spark = sets.sparkSession
    sets.where("NOT is_test").drop("is_test").write.mode("overwrite").parquet(f"{folder}/train_set.parquet")
    sets.where("is_test AND kind = 'positive'").drop("is_test", "kind").write.mode("overwrite").parquet(f"{folder}/test_set.parquet")
    write_text(spark, f"{folder}/config.json", json.dumps({k: v for k, v in config.items() if k != "seed"}, indent=2))


def remove(spark: SparkSession, path: str) -> None:
    for p in (_path(path), _meta_path(path)):
        if exists(spark, p):
            delete_path(spark, p)
