"""Helpers shared by the training-data operators: shared storage, words, hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit multipliers of the shingle and signature hashes.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93],
    dtype=np.uint64,
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a temporary folder is made and
    remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that a later one replaces."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def tidy(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to go when the driver's JVM collects them: let it do so now."""
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, modulus: int):
    """crc32(id as text) mod ``modulus``; a null id falls in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """An object that a Python worker keeps between tasks. It keeps one: another name replaces it, so
    workers don't hold the caches of jobs that are over."""
    if name not in _KEPT:
        release()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Drop what the worker keeps, and let the C library return freed memory to the system, where it
    can. Tasks that keep nothing themselves begin with it, as Spark uses workers again."""
    if not _KEPT and not _POWERS:
        return
    _KEPT.clear()
    _POWERS.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(29))
    h = h * MULTIPLIERS[1]
    h = h ^ (h >> np.uint64(32))
    h = h * MULTIPLIERS[0]
    return h ^ (h >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[2])[_LOWER]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = int(MULTIPLIERS[3])
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\x20\x09-\x0D]+`` of a text's bytes, A-Z lower-cased, and the places where they start.

    Polynomial hashes from one running sum: a word's sum is the difference of two, divided by
    the power at its start.
    """
    inside = np.r_[False, ~_SPACE[text], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(text))
    total = np.r_[np.uint64(0), np.cumsum(_VALUES[text] * power[: len(text)], dtype=np.uint64)]
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; no text, no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order; no text, no words."""
    return word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[0] if text else np.empty(0, np.uint64)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; fewer words make one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = max(1, len(hashes) - width + 1)
    width = min(width, len(hashes))
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h ^ hashes[i : i + n]) * MULTIPLIERS[i % len(MULTIPLIERS)] + np.uint64(i + 1)
    return np.unique(mix(h))
