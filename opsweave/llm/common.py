"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper-case to lower-case for A-Z only, as arguments of ``translate``.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (as in tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opsweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, computed once,
    and still there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/opsweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_number(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by their number, so that an operator's own names clash with none, and
    the new names of ``names``.  ``toDF(*df.columns)`` names them back."""
    at = {name: f"c{k}" for k, name in reversed(list(enumerate(df.columns)))}
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), [at[name] for name in names]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column, without decoding them."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        for first in range(0, len(chunk), 256):
            yield from chunk.slice(first, 256).cast(pa.large_binary()).to_pylist()


def ascii_lower(text: bytes) -> bytes:
    """Lower-cases A-Z only (``bytes.lower`` leaves all other bytes alone)."""
    return text.lower()


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of anything but space and \\x09-\\x0D, which is what ``bytes.split`` gives."""
    return text.split() if text else []


def pack_uint(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, little-endian."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width]).tobytes()


def unpack_uint(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def width_of(values: np.ndarray) -> int:
    """Bytes that the largest value needs."""
    top = int(values.max()) if len(values) else 0
    return max(1, (top.bit_length() + 7) // 8)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as differences of fixed width."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = width_of(steps[1:])
    return bytes([width]) + int(steps[0]).to_bytes(8, "little") + pack_uint(steps[1:], width)


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(data, "<u8", 1, 1)
    return np.cumsum(np.concatenate([first.astype(np.uint64), unpack_uint(data[9:], data[0])]), dtype=np.uint64)


class WordCache:
    """A dict ``now`` of at most about twice ``limit`` entries that forgets those not asked for lately."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict = {}
        self.older: dict = {}

    def missing(self, wanted: set) -> list:
        """The keys of ``wanted`` that must still be worked out; all others are in ``now`` then."""
        if len(self.now) > self.limit:
            self.older, self.now = self.now, {}
        absent = wanted.difference(self.now)
        new = absent.difference(self.older)
        for key in absent - new:
            self.now[key] = self.older[key]
        return list(new)


#: ``cache_clear`` of what operators keep in a Python worker.
CACHES: list[Callable[[], None]] = []
_running = [""]
#: Arrays from this size on are given back to the machine as soon as they are dropped.
_GIVEN_BACK = 1 << 18
#: Bytes of a large group.
_LARGE = 1 << 19


def settle(operator: str) -> None:
    """Called by an operator's function as its task begins.  Spark reuses Python workers from stage to
    stage: what another operator kept there is dropped, and free memory goes back to the machine."""
    if not _running[0]:
        pa.set_memory_pool(pa.system_memory_pool())
        if limit := getattr(ctypes.CDLL(None), "mallopt", None):
            limit(-3, _GIVEN_BACK)  # M_MMAP_THRESHOLD
    if _running[0] == operator:
        return
    _running[0] = operator
    for clear in CACHES:
        clear()
    release()


def release() -> None:
    """Gives free memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def leave(operator: str) -> Callable:
    """Wraps a function of ``mapInArrow`` or a group function: ``settle`` before, ``release`` after, caches
    included: Spark keeps several workers for each core and turns from one to the next, so what a worker
    holds while it waits counts many times.  Functions of small groups run often and release once a second."""

    def wrap(function: Callable) -> Callable:
        if inspect.isgeneratorfunction(function):

            @functools.wraps(function)
            def stream(batches):
                settle(operator)
                try:
                    yield from function(batches)
                finally:
                    for clear in CACHES:
                        clear()
                    release()

            return stream

        @functools.wraps(function)
        def group(*args):
            settle(operator)
            out = function(*args)
            if any(x.nbytes > _LARGE for x in args[1:]) or time.monotonic() > _released[0] + 1:
                del args
                release()
                _released[0] = time.monotonic()
            return out

        group.__signature__ = inspect.signature(function)  # Spark counts the arguments
        return group

    return wrap


_released = [0.0]
