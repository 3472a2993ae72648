"""Where derived tables are written."""

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

#: What keeps a job's disk small: shuffle files go when their query has ended, not when the driver collects its
#: garbage, and tables are stored in the smaller code.
SPARING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


class _Scopes(threading.local):
    """Per thread: the tables settled in each open scope, as (frame, path)."""

    def __init__(self) -> None:
        self.open: list[list[tuple[DataFrame, str]]] = []


_SCOPES = _Scopes()


def scratch_root(spark: SparkSession) -> str:
    """A folder every executor can reach, for this application only.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A machine-local
    temporary folder is used only by a local session that leaves the setting unset.
    """
    app = spark.conf.get("spark.app.id")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/slotwise-{app}"
    if not spark.conf.get("spark.master").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="slotwise-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, so a failed job never leaves half a table behind a name."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written out and read back.

    Used for a reduced result that meets a large table next: its lineage ends here, and the
    planner sees its real size instead of an estimate grown from the table it came from, so
    it is broadcast exactly when it fits under the broadcast threshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if _SCOPES.open:
        _SCOPES.open[-1].append((found, path))
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table, wherever the folder lies."""
    root = scratch_root(spark)
    if not path.startswith(f"{root}/"):
        raise ValueError(f"{path} is no table of this application")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for what is run inside, but for those that the session names itself."""
    own = [name for name in values if spark.conf.get(name, None) is None]
    for name in own:
        spark.conf.set(name, values[name])
    try:
        yield
    finally:
        for name in own:
            spark.conf.unset(name)


@contextmanager
def sparing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """:func:`discard` under the settings of :data:`SPARING`."""
    with settings(spark, SPARING), discard(spark) as keep:
        yield keep


@contextmanager
def discard(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted at the end, but for those given to what this yields.

    What leaves the scope must read kept tables only. Those belong to the scope around it, if any.
    """
    _SCOPES.open.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df, path in _SCOPES.open.pop():
            if any(df is k for k in kept):
                if _SCOPES.open:
                    _SCOPES.open[-1].append((df, path))
            else:
                remove(spark, path)
