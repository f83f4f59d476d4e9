"""Helpers shared by the pipeline operators: table access, shared folders, Arrow maps, worker state."""

from __future__ import annotations

import atexit
import pickle
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: What a worker turns into Python objects at once: Spark's batches are bounded by
#: spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default) and are gone through in slices of so many rows or bytes.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20

# Functions of this package travel to the workers by value: an executor needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0].rpartition(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conf(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    value = spark.conf.get(key, None)
    return value if value is not None else spark.sparkContext.getConf().get(key, default)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to SLICE_ROWS rows and about SLICE_BYTES bytes; a single longer row is a slice of its own."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder that goes with the process; on a cluster, whose executors could not see it, that is an error."""
    found = conf(spark, "spark.checkpoint.dir")
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name beneath the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of the taken (case aside, as Spark compares)."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that neither lineage nor a lost executor brings recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(key: str, make: Callable):
    """One object per Python worker process, kept between tasks (functions sent by value lose their globals)."""
    home = sys.modules.setdefault("_tidemark_worker_state", types.ModuleType("_tidemark_worker_state"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast value, whose classes travel by value too; the result gives it back, once per worker process."""
    key = f"shared-{uuid.uuid4().hex}"
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: worker_state(key, lambda: pickle.loads(sent.value))


def map_columns(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """mapInArrow over some columns only. make() runs once a task; what it gives turns a slice's columns into
    a dict of lists or arrays in the order of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            out = work(*batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class LocalSets:
    """Union-find over any hashable, smallest member as root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            lo, hi = (x, y) if x < y else (y, x)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)
