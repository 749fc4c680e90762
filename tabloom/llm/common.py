"""Shared pieces of the training-data operators: work tables, Arrow batches, words."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII spaces.
WORD_RE = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_RE)

#: A table that is broadcast must have fewer rows and bytes than this; beyond it joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: An Arrow batch ends at so many bytes; each task holds some of them twice, in the JVM and in its Python worker
BATCH_BYTES = 4 << 20
#: a key with more rows than this is dealt out over parts
HOT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``. Only a local master may do without it: a folder of the
    driver's own would split a cluster's work tables over its machines."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context = spark.sparkContext  # the setting itself cannot be changed any more
        at = context._tabloom_shared = getattr(context, "_tabloom_shared", None) or f"file://{tempfile.mkdtemp(prefix='tabloom-')}"
    return at.rstrip("/")


def _work_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tabloom-work/{spark.sparkContext.applicationId}"


def clear_work_tables(spark: SparkSession) -> None:
    """Delete this application's work tables. Results that were not written or collected yet still need them; so it
    is done at the end of the process, or by a caller who knows better."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(root: str, jvm, conf) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the gateway may be gone already
        return


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends here, so an executor that
    is lost later costs a re-read and not a recomputation."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    root = _work_root(spark)
    if getattr(context, "_tabloom_work", None) != root:
        atexit.register(_clear_at_exit, root, context._jvm, context._jsc.hadoopConfiguration())
        context._tabloom_work = root
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are under ``limit`` and their text and binary columns, with 16 bytes
    for every other, under BROADCAST_BYTES; df should be a work table."""
    wide = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, k in df.dtypes if k in ("string", "binary")]
    size = sum(wide, F.lit(16 * len(df.columns)))
    rows, held = df.limit(limit + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= limit and (held or 0) <= BROADCAST_BYTES else df


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, by: list[str]) -> DataFrame:
    """``rows`` joined with ``per_key`` (one row for each key; ``count`` is how many rows have it) without a hot task.

    A key of more than ``most`` rows is dealt out over parts by a hash of ``by``, and its one row is copied to each part. As
    the counts add up to ``total`` at most, there are at most total / most <= BROADCAST_ROWS such keys: the only thing
    that is broadcast. ``count`` is not in the result."""
    most = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    parts = F.ceil(F.col(count) / most).cast("int")
    hot = per_key.where(F.col(count) > most).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    left = left.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_hot", "_parts")
    right = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return left.join(right, [key, "_part"]).drop("_part")


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tabloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="tabloom-code-")) / "tabloom_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(at))
    context._tabloom_shipped = True


def arrow_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, as texts can be long. Called before each Python stage, so it also sees to it
    that the executors have the code. The bound is the same for all stages: it acts when a plan runs, not here."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 1000) -> DataFrame:
    """Apply a batch function (columns as lists in, columns as lists out) to ``df``, ``rows`` rows at a time.

    ``make`` runs once in each Python worker's task and returns the function, so that models are loaded once."""
    spark = df.sparkSession
    arrow_batches(spark)
    arrow_schema = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for whole in batches:
            if apply is None:
                apply = make()
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                out = apply({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it many times in ``body`` (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """array<string> of the words of ``text``; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def n_words_of(text: Column) -> Column:
    """Number of words of ``text`` as bigint; null text has 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it (Spark tells no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def learn_rows(doc_id: Column, mod: int, held: int) -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is not ``held``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod != held, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine (each executor has its own)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers

    return public_tokenizers.path(name)
