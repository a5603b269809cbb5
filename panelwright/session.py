"""Session set-up and reliable staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "panelwright", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


#: HotSpot never compiles a method of more bytes than this; Spark's own limit is 65,535.
METHOD_BYTES = 8_000


def compiled(frame: DataFrame) -> DataFrame:
    """The frame, in a session that keeps generated methods small enough to be compiled.

    Dozens of formulas in one whole-stage method pass 8,000 bytes and are then interpreted row by row, several times
    slower.  Below the limit Spark splits them into one method a few.  A limit that the user has set stays.
    """
    conf = frame.sparkSession.conf
    if conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))
    return frame


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only local runs get a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelwright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)  # the tree learner cuts its lineage there as well
    return folder


#: Tables of more columns than this are staged without dictionaries.
WIDE = 100


#: Shuffle files go when the command that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(frame: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write a frame that several later passes read to a table, and read it back.

    The table survives lost executors and cuts the lineage.  Later passes read only
    the columns they need, and its file size tells the optimizer which joins may
    broadcast.  The shuffle files of the write are deleted with its end.  Wide tables go without dictionaries: hashing hundreds of columns of measured values costs
    more than writing them.  Writers and readers hold a row group at a time (a reader up to 4,096 rows of it): rows of
    megabytes need ``group_rows``.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    dictionaries = "true" if len(frame.columns) <= WIDE else "false"
    options = {"parquet.enable.dictionary": dictionaries}
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    if group_rows is not None:
        options |= {"parquet.block.row.count.limit": str(group_rows), "parquet.page.size.row.check.min": "1"}
    try:
        frame.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if held is None else spark.conf.set(CLEANUP, held)
    return spark.read.schema(frame.schema).parquet(path)


def unstage(frame: DataFrame) -> None:
    """Delete the table of a staged frame that nothing reads any more."""
    spark = frame.sparkSession
    for path in {file.rpartition("/")[0] for file in frame.inputFiles()}:
        if path.rpartition("/")[2].startswith("stage-"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
