"""A local session for tests and the benchmark.  On a cluster the caller brings its own."""

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*", app: str = "moodspark", memory: str = "8g", stages: str | None = None
) -> SparkSession:
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # no call site for each Column: building a plan of many expressions takes a third
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if stages:
        builder = builder.config("spark.checkpoint.dir", stages)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
