from pyspark.sql import SparkSession

# Runtime settings for the analytics, used where the cluster or the caller has
# not chosen otherwise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # AQE measures every shuffle: it joins small partitions, splits skewed ones
    # and turns a join into a broadcast when a side proves small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, **settings: str
) -> SparkSession:
    """A session with ``settings`` (dots written as ``__``), completed by the defaults above.

    ``shuffle_partitions`` is the number AQE starts from and shrinks: choose it
    so that the largest shuffle, divided by it, fits in a task's memory. For the
    as-of join that shuffle holds three columns of all candles and plays.
    """
    builder = SparkSession.builder.appName("fourthtick")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()

    chosen = {row.key for row in spark.sql("SET").collect()}
    for key, value in DEFAULTS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark
