"""Session helpers: settings the library relies on, nothing machine-local."""

from pyspark.sql import SparkSession

#: Partitions a shuffle starts with where the session names fewer; adaptive execution
#: joins the small ones. Up to 200 Spark writes them without a sort in memory.
PARTITIONS = 200
#: Bytes of files a task reads at most: its aggregates combine what it has read.
SPLIT_BYTES = 32 << 20
#: Compressed bytes up to which adaptive execution joins parts of a shuffle. Rows of keys,
#: times and short codes take 20 times that and more where they are sorted or aggregated.
JOINED_BYTES = 8 << 20
#: Adaptive execution's rule that drops the last sort of a page cut by offset once the
#: page's marks are joined (Spark 4.1).
UNSAFE_RULE = "org.apache.spark.sql.catalyst.optimizer.OptimizeOneRowPlan"


def pin(spark: SparkSession) -> SparkSession:
    """Settings every job here relies on.

    Times are UTC everywhere, so buckets and hours agree. Generated methods are
    kept below the size the JVM stops compiling at (8000 bytes of bytecode):
    parsing one log line is a wide projection that would otherwise run
    interpreted, at half the speed. What one task sorts or aggregates follows the size
    of its split and its share of a shuffle: splits are bounded, and shuffles start
    with many parts whatever the number of cores, of which only small ones are joined.
    Rows come in the order asked for: a rule that loses it is left out.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    conf = spark._jsparkSession.sessionState().conf()
    if conf.numShufflePartitions() < PARTITIONS:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(PARTITIONS))
    if conf.filesMaxPartitionBytes() > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(joined)) > JOINED_BYTES:
        spark.conf.set(joined, str(JOINED_BYTES))
    left_out = "spark.sql.adaptive.optimizer.excludedRules"
    rules = [r for r in spark.conf.get(left_out, "").split(",") if r]
    if UNSAFE_RULE not in rules:
        spark.conf.set(left_out, ",".join([*rules, UNSAFE_RULE]))
    return spark


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder every executor sees, for checkpoints and interim tables.

    The cluster names it in ``spark.checkpoint.dir``; ``fallback`` is used only
    where that is unset (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not found:
        raise ValueError("spark.checkpoint.dir is not set and no fallback was given")
    return found
