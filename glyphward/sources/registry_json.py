"""The font index as JSON: an object with ``fonts``, each with names, hashes, ``cmap`` pairs and ``outlines`` pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = (
    "tool string, source_dir string, count long, skipped array<string>, fonts array<struct<family:string, full:string, postscript:string, file_sha:string, "
    "cmap_sha:string, cmap_len:long, cmap:array<array<long>>, outlines:array<array<decimal(20,0)>>>>"
)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Of a path or URI of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(faces: face_ord, names and hashes; outlines: face_ord, cp, outline_hash as signed 64 bits)."""
    if _is_folder(spark, path):  # as ``save`` writes it
        one = SCHEMA.partition("array<struct<")[2][:-2].replace(":", " ", 6).replace("cmap:", "cmap ").replace("outlines:", "outlines ")
        fonts = spark.read.schema(one).json(path)
        fonts = fonts.select(F.monotonically_increasing_id().alias("face_ord"), F.struct(*fonts.columns).alias("f"))
    else:
        fonts = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.posexplode("fonts").alias("face_ord", "f"))
    faces = fonts.select("face_ord", "f.family", "f.full", "f.postscript", "f.file_sha", "f.cmap_sha", "f.cmap_len")
    pairs = fonts.select("face_ord", F.explode("f.outlines").alias("p"))
    big = F.col("p")[1]
    signed = F.when(big >= F.lit(str(1 << 63)).cast("decimal(20,0)"), big - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(big).cast("long")
    return faces, pairs.select("face_ord", F.col("p")[0].cast("int").alias("cp"), signed.alias("outline_hash"))


def save(faces: DataFrame, path: str, slim: bool = False) -> None:
    """Faces as ``fonts.read_fonts`` gives them, a JSON object a line; the character map is left out where ``slim``."""
    unsigned = lambda h: F.when(h < 0, h.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)"))
    drawn = F.transform(F.filter("cps", lambda c: c["outline_hash"].isNotNull()), lambda c: F.array(c["cp"].cast("decimal(20,0)"), unsigned(c["outline_hash"])))
    cols = ["family", "full", "postscript", "file_sha", "cmap_sha", F.size("cps").alias("cmap_len"), drawn.alias("outlines")]
    if not slim:
        cols.append(F.transform("cps", lambda c: F.array(c["cp"], c["gid"])).alias("cmap"))
    faces.select(*cols).write.mode("overwrite").json(path)
