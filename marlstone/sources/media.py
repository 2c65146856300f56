"""Folders of media files: listing, pictures, sound features, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.media import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS, image_histogram, media_kind
from marlstone.functions.mfcc import mfcc, read_wave, resampled


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO_EXTENSIONS) -> DataFrame:
    """Rows path, name: files under folder with one of the extensions, in any depth. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    ok = F.lit(False)
    for e in extensions:
        ok |= F.lower("path").endswith(e)
    return files.where(ok).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Rows path, histogram: decoded in the JVM; files that are no pictures are left out."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    return images.select(F.col("image.origin").alias("path"), image_histogram(F.col("image")).alias("histogram")).where(F.col("histogram").isNotNull())


def manifest(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The rows of a manifest of a folder's pictures (id, title, image_path, image_text) or sounds (audio_id, file_name, file_path, tfidf_vector)."""
    found = list_files(spark, folder, IMAGE_EXTENSIONS if kind == "image" else AUDIO_EXTENSIONS)
    # ids without one global sort: rows of a range get their place in it after the sizes of the ranges before
    ranged = found.repartitionByRange("path").sortWithinPartitions("path").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() % F.lit(1 << 33))
    sizes = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.coalesce(F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("p")], F.lit(0)) if before else F.lit(0)
    number = (start + F.col("i") + 1).cast("int")
    title = F.regexp_replace("name", r"\.[^.]*$", "")
    if kind == "image":
        return ranged.select(number.alias("id"), title.alias("title"), F.col("path").alias("image_path"), title.alias("image_text"))
    return ranged.select(number.alias("audio_id"), F.col("name").alias("file_name"), F.col("path").alias("file_path"), F.lit("").alias("tfidf_vector"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def sound_frames(spark: SparkSession, folder: str, extract: Callable[[bytes], list[list[float]]]) -> DataFrame:
    """Rows path, frame (array of doubles): `extract` turns a file's bytes into its frames of coefficients; files it can't read have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    frames = extract(content)
                except (ValueError, OSError):
                    frames = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(frames), pa.string()), pa.array(frames, pa.list_(pa.float64()))], names=["path", "frame"])

    return files.mapInArrow(run, "path string, frame array<double>")


def mfcc_extractor(coefficients: int = 13, rate: int = 22_050, seconds: float = 30.0) -> Callable[[bytes], list[list[float]]]:
    """MFCC frames of a file's first seconds in mono: by librosa where that is installed, else for PCM WAVE files, by numpy."""

    def extract(content: bytes) -> list[list[float]]:
        try:
            import librosa
        except ImportError:
            y, sr = read_wave(content, seconds)
            return mfcc(resampled(y, sr, rate), rate, coefficients).tolist()
        import io

        y, sr = librosa.load(io.BytesIO(content), sr=rate, mono=True, duration=seconds)
        return librosa.feature.mfcc(y=y, sr=sr, n_mfcc=coefficients).T.tolist()

    return extract


__all__ = ["list_files", "manifest", "media_kind", "mfcc_extractor", "read_pictures", "sound_frames", "write_manifest"]
