"""Shared pieces of the training-data operators: shared-folder tables, whole-text words and hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: bounds a Python worker's memory at a few MB of text for ordinary rows.
ARROW_ROWS = 1000
CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of text whose features are held at once, where they take many times as much.
SLICE_BYTES = 1 << 19
#: A key with more than this share of a table's rows, and more than HOT_LEAST of them, is dealt to several tasks.
HOT_SHARE, HOT_LEAST = 0.001, 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session. Only a local session may lack it: it gets a folder
    of this machine; a cluster without one is refused, as each machine would write to its own disk."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later plan reads, and let Spark delete the shuffle files behind
    them: it does so once nothing refers to their plans any more, which both sides' collectors have to find out. Steps in a
    loop would otherwise leave the files of all their rounds until the session ends."""
    for df in tables:
        path = df.__dict__.get("_scratch")
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n", share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame | None:
    """Keys of a counted table with more than `share` of all its rows, and in how many parts to deal theirs: there are
    1 / share of them at most, whatever the data. None where no key has so many, as in most tables: a join then needs
    neither these keys nor copies. The table is read here and by the join, so it should be one that is stored."""
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    bound = max(float(least), share * (total or 0))
    if (most or 0) <= bound:
        return None
    return counted.filter(F.col(n) > bound).select(*keys, F.ceil(F.col(n) / bound).cast("int").alias("__parts"))


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, salt, how: str = "inner") -> DataFrame:
    """many joined with one (a row for each key): the rows of hot keys are dealt by `salt` to several tasks, each with a
    copy of the key's row. The hot keys, at most 1 / HOT_SHARE by hot_keys(), are broadcast."""
    if hot is None:
        return many.join(one, keys, how)
    hot = F.broadcast(hot)
    dealt = many.join(hot, keys, "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(salt, F.col("__parts"))).otherwise(0).cast("int")).drop("__parts")
    copies = one.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")


def give_back() -> None:
    """Return to the machine what earlier tasks of this worker have freed: workers are used again, and their allocators keep
    what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has Spark's default of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def quoted(name: str) -> F.Column:
    """A column by its very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id) -> F.Column:
    """The remainder that splits documents: crc32 of the id as text, modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def row_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Slices of an array of texts with about `most` bytes each, one row at least: what is held at once then depends on
    the longest text, not on the rows of a batch."""
    upto = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        yield texts.slice(a, b - a)
        a = b


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: all words in one array, and where each text's begin and end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # the kernels below misread slices
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    ends = ends - ends[0]
    some = np.asarray(pc.binary_length(flat)) > 0
    if not some.all():
        flat = flat.filter(pa.array(some))
        ends = np.concatenate([[0], np.cumsum(some)])[ends]
    return flat, ends


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's number in the list of distinct words, and that list."""
    if len(flat) == 0:
        return np.zeros(0, np.int64), []
    encoded = flat.dictionary_encode()
    return np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.to_pylist()


def hashes(distinct) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64)


#: Words that are told apart at once by token_hashes; bytes whose powers are held at once by polynomials (a longer word alone
#: goes on its own).
HASH_WORDS = 1 << 19
HASH_BYTES = 1 << 19
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    factors = np.full((2, n), [[BASE], [BASE_INVERSE]], np.uint64)
    factors[:, 0] = 1
    up, down = np.cumprod(factors, axis=1, dtype=np.uint64)
    return up, down


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def token_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a large_string array. Each distinct word is hashed once, some at a time: polynomials
    modulo 2^64 would give some different words the same value whatever their base."""
    out = np.zeros(len(flat), np.uint64)
    for a in range(0, len(flat), HASH_WORDS):
        encoded = flat.slice(a, HASH_WORDS).dictionary_encode()
        distinct, n = encoded.dictionary, len(encoded.dictionary)
        _, ends, data = distinct.buffers()
        ends = np.frombuffer(ends, np.int64)[distinct.offset : distinct.offset + n + 1].tolist()
        raw = data.to_pybytes() if data is not None else b""  # cut here: as a list, the words would take most of the time
        out[a : a + HASH_WORDS] = hashes(map(raw.__getitem__, map(slice, ends, ends[1:])))[np.asarray(encoded.indices)]
    return out


def put_together(first: np.ndarray, second: np.ndarray, bytes_of_first: np.ndarray) -> np.ndarray:
    """The polynomials of words made of two, from theirs."""
    return first + second * _powers(HASH_BYTES)[0][np.minimum(bytes_of_first, HASH_BYTES - 1)]


def polynomials(flat: pa.Array) -> np.ndarray:
    """A polynomial in the bytes of each word of a large_string array, modulo 2^64, for all words at once."""
    n = len(flat)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    _, ends, data = flat.buffers()
    ends = np.frombuffer(ends, np.int64)[flat.offset : flat.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + HASH_BYTES, "right")) - 1)
        part = raw[ends[a] : ends[b]]
        size = HASH_BYTES
        while size < len(part):
            size *= 2
        up, down = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_values()[part] * up[: len(part)], out=total[1:])
        at = ends[a : b + 1] - ends[a]
        out[a:b] = (total[at[1:]] - total[at[:-1]]) * down[np.minimum(at[:-1], size - 1)]
        a = b
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number's bits (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
