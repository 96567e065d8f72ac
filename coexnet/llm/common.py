"""Shared helpers: table access, written intermediates, word splitting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a temporary folder of
    this process stands in for it; it goes when the process ends. Elsewhere a
    folder of one machine would lose rows, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="coexnet-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them no columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def if_small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows take ``most_bytes`` at most; pass what is written, for it is read to measure it."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(",", *(F.col(f"`{c}`").cast("string") for c in df.columns))) + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


HOT_ROWS, HOT_KEYS = 1024, 1 << 16


def attach(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows.join(keyed, key, how)`` for one row a key in ``keyed``, which says in ``n`` how many rows have the key (dropped).

    Rows of a key with many (1024, or a 65,536th of all, which leaves 65,536 such keys at most)
    are dealt to several tasks, and the key's one row is sent to each of them.
    """
    keyed = save(keyed, "keyed")
    total, most = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = max(HOT_ROWS, -(-total // HOT_KEYS))
    if most <= hot:
        return rows.join(keyed.drop("n"), key, how)
    salts = F.broadcast(keyed.where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("__salts")))
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.col("__salts")).cast("int")
    spread = rows.join(salts, key, "left").withColumn("__salt", F.coalesce(salt, F.lit(0))).drop("__salts")
    copies = keyed.drop("n").join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(doc index of each word, code of each word, distinct words) of a batch.

    Null texts count as empty. Lower-casing touches A-Z only. White space becomes
    blanks byte by byte first, so the split needs no pattern.
    """
    texts = map_bytes(pc.fill_null(texts.cast(pa.large_string()), ""), _LOWER if lower else _BLANKS)
    parts = pc.split_pattern(texts, " ")
    words = parts.values if parts.offset == 0 else pc.list_flatten(parts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    coded = pc.dictionary_encode(words)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary
    if len(names):  # runs of white space, and text that starts or ends with it, leave empty parts
        void = np.flatnonzero(pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False))
        if len(void):
            keep = codes != void[0]
            owner, codes = owner[keep], codes[keep]
    return owner, codes, names


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of strings by their UTF-8 bytes."""
    names = words.to_numpy(zero_copy_only=False) if len(words) else ()  # far quicker than to_pylist
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[9:14] = 32
_LOWER = _BLANKS.copy()
_LOWER[65:91] += 32


def map_bytes(texts: pa.LargeStringArray, to: np.ndarray) -> pa.LargeStringArray:
    """Replace ASCII bytes in the whole batch (no nulls)."""
    _, offsets, data = texts.buffers()
    if data is None or data.size == 0:
        return texts
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = to[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(low)])


def chunks_of(rows: int, weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut ``rows`` consecutive rows so that each slice weighs about ``most`` at most."""
    cuts, start, total = [], 0, 0
    for i in range(rows):
        if i > start and total + weights[i] > most:
            cuts.append((start, i))
            start, total = i, 0
        total += int(weights[i])
    if rows > start:
        cuts.append((start, rows))
    return cuts


def text_slices(batches, column: str = "text", most: int = 8 << 20):
    """Record batches cut so that the texts of one slice stay near ``most`` bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, b in chunks_of(batch.num_rows, size, most):
            yield batch.slice(a, b - a)


