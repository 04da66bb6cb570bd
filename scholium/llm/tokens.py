"""Token counts behind a digest cache.

A text is known by the SHA-256 digest of its normalised content and of the tokenizer file. The only normalisation is
that a null is the empty text: the tokenizers tell apart case, white space and Unicode forms, so any other would give
a text the count of another one. Stored counts are joined by that key; only distinct texts without one are encoded,
and their counts are appended to the cache, which outlives the query. Each append is a Parquet folder of its own below
the cache's, so writers never touch each other's files, and only folders that Spark has marked as complete are read.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows keep their number. An empty table
gives an empty result; other columns are ignored. Texts are encoded whole. Two writers may store the same digest
twice; it is read as one. An append that fails has no mark, is never read and is repeated by the next run. A text whose
count is in no folder when the result is read (somebody has deleted the cache) raises an error; no row is left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.bpe import byte_characters, default_path
from scholium.llm.common import id_text, materialize, shared_dir, table

LIMIT = 512
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Characters whose classes no release of Unicode has changed: the faster encoder is used for texts of these only.
_SETTLED = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f]*")


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _fast(path: str, pattern: str) -> Callable[[str], int] | None:
    """A second encoder over the same merges, where the file is plain byte-level BPE with ids in merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or spec.get("normalizer") or any(pre.get(k) != v for k, v in plain.items()):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        return None
    back = {c: b for b, c in byte_characters().items()}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    fast = _fast(path, public_tokenizers.PATTERN)
    library = None

    def count(texts: list[str]) -> list[int]:
        nonlocal library
        out = [0] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if fast and _SETTLED.fullmatch(text) and not any(s in text for s in special):
                out[i] = fast(text)
            else:
                slow.append(i)
        if slow:
            library = library or _library(path)  # loaded where a text needs it
            for i, found in zip(slow, library.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = len(found.ids)
        return out

    return count


def appends(spark: SparkSession, cache: str) -> list[str]:
    """The cache's complete folders, by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/counts-*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    folders = appends(spark, cache)
    return spark.read.schema(CACHE_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], CACHE_SCHEMA)


def _append(counts: DataFrame, cache: str) -> None:
    """Write counts to a new folder of the cache; where there are none, it goes again."""
    spark = counts.sparkSession
    folder = f"{cache}/counts-{uuid.uuid4().hex}"
    counts.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
    if spark.read.schema(CACHE_SCHEMA).parquet(folder).isEmpty():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _known(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, each digest once."""
    return _stored(spark, cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of each text. ``cache`` is a folder that all machines share; without one it is ``token-counts``
    beside the intermediate tables, where the next query finds what this one stored."""
    spark = docs.sparkSession
    path = path or default_path()
    cache = cache or f"{shared_dir(spark)}/token-counts"
    version = tokenizer_version(path)
    keyed = id_text(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    sizes = materialize(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    known = _known(spark, cache, version)
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    counted = misses.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    _append(counted.select(F.lit(version).alias("version"), "digest", "n_tokens"), cache)
    lost = F.raise_error(F.lit(f"a count is missing in {cache}; was it deleted while this ran?")).cast("long")
    found = sizes.join(_known(spark, cache, version), "digest", "left").withColumn("n_tokens", F.coalesce("n_tokens", lost))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
