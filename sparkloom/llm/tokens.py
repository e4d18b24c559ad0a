"""Token-ID output in training order: a keyed Feistel permutation gives every sequence its global slot.

1. Each task tokenises its documents, ends each with the end token, and packs them into sequences of `length` ids
   (the last one of a task is padded). The packed table is written once, so numbers given to it are final.
2. Sequences are numbered 0..N-1: one count a task, then place in the task.
3. A balanced Feistel network over the next even power of two, with cycle-walking, permutes 0..N-1 under a key.
4. Range partitions by slot hold consecutive slots; a shard is `per_shard` slots of fixed stride, so a reader can
   seek to any slot and resume there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

common.ship(__name__)

# The public byte-level vocabulary in use, its word pattern and its end token.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

LENGTH, PER_SHARD, KEY = 2048, 4096, 0x5EED
SCHEMA = "part int, ord long, doc_ids array<long>, n_tokens int, tokens binary"


def encoder(ranks_file: bytes):
    """The tiktoken encoding of a ranks file; kept in the worker process for later tasks."""
    import base64

    import tiktoken

    kept = tiktoken.__dict__.setdefault("_loom_kept", {})
    name = str(hash(ranks_file))
    if name not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        kept[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[name]


class Packer:
    """Joins documents' ids and cuts them every `length`; holds less than one sequence between calls."""

    def __init__(self, length: int, end: int):
        self.length, self.end = length, end
        self.room = np.full(length, end, np.uint16)
        self.used, self.ids = 0, []

    def add(self, doc_id, tokens: np.ndarray) -> Iterator[tuple[list, int, bytes]]:
        tokens = np.append(tokens, self.end).astype(np.uint16)
        at = 0
        while at < len(tokens):
            n = min(self.length - self.used, len(tokens) - at)
            self.room[self.used : self.used + n] = tokens[at : at + n]
            self.used, at = self.used + n, at + n
            self.ids.append(doc_id)
            if self.used == self.length:
                yield self.take()

    def take(self) -> tuple[list, int, bytes]:
        out = (self.ids, self.used, self.room.tobytes())
        self.room[:] = self.end
        self.used, self.ids = 0, []
        return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Packed sequences (SCHEMA) of docs, saved. Null texts count as empty and add their end token alone."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, enc, packer, ord_ = TaskContext.get().partitionId(), encoder(ranks.value), Packer(length, END), 0
        columns = ["part", "ord", "doc_ids", "n_tokens", "tokens"]

        def frame(rows):
            return pd.DataFrame([(part, n, *row) for n, row in rows], columns=columns)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)
                for row in packer.add(None if pd.isna(doc_id) else int(doc_id), ids):
                    rows.append((ord_, row))
                    ord_ += 1
            if rows:
                yield frame(rows)
        if packer.used:
            yield frame([(ord_, packer.take())])

    return common.save(docs.select("doc_id", "text").mapInPandas(run, SCHEMA), "tokens")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..n-1: a balanced Feistel network, walked until the value falls below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, (key * 1_000_003 + r * 7919 + 1) % (1 << 64)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def training_order(packed: DataFrame, key: int = KEY, per_shard: int = PER_SHARD, length: int = LENGTH) -> DataFrame:
    """(slot, shard, position, offset, index, doc_ids, n_tokens, tokens) in slot order over range partitions.

    index is the place before the permutation: sequences in index order give back the documents. offset is the
    byte at which the sequence starts in its shard's file. Empty input gives no rows.
    """
    counts = packed.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = common.save(base, "tokens-base")  # a row a task
    total = packed.count()

    @F.pandas_udf("long")
    def place(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(np.int64), total, key))

    # The counts have a row a task of the scan, so tokens are never shuffled to meet them.
    rows = packed.join(F.broadcast(base), "part").withColumn("index", F.col("base") + F.col("ord"))
    rows = rows.withColumn("slot", place("index"))
    n = max(1, min(total // 256 + 1, max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // per_shard + 1)))
    rows = rows.withColumns({"shard": F.expr(f"cast(slot div {per_shard} as int)"), "position": F.expr(f"cast(slot % {per_shard} as int)")})
    rows = rows.withColumn("offset", F.col("position").cast("long") * (2 * length))
    return rows.repartitionByRange(n, "slot").sortWithinPartitions("slot").select("slot", "shard", "position", "offset", "index", "doc_ids", "n_tokens", "tokens")


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write shard-NNNNN.bin files of fixed stride under a shared folder; returns (shard, sequences).

    Each shard is one task's sorted rows, written beside and then renamed, so a task that runs again leaves the
    same file. A shard's size is fixed by per_shard, whatever the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        open_, shard, count, name = None, None, 0, ""

        def close():
            open_.close()
            os.replace(open_.name, name)
            return pd.DataFrame({"shard": [shard], "sequences": [count]})

        for batch in batches:
            for s, tokens in zip(batch["shard"], batch["tokens"], strict=True):
                if s != shard:
                    if open_:
                        yield close()
                    shard, count, name = int(s), 0, f"{folder}/shard-{int(s):05d}.bin"
                    open_ = open(f"{name}.{uuid.uuid4().hex}", "wb")
                open_.write(tokens)
                count += 1
        if open_:
            yield close()

    os.makedirs(folder, exist_ok=True)
    shards = ordered.select("shard", "slot", "tokens")
    return shards.repartition("shard").sortWithinPartitions("shard", "slot").mapInPandas(run, "shard int, sequences long")


def read_sequences(folder: str, start: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences from global slot `start` on, by seeking: what a resumed training job reads."""
    shard, position = divmod(start, per_shard)
    while os.path.exists(name := f"{folder}/shard-{shard:05d}.bin"):
        with open(name, "rb") as f:
            f.seek(position * 2 * length)
            while len(row := f.read(2 * length)) == 2 * length:
                yield np.frombuffer(row, np.uint16)
        shard, position = shard + 1, 0


def materialise(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Packed sequences of docs in training order, see training_order().

    Null and empty texts add their end token alone; null ids stand as null in doc_ids. Very long texts run over as
    many sequences as they need. Repeated rows are packed one by one. Columns but doc_id and text are not read. Empty
    input gives no rows.
    """
    return training_order(pack(docs, tokenizer))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(common.load(spark, sf_dir, "documents"))
