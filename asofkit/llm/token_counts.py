"""Operator 5: token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a run of blocks of 16-bit token ids. Documents follow each other without an index; each ends with the
end-of-document id, and documents cross block edges freely. Every block is scanned on its own with one vectorised search
for that id, which gives the lengths of the documents that lie inside it, the tokens before its first separator and the
tokens after its last one. A prefix scan over the blocks of a file then adds the open tokens of earlier blocks to the first document of a
block and numbers the documents, so blocks are read once and in any order.

Defined cases: a file that ends without a separator has a last document that is still open (it is reported with
``closed = false``; none is reported if no token is open); two separators in a row end an empty document; empty files and
empty blocks have no documents. Null texts are written as empty documents.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import work_table

EOD = 50256
BLOCK_TOKENS = 1 << 16
TOKENIZERS = "/opt/tokenizers"


def load_encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """A public byte-level vocabulary read from its file; the pattern comes with the vocabularies."""
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("token_vocabularies", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files from documents: ``file, block, tokens`` (16-bit ids), and ``ids`` (the ids of the documents that end in the block).

    One task writes one file; blocks have ``block_tokens`` ids whatever the documents' edges.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        encoding = load_encoding(folder)
        file = TaskContext.get().partitionId()
        held, n, block, ids, ends = [], 0, 0, [], []

        def blocks(final: bool):
            nonlocal held, n, block, ids, ends
            flat = np.concatenate(held) if held else np.zeros(0, np.uint16)
            at = 0
            while n - at >= block_tokens or (final and n > at):
                stop = min(at + block_tokens, n)
                closed = int(np.searchsorted(ends, stop, side="right"))
                yield file, block, flat[at:stop].tobytes(), ids[:closed]
                ids, ends, at, block = ids[closed:], ends[closed:], stop, block + 1
            held, n, ends = [flat[at:]], n - at, [e - at for e in ends]

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.asarray(encoding.encode_ordinary(text or "") + [eod], dtype=np.uint16)
                held.append(tokens)
                n += len(tokens)
                ids.append(doc_id)
                ends.append(n)
                if n >= 8 * block_tokens:
                    yield from _rows(blocks(False), kind_of)
        yield from _rows(blocks(True), kind_of)

    kind_of = _arrow_type(kind)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, f"file int, block int, tokens binary, ids array<{kind}>")


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())


def _rows(blocks, kind):
    for file, block, tokens, ids in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([tokens], pa.binary()), pa.array([ids], pa.list_(kind))], ["file", "block", "tokens", "ids"])


def scan_separators(blocks: DataFrame, *, eod: int = EOD) -> DataFrame:
    """Per document of the token files: ``file, document`` (its number in the file), ``n_tokens`` (without the separator), ``closed``."""

    def scan(batches):
        for batch in batches:
            head, tail, inner = [], [], []
            for raw in batch.column("tokens").to_pylist():
                tokens = np.frombuffer(raw, dtype=np.uint16)
                at = np.flatnonzero(tokens == eod)
                head.append(int(at[0]) if len(at) else None)
                tail.append(len(tokens) - int(at[-1]) - 1 if len(at) else len(tokens))
                inner.append((np.diff(at) - 1).tolist() if len(at) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                ["file", "block", "head", "tail", "inner"],
            )

    scanned = blocks.select("file", "block", "tokens").mapInArrow(scan, "file int, block int, head bigint, tail bigint, inner array<bigint>")
    ends = F.when(F.col("head").isNull(), 0).otherwise(F.size("inner") + 1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = scanned.withColumn("ends", ends)
    s = s.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # tokens left open by the blocks since the last separator: running total less its value at the last block with one
    s = s.withColumn("all_open", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    s = s.withColumn("mark", F.when(F.col("head").isNotNull(), F.col("all_open")))
    s = s.withColumn("open", F.col("all_open") - F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0)))
    lengths = F.when(F.col("head").isNotNull(), F.concat(F.array(F.col("head") + F.col("open")), F.col("inner")))
    whole = s.select("file", F.posexplode(lengths).alias("k", "n_tokens"), "first").select("file", (F.col("first") + F.col("k")).alias("document"), "n_tokens", F.lit(True).alias("closed"))
    last = s.groupBy("file").agg(F.max_by(F.struct("head", "tail", "open", "ends", "first"), "block").alias("x"))
    rest = last.select("file", (F.col("x.first") + F.col("x.ends")).alias("document"), F.when(F.col("x.head").isNull(), F.col("x.tail") + F.col("x.open")).otherwise(F.col("x.tail")).alias("n_tokens"), F.lit(False).alias("closed"))
    return whole.unionByName(rest.filter("n_tokens > 0"))


def document_token_counts(docs: DataFrame, **options) -> DataFrame:
    """Token counts of documents through flat token files in the shared folder: ``doc_id, file, document, n_tokens``."""
    files = work_table(write_token_files(docs, **options), "tokens")
    counts = scan_separators(files)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = files.select("file", "block", "ids").withColumn("first", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))
    ids = order.select("file", F.posexplode("ids").alias("k", "doc_id"), "first").select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id")
    return ids.join(counts.filter("closed"), ["file", "document"]).select("doc_id", "file", "document", "n_tokens")
