"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

Words are split in Spark. Documents are hashed into blocks of a bounded number of rows; each block keeps
a table of its distinct words. The block tables, not the texts, are brought together by word, so that each
distinct word of the corpus is encoded once, and go back to their blocks with the ids. There the ids
replace the words by position, column-wise.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the rank file's vocabulary splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of a block: documents, and characters in the mean.
ROWS_PER_BLOCK, CHARS_PER_BLOCK = 4096, 1 << 25
#: Blocks whose common words come together; with more blocks, a word that stands in all of them is encoded once for each so many.
BLOCKS_PER_WORD = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def split_words(text: Column) -> Column:
    """The words of a text, which joined give the text again; none for null and empty texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PATTERN), F.lit(0))


def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def _encode_words(path: str):
    """(block, word), the same words in succession -> (block, word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)._encode_single_piece
        last, ids = None, []
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("word"), pa.array(out, pa.list_(pa.int32()))], ["block", "word", "ids"])

    return run


def _replace(counts: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        lists = docs.column("words").combine_chunks()
        known = words.column("ids").combine_chunks()
        at = pc.index_in(lists.flatten(), words.column("word").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[at] if len(at) else at)])
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        if counts:
            return pa.table({"id": docs.column("id"), "n_tokens": pa.array(np.diff(bounds), pa.int64())})
        flat = known.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        take = np.repeat((starts[at] if len(at) else at) - ends[:-1], sizes[at] if len(at) else at) + np.arange(ends[-1])
        return pa.table({"id": docs.column("id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[take], pa.int32()))})

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, rows_per_block: int = ROWS_PER_BLOCK, counts: bool = False) -> DataFrame:
    """``id_col, ids`` (or ``n_tokens`` with ``counts``) of each row, without special tokens.

    Null and empty texts have no ids (an empty list). Repeated rows stay repeated; other columns are
    ignored. ``ranks``: a rank file that every executor can read.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length(text_col)).alias("chars")).first()
    blocks = max(1, math.ceil(size["n"] / rows_per_block), math.ceil((size["chars"] or 0) / CHARS_PER_BLOCK))
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts move once; both uses below read the same shuffle and split the words behind it
    split = keyed.repartition("block").select("block", "id", split_words(F.col("text")).alias("words"))
    words = split.select("block", F.explode(F.array_distinct("words")).alias("word")).distinct()
    # by the word and the block's group, so that no word has more rows than BLOCKS_PER_WORD in one place
    encoded = words.repartition("word", F.floor(F.col("block") / BLOCKS_PER_WORD)).sortWithinPartitions("word").mapInArrow(_encode_words(ranks), "block int, word string, ids array<int>")
    result = f"id {id_type}, n_tokens bigint" if counts else f"id {id_type}, ids array<int>"
    done = split.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_replace(counts), result)
    return done.withColumnRenamed("id", id_col)


def pieces(spark: SparkSession, ranks: str = RANKS) -> DataFrame:
    """``id, piece``: the bytes of each id, one character up to U+00FF per byte."""
    return spark.createDataFrame([(i, b.decode("latin-1")) for b, i in read_ranks(ranks).items()], "id int, piece string")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``id_col, text`` from ids by a join with the table of pieces; ids must be of the vocabulary.

    A null or empty list gives an empty text. Rows are grouped by ``id_col``, which must be unique.
    The table of pieces is broadcast: its size is the vocabulary's, whatever the corpus.
    """
    at = encoded.select(F.col(id_col).alias("key"), F.posexplode_outer(ids_col).alias("pos", "id"))
    joined = at.join(F.broadcast(pieces(encoded.sparkSession, ranks)), "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    text = F.encode(F.array_join(F.transform(parts, lambda p: p["piece"]), ""), "ISO-8859-1").cast("string")
    return joined.groupBy("key").agg(text.alias("text")).withColumnRenamed("key", id_col)
