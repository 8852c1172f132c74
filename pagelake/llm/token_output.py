"""Token ids in a compact binary form: Huffman-coded blocks in document order.

Format, under one folder:

* ``header``: one row with ``version``, ``max_bits``, ``stride``, ``vocabulary``
  and ``lengths``, one byte per id: the code lengths that define all codes.
* ``blocks/part=N``: rows of independent blocks.  Parts ascend with the id of
  the document, and so do the blocks of a part by ``first``.  A block holds
  whole documents: ``first`` (number of ids in all documents before it),
  ``doc_ids``, ``counts`` (ids per document), ``n``, ``checkpoints`` (bit offset
  of every 64th id, little-endian unsigned 32 bit) and ``payload``.

Blocks are rows of Parquet files, so any store that Spark reaches can hold
them, and a reader can decode any block by itself.

Defined results: a null or empty text has the end id only; null ids come
first; rows with equal ids are all kept, in no particular order among
themselves; an empty table gives a header with one code and no blocks; other
input columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from pagelake.llm import tokens
from pagelake.llm.common import pick, slices_by_chars
from pagelake.llm.huffman import MAX_BITS, STRIDE, Code, code_lengths
from pagelake.session import shared_dir

END_ID = 0
VOCABULARY = 50_257
BLOCK_IDS = 65_536


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
              end_id: int = END_ID, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(part, doc_id, ids, at, n, counts)`` in ascending order of ids within and between parts.

    ``ids`` are 16 bits each, ``at`` is the number of ids before the document
    in its part.  The last row of a part has no ids: ``n`` is the part's number
    of ids and ``counts`` how often each id occurs there, as 64-bit integers.
    """
    path = tokenizer or tokens.default_tokenizer()
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", d.schema["doc_id"].dataType),
                           T.StructField("ids", T.BinaryType()), T.StructField("at", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end = TaskContext.get().partitionId(), tokens.encoder(path), np.array([end_id], "<u2")
        before, counts, any_row = 0, np.zeros(vocabulary, "int64"), False

        def rows(doc_ids: pa.Array, ids: list, at: np.ndarray, n: np.ndarray, counts: list) -> pa.RecordBatch:
            made = ([part] * len(n), doc_ids, ids, at, n, counts)
            return pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)
                                               for x, f in zip(made, arrow, strict=True)], schema=arrow)

        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype("int64")
            for begin, count in slices_by_chars(lengths, 2_000_000) if batch.num_rows else ():
                held = batch.slice(begin, count)
                coded = [np.concatenate((enc.encode(t), end), dtype="<u2", casting="unsafe")
                         for t in held.column("text").to_pylist()]
                counts += np.bincount(np.concatenate(coded), minlength=vocabulary)
                n = np.array([len(ids) for ids in coded], "int64")
                ends = before + n.cumsum()
                yield rows(held.column("doc_id"), [ids.tobytes() for ids in coded], ends - n, n, [None] * count)
                before, any_row = int(ends[-1]), True
        if any_row:
            yield rows(pa.array([None], arrow.field("doc_id").type), [None], np.array([before]), np.array([before]),
                       [counts.astype("<i8").tobytes()])

    return d.mapInArrow(run, schema)


def id_counts(parts: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each id in all documents, from the last rows of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, "int64")
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_py(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    counts = np.zeros(vocabulary, "int64")
    # at most one row per id of the vocabulary
    for row in parts.select("counts").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def _blocks(coded: DataFrame, lengths: np.ndarray, firsts: dict[int, int], block_ids: int) -> DataFrame:
    """Blocks of consecutive documents; ``at`` is a document's first id within its part."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(coded.schema["doc_id"].dataType)
    schema = f"part int, first bigint, doc_ids array<{kind}>, counts array<int>, n int, checkpoints binary, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, state = Code(lengths), [], {"part": None, "first": 0, "n": 0}

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[1] for x in held), "<u2")
            payload, checkpoints = code.encode(ids)
            block = pa.RecordBatch.from_arrays([
                pa.array([state["part"]], pa.int32()), pa.array([firsts[state["part"]] + state["first"]], pa.int64()),
                pa.array([[x[0] for x in held]], pa.list_(arrow_id)), pa.array([[len(x[1]) // 2 for x in held]], pa.list_(pa.int32())),
                pa.array([len(ids)], pa.int32()), pa.array([checkpoints.astype("<u4").tobytes()], pa.binary()),
                pa.array([payload], pa.binary())],
                names=["part", "first", "doc_ids", "counts", "n", "checkpoints", "payload"])
            state.update(first=state["first"] + state["n"], n=0)
            held.clear()
            return block

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "ids")), strict=True)
            for part, at, doc_id, ids in rows:
                if held and (part != state["part"] or at != state["first"] + state["n"] or state["n"] >= block_ids):
                    yield close()
                if not held:
                    state.update(part=part, first=at)
                held.append((doc_id, ids))
                state["n"] += len(ids) // 2
        if held:
            yield close()

    return coded.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
          end_id: int = END_ID, vocabulary: int = VOCABULARY, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in ascending order of their ids, under ``path``."""
    if vocabulary > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    spark = docs.sparkSession
    rough = f"{path}/ids"
    rough_rows = tokenized(docs, id_col, text_col, tokenizer, end_id, vocabulary)
    rough_rows.write.option("compression", "lz4_raw").parquet(rough)
    coded = spark.read.schema(rough_rows.schema).parquet(rough)
    parts = coded.where("counts is not null")
    lengths = code_lengths(id_counts(parts, vocabulary))
    if not lengths.any():
        lengths[end_id] = 1
    # one row per part, and the parts are as many as the tasks that wrote them
    sizes = parts.select("part", "n").collect()
    firsts, before = {}, 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        firsts[row["part"]], before = before, before + row["n"]
    header = [(1, MAX_BITS, STRIDE, vocabulary, bytearray(lengths.tobytes()))]
    spark.createDataFrame(header, "version int, max_bits int, stride int, vocabulary int, lengths binary").coalesce(1).write.parquet(f"{path}/header")
    rows = coded.where("counts is null").select("part", "doc_id", "ids", "at")
    _blocks(rows, lengths, firsts, block_ids).write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` decoded from the files; ids as little-endian unsigned 32 bit."""
    head = spark.read.parquet(f"{path}/header").first()
    lengths = np.frombuffer(bytes(head["lengths"]), "uint8")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("first", "doc_ids", "counts", "n", "checkpoints", "payload")}
                points = np.frombuffer(row["checkpoints"].as_py(), "<u4")
                ids = code.decode(row["payload"].as_py(), points, row["n"].as_py()).astype("<u4")
                counts = row["counts"].values.to_numpy().astype("int64")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"].values, pa.array(row["first"].as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([ids[e - n:e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.drop("part").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark, 'llm')}/tokens-{uuid.uuid4().hex}"
