"""Helpers shared by the operators: columns by position, shared tables, batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelake.session import shared_dir

# A word is a run of characters other than ASCII white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
# Tables of more rows than this are joined by key, however small their files are.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def pick(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Columns of ``df`` chosen by exact name and renamed, whatever else it holds.

    Renaming by position keeps names that differ in case only, names with
    dots, and names that an operator uses itself from becoming ambiguous.
    ``None`` as a name gives a null string column.
    """
    names = df.columns
    apart = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for new, old in wanted.items():
        if old is None:
            out.append(F.lit(None).cast("string").alias(new))
        elif old in names:
            out.append(F.col(f"c{names.index(old)}").alias(new))
        else:
            raise ValueError(f"no column {old!r} among {names}")
    return apart.select(*out)


def apart(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with columns renamed by position, the new names and the old ones."""
    old = df.columns
    new = [f"in_{i}" for i in range(len(old))]
    return df.toDF(*new), new, old


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``, equals ``rest`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts) == F.lit(rest)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def by_key(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join that sends neither side to every task; with ``rows`` (a bound of its rows), only if they are many.

    Spark takes rows behind an explode for as large as those before it, and rows
    of a table for as large as its files, where a repeated value takes no room:
    it would collect in the driver what it thinks is small.
    """
    return df if rows is not None and rows <= BROADCAST_ROWS else df.hint("merge")


def process_cache(key: str, make: Callable):
    """One object per Python worker process, kept across tasks (a tokenizer, say)."""
    module = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    held = module.__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def slices_by_chars(lengths: np.ndarray, chars: int) -> Iterator[tuple[int, int]]:
    """``(begin, count)`` runs of rows of about ``chars`` characters, one row at least."""
    group = (lengths.cumsum() - lengths) // chars
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(begins, [*begins[1:], len(lengths)], strict=True):
        yield int(a), int(b - a)


def map_texts(df: DataFrame, text: str, outputs: str, fn: Callable[[list[str]], dict], chars: int = 4_000_000) -> DataFrame:
    """Replace the column ``text`` by the columns that ``fn`` computes from runs of whole texts.

    The other columns travel as Arrow arrays, untouched.  ``outputs`` is a DDL
    schema; ``fn`` gets a list of texts and returns a sequence per output.
    """
    carried = [f for f in df.schema.fields if f.name != text]
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType(carried + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64")
            for begin, count in slices_by_chars(lengths, chars):
                part = batch.slice(begin, count)
                made = fn(part.column(text).to_pylist())
                columns = [part.column(f.name).cast(arrow.field(f.name).type) for f in carried]
                columns += [pa.array(made[f.name], type=arrow.field(f.name).type) for f in added.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
