"""Helpers shared by the text operators."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeping_columns(*internal: str):
    """For operators on a table: its columns named like one of ``internal``, which the operator uses itself, are
    called otherwise meanwhile. Arguments that name such a column follow it."""
    taken = {name.lower() for name in internal}

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **named):
            mark = "kept_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
            away = {c: mark + c for c in docs.columns if c.lower() in taken}
            if not away:
                return operator(docs, *args, **named)
            moved = lambda v: away.get(v, v) if isinstance(v, str) else v
            out = operator(docs.withColumnsRenamed(away), *map(moved, args), **{k: moved(v) for k, v in named.items()})
            return out.withColumnsRenamed({new: old for old, new in away.items()})
        return run
    return wrap


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; only the six ASCII blanks separate."""
    return text.lower().split() if text else []


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts (binary), the words of all texts as numbers of these, and how many each text has.

    As by bytes.split; a null text has none.
    """
    split = pc.ascii_split_whitespace(texts.view(pa.string()))
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    sizes = pc.fill_null(split.value_lengths(), 0).to_numpy().astype(np.int64)
    if b"" in words:  # before a leading blank and after a closing one
        empty = words.index(b"")
        del words[empty]
        kept = codes != empty
        before, ends = np.append(0, np.cumsum(kept)), np.cumsum(sizes)
        sizes = before[ends] - before[ends - sizes]
        codes = codes[kept]
        codes = codes - (codes > empty)
    return words, codes, sizes


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def blocks_for(total: int | None, per_block: int) -> int:
    """Number of blocks of about ``per_block`` for ``total``, one at least."""
    return max(1, math.ceil((total or 0) / per_block))


def utf8(column: str = "text"):
    """The text as bytes; Arrow hands binary to Python without decoding it."""
    return F.col(column).cast("binary")


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))  # a copy, changed in place from here
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))
