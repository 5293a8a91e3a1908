"""Terms of the ranked search and of importance weights: runs of ASCII letters, digits and all that is not ASCII."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from granula.llm.base import slices

#: Bytes of a term keep their place, A-Z in lower case; all others are blanks. Bytes past 127 belong to characters that are not ASCII.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Rows whose texts a Python worker holds at once.
HELD = 256


def terms(data: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text in order; null has none."""
    return (data or b"").translate(TERM_BYTES).split()


def utf8(text: Column) -> Column:
    return text.cast("binary")


def strings(values: list[bytes]) -> pa.Array:
    """Whole UTF-8 sequences as strings, without decoding each."""
    return pa.array(values, pa.binary()).view(pa.string())


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, terms, counts) of batches of (key, text): the number of terms, and each distinct one with its number."""
    for batch in slices(batches, HELD):
        ns, ends, names, tfs = [], [0], [], []
        for text in batch.column(1).to_pylist():
            found = Counter(terms(text))
            ns.append(found.total())
            names.extend(found)
            tfs.extend(found.values())
            ends.append(len(names))
        at = pa.array(np.array(ends, np.int32))
        lists = [pa.ListArray.from_arrays(at, strings(names)), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], ["key", "n", "terms", "counts"])


COUNTED = "key long, n long, terms array<string>, counts array<long>"


def each_term() -> Column:
    """The pairs (terms, counts) of a row of ``counted`` as an array of structs."""
    return F.arrays_zip("terms", "counts")
