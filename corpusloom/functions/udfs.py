"""What built-in expressions cannot say: Unicode forms, hashed embeddings, JSON repair. Arrow batches, never single rows."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A unit vector from the text's SHA-256: equal texts meet, nothing else means anything."""
    digest = hashlib.sha256(text.encode()).digest()
    raw = [(digest[i % 32] / 255.0) * 2 - 1 for i in range(dim)]
    size = sum(x * x for x in raw) ** 0.5 or 1.0
    return [x / size for x in raw]


def repaired(text: str) -> str:
    """Closes what a cut-off JSON text left open; brackets inside strings do not count."""
    stack: list[str] = []
    inside = escaped = False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    body = text + '"' if inside else text.rstrip().rstrip(",")
    return body + "".join(reversed(stack))


def nearest(number: int, known: list[int]) -> int | None:
    """The nearest number; of two as near the smaller."""
    return min(known, key=lambda k: (abs(k - number), k), default=None)


def register(spark: SparkSession) -> None:
    """Registers the SQL functions nfkc, hash_embedding and repair_json."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hash_embedding(t) if t is not None else None)

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(lambda t: repaired(t) if t is not None else None)

    for name, udf in (("nfkc", nfkc), ("hash_embedding", embed), ("repair_json", repair)):
        spark.udf.register(name, udf)
