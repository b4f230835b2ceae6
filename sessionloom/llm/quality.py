"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes ten statistics (lengths, shares of kinds of bytes, repetition of words),
transformed so that they are closer to normal.  For both classes the mean and the covariance
over all labelled training documents are computed in Spark; the covariances are shrunk towards
the pooled covariance and its diagonal.  The Cholesky factor of each class is computed once and
cached in the scoring expression; the score is the logistic function of the difference of the
two log densities (Mahalanobis distance and determinant) plus that of the class shares.

Null and empty texts have the statistics of an empty text and are scored as such.  A document
with several labels counts once per label row; null labels are not used.  If a class has no
training document, every score is 0.5.  Columns of the input other than id and text are not
read, so labels, source and language never reach the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.textbytes import prefix_sums, span_hashes, text_blocks, words
from sessionloom.operators.scale import materialize

NAMES = ("log_bytes", "log_words", "word_length", "upper", "symbols", "marks", "bars", "digits", "distinct", "repeats")
POOLED = 0.1    # share of the pooled covariance in a class covariance
DIAGONAL = 0.1  # share of the pooled diagonal
RIDGE = 1e-3    # least variance
THRESHOLD = 0.3

# Kinds of bytes: 0 other, 1 upper case of ASCII, 2 symbols, 3 ! and ?, 4 bars, 5 digits.
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]] = 2
_KIND[[ord(c) for c in "!?"]] = 3
_KIND[ord("|")] = 4
_KIND[ord("0"):ord("9") + 1] = 5
# Upper-case letters of Latin-1: C3 followed by 80..9E.
_LEAD, _LOW, _HIGH = 0xC3, 0x80, 0x9E


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text of a block."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, len(NAMES)))
    kinds = _KIND[data]
    if data.size > 1:
        kinds[1:][(data[:-1] == _LEAD) & (data[1:] >= _LOW) & (data[1:] <= _HIGH)] = 1
    starts, ends, owner = words(data, offsets)
    hashes = span_hashes(prefix_sums(data), starts, ends)
    first = np.searchsorted(owner, np.arange(rows + 1))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lengths = ends - starts
    for i in range(rows):
        a, b = first[i], first[i + 1]
        n, count = int(size[i]), int(b - a)
        k = np.bincount(kinds[offsets[i]:offsets[i + 1]], minlength=6)
        w, m = max(count, 1), max(n, 1)
        out[i] = (np.log1p(n), np.log1p(count), np.log1p(lengths[a:b].sum() / w), np.sqrt(k[1] / m), np.sqrt(k[2] / m),
                  np.sqrt(k[3] / w), np.sqrt(k[4] / w), np.sqrt(k[5] / m),
                  np.log1p(len(np.unique(hashes[a:b]))) - np.log1p(count), np.sqrt(again[a:b].sum() / w))
    return out


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), out: str = "x") -> DataFrame:
    """``key``, the columns of ``carry`` and ``out``, the list of statistics of the whole text."""
    columns = [key, *carry]
    names = [f"_c{i}" for i in range(len(columns))]
    return _private_statistics(df, columns, text).withColumnsRenamed({**dict(zip(names, columns)), "_x": out})


def _private_statistics(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``_c0``, ``_c1``, ... for ``columns``, and ``_x``: no name of the input is left to clash with."""
    names = [f"_c{i}" for i in range(len(columns))]
    source = names[columns.index(text)] if text in columns else "_text"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(source)):
                x = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(first, last - first) for n in names), flat], names=[*names, "_x"])

    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, columns)) + ", _x array<double>"
    own = [F.col(f"`{text}`").alias(source)] if source not in names else []
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, columns)), *own).mapInArrow(compute, schema)


def class_moments(rows: DataFrame, label: str, x: str = "x") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, mean and covariance of each class, from combinable (centred) aggregates."""
    d = len(NAMES)
    at = [F.col(x)[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = {}
    for row in rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(
            F.count(F.lit(1)), *(F.avg(a) for a in at), *(F.covar_pop(at[i], at[j]) for i, j in pairs)).collect():
        covariance = np.zeros((d, d))
        for (i, j), value in zip(pairs, row[2 + d:]):
            covariance[i, j] = covariance[j, i] = value or 0.0
        found[int(row[0])] = (row[1], np.array(row[2:2 + d]), covariance)
    return found


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL):
    """For class 0 and 1 the mean, the inverse of the Cholesky factor and the log constant; None if a class is missing."""
    if set(moments) != {0, 1}:
        return None
    total = sum(n for n, *_ in moments.values())
    common = sum(n * c for n, _, c in moments.values()) / total
    model = []
    for label in (0, 1):
        n, mean, covariance = moments[label]
        shrunk = (1 - pooled - diagonal) * covariance + pooled * common + diagonal * np.diag(np.diag(common))
        factor = np.linalg.cholesky(shrunk + RIDGE * np.eye(len(mean)))
        model.append((mean, np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum()))
    return model


def score_column(model, x: str = "x") -> Column:
    """Logistic function of the log density difference, as one expression over the list ``x``."""
    if model is None:
        return F.lit(0.5)
    logs = []
    for mean, inverse, constant in model:
        distance = F.lit(0.0)
        for i in range(len(mean)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + (F.col(x)[j] - F.lit(float(mean[j]))) * F.lit(float(inverse[i, j]))
            distance = distance + z * z
        logs.append(F.lit(float(constant)) - distance * 0.5)
    gap = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), logs[1] - logs[0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-gap))


def held_out(key: str = "doc_id", parts: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == rest, F.lit(False))


def _scored(df: DataFrame, labels: DataFrame, columns: list[str], key: str, text: str, label: str) -> DataFrame:
    """``_c0`` (the key), ``_c1``, ... for ``columns``, ``_held_out`` and ``_score``."""
    rows = materialize(_private_statistics(df, columns, text).withColumn("_held_out", held_out("_c0")))
    taught = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    known = rows.filter(~F.col("_held_out")).join(taught, F.col("_c0") == F.col("_key"))
    model = discriminant(class_moments(known, "_label", "_x"))
    return rows.withColumn("_score", score_column(model, "_x")).drop("_x")


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``carry``, ``held_out``, ``score`` and ``predicted`` of every row.

    Only labels of documents that are not held out are learned from."""
    columns = [key, *carry]
    scored = _scored(df, labels, columns, key, text, label)
    return scored.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)), F.col("_held_out").alias("held_out"),
                         F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score of at least ``threshold``, whatever their columns are called."""
    columns = [key, *(c for c in df.columns if c != key)]
    kept = _scored(df, labels, columns, key, text, label).filter(F.col("_score") >= threshold)
    return kept.select(*(F.col(f"_c{columns.index(c)}").alias(c) for c in df.columns))
