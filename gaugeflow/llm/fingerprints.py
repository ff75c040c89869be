"""Document fingerprints: a digest of bucket quartiles.

Every three consecutive bytes of a text hash into one of 1,024 buckets.  A
bucket's count is encoded by the quartile it falls in (two bits), and the length
by its logarithm; the digest is their hexadecimal text.  The difference of two
digests sums the quartile steps and the length steps and is bounded by what
unrelated digests reach; likeness is 1 less the difference's part of that bound.

``report`` compares every document with the next one by id.  Texts are shuffled
once, into ranges of ids, and a task streams through its sorted range.  The first
and the last row of each range are written beside the results, and a small join
of them completes the last rows; nothing of a range reaches the driver.

Defined results: null and empty texts, and texts of fewer than three bytes, have
all counts 0; equal texts have equal digests; two digests without counts have
likeness 1; ids may have any type that can be ordered; rows of one id are ordered
by a hash of their text; null ids come first; a single row is the next of itself;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import materialize
from gaugeflow.llm.words import column_bytes

BUCKETS = 1024
#: Unrelated digests differ by 1.25 a bucket on average.
BOUND = BUCKETS * 5 // 4
#: A step of the length code is a factor of 1.1; a step counts as so many quartile steps.
LENGTH_STEP = 4
#: Text characters of a range of ids, which is what a task sorts.
RANGE_CHARS = 24 << 20
_SLICE = 1 << 18

_rng = np.random.Generator(np.random.PCG64(7))
_TABLES = _rng.integers(0, BUCKETS, (3, 256), dtype=np.int32)


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (a row of ``BUCKETS`` per text) and length codes."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, BUCKETS), np.int32)
    for low in range(0, max(0, len(data) - 2), _SLICE):
        high = min(len(data) - 2, low + _SLICE)
        part = data[low : high + 2]
        bucket = _TABLES[0][part[:-2]] ^ _TABLES[1][part[1:-1]] ^ _TABLES[2][part[2:]]
        first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        # a triplet belongs to a text if it begins and ends in it
        begin = np.clip(offsets[first:last], low, high)
        end = np.clip(np.maximum(offsets[first + 1 : last + 1] - 2, offsets[first:last]), low, high)
        size = end - begin
        inside = np.ones(high - low, bool)
        gaps = offsets[first + 1 : last + 1]
        for back in (1, 2):
            at = gaps - back
            inside[at[(at >= low) & (at < high)] - low] = False
        place = np.repeat(np.arange(last - first, dtype=np.int32) * BUCKETS, np.maximum(size, 0))
        counts[first:last] += np.bincount(
            place + bucket[inside], minlength=(last - first) * BUCKETS
        ).reshape(-1, BUCKETS).astype(np.int32)
    at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    codes = np.zeros((rows, BUCKETS), np.uint8)
    for r in range(0, rows, 256):
        some = counts[r : r + 256]
        quartile = np.partition(some, at, axis=1)[:, at]
        for k in range(3):
            codes[r : r + 256] += some > quartile[:, k : k + 1]
    length = np.minimum(255, np.ceil(np.log1p(np.diff(offsets)) / np.log(1.1))).astype(np.int64)
    return codes, length


def as_bytes(codes: np.ndarray, length: np.ndarray) -> list[bytes]:
    """Digests as bytes: the length, then four buckets to a byte."""
    packed = (codes[:, 0::4] << 6) | (codes[:, 1::4] << 4) | (codes[:, 2::4] << 2) | codes[:, 3::4]
    return [row.tobytes() for row in np.concatenate([length.astype(np.uint8)[:, None], packed], 1)]


def as_text(codes: np.ndarray, length: np.ndarray) -> list[str]:
    """Digests as hexadecimal text."""
    return [digest.hex() for digest in as_bytes(codes, length)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 less the bounded difference of digests, row by row."""
    steps = np.abs(a[0].astype(np.int8) - b[0].astype(np.int8)).sum(1, dtype=np.int64)
    steps = steps + LENGTH_STEP * np.abs(a[1] - b[1])
    return 1 - np.minimum(steps, BOUND) / BOUND


def from_text(digest: str) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``as_text`` for one digest."""
    packed = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], 1).reshape(1, -1)
    return codes, np.array([int(digest[:2], 16)])


def fingerprint(docs: DataFrame, *, text_col: str = "text", digest_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of each whole text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = as_text(*digests(*column_bytes(batch.column(at))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, digest_col]
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, `{digest_col}` string")


#: Digests are stored as bytes, half of their text.
RESULT = (
    "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter gives way to the beginning of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _measured(texts: list[str]) -> list[pa.Array]:
    """The columns of ``RESULT`` for all but the last of ``texts``, each with the one after it."""
    plain = digests(*column_bytes(pa.array(texts, pa.string())))
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = digests(*column_bytes(pa.array(changed, pa.string())))
    own = plain[0][:-1], plain[1][:-1]
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        pa.array(as_bytes(*own), pa.binary()),
        pa.array(as_bytes(*other), pa.binary()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, (plain[0][1:], plain[1][1:])), pa.float64()),
    ]


def _ranges(light: DataFrame, kind: str) -> DataFrame:
    """Results of the sorted ranges of ``light`` (part, id, text), and their open ends.

    Columns: id, those of ``RESULT``, part, head and last; ``head`` is the text
    of a range's first row, and of its last row only id and ``last``, its text,
    are given.
    """

    def row(id_: pa.Array, results: list[pa.Array] | None, part: int, head: str | None, last: str | None) -> pa.RecordBatch:
        n = len(id_)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        results = results or [pa.nulls(n, k) for k in kinds]
        rest = [pa.array([part] * n, pa.int32()), pa.array([head] + [None] * (n - 1), pa.string()), pa.array([last] * n, pa.string())]
        return pa.RecordBatch.from_arrays([id_, *results, *rest], names=["id", *_NAMES, "part", "head", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, part, first, begun = [], [], 0, None, False
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                part, more = some.column(0)[0].as_py(), some.column(2).to_pylist()
                if not begun:
                    first, begun = more[0], True
                every, texts = pa.concat_arrays([*ids, some.column(1)]), texts + more
                if len(texts) > 1:
                    yield row(every[:-1], _measured(texts), part, first, None)
                    first = None
                ids, texts = [every[-1:]], texts[-1:]
        if ids:
            yield row(ids[0], None, part, first, texts[0])

    return light.mapInArrow(run, f"id {kind}, {RESULT}, part int, head string, last string")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its digest, its edited text's, and their likeness."""
    light = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = light.schema["id"].dataType.simpleString()
    size = light.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    parts = max(1, min(int(size[1] or 0), -(-int(size[0] or 0) // RANGE_CHARS)))
    # the hash and the row's number spread the rows of one id; equal rows may stand in any order
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = light.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialize(_ranges(ranged.select(F.spark_partition_id().alias("part"), "id", "text"), kind), "ranges")
    # a row a range from here on; the range after the last is the first
    heads = found.where("head IS NOT NULL").select("part", "head")
    numbers = heads.select("part", F.lead("part").over(Window.partitionBy().orderBy("part")).alias("after"))
    least = heads.agg(F.min("part").alias("least"))
    numbers = numbers.join(F.broadcast(least)).select("part", F.coalesce("after", "least").alias("after"))  # one row
    following = numbers.join(heads.withColumnRenamed("part", "after"), "after").select("part", "head")
    lasts = found.where("last IS NOT NULL").select("id", "last", "part").join(following, "part").select("id", "last", "head")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                results = _measured([batch.column(1)[r].as_py(), batch.column(2)[r].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[r : r + 1], *results], names=["id", *_NAMES])

    done = found.where("last IS NULL").select("id", *_NAMES)
    every = done.union(lasts.mapInArrow(complete, f"id {kind}, {RESULT}"))
    digest = lambda c: F.lower(F.hex(c)).alias(c)
    texts = {c: digest(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return every.select(F.col("id").alias("doc_id"), *[texts.get(c, F.col(c)) for c in _NAMES])
