"""Benchmark decontamination by winnowing.

Of every six consecutive runs of five words the one of least hash is kept as a
fingerprint.  Two texts that share ten words in a row share six such runs and so
keep a common fingerprint: every shared span of ten words is found.  Fingerprints
of the documents are joined with those of the items, and each hit is extended to
the windows of ten words around it, which count if an item has them.  An item of
fewer words is one window; it is looked up among all document runs of its length.

Windows are held once, with the list of their items, so a phrase of many items
costs a document one hit; the items are listed per document after that.  Items of
up to ``block_bytes`` are sent to the tasks and the documents stream past them
without a shuffle.  Beyond, fingerprints and windows are joined by shuffles, so no
task holds the items.

Defined results: a null or empty text has no words and no hits; a null item text
has no windows; an item whose id is null counts as no item but its windows mark
words; repeated rows get equal results; with an empty item table no document has
hits; a column of ``docs`` named as those ``find_hits`` adds gives way to them.
Words are compared by 64-bit hashes, texts by 128 bits where they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import materialize
from gaugeflow.llm.words import ALNUM, Words, column_bytes, grams, grams_at

WINDOW = 10
GRAM = 5
#: Consecutive grams of which one is kept; WINDOW words hold as many.
SPAN = WINDOW - GRAM + 1
#: UTF-8 bytes of the items that are sent to the tasks.
BLOCK_BYTES = 16 << 20

#: What a scan adds to its rows.
ADDED = ["__hit_from", "__hit_to", "__hit_items", "__hit_words"]
HITS = "__hit_from array<int>, __hit_to array<int>, __hit_items array<string>, __hit_words long"


def winnowed(gram: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of ``gram`` that are least in some window of ``SPAN`` within one text.

    ``row[i]`` is the text of the gram or -1 where it crosses texts.
    """
    n = len(gram) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = gram[:n].copy()
    for k in range(1, SPAN):
        np.minimum(least, gram[k : k + n], out=least)
    whole = (row[:n] >= 0) & (row[:n] == row[SPAN - 1 :])
    kept = np.zeros(len(gram), bool)
    for k in range(SPAN):
        kept[k : k + n] |= whole & (gram[k : k + n] == least)
    return np.flatnonzero(kept)


def _gram_rows(row: np.ndarray, size: int) -> np.ndarray:
    n = len(row) - size + 1
    if n <= 0:
        return np.empty(0, row.dtype)
    return np.where(row[:n] == row[size - 1 :], row[:n], -1)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays, ascending."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _prints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of texts and the places they begin at."""
    gram = grams(words.hash, GRAM)
    kept = winnowed(gram, _gram_rows(words.row_of(), GRAM))
    return gram[kept], kept


def _windows_around(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and hashes of the windows that hold a gram which begins ``at``."""
    begin = np.unique((at[:, None] - np.arange(SPAN)).ravel())
    begin = begin[(begin >= 0) & (begin + WINDOW <= len(words.hash))]
    row = words.row_of()
    begin = begin[row[begin] == row[begin + WINDOW - 1]] if len(begin) else begin
    return begin, grams_at(words.hash, begin, WINDOW)


def _short(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and beginnings of all runs of ``size`` words."""
    at = np.flatnonzero(_gram_rows(words.row_of(), size) >= 0)
    return grams(words.hash, size)[at], at


def _item_windows(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes, items) of the windows of items: of WINDOW words, or all of a shorter item's."""
    value, at = _short(words, WINDOW)
    yield WINDOW, value, words.row_of()[at]
    count = words.counts()
    for size in range(1, WINDOW):
        items = np.flatnonzero(count == size)
        yield size, grams_at(words.hash, words.first[items], size), items


class Block:
    """Items of a bounded number of words, ready to be looked up."""

    def __init__(self, ids: list, texts: list):
        words = Words(*column_bytes(pa.array(texts, pa.string())), ALNUM)
        self.ids = ids
        self.print = np.unique(_prints(words)[0])
        #: size -> hashes of the windows, and the items of window k at first[k] to first[k + 1]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, value, item in _item_windows(words):
            if len(value):
                value, item = _pairs(value, item)
                distinct, first = np.unique(value, return_index=True)
                self.windows[size] = distinct, np.append(first, len(value)), item

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginning, size and index of the windows in texts; a place has one of a size."""
        found = []
        for size, (known, _, _) in self.windows.items():
            if size == WINDOW:
                value, at = _prints(words)
                at, value = _windows_around(words, at[np.isin(value, self.print)])
            else:
                value, at = _short(words, size)
            index = np.minimum(np.searchsorted(known, value), len(known) - 1)
            same = known[index] == value
            found.append((at[same], np.full(same.sum(), size), index[same]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def items(self, sizes: np.ndarray, index: np.ndarray) -> list[str]:
        """The ids of the items that have any of the windows, sorted."""
        mask = np.zeros(len(self.ids), bool)
        for size in np.unique(sizes).tolist():
            _, first, item = self.windows[size]
            for k in np.unique(index[sizes == size]).tolist():
                mask[item[first[k] : first[k + 1]]] = True
        return sorted({self.ids[i] for i in np.flatnonzero(mask).tolist()} - {None})


def _scan(block_value, keep: list[str], text_at: int):
    """A function for mapInArrow: the columns ``keep`` and each row's hits in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = block_value.value
        for batch in batches:
            words = Words(*column_bytes(batch.column(text_at)), ALNUM)
            begin, size, index = block.hits(words)
            row = words.row_of()[begin] if len(begin) else np.empty(0, np.int64)
            froms, tos, names = ([None] * words.rows for _ in range(3))
            order = np.argsort(row, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else ():
                r = row[part[0]]
                spans = np.unique(np.stack([begin[part], begin[part] + size[part]], 1), axis=0) - words.first[r]
                froms[r], tos[r] = spans[:, 0].tolist(), spans[:, 1].tolist()
                names[r] = block.items(size[part], index[part])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keep))]
                + [
                    pa.array(froms, pa.list_(pa.int32())),
                    pa.array(tos, pa.list_(pa.int32())),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(words.counts(), pa.int64()),
                ],
                names=[*keep, *ADDED],
            )

    return run


def _passed(docs: DataFrame, block: Block, text_col: str) -> DataFrame:
    """``docs`` with the columns ``ADDED`` by one block."""
    keep = docs.columns
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(block)  # of BLOCK_BYTES of texts at most
    return docs.mapInArrow(_scan(sent, keep, keep.index(text_col)), f"{columns}, {HITS}")


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _window_rows(items: DataFrame) -> DataFrame:
    """(size, value, item) of the windows of ``items`` (i, t); size 0 is a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*column_bytes(batch.column(1)), ALNUM)
            prints = np.unique(_prints(words)[0])
            for size, value, item in [(0, prints, None), *_item_windows(words)]:
                ids = pa.nulls(len(value), pa.string()) if item is None else batch.column(0).take(pa.array(item))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), size), pa.int32()), _long(value), ids], names=["size", "value", "item"])

    return items.select("i", "t").mapInArrow(run, "size int, value long, item string").distinct()


def _probes(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(k1, k2, value) of ``texts`` (k1, k2, t): fingerprints and runs as long as the short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*column_bytes(batch.column(2)), ALNUM)
            row = words.row_of()
            for value, at in [_prints(words), *(_short(words, n) for n in sizes)]:
                of, value = _pairs(row[at], value)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), _long(value)], names=["k1", "k2", "value"])

    return texts.select("k1", "k2", "t").mapInArrow(run, "k1 long, k2 long, value long")


def _spans(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(k1, k2, begin, size, value) of the windows around the ``found`` values of ``texts`` (k1, k2, t, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*column_bytes(batch.column(2)), ALNUM)
            row, found = words.row_of(), batch.column(3)
            # the values of the batch; a window of another row's is no item's window or is one all the same
            known = found.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            value, at = _prints(words)
            at, value = _windows_around(words, at[np.isin(value, known)])
            for size, value, at in [(WINDOW, value, at), *((n, *_short(words, n)) for n in sizes)]:
                if size != WINDOW:
                    some = np.isin(value, known)
                    value, at = value[some], at[some]
                of = pa.array(row[at])
                begin = pa.array(at - words.first[row[at]], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), begin, pa.array(np.full(len(at), size), pa.int32()), _long(value)],
                    names=["k1", "k2", "begin", "size", "value"],
                )

    return texts.select("k1", "k2", "t", "found").mapInArrow(run, "k1 long, k2 long, begin int, size int, value long")


def _joined(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the columns ``ADDED`` by joins with all ``items`` (i, t)."""
    key = ["k1", "k2"]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit("text"), text)
    rows = materialize(_window_rows(items), "item-windows")
    sizes = sorted(r[0] for r in rows.where(f"size BETWEEN 1 AND {WINDOW - 1}").select("size").distinct().collect())
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("t"))
    probed = rows.where(f"size < {WINDOW}").select("value").distinct()
    hits = materialize(_probes(texts, sizes).join(probed, "value", "left_semi").distinct(), "hits")
    found = hits.groupBy(*key).agg(F.collect_list("value").alias("found"))
    spans = _spans(texts.join(found, key), sizes).distinct()
    windows = rows.where("size > 0").select("size", "value").distinct()
    spans = materialize(spans.join(windows, ["size", "value"], "left_semi"), "spans")
    ends = F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))
    places = spans.groupBy(*key).agg(F.sort_array(F.collect_list(ends)).alias("s"))
    places = places.select(*key, F.col("s.begin").alias(ADDED[0]), F.col("s.end").alias(ADDED[1]))
    # a phrase counts once a text before it meets its items; nulls are left out by the set
    named = spans.select(*key, "size", "value").distinct().join(rows, ["size", "value"])
    named = named.select(*key, "item").distinct().groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias(ADDED[2]))
    united = materialize(places.join(named, key).withColumnsRenamed({"k1": "__hit_k1", "k2": "__hit_k2"}), "united")
    counted = _passed(docs, Block([], []), text_col).drop(*ADDED[:3])
    same = (k1 == F.col("__hit_k1")) & (k2 == F.col("__hit_k2"))
    return counted.join(united, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the columns ``ADDED``.

    They are the hit spans (word places from and to, end exclusive), the ids of
    the items that occur (as strings; all three null where nothing occurs) and
    the number of words.
    """
    docs = docs.drop(*ADDED)
    named = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = named.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 16)).first()[0] or 0
    if size > block_bytes:
        return _joined(docs, named, text_col)
    rows = named.collect()  # of ``block_bytes`` at most
    return _passed(docs, Block([r.i for r in rows], [r.t for r in rows]), text_col)


def report(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, **options)
    places = F.flatten(
        F.zip_with("__hit_from", "__hit_to", lambda begin, end: F.sequence(begin, end - F.lit(1)))
    )
    n_hit = F.coalesce(F.size(F.array_distinct(places)).cast("long"), F.lit(0).cast("long"))
    ids = F.coalesce(F.array_join(F.array_sort("__hit_items"), ","), F.lit(""))
    return found.select(
        "doc_id",
        F.col("__hit_words").alias("n_words"),
        F.when(F.col("__hit_from").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"),
        F.coalesce(F.when(F.col("__hit_items").isNotNull(), F.size("__hit_items")), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        F.col("__hit_from").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no window of an item occurs in."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = find_hits(plain, items, text_col=f"c{docs.columns.index(text_col)}", **options)
    return found.where("__hit_from IS NULL").select(*plain.columns).toDF(*docs.columns)
