"""Similarity join of documents on word shingles with PartEnum signatures.

The feature domain (64-bit shingle hashes) is cut into ranges, and a signature is
the hash of a set's elements in some of them.  Sets are handled in overlapping
bands of sizes, so that two sets that may be similar share a band; within a band
at most ``k`` elements differ between similar sets.  With ``p`` ranges at least
``p - k`` ranges then agree, so the sets share a signature:

- for small ``k`` one block of ``k + 2`` ranges is enumerated by pairs of ranges;
- beyond, ``k + 1 + slack`` ranges form blocks of two of which one may differ, so
  single ranges are the signatures.  A set with at most ``slack`` empty ranges
  leaves those out: an agreeing range that is not empty remains.

Sets are compared by class (equal sets).  Similar sets share at least as many
signatures of a band as ranges agree for sure and aren't left out by either, so a
class that shares fewer with all others leaves the band.  Of the others a class keeps
so many, the rarest first, that less than this number is left out: of two sets that
share the number, the kept parts then share one.

Each signature group has a pivot, its least class.  First every class is compared
with the pivot it shares most signatures with, in pieces of a bounded number of
classes, so near copies of one text cost a comparison each.  Classes that share
signatures, directly or through others, form a unit; a unit that these links
connect is done.  The sets of another unit are sent to one task, or, if they are
many, cut in blocks with a task per pair of blocks; a unit so large that its
single signature groups hold fewer pairs is taken apart into them.  A task walks
through its classes and compares one with those that it isn't connected with yet:
first by parity sketches, whose difference never exceeds that of the sets, then
by the whole sets.  It returns the links that connected something, so no pairs of
a group are written.

Shingles are compared by 64-bit hashes and classes by a 64-bit hash of their set.

Defined results: null, empty and wordless texts have an empty set, link with
nothing and are their own component; fewer words than a shingle form one; rows
that repeat an id are separate documents, and the least id of a component counts;
a null id is never the least unless no other is there; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.components import connected_components
from gaugeflow.llm.runtime import discard, materialize, sided
from gaugeflow.llm.words import NOT_SPACE, Words, column_bytes, grams, mix64

WORDS = 5
PERCENT = 80
#: A band reaches from its least size to so many times it.
BAND = 1.6
#: Up to this many differing elements, pairs of ranges are enumerated.
FEW = 3
#: Classes and set elements of a block of a unit.
BLOCK, BLOCK_ITEMS = 4096, 1_500_000
#: Classes of a piece that is compared with its pivot.
PIECE = 512
#: Up to so many classes a unit isn't taken apart.
UNIT = 50_000
SKETCH_BITS = 2048
#: A signature's low bits hold its band.
BAND_MASK = 127

_VALUE, _TAG, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class Band:
    """Sizes ``low`` to ``high``, of which similar sets differ in ``k`` elements at most."""

    def __init__(self, number: int, low: int, high: int, percent: int):
        self.low, self.high = low, high
        self.k = 2 * high * (100 - percent) // (100 + percent)
        self.slack = self.k // 8 + 1
        self.pairs = self.k <= FEW
        self.parts = self.k + 2 if self.pairs else (self.k + 1 + self.slack + 1) // 2 * 2
        if not self.pairs:
            self.slack = self.parts - self.k - 1
        self.number = number

    @cached_property
    def cuts(self) -> np.ndarray:
        return np.array([(i << 64) // self.parts for i in range(1, self.parts)], np.uint64)

    @cached_property
    def tag(self) -> np.ndarray:
        """A value for each place a signature can come from."""
        place = np.arange(self.parts**2 if self.pairs else self.parts, dtype=np.uint64)
        return mix64((place + np.uint64(1)) * _PLACE + np.array([self.number + 1], np.uint64) * _TAG)

    @cached_property
    def two(self) -> tuple[np.ndarray, np.ndarray]:
        return np.triu_indices(self.parts, 1)

    def signatures(self, ordered: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, int]:
        """Signatures of a set from its ascending hashes and the prefix sums of their values,
        and how many of them it shares with any similar set."""
        at = np.concatenate([[0], np.searchsorted(ordered, self.cuts), [len(ordered)]])
        part = sums[at[1:]] - sums[at[:-1]]
        if self.pairs:
            a, b = self.two
            found, need = mix64(mix64(part[a] + self.tag[a * self.parts + b]) + part[b]), 1
        else:
            full = at[1:] > at[:-1]
            empty = self.parts - np.count_nonzero(full)
            # either set may leave its empty ranges out, at most ``slack``
            need = max(1, self.parts - self.k - min(empty, self.slack))
            if empty <= self.slack:
                found = mix64(part[full] + self.tag[full])
            else:
                found = mix64(part + self.tag)
        return found & ~np.uint64(BAND_MASK) | np.uint64(self.number), need


@cache
def bands(percent: int) -> list[Band]:
    """Bands so that any two sizes of similar sets lie in a common one, up to 2**33 elements."""
    found, low = [], 1
    while not found or found[-1].high < 1 << 33:
        high = max(low, int(low * BAND), found[-1].high + 1 if found else 1)
        found.append(Band(len(found), low, high, percent))
        low = -(-percent * (high + 1) // 100)
    return found


def bands_of(size: int, percent: int) -> list[Band]:
    every = bands(percent)
    at = bisect_left(_highs(percent), size)
    found = []
    while at < len(every) and every[at].low <= size:
        found.append(every[at])
        at += 1
    return found


@cache
def _highs(percent: int) -> list[int]:
    return [b.high for b in bands(percent)]


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    every, count = grams(words.hash, size), words.counts()
    for r in range(words.rows):
        n, at = int(count[r]), words.first[r]
        if n >= size:
            ordered = np.sort(every[at : at + n - size + 1])
            yield ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
        else:
            yield grams(words.hash[at : at + n], n) if n else np.empty(0, np.uint64)


def _sums(ordered: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ordered) + 1, np.uint64)
    np.cumsum(mix64(ordered + _VALUE), out=out[1:])
    return out


def _class(sums: np.ndarray) -> int:
    return int(mix64(sums[-1:] * _TAG + np.uint64(len(sums)))[0].view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, class, signatures, bands, needs) of each row of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, found, numbers, needs = [], [], [], [], []
            for ordered in shingle_sets(Words(*column_bytes(batch.column(1)), NOT_SPACE), words):
                sums = _sums(ordered)
                of = [b for b in bands_of(len(ordered), percent) if b.k] if len(ordered) else []
                parts = [b.signatures(ordered, sums) for b in of]
                sizes.append(len(ordered))
                classes.append(_class(sums) if len(ordered) else None)
                found.append(np.concatenate([p for p, _ in parts]) if parts else np.empty(0, np.uint64))
                numbers.append([b.number for b in of])
                needs.append([int(n) for _, n in parts])
            few = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), _lists(found), pa.array(numbers, few), pa.array(needs, few)],
                names=["id", "n", "class", "signatures", "bands", "needs"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, class long, signatures array<long>, bands array<int>, needs array<int>")


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(class, n, sketch, items) of each row of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, sketches, items = [], [], [], []
            for ordered in shingle_sets(Words(*column_bytes(batch.column(0)), NOT_SPACE), words):
                if not len(ordered):
                    continue
                classes.append(_class(_sums(ordered)))
                sizes.append(len(ordered))
                bit = (mix64(ordered ^ _PLACE) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
                odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
                sketches.append(np.packbits(odd).view(np.uint64))
                items.append(ordered)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), _lists(sketches), _lists(items)],
                names=["class", "n", "sketch", "items"],
            )

    return docs.mapInArrow(run, "class long, n long, sketch array<long>, items array<long>")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _near(size: np.ndarray, other: int, sketch: np.ndarray, against: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets may be similar to another: sizes and sketches of similar sets are near."""
    bound = (size + other) * (100 - percent)
    fits = np.abs(size - other) * (100 + percent) <= bound
    differ = np.bitwise_count(sketch[fits] ^ against).sum(1, dtype=np.int64)
    fits[fits] = differ * (100 + percent) <= bound[fits]
    return fits


def _sets(part: pa.RecordBatch, sketch_at: int, items_at: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sketches and sets of the rows of a batch."""
    sets = part.column(items_at)
    flat = sets.flatten().to_numpy().view(np.uint64)
    cut = np.cumsum(pa.compute.list_value_length(sets).to_numpy())[:-1]
    sketch = part.column(sketch_at).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)
    return sketch, np.split(flat, cut)


def _star(percent: int):
    """Links (a, b) of pivots and their classes in sorted rows (pivot, piece, member, class, sketch, items), the pivot first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, one, its_sketch = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, classes = (batch.column(k).to_numpy() for k in (0, 3))
            sketch, items = _sets(batch, 4, 5)
            size = np.array([len(x) for x in items])
            found = []
            edge = np.flatnonzero(of[1:] != of[:-1]) + 1
            for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), len(of)], strict=True):
                if of[begin] != pivot:
                    pivot, one, its_sketch = of[begin], items[begin].copy(), sketch[begin].copy()
                near = _near(size[begin:end], len(one), sketch[begin:end], its_sketch, percent) & (classes[begin:end] != pivot)
                found += [begin + k for k in np.flatnonzero(near).tolist() if _similar(one, items[begin + k], percent)]
            yield pa.RecordBatch.from_arrays([pa.array(of[found], pa.int64()), pa.array(classes[found], pa.int64())], names=["a", "b"])

    return run


def _unit_links(blocks: np.ndarray, label: np.ndarray, items: list, sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets that connect all of a task's classes that can be.

    ``blocks`` holds each class's block; of two blocks only pairs across count,
    as another task has those within.  Classes of one ``label`` are connected.
    """
    size = np.array([len(x) for x in items])
    root = np.unique(label, return_inverse=True)[1]
    across = len(set(blocks.tolist())) > 1
    links = []
    for i in range(len(items) - 1):
        other = root[i + 1 :] != root[i]
        if across:
            other &= blocks[i + 1 :] != blocks[i]
        other = np.flatnonzero(other) + i + 1
        other = other[_near(size[other], size[i], sketch[other], sketch[i], percent)]
        for j in other.tolist():
            if root[i] != root[j] and _similar(items[i], items[j], percent):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                links.append((i, j))
    return links


def _compare(percent: int):
    """Links (a, b) of the units in sorted rows (unit, i, j, block, class, label, sketch, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> pa.RecordBatch:
            blocks, number, label, sketch, items = (np.concatenate(x) if k < 4 else sum(x, []) for k, x in enumerate(zip(*held)))
            found = _unit_links(blocks, label, items, sketch, percent)
            ends = [pa.array([int(number[p[k]]) for p in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
                if at is not None and tuple(key[begin]) != at:
                    yield links()
                    held = []
                at = tuple(key[begin])
                part = batch.slice(begin, end - begin)
                held.append((*(part.column(k).to_numpy() for k in (3, 4, 5)), *_sets(part, 6, 7)))
        if held:
            yield links()

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    """(signature, least, rows, class) of signatures that several classes share, and in how many rows."""
    shared = (
        rows.groupBy("signature")
        .agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("rows"))
        .where("least < most")
        .select("signature", "least", "rows")
    )
    return rows.join(materialize(shared, "shared"), "signature")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(signature, least, class) of ``signature_rows``, without bands that a class can't have links in."""
    members = _grouped(rows.select(F.explode("signatures").alias("signature"), "class"))
    members = materialize(members.select("signature", "rows", "class").distinct(), "members")
    needs = rows.where("class IS NOT NULL").select("class", F.explode(F.arrays_zip("bands", "needs")).alias("b"))
    needs = needs.select("class", F.col("b.bands").alias("band"), F.col("b.needs").alias("need")).distinct()
    banded = members.withColumn("band", F.col("signature").bitwiseAND(F.lit(BAND_MASK)).cast("int"))
    # a class has some hundred signatures of a band; those that no other class has come before all of these
    own = Window.partitionBy("class", "band")
    counted = banded.withColumns(
        {"count": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("rows", "signature"))}
    )
    kept = counted.join(needs, ["class", "band"]).where("count >= need AND rank <= count - need + 1").select("signature", "class")
    kept = materialize(kept, "kept")
    found = materialize(_grouped(kept).drop("rows"), "members")
    discard(members)
    discard(kept)
    return found


def star_links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of classes with the pivot they share most signatures with, if similar."""
    shares = members.where("class <> least").groupBy("class", "least").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", F.col("least").alias("pivot"))).alias("best")
    chosen = materialize(shares.groupBy("class").agg(best).select("class", "best.pivot"), "pivots")
    pieces = chosen.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    pieces = materialize(pieces, "pieces")
    piece = F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int").alias("piece")
    rows = chosen.join(pieces, "pivot").select("pivot", piece, F.lit(1).alias("member"), "class")
    own = pieces.select("pivot", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("member"), F.col("pivot").alias("class"))
    places = materialize(rows.union(own), "places")
    tasks = set_rows(texts, words).join(sided(places), "class").select("pivot", "piece", "member", "class", "sketch", "items")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tasks.repartition(parts, "pivot", "piece").sortWithinPartitions("pivot", "piece", "member")
    return materialize(ordered.mapInArrow(_star(percent), "a long, b long"), "stars")


def class_links(members: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all similar classes.

    ``members`` has (signature, least, class), ``sizes`` (class, n) and ``texts``
    (text) the text of each class.
    """
    stars = star_links(members, texts, words, percent)
    labels = connected_components(stars).select(F.col("node").alias("class"), F.col("component").alias("label"))
    units = connected_components(members.where("class <> least").select("class", "least"))
    sized = units.select(F.col("component").alias("unit"), F.col("node").alias("class")).join(sizes, "class").join(labels, "class", "left")
    sized = materialize(sized.withColumn("label", F.coalesce("label", "class")), "sized")
    whole = sized.groupBy("unit").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("elements"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    pieces = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_ITEMS)).cast("int")
    whole = whole.where("least < most").withColumn("blocks", pieces(F.col("classes"), F.col("elements")))
    whole = materialize(whole, "units")  # those that the stars left in parts
    dealt = sized.join(whole.select("unit", "classes", "blocks"), "unit").select("unit", "class", "label", "n", "classes", "blocks")
    if not whole.where(F.col("classes") > UNIT).isEmpty():
        # of the large units, those whose groups hold fewer pairs are dealt by group
        grouped = members.select("signature", "class").join(dealt.where(F.col("classes") > UNIT), "class")
        groups = grouped.groupBy("unit", "classes", "signature").agg(
            F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements"), F.min("label").alias("least"), F.max("label").alias("most")
        )
        square = F.when(F.col("least") < F.col("most"), F.col("size").cast("double") * F.col("size")).otherwise(0.0)
        apart = (
            groups.groupBy("unit", "classes")
            .agg(F.sum(square).alias("pairs"))
            .where(F.col("pairs") < F.col("classes").cast("double") * F.col("classes"))
            .select("unit")
        )
        groups = groups.where("least < most").select("signature", pieces(F.col("size"), F.col("elements")).alias("pieces"))
        by_group = (
            grouped.join(apart, "unit", "left_semi")
            .join(groups, "signature")
            .select(F.col("signature").alias("unit"), "class", "label", "n", "classes", F.col("pieces").alias("blocks"))
        )
        dealt = dealt.join(apart, "unit", "left_anti").union(by_group)
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    places = (
        dealt.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "label"
        )
    )
    places = materialize(places, "places")
    tasks = set_rows(texts, words).join(sided(places), "class").select("unit", "i", "j", "block", "class", "label", "sketch", "items")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tasks.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "class")
    links = materialize(ordered.mapInArrow(_compare(percent), "a long, b long"), "links")
    return stars.union(links)


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """What ``components`` returns, and ``component``, the class that names the component."""
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialize(signature_rows(light, words, percent), "signatures")
    members = shared_signatures(found)
    rows = materialize(found.select("id", "n", "class"), "rows")
    discard(found)
    # one document stands for a class
    wanted = members.select("class").distinct()
    chosen = (
        rows.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    )
    chosen = materialize(chosen, "chosen")
    ids = sided(chosen.select("id"))
    texts = light.alias("l").join(ids.alias("c"), F.col("l.id").eqNullSafe(F.col("c.id")), "left_semi").select("text")
    labels = connected_components(class_links(members, chosen.select("class", "n"), texts, words, percent))
    discard(members)
    joined = (
        rows.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    joined = materialize(joined, "labelled")
    discard(rows)
    least = joined.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    return joined.join(least, "component", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.col("class").alias("class_id"),
        "component",
    )


def components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id.

    ``component_id`` is the least id reachable over links of ``percent`` or more.
    """
    return _labelled(docs, id_col, text_col, words, percent).drop("component")


def _with_class(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``docs`` with ``__class``, the class of each row; null without words."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(Words(*column_bytes(batch.column(at)), NOT_SPACE), words)
            classes = pa.array([_class(_sums(x)) if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, classes], names=[*batch.schema.names, "__class"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, __class long")


def keep_first(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` with the least id of their component; of a component's rows that repeat it, one.

    Rows without an id stay, and so do all rows without words, which are
    components of their own.
    """
    names = docs.columns
    # columns of any name: they are numbered here and named again in the result
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    labelled = _labelled(docs, id_col, text_col, words, percent)
    labelled = materialize(labelled.select("doc_id", "n_shingles", "component_id", "class_id", "component"), "first")
    is_first = F.col("doc_id") == F.col("component_id")
    kept = materialize(
        labelled.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("__kept"))
        .agg(F.count(F.lit(1)).alias("__rows"), F.count_if(is_first).alias("__firsts"))
        .where("__firsts > 0")
        .drop("__firsts"),
        "kept",
    )
    most = kept.agg(F.max("__rows")).first()[0]
    joined = docs.join(sided(kept), F.col(id_col) == F.col("__kept"), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not most or most == 1:
        return joined.where(F.col(id_col).isNull() | F.col("__kept").isNotNull()).select(*columns).toDF(*names)
    single = joined.where(F.col(id_col).isNull() | (F.col("__rows") == 1)).select(*columns)
    # rows of one id are told apart by their class, of which a component keeps one
    chosen = materialize(
        labelled.where(is_first & (F.col("n_shingles") > 0))
        .groupBy(F.col("doc_id").alias("__id"), "component")
        .agg(F.min("class_id").alias("__chosen"))
        .select("__id", "__chosen"),
        "chosen",
    )
    repeated = _with_class(joined.where("__rows > 1").select(*columns), text_col, words)
    texts = repeated.join(chosen, (F.col(id_col) == F.col("__id")) & (F.col("__class") == F.col("__chosen")))
    texts = texts.dropDuplicates(["__id", "__chosen"]).select(*columns)
    return single.union(texts).union(repeated.where("__class IS NULL").select(*columns)).toDF(*names)
