"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if an earlier line, by document id and place, is equal or one
edit (an inserted, deleted or replaced character) away.

Equal lines are grouped by a 128-bit hash.  Distinct lines are cut into segments
by a base length (their own or one less); the hash of all but one segment is a
key, and a line one edit away shares the key of the segment that the edit lies
in.  Lines whose keys nobody shares are done.  For the others all variants of
the shared segment within the bound are emitted as hashed keys: the segment with
one character deleted and its place marked (lines that share it differ there
alone), the whole segment, and the segment one longer with each character
deleted.  Equal variants are joined on the earliest line of their group, so no
pairs within a group are made, and the edit distance of each pair is verified on
the texts.

Defined results: lines end at line feeds; lines of fewer than ``min_chars``
characters are kept, or, with ``exact_short``, dropped if an earlier line is equal
and they aren't blank; a null text has no lines and stays null; an empty
text is one empty line; null ids come last; rows that repeat an id come in the
order of a hash of their texts, and of rows that repeat id and text one is the
first; an empty table gives an empty result; a column named ``__lines`` or
``__kept`` gives way to the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import discard, materialize, sided

#: Lines below it have no near copies, only equal ones.
MIN_CHARS = 20
#: Segments of a line.
SEGMENTS = 4
#: A shared segment of more characters is cut in pieces, as its variants are.
PIECE_CHARS = 1024


def _begin(base: Column, j: Column | int) -> Column:
    """Characters before segment ``j`` of a line of base length ``base``."""
    return F.shiftright(base * j, 2)


def _key(line: Column, base: Column, j: int) -> Column:
    """The hash of all but segment ``j``."""
    return F.xxhash64(base, F.lit(j), F.left(line, _begin(base, j)), F.right(line, base - _begin(base, j + 1)))


def _keys(line: Column, size: Column) -> Column:
    """The keys of the segments, for both base lengths; written out, so that they compile."""
    return F.array(*[_key(line, base, j) for base in (size, size - 1) for j in range(SEGMENTS)])


def _segment_keys(line: Column, size: Column) -> Column:
    """(base, segment, key) of what ``_keys`` has."""
    return F.array(
        *[
            F.struct(base.alias("base"), F.lit(j).alias("segment"), _key(line, base, j).alias("key"))
            for base in (size, size - 1)
            for j in range(SEGMENTS)
        ]
    )


def _lines(docs: DataFrame) -> DataFrame:
    """Every line of ``docs`` (id, doc, text): id, doc, place, line."""
    return docs.select("id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with their hash (h1, h2), rank (a struct that orders them) and size."""
    return lines.withColumns(
        {
            "h1": F.xxhash64("line"),
            "h2": F.xxhash64(F.lit("line"), F.col("line")),
            "rank": F.struct(F.col("id").isNull().alias("last"), "id", "doc", "place"),
            "size": F.length("line"),
        }
    )


def _variants(lines: DataFrame) -> DataFrame:
    """(h1, h2, rank, kind, variant) of shared segments; kind is replaced, whole or shorter."""
    begin, end = _begin(F.col("base"), F.col("segment")), _begin(F.col("base"), F.col("segment") + 1)
    inside = F.substring("line", begin + 1, F.col("size") - begin - (F.col("base") - end))
    rows = lines.select(
        "h1", "h2", "rank", "key", inside.alias("inside"), (end - begin).alias("span"), (F.col("size") == F.col("base")).alias("same")
    )
    # the pieces of a long segment are to it as segments are to a line
    count = F.greatest(F.lit(1), F.ceil(F.col("span") / PIECE_CHARS).cast("int"))
    rows = rows.withColumn("count", count).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    low, high = (F.floor(F.col("span").cast("long") * p / F.col("count")).cast("int") for p in (F.col("piece"), F.col("piece") + 1))
    behind = F.col("span") - high
    rows = rows.select(
        "h1", "h2", "rank", "same",
        F.xxhash64("key", "piece", F.left("inside", low), F.right("inside", behind)).alias("key"),
        F.substring("inside", low + 1, F.length("inside") - low - behind).alias("middle"),
    )
    without = lambda i: F.concat(
        F.substring(F.col("middle"), F.lit(1), i), F.substring(F.col("middle"), i + 2, F.length("middle"))
    )
    places = F.when(F.length("middle") > 0, F.sequence(F.lit(0), F.length("middle") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    kind = lambda name, variant: F.struct(F.lit(name).alias("kind"), variant.alias("variant"))
    replaced = F.transform(places, lambda i: kind("replaced", F.xxhash64(F.col("key"), i, without(i))))
    shorter = F.transform(places, lambda i: kind("shorter", F.xxhash64(F.col("key"), without(i))))
    whole = F.array(kind("whole", F.xxhash64("key", "middle")))
    emitted = F.when(F.col("same"), F.concat(replaced, whole)).otherwise(F.array_distinct(shorter))
    return rows.select("h1", "h2", "rank", F.explode(emitted).alias("v")).select("h1", "h2", "rank", "v.*")


def _bare(line: Column, min_chars: int) -> Column:
    """A line of fewer than ``min_chars`` characters that isn't blank."""
    return (F.length(line) < min_chars) & F.rlike(line, F.lit(r"\S"))


def kept_places(docs: DataFrame, *, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """(id, doc, place) of the lines of ``docs`` (id, doc, text) that stay.

    These are lines of ``min_chars`` or more and, with ``exact_short``, shorter
    ones that aren't blank; shorter ones have no keys, so only equal ones meet.
    """
    long = F.col("size") >= min_chars
    keys = F.when(long, _keys(F.col("line"), F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    lines = materialize(
        _marked(_lines(docs)).where(long | _bare(F.col("line"), min_chars) if exact_short else long).select("h1", "h2", "rank", keys.alias("keys")),
        "lines",
    )
    # the keys of equal lines are equal, so any will do
    firsts = materialize(
        lines.groupBy("h1", "h2").agg(F.min("rank").alias("rank"), F.first("keys").alias("keys")), "firsts"
    )
    discard(lines)
    keyed = firsts.select("h1", "h2", F.explode("keys").alias("key"))
    shared = materialize(
        keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key"),
        "shared-keys",
    )
    near = materialize(keyed.join(shared, "key").select("h1", "h2", "key").distinct(), "near-keys")
    places = materialize(
        firsts.join(near.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "rank"), "places"
    )
    # the texts of lines that share a key, each from its first place
    wanted = materialize(places.select(F.col("rank.doc").alias("doc")).distinct(), "wanted")
    some = docs.join(sided(wanted), "doc", "left_semi")
    texts = _marked(_lines(some).where(F.length("line") >= min_chars)).select("h1", "h2", "rank", "size", "line")
    texts = materialize(texts.join(places, ["h1", "h2", "rank"], "left_semi").dropDuplicates(["h1", "h2"]), "texts")
    segments = texts.withColumn("k", F.explode(_segment_keys(F.col("line"), F.col("size")))).select("h1", "h2", "rank", "size", "line", "k.*")
    variants = materialize(_variants(segments.join(near, ["h1", "h2", "key"], "left_semi")), "variants")
    line_of = F.struct("rank", "h1", "h2")
    earliest = lambda kind: F.min(F.when(F.col("kind") == kind, line_of)).alias(kind)
    groups = (
        variants.groupBy("variant")
        .agg(
            earliest("replaced"), earliest("whole"), earliest("shorter"),
            F.min("h1").alias("lo"), F.max("h1").alias("hi"),
        )
        .where("lo < hi")
        .drop("lo", "hi")
    )
    # each line meets the earliest of its group that is one edit away
    other = (
        F.when(F.col("kind") == "replaced", F.col("g.replaced"))
        .when(F.col("kind") == "shorter", F.col("g.whole"))
        .otherwise(F.col("g.shorter"))
    )
    pairs = (
        variants.alias("v")
        .join(groups.alias("g"), "variant")
        .select("h1", "h2", F.col("v.rank").alias("rank"), other.alias("o"))
        .where("o.rank < rank")
        .select("h1", "h2", F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2"))
        .distinct()
    )
    mine = texts.select("h1", "h2", F.col("line").alias("x"))
    theirs = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("y"))
    dropped = (
        pairs.join(mine, ["h1", "h2"]).join(theirs, ["o1", "o2"]).where(F.levenshtein("x", "y", 1) >= 0).select("h1", "h2")
    )
    dropped = materialize(dropped.distinct(), "dropped")
    return firsts.join(dropped, ["h1", "h2"], "left_anti").select("rank.id", "rank.doc", "rank.place")


def _flags(places: Column) -> Column:
    """An array that holds true at ``places`` (ascending) and false between them, built in one pass."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(places, i - 1))
    run = lambda i: F.array_append(F.array_repeat(F.lit(False), (F.get(places, i) - before(i) - 1).cast("int")), F.lit(True))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - 1), run))


def _firsts_of_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (with __id, __doc) and ``__first``: false for all but one of the rows that repeat id and text."""
    twice = docs.groupBy("__id", "__doc").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    twice = materialize(twice, "repeats")
    if twice.isEmpty():
        return docs.withColumn("__first", F.lit(True))
    same = F.col("d.__id").eqNullSafe(F.col("r.__id")) & (F.col("d.__doc") == F.col("r.__doc"))
    # only repeated rows are stored with a number, the least of which is first
    some = docs.alias("d").join(twice.alias("r"), same, "left_semi").withColumn("__row", F.monotonically_increasing_id())
    some = materialize(some, "repeated")
    least = some.groupBy("__id", "__doc").agg(F.min("__row").alias("__row")).select("__row", F.lit(True).alias("__least"))
    marked = some.join(least, "__row", "left").withColumn("__first", F.coalesce("__least", F.lit(False)))
    rest = docs.alias("d").join(twice.alias("r"), same, "left_anti").withColumn("__first", F.lit(True))
    return rest.unionByName(marked.select(*rest.columns))


def dedupe_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    exact_short: bool = False,
) -> DataFrame:
    """``docs`` with the deduplicated text in place of the text, and ``__lines`` and ``__kept``, counts of lines.

    With ``exact_short`` lines below ``min_chars`` are deduplicated too, by equality.
    """
    columns = [c for c in docs.columns if c not in ("__lines", "__kept")]
    named = docs.select(
        *[F.col(f"`{c}`").alias(f"c_{c}") for c in columns],
        F.col(f"`{id_col}`").alias("__id"),
        F.xxhash64(F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")).alias("__doc"),
    )
    text = F.col(f"`c_{text_col}`")
    light = named.select(F.col("__id").alias("id"), F.col("__doc").alias("doc"), text.alias("text"))
    kept = (
        kept_places(light, min_chars=min_chars, exact_short=exact_short)
        .groupBy(F.col("id").alias("k_id"), F.col("doc").alias("k_doc"))
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
        .select("k_id", "k_doc", _flags(F.col("places")).alias("__flags"))
    )
    same = F.col("__id").eqNullSafe(F.col("k_id")) & (F.col("__doc") == F.col("k_doc"))
    joined = _firsts_of_repeats(named).join(kept, same, "left")
    split = F.split(text, "\n", -1)
    free = lambda line: (F.length(line) < min_chars) & (~_bare(line, min_chars) if exact_short else F.lit(True))
    # a place of an array is found at once, so a document costs its lines
    stays = F.filter(split, lambda line, i: free(line) | (F.col("__first") & F.coalesce(F.get(F.col("__flags"), i), F.lit(False))))
    joined = joined.withColumn("__stays", stays)
    count = lambda array: F.coalesce(F.when(text.isNotNull(), F.size(array)), F.lit(0)).cast("long")
    return joined.select(
        *[(F.array_join("__stays", "\n") if c == text_col else F.col(f"`c_{c}`")).alias(c) for c in columns],
        count(split).alias("__lines"),
        count(F.col("__stays")).alias("__kept"),
    )


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept and the digest of the deduplicated text.

    Lines that aren't blank are deduplicated whatever their length, those below
    ``MIN_CHARS`` characters by equality.
    """
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return dedupe_lines(light, exact_short=True).select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__kept").alias("n_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
