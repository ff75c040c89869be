"""Station resolution: fuzzy joins and the registry of canonical stations."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import geo, text
from gaugeflow.functions.text import STOP_TERMS
from gaugeflow.operators.order import numbered
from gaugeflow.scratch import materialize

# Weights of name and place, least score to merge, km of the place's threshold.
NAME_WEIGHT, PLACE_WEIGHT, MERGE = 0.4, 0.6, 0.7
THRESHOLD_KM = 2.0


def match_score(words_a: Column, words_b: Column, km: Column) -> Column:
    near = F.coalesce(geo.spatial_similarity(km, THRESHOLD_KM), F.lit(0.0))
    return text.set_similarity(words_a, words_b) * NAME_WEIGHT + near * PLACE_WEIGHT


def reach_km(least: float) -> float:
    """The distance within which a score of ``least`` can be had by equal names, and a little more for rounding."""
    return max(0.1, 2 * THRESHOLD_KM * (1 - (least - NAME_WEIGHT) / PLACE_WEIGHT)) + 1e-6


def is_placed(lat: str, lon: str) -> Column:
    return F.expr(f"{lat} IS NOT NULL AND {lon} IS NOT NULL AND {lat} <> 0 AND {lon} <> 0")


def fuzzy_join(left: DataFrame, right: DataFrame, least: float = MERGE) -> DataFrame:
    """Pairs of stations (id, name, lat, lon) that score ``least`` or more: left_id, right_id, km, score.

    A name alone scores at most the name's weight, so matches lie within a
    distance.  Stations of equal names and places are compared once; these meet
    in the cells of a grid in space that the distance touches, and get their
    stations' ids afterwards.  There is no cross join.
    """
    if least <= NAME_WEIGHT:
        raise ValueError("a score that names alone can reach needs no place, so a grid can't find all pairs")
    reach = reach_km(least)
    width = 2 * reach

    def stations(df: DataFrame, p: str) -> DataFrame:
        return df.where(is_placed("lat", "lon") & F.col("name").isNotNull()).select(
            F.col("id").alias(f"{p}_id"), text.comparable_name(F.col("name")).alias(f"{p}_name"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon")
        )

    def places(df: DataFrame, p: str) -> DataFrame:
        xyz = geo.earth_xyz(F.col(f"{p}_lat"), F.col(f"{p}_lon"))
        found = df.select(f"{p}_name", f"{p}_lat", f"{p}_lon").distinct()
        return found.select("*", text.word_set(F.col(f"{p}_name")).alias(f"{p}_words"), *[c.alias(f"{p}_{n}") for n, c in zip("xyz", xyz)])

    left, right = stations(left, "left"), stations(right, "right")
    around, own = places(left, "left"), places(right, "right")
    for n in "xyz":
        c = F.col(f"left_{n}")
        around = around.withColumn(f"_{n}", F.explode(F.sequence(F.floor((c - reach) / width), F.floor((c + reach) / width))))
        own = own.withColumn(f"_{n}", F.floor(F.col(f"right_{n}") / width))
    gap = [F.col(f"left_{n}") - F.col(f"right_{n}") for n in "xyz"]
    # files say too little of the rows in memory, and a side that is broadcast by their size can be more than the driver holds
    near = around.join(own.hint("merge"), ["_x", "_y", "_z"]).where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= reach * reach)
    km = geo.haversine_km(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon"))
    score = match_score(F.col("left_words"), F.col("right_words"), F.col("km"))
    keys = {p: [f"{p}_{c}" for c in ("name", "lat", "lon")] for p in ("left", "right")}
    pairs = near.withColumn("km", km).withColumn("score", score).where(F.col("score") >= least).select(*keys["left"], *keys["right"], "km", "score")
    return pairs.join(left.hint("merge"), keys["left"]).join(right.hint("merge"), keys["right"]).select("left_id", "right_id", "km", "score")


def _comparable(name: str) -> frozenset[str]:
    s = re.sub(STOP_TERMS, "", name.lower().strip())
    return frozenset(re.sub(r"[^a-z0-9\s]", "", s).split())


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    (p, q), (r, s) = ((math.radians(x) for x in pair) for pair in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * geo.RADIUS_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


REGISTRY = (
    "source string, source_station_id string, canonical_id string, best_name string, best_river string, "
    "best_state string, best_latitude double, best_longitude double, record_count long"
)


def _mode(values: Counter[str]) -> str:
    """The most frequent, the least of equals."""
    return min(values, key=lambda v: (-values[v], v), default="")


#: Within ``REACH`` of a canonical station's mean place lies whatever merges with it, in cells of ``WIDTH`` km.
REACH = reach_km(MERGE)
WIDTH = 2 * REACH
#: Two source stations that join a canonical station one after the other lie within ``REACH`` of its mean, which the
#: first moved by half of ``REACH`` at most, so within 2.5 of it; the rest is for the rounding of the globe.
HOP = 3 * REACH
#: Degrees beyond which means of degrees may lie far from the places themselves.
POLE, DATE_LINE = 89, 179


def _cells(at: tuple[float, float], reach: float = 0.0) -> list[tuple[int, ...]]:
    """The cells of the grid in space within ``reach`` km."""
    p, q = map(math.radians, at)
    xyz = math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)
    spans = [(geo.RADIUS_KM * c - reach, geo.RADIUS_KM * c + reach) for c in xyz]
    return list(product(*[range(math.floor(low / WIDTH), math.floor(high / WIDTH) + 1) for low, high in spans]))


def _alike(words: frozenset[str], others: dict[frozenset[str], None]) -> float:
    if not words or words in others:
        return float(bool(words))
    return max((len(words & other) / len(words | other) for other in others if other), default=0.0)


def _registry(frame: pd.DataFrame) -> pd.DataFrame:
    """Canonical stations of source stations in order, each merged with the best match so far.

    Only stations in cells within reach are compared, and a name and place that
    came before only if something in these cells has changed since.
    """
    known: list[dict] = []
    inside: dict[tuple, set[int]] = defaultdict(set)
    changes: Counter[tuple] = Counter()
    seen: dict[tuple, tuple] = {}
    chosen = []
    for row in frame.sort_values("place").itertuples():
        name, lat, lon = row.station_name or "", row.latitude, row.longitude
        lat = None if lat is None or math.isnan(lat) else lat
        lon = None if lon is None or math.isnan(lon) else lon
        if (key := (name, lat, lon)) not in seen:
            placed = lat and lon and math.isfinite(lat) and math.isfinite(lon)
            seen[key] = _comparable(name), _cells((lat, lon), REACH) if placed else [], None, -1
        words, cells, best, state = seen[key]
        if (now := sum(changes[c] for c in cells)) != state:
            best, score = None, 0.0
            for k in sorted(set().union(*[inside.get(c, ()) for c in cells])):
                km = _km((lat, lon), known[k]["at"])
                near = 1.0 if km <= 0.1 else max(0.0, 1 - km / (2 * THRESHOLD_KM))
                if NAME_WEIGHT + near * PLACE_WEIGHT > score and (s := _alike(words, known[k]["words"]) * NAME_WEIGHT + near * PLACE_WEIGHT) > score:
                    best, score = k, s
            best = best if score >= MERGE else None
            seen[key] = words, cells, best, now
        if best is None:
            best = len(known)
            known.append({"names": {}, "words": {}, "lats": {}, "lons": {}, "at": None, "cell": None, "rivers": Counter(), "states": Counter(), "n": 0, "founder": row.place})
        station = known[best]
        fresh = [(held, value) for held, value in (("names", name), ("lats", lat), ("lons", lon)) if value and value not in station[held]]
        for held, value in fresh:
            station[held][value] = None
        if fresh and cells:
            if name:
                station["words"][words] = None
            station["at"] = sum(station["lats"]) / len(station["lats"]), sum(station["lons"]) / len(station["lons"])
            cell = _cells(station["at"])[0]
            inside[station["cell"]].discard(best)
            inside[cell].add(best)
            changes.update({station["cell"], cell})
            station["cell"] = cell
        station["rivers"].update([row.river] if row.river else [])
        station["states"].update([row.state] if row.state else [])
        station["n"] += row.n
        chosen.append((row.source, row.source_station_id, best))
    mean = lambda v: sum(v) / len(v) if v else None
    best_of = [
        (s["founder"], max(s["names"], key=len, default=""), _mode(s["rivers"]), _mode(s["states"]), mean(s["lats"]), mean(s["lons"]), s["n"]) for s in known
    ]
    return pd.DataFrame([(source, sid, *best_of[k]) for source, sid, k in chosen], columns=[c.split()[0] for c in FOUND.split(", ")])


#: What ``_registry`` returns: the place of a canonical station's first source station stands for its number.
FOUND = REGISTRY.replace("canonical_id string", "_founder long")


def _split(reps: DataFrame, groups: int) -> DataFrame:
    """``reps`` with ``_group``; source stations of different groups can't meet in a canonical station.

    Successive members of one lie within ``HOP``, so they are in equal or
    neighbouring cells that wide, and cells joined by neighbours stay together.
    Stations without a place meet none.  Near a pole or the date line means of
    degrees can be far off, so then all is one group.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) != 0)
    placed = finite("latitude") & finite("longitude")
    if not reps.where(placed & ((F.abs("latitude") > POLE) | (F.abs("longitude") > DATE_LINE))).isEmpty():
        return reps.withColumn("_group", F.lit(0).cast("long"))
    side = 2 * math.ceil(geo.RADIUS_KM / HOP) + 4  # cells along an axis, beyond the globe's by one on each side
    x, y, z = [F.floor(c / HOP) + side // 2 for c in geo.earth_xyz(F.col("latitude"), F.col("longitude"))]
    celled = reps.withColumn("_cell", F.when(placed, (x * side + y) * side + z))
    cells = materialize(celled.where("_cell IS NOT NULL").select("_cell").distinct(), "cells")
    steps = [step for i, j, k in product((-1, 0, 1), repeat=3) if (step := (i * side + j) * side + k) > 0]
    ends = cells.select(F.explode(F.array(*[F.col("_cell") + s for s in steps])).alias("a"), F.col("_cell").alias("b"))
    labels = _components(ends.join(cells.select(F.col("_cell").alias("a")), "a").select("a", "b"))
    joined = celled.join(labels.select(F.col("id").alias("_cell"), "root"), "_cell", "left")
    together = F.coalesce("root", "_cell", -1 - F.col("place"))
    return joined.withColumn("_group", F.pmod(F.xxhash64(together), F.lit(groups))).drop("_cell", "root")


def station_registry(df: DataFrame, most: int = 50_000) -> DataFrame:
    """Canonical stations by merging source stations greedily in the order they appear.

    The order decides, so a task walks through source stations: a row per
    station, not per reading.  Beyond ``most`` of them, those that can't meet
    are dealt to several tasks; the result is the same.
    """
    reps = df.groupBy("source", "source_station_id").agg(
        F.min_by(F.struct("station_name", "river", "state", "latitude", "longitude"), "_seq").alias("r"), F.min("_seq").alias("_seq"), F.count(F.lit(1)).alias("n")
    )
    reps = reps.select("source", "source_station_id", "r.*", "_seq", "n")
    reps = numbered(reps, [F.col("_seq").asc_nulls_last(), F.col("source"), F.col("source_station_id")], "place")
    n = reps.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = reps.withColumn("_group", F.lit(0).cast("long")) if n <= most else _split(reps, parts * math.ceil(n / most))
    found = materialize(grouped.groupBy("_group").applyInPandas(_registry, FOUND), "registry")
    numbers = numbered(found.select("_founder").distinct(), ["_founder"], "_number")
    named = found.join(numbers, "_founder").withColumn("canonical_id", F.format_string("WQ_%05d", F.col("_number") + 1))
    return named.select(*[c.split()[0] for c in REGISTRY.split(", ")])


def grid_registry(df: DataFrame) -> DataFrame:
    """Canonical stations as connected components of ``fuzzy_join``: (id, canonical_id).

    Scales with the stations; unlike the greedy registry a chain of matches is one
    station and means of merged places don't shift.  ``df`` has id, name, lat, lon.
    """
    pairs = fuzzy_join(df, df).where("left_id < right_id").select(F.col("right_id").alias("a"), F.col("left_id").alias("b"))
    labels = _components(pairs)
    named = df.select("id").distinct().join(labels, "id", "left")
    return named.select("id", F.coalesce("root", "id").alias("canonical_id"))


def _components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ends of ``edges`` (a > b): stars are hung on least neighbours, above and below in turn,
    until nothing changes, in rounds that grow with the logarithm of the longest chain; each round is stored."""
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    current, state = materialize(edges.distinct(), "edges"), None
    while state != (state := mark(current)):
        both = current.union(current.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(below.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return current.select(F.col("a").alias("id"), F.col("b").alias("root"))


def apply_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical ids, names, rivers, states and places in place of the sources' own."""
    r = registry.select("source", "source_station_id", "canonical_id", *[f"best_{c}" for c in ("name", "river", "state", "latitude", "longitude")])
    joined = df.join(r, ["source", "source_station_id"], "left")
    to = {"station_id": "canonical_id", "station_name": "best_name", "river": "best_river", "state": "best_state", "latitude": "best_latitude", "longitude": "best_longitude"}
    found = F.col("canonical_id").isNotNull()
    joined = joined.select(*[c for c in df.columns if c not in to], *[F.when(found, F.col(b)).otherwise(F.col(c)).alias(c) for c, b in to.items() if c in df.columns])
    return joined.select(*df.columns)
