import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import entity, features, lookup, profile, quality, reshape, temporal, verdicts

D = dt.date(2024, 1, 1)
OBS = "station_name string, date date, parameter string, value double, source string, quality_flag string, trust_score double, _seq long"


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


@pytest.mark.parametrize(("n", "flagged"), [(19, 0), (20, 1), (21, 1)])
def test_outliers_need_twenty_rows(spark, n, flagged):
    rows = [("s", D, "bod", float(i % 7), "cpcb", "valid", 1.0, i) for i in range(n - 1)] + [("s", D, "bod", 1e5, "cpcb", "valid", 1.0, n)]
    out = quality.flag_outliers(obs(spark, rows)).where("quality_flag = 'suspect_outlier'").collect()
    assert len(out) == flagged and all(r.trust_score == 0.5 for r in out)


def test_positional_quartiles(spark):
    rows = [("s", D, "p", float(v), "x", "valid", 1.0, v) for v in range(1, 25)]
    found = quality.quartiles(obs(spark, rows)).first()
    ordered = list(range(1, 25))
    q1, q3 = ordered[24 // 4], ordered[3 * 24 // 4]
    assert (found.lower, found.upper) == (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))


def test_outliers_without_range(spark):
    rows = [("s", D, "p", 5.0, "x", "valid", 1.0, i) for i in range(30)] + [("s", D, "p", 9.0, "x", "valid", 1.0, 99)]
    assert quality.flag_outliers(obs(spark, rows)).where("quality_flag <> 'valid'").count() == 0


def test_consistency_takes_the_last_value_and_null_dates(spark):
    rows = [
        ("a", None, "bod", 1.0, "x", "valid", 1.0, 1), ("a", None, "bod", 9.0, "x", "valid", 1.0, 2), ("a", None, "cod", 4.0, "x", "valid", 1.0, 3),
        ("b", D, "bod", 8.0, "x", "valid", 1.0, 4), ("b", D, "cod", 4.0, "x", "valid", 1.0, 5),
        ("c", D, "tds", 1.0, "x", "valid", 1.0, 6), ("c", D, "conductivity", 0.0, "x", "valid", 1.0, 7),
    ]
    out = {r._seq: r for r in quality.flag_inconsistent(obs(spark, rows)).collect()}
    assert {k for k, r in out.items() if r.quality_flag == "suspect_consistency"} == {1, 2, 3}
    assert out[1].qc_notes == "BOD > 2*COD" and out[1].trust_score == pytest.approx(0.7)


def test_fusion(spark):
    rows = [
        ("WQ Patna", D, "bod", 10.0, "x", "suspect_outlier", 0.5, 1), ("patna", D, "bod", 9.5, "y", "valid", 0.9, 2), ("Patna.", D, "bod", 9.6, "z", "valid", 0.9, 3),
        ("q", None, "cod", 0.0, "x", "valid", 0.5, 4), ("q", None, "cod", 0.0, "y", "valid", 0.5, 5), ("r", D, "cod", 1.0, "x", "valid", 0.5, 6),
    ]
    out = {(r.parameter, r.date): r for r in quality.fuse(obs(spark, rows)).where("station_name <> 'r'").collect()}
    best = out["bod", D]
    assert (best._seq, best.all_sources, best.n_sources, best.trust_score) == (2, "x; y; z", 3, 1.0)
    assert out["cod", None]._seq == 4 and out["cod", None].trust_score == 0.5
    fused = quality.fuse(obs(spark, rows))
    assert quality.fuse(fused.drop("all_sources", "n_sources")).count() == fused.count() == 3


def test_fusion_does_not_depend_on_row_order(spark):
    rows = [("s", D, "bod", float(i), f"x{i % 3}", "valid", 0.5, i) for i in range(9)]
    a, b = (quality.fuse(obs(spark, r)).drop("_name").collect() for r in (rows, rows[::-1]))
    assert [x.asDict() for x in a] == [x.asDict() for x in b]


CANON = "station_id string, sample_date date, parameter string, value double, source string, quality_flag string, confidence double, notes string, _seq long"


def canon(spark, rows):
    return spark.createDataFrame([(s, D, p, v, src, flag, 1.0, "", i) for i, (s, p, v, src, flag) in enumerate(rows)], CANON)


def test_conflicts(spark):
    rows = [
        ("a", "bod", 10.0, "cpcb", "valid"), ("a", "bod", 12.0, "cwc", "valid"),
        ("b", "bod", 1.0, "cpcb", "valid"), ("b", "bod", 9.0, "unknown", "valid"), ("b", "bod", 5.0, "x", "rejected"),
        ("c", "bod", -1.0, "cpcb", "valid"), ("c", "bod", 1.0, "cwc", "valid"),
        ("d", "bod", 1.0, "x", "valid"), ("d", "bod", 2.0, "x", "valid"), ("e", "bod", 1.0, "x", "valid"),
        ("f", "bod", 8.0, "cpcb", "valid"), ("f", "bod", 12.0, "cwc", "valid"),
    ]
    out = {}
    for r in quality.resolve_conflicts(canon(spark, rows)).collect():
        out.setdefault(r.station_id, {})[r._seq] = (r.outcome, r.value, r.quality_flag, r.confidence)
    assert out["a"] == {0: ("agreed", 10.0, "valid", 1.0), 1: ("agreed", 12.0, "suspect_duplicate", 1.0)}
    assert out["b"] == {2: ("conflict", 1.0, "valid", 0.8), 3: ("conflict", 9.0, "suspect_consistency", 0.5)}
    assert {x[0] for x in out["c"].values()} == {"kept"} and len(out["c"]) == 2
    assert out["d"] == {7: ("averaged", 1.5, "valid", 1.0)} and out["e"][9][0] == "single"
    assert out["f"][10][0] == "agreed"  # exactly a fifth


def test_validation_order(spark):
    rows = [("a", "ph", 3.0, "x", "valid"), ("a", "ph", 15.0, "x", "valid"), ("a", "water_level", -5.0, "x", "valid"), ("a", "other", 5.0, "x", "valid"), ("a", "temperature", 3.0, "x", "valid")]
    out = [(r.quality_flag, r.confidence) for r in quality.validate(canon(spark, rows)).orderBy("_seq").collect()]
    assert out == [("suspect_range", 0.6), ("rejected", 1.0), ("rejected", 0.6), ("valid", 1.0), ("suspect_range", 0.6)]


def test_units(spark):
    df = spark.createDataFrame(
        [("t", 212.0, "°F"), ("bod", 5.0, "ug/l"), ("bod", 5.0, ""), ("bod", 5.0, "cups"), ("turbidity", 3.0, "JTU"), ("ph", 7.0, "units")], "parameter string, value double, unit string"
    ).withColumns({"source_value": F.lit(0.0), "source_unit": F.lit(""), "confidence": F.lit(1.0), "notes": F.lit("")})
    targets = spark.createDataFrame([("t", "°C"), ("bod", "mg/L"), ("turbidity", "NTU"), ("ph", "")], "parameter string, target_unit string")
    out = {(r.parameter, r.source_value, r.unit): (r.value, r.confidence) for r in quality.convert_units(df, targets).collect()}
    assert out["t", 212.0, "°C"] == (100.0, 1.0) and out["bod", 5.0, "mg/L"] == (0.005, 1.0) and out["bod", 0.0, "mg/L"] == (5.0, 1.0)
    assert out["bod", 0.0, "cups"] == (5.0, 0.7) and out["turbidity", 3.0, "NTU"] == (3.0, 0.85) and out["ph", 0.0, ""] == (7.0, 1.0)


def test_spatial_filter_keeps_missing_and_edges(spark):
    df = spark.createDataFrame([(21.0, 90.0), (None, 80.0), (31.6, 80.0), (25.0, 72.9)], "latitude double, longitude double")
    assert quality.spatial_filter(df).count() == 2


def test_pivot(spark):
    rows = [("s", D, "bod", 1.0, "x", "valid", 0.5, 1), ("s", D, "bod", 2.0, "y", "valid", 0.9, 2)]
    df = obs(spark, rows).withColumns(
        {"station_code": F.lit("c"), "year": F.lit(2024), "latitude": F.when(F.col("_seq") == 1, 0.0).otherwise(25.0), "longitude": F.lit(None).cast("double"), "state": F.lit(""), "all_sources": F.lit(None).cast("string")}
    )
    r = reshape.pivot_wide(df, ["bod", "cod"]).first()
    assert (r.bod, r.cod, r.latitude, r.longitude, r.state, r.n_params, r.min_trust, r.mean_trust, r.all_sources) == (2.0, None, 25.0, None, None, 2, 0.5, 0.7, "x; y")


def test_upsert_replaces_whole_rows(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, only int"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted((r.k, r.v, r.only) for r in reshape.upsert(old, new, ["k"]).collect()) == [(1, "a", 5), (2, "c", None), (3, "d", None)]


def test_sample(spark):
    df = spark.range(100)
    a, b = (sorted(r.id for r in reshape.exact_sample(df, "id", n=7).collect()) for _ in range(2))
    assert a == b and len(a) == 7 and reshape.exact_sample(df, "id", fraction=0.1, n=3).count() == 10
    with pytest.raises(ValueError, match="n or fraction"):
        reshape.exact_sample(df, "id")


def test_tiers(spark):
    readings = spark.createDataFrame([("s", D), ("t", D), ("u", D)], "key string, date date")
    day = lambda n: D + dt.timedelta(n)
    scenes = spark.createDataFrame(
        [("s", day(3), 19.0, 1.0), ("s", day(-3), 5.0, 3.0), ("s", day(1), 20.0, 9.0), ("t", day(-10), 59.0, 4.0), ("t", day(2), 60.0, 8.0), ("u", day(31), 1.0, 1.0)],
        "key string, scene_date date, cloud double, B1 double",
    )
    out = {r.key: (r.tier, r.scene_count, r.B1) for r in temporal.tiered_composite(readings, scenes, ["key"], ["B1"]).collect()}
    assert out == {"s": (0, 2, 2.0), "t": (1, 1, 4.0)}
    near = temporal.nearest_clear(readings, scenes, ["key"], tie="scene_date").collect()
    assert [(r.key, r.cloud) for r in near] == [("s", 5.0)]
    profiles = spark.createDataFrame([("u", [5, 40], [50.0, 50.0])], "key string, days array<int>, clouds array<double>")
    assert [(r.key, r.tier) for r in temporal.profiled_composite(readings, scenes, profiles, ["key"], ["B1"]).collect()] == [("u", 1)]


def test_west_to_east(spark):
    rows = [(1, "b", 5.0), (2, "a", 7.0), (3, "a", 6.0), (4, "b", 9.0), (5, "a", 6.0), (6, None, 5.5), (7, "a", None), (8, "c", None)]
    df = spark.createDataFrame(rows, "id int, region string, lon double").repartition(3)
    wanted = [1, 4, 6, 3, 5, 2, 7, 8]
    assert [r.id for r in reshape.west_to_east(df, ties=("id",)).collect()] == wanted
    placed = reshape.west_to_east_places(df, "place", ties=("id",))
    assert placed.columns == [*df.columns, "place"] and sorted((r.place, r.id) for r in placed.collect()) == list(enumerate(wanted))
    assert reshape.west_to_east_places(df.limit(0), "place").count() == 0


STATION = "source string, source_station_id string, station_name string, river string, state string, latitude double, longitude double, _seq long"


def test_registry(spark):
    rows = [
        ("a", "1", "Ganga at Patna", "Ganga", "Bihar", 25.0, 85.0, 1), ("a", "1", "x", "", "", 0.0, 0.0, 2), ("b", "9", "Ganga at Patna Ghat", "Ganga", "Bihar", 25.0005, 85.0, 3),
        ("c", "7", "Ganga at Patna", "", "", 0.0, 0.0, 4), ("d", "5", "Yamuna", "Yamuna", "Delhi", 28.0, 77.0, 5),
    ]
    df = spark.createDataFrame(rows, STATION)
    reg = {r.source: r for r in entity.station_registry(df).collect()}
    assert reg["a"].canonical_id == reg["b"].canonical_id == "WQ_00001" and reg["b"].best_name == "Ganga at Patna Ghat" and reg["a"].record_count == 3
    assert reg["c"].canonical_id == "WQ_00002" and reg["c"].best_latitude is None and reg["d"].canonical_id == "WQ_00003"
    applied = entity.apply_registry(df.withColumn("station_id", F.lit("?")), entity.station_registry(df))
    assert {r.station_id for r in applied.where("source = 'b'").collect()} == {"WQ_00001"}


def brute_registry(rows):
    """Source station -> (canonical id, name, river, state, mean place, records): every one compared with all canonical stations so far."""
    known, chosen = [], {}
    for source, sid, name, river, state, lat, lon, seq in sorted(rows, key=lambda r: r[-1]):
        name, lat, lon = name or "", *[None if v is None or math.isnan(v) else v for v in (lat, lon)]
        words, best, score = entity._comparable(name), None, 0.0
        for k, s in enumerate(known):
            near = 0.0
            if lat and lon and s["lats"] and s["lons"]:
                km = entity._km((lat, lon), (sum(s["lats"]) / len(s["lats"]), sum(s["lons"]) / len(s["lons"])))
                near = 1.0 if km <= 0.1 else max(0.0, 1 - km / 4)
            for other in map(entity._comparable, s["names"]):
                alike = len(words & other) / len(words | other) if words and other else 0.0
                if alike * 0.4 + near * 0.6 > score:
                    best, score = k, alike * 0.4 + near * 0.6
        if best is None or score < 0.7:
            best = len(known)
            known.append({"names": [], "lats": [], "lons": [], "rivers": [], "states": [], "n": 0})
        s = known[best]
        for held, value in (("names", name), ("lats", lat), ("lons", lon)):
            if value and value not in s[held]:
                s[held].append(value)
        s["rivers"] += [river] if river else []
        s["states"] += [state] if state else []
        s["n"] += 1
        chosen[source, sid] = best
    mode = lambda v: min(set(v), key=lambda x: (-v.count(x), x)) if v else ""
    mean = lambda v: sum(v) / len(v) if v else None
    out = [(f"WQ_{i + 1:05d}", max(s["names"], key=len, default=""), mode(s["rivers"]), mode(s["states"]), mean(s["lats"]), mean(s["lons"]), s["n"]) for i, s in enumerate(known)]
    return sorted((source, sid, *out[k]) for (source, sid), k in chosen.items())


@pytest.mark.parametrize("border", [False, True])
def test_registry_beyond_one_task(spark, border):
    """Towns, chains of drifting means, copies, stations without a place; with ``border`` some across the date line, whose means lie elsewhere."""
    random.seed(11)
    towns = [(random.uniform(20, 30), random.uniform(70, 90)) for _ in range(12)] + [(10.0, 0.03), (-33.0, -70.0)]
    rows = []
    for i in range(700):
        lat, lon = random.choice(towns)
        lat, lon = lat + random.choice([0.0, random.uniform(-0.06, 0.06)]), lon + random.choice([0.0, 0.001, random.uniform(-0.06, 0.06)])
        if border and i % 9 == 0:
            lat, lon = 10 + random.uniform(-0.01, 0.01), random.choice([-1, 1]) * random.uniform(179.99, 180)
        if i % 31 == 0:
            lat, lon = random.choice([(None, lon), (lat, 0.0), (float("nan"), lon), (None, None)])
        name = random.choice(["Ganga at Patna", "Ganga at Gaya", "Patna", "Ganga Ghat Patna", "Yamuna", "WQ Station", "", None])
        rows.append((f"s{i % 3}", str(i), name, random.choice(["Ganga", "Yamuna", "", None]), random.choice(["Bihar", "Delhi", None]), lat, lon, (i * 389) % 701))
    df = spark.createDataFrame(rows, STATION).repartition(3)
    wanted = brute_registry(rows)
    assert 20 < len({r[2] for r in wanted}) < 650
    for most in (50_000, 100):
        assert sorted(tuple(r) for r in entity.station_registry(df, most).collect()) == wanted


def test_registry_deals_apart_what_cannot_meet(spark):
    rows = [(i, 20 + i % 5 * 0.03, 80 + i // 5 * 0.5) for i in range(50)] + [(i, None, None) for i in range(50, 60)]
    reps = spark.createDataFrame(rows, "place long, latitude double, longitude double")
    groups = {r.place: r._group for r in entity._split(reps, 1_000_000_007).collect()}
    assert all(len({groups[5 * k + j] for j in range(5)}) == 1 for k in range(10)) and len(set(groups.values())) == 20


def test_grid_registry(spark):
    df = spark.createDataFrame([(1, "a b", 25.0, 85.0), (2, "a b", 25.001, 85.0), (3, "a b", 26.0, 85.0)], "id long, name string, lat double, lon double")
    assert sorted(tuple(r) for r in entity.grid_registry(df).collect()) == [(1, 1), (2, 1), (3, 3)]


NAMED = "id long, name string, lat double, lon double"


def brute_pairs(left, right, least):
    """Ids of all pairs that score ``least``."""
    found = []
    for i, a, *p in left:
        for j, b, *q in right:
            if a is None or b is None or not all(v and math.isfinite(v) for v in (*p, *q)):
                continue
            x, y, km = set(a.split()), set(b.split()), entity._km(p, q)
            alike, near = len(x & y) / len(x | y) if x and y else 0.0, 1.0 if km <= 0.1 else max(0.0, 1 - km / 4)
            if alike * 0.4 + near * 0.6 >= least:
                found.append((i, j))
    return sorted(found)


@pytest.mark.parametrize("least", [0.41, 0.55, 0.7, 0.95])
def test_fuzzy_join_finds_all_pairs(spark, least):
    """Places around a town, the date line, the equator and a pole, copies among them."""
    random.seed(5)
    odd = [("a b", None, 1.0), (None, 25.0, 85.0), ("a b", 0.0, 85.0), ("a b", float("nan"), 85.0), ("a b", 25.0, float("inf")), ("", 25.0, 85.0)]

    def some(first):
        rows = []
        for lat, lon, wide in ((25.0, 85.0, 0.02), (10.0, 180.0, 0.02), (0.0, -60.0, 0.02), (89.99, 0.0, 180.0)):
            for _ in range(40):
                x = lon + random.uniform(-wide, wide)
                rows.append((random.choice(["a b", "a c", "b a c", "d"]), min(90.0, lat + random.uniform(-0.02, 0.02)), x - 360 if x > 180 else x))
        return [(first + i, *r) for i, r in enumerate(rows + rows[::5] + [("a b", 25.0, 85.0)] + odd)]

    left, right = some(0), some(1000)
    out = entity.fuzzy_join(spark.createDataFrame(left, NAMED), spark.createDataFrame(right, NAMED), least).collect()
    assert sorted((r.left_id, r.right_id) for r in out) == brute_pairs(left, right, least)


def test_fuzzy_join_compares_copies_once(spark):
    """30,000 and 30,000 stations at forty near places: only the places are compared, not 900 million pairs."""
    rows = spark.range(60_000).withColumn("at", F.col("id") % 40)
    name = F.concat(F.lit("n"), F.when(F.col("id") == 59_999, 2).otherwise(F.col("at")))
    rows = rows.select("id", name.alias("name"), (25 + F.col("at") * 0.0001).alias("lat"), F.lit(85.0).alias("lon"))
    out = entity.fuzzy_join(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).collect()
    assert sorted((r.left_id, r.right_id) for r in out) == [(i, 59_999) for i in range(2, 60_000, 40)]


def test_lookup_fills_only_empty_and_last_wins(spark):
    df = spark.createDataFrame([("1.0", ""), ("2", "own"), ("9", None)], "station_id string, state string")
    st = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "other", 3)], "station_id int, state string, _seq int")
    assert {r.station_id: r.state for r in lookup.station_lookup(df, st).collect()} == {"1.0": "new", "2": "own", "9": None}
    assert [r.station_id for r in lookup.lookup_misses(df, st).collect()] == ["9"]
    with pytest.raises(ValueError, match="missing"):
        lookup.require(df, ["zz"])


def test_cleaning_and_imputation(spark):
    df = spark.createDataFrame([(1, -999.0, 1.0), (2, float("nan"), 2.0), (3, 3.0, None)], "i int, a double, b double")
    assert [r.a for r in features.sentinels_to_null(df, ["a"]).orderBy("i").collect()] == [None, None, 3.0]
    rows = [(i, float(i), float(2 * i)) for i in range(20)] + [(99, 4.0, None)]
    filled = features.knn_impute(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"], k=3).where("i = 99").first()
    assert filled.b == pytest.approx(8.0)


def brute_impute(rows, k):
    """Mean of the k nearest by nan-euclidean distance, ties by value; without any the column's mean."""
    width, out = len(rows[0]), []
    for r in rows:
        done = list(r)
        for c in [c for c in range(width) if r[c] is None]:
            able = []
            for g in rows:
                both = [i for i in range(width) if r[i] is not None and g[i] is not None]
                if g[c] is not None and both:
                    able.append((sum((r[i] - g[i]) ** 2 for i in both) * width / len(both), g[c]))
            near = [v for _, v in sorted(able)[:k]] or [g[c] for g in rows if g[c] is not None]
            done[c] = sum(near) / len(near)
        out.append(done)
    return out


def test_imputation_compares_with_all_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "QUERIES", 16)
    monkeypatch.setattr(features, "PAIRS", 64)
    random.seed(17)
    value = lambda: random.choice([None, float(random.randint(0, 9)), random.random() * 50])
    rows = [[value() for _ in range(4)] for _ in range(150)] + [[None] * 4, [None, None, None, 7.0]] + [[3.0, 3.0, 3.0, 3.0]] * 9
    df = spark.createDataFrame([(i, f"s{i}", D, *r) for i, r in enumerate(rows)], "i int, s string, day date, a double, b double, c double, d double")
    filled = features.knn_impute(df, ["a", "b", "c", "d"], donors=20)
    assert filled.columns == df.columns
    out = {r.i: r for r in filled.collect()}
    assert len(out) == len(rows) and all((r.s, r.day) == (f"s{i}", D) for i, r in out.items())
    for i, r in enumerate(brute_impute(rows, 5)):
        assert [out[i].a, out[i].b, out[i].c, out[i].d] == pytest.approx(r)


def test_imputation_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, None, 4.0)], "i int, a double, b double")
    assert sorted((r.i, r.a, r.b) for r in features.knn_impute(df, ["a", "b"]).collect()) == [(1, None, 4.0), (2, None, 4.0)]
    assert features.knn_impute(df.limit(0), ["a", "b"]).count() == 0


def test_ensemble_interval(spark):
    r = spark.createDataFrame([([float(i) for i in range(101)],)], "p array<double>").select(features.ensemble_interval(F.col("p")).alias("x")).first().x
    assert (r.low, r.high) == (5.0, 95.0)


def test_folds_balance(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 2)) for _ in range(n)], "g string")
    assert {r.g: r.fold for r in features.group_folds(df, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_rank_correlation_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0), (None, 9.0)], "a double, b double")
    r = profile.rank_correlation(df, "a", "b").first()
    assert r.n == 4 and r.rho == pytest.approx(0.9486832980505138)


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "suspect_range", 0.6), (2, "suspect_outlier", 0.5), (3, "valid", 1.0)], "_seq long, quality_flag string, confidence double")
    assert verdicts.suspects(df, 1).first()._seq == 1
    v = spark.createDataFrame([(1, "valid", 0.9), (2, "reject", 0.8)], "_seq long, verdict string, certainty double")
    out = {r._seq: (r.quality_flag, round(r.confidence, 3)) for r in verdicts.apply_verdicts(df, v).collect()}
    assert out == {1: ("valid", 0.9), 2: ("rejected", 0.2), 3: ("valid", 1.0)}
    assert verdicts.reply_map('```json\n{"a": "bod"}\n```') == {"a": "bod"} and verdicts.reply_map("no") == {}
    names = spark.createDataFrame([("a",), ("a",), (None,)], "n string")
    assert [tuple(r) for r in verdicts.map_names(names, "n", lambda found: '{"a": "bod"}').collect()] == [("a", "bod")]
    assert [tuple(r) for r in verdicts.map_names(names, "n").collect()] == [("a", None)]


def test_empty_inputs(spark):
    empty = obs(spark, [])
    for f in (quality.flag_outliers, quality.flag_inconsistent, quality.fuse, quality.range_check):
        assert f(empty).count() == 0
    assert quality.resolve_conflicts(canon(spark, [])).count() == 0
    assert entity.station_registry(spark.createDataFrame([], STATION)).count() == 0
