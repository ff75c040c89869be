"""Brute force, round trips and edge cases of the operators on documents."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import components, decontamination, fingerprints, line_dedup, mixing, ngram_join, quality, sharding, token_counts
from gaugeflow.llm.runtime import prepare, scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


ODD = [None, "", " \n\t", "a", "A b\x0bc", "Ünï çödé ßÜ ﷽ 漢字 词", "x" * 5000, "w " * 3000, "a", None, "Ab\tb\r\nC", "é" * 3]


# --- words ----------------------------------------------------------------------


def test_words_agree_with_regex():
    import numpy as np
    import pyarrow as pa

    from gaugeflow.llm import words as W

    texts = [t or "" for t in ODD] + ["q" * (W.SEGMENT + 7) + " end", "a b " * (W.SEGMENT // 3)]
    for table, pattern in ((W.NOT_SPACE, WORD), (W.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        found = W.Words(*W.column_bytes(pa.array(texts)), table)
        seen = {}
        for r, t in enumerate(texts):
            expected = pattern.findall(lower(t))
            hashes = found.hash[found.first[r] : found.first[r + 1]].tolist()
            assert len(hashes) == len(expected)
            for word, value in zip(expected, hashes):
                assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)
    assert found.first.dtype == np.int64


# --- 1 ---------------------------------------------------------------------------


def test_shards(spark, tmp_path):
    random.seed(1)
    texts = ["hot"] * 300 + ["w" * random.randint(0, 400) for _ in range(600)] + ODD
    out = sharding.shard(docs(spark, texts), 5, map_path=str(tmp_path / "map")).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    total = [0] * 5
    places = {}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        total[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(total) <= 1.02 * sum(total) / 5 and all(sorted(p) == list(range(len(p))) for p in places.values())
    stored = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert stored.version == 1 and all(stored.owner[r.virtual_slot] == r.shard for r in out)
    groups = {}
    for r in out:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(groups["a"]) == 1 and len(groups[""]) == 1


def test_slot_map_moves_little():
    before = sharding.SlotMap.initial(1000, 10)
    weight = {s: 100 for s in range(1000)} | {0: 500}
    after = before.rebalanced(weight)
    assert sum(a != b for a, b in zip(before.owner, after.owner)) <= 8
    grown = after.grown()
    assert all(b in (a, 10) for a, b in zip(after.owner, grown.owner)) and 80 <= grown.owner.count(10) <= 100


def test_hot_groups_are_dealt_out(spark):
    rows = [(None, "same text", "en", "s", None)] * 900 + [(i, "", "en", "s", None) for i in range(900)] + [(i, f"text {i} " * 20, "en", "s", None) for i in range(1000, 1900)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "content": F.lit(1), "part": F.lit(2), "record": F.lit(3)})
    out = sharding.shard(df, 4).collect()
    total, places = [0] * 4, {}
    for r in out:
        total[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 2700 and max(total) <= 1.02 * sum(total) / 4
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    for empty in (True, False):
        hot = [r.virtual_slot for r in out if (r.size == 16) == empty and r.size < 40]
        assert len(hot) == 900 and max(hot.count(v) for v in set(hot)) <= 10


def test_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    first = docs(spark, [f"{i} " * (i % 50) for i in range(800)])
    sharding.shard(first, 4, slots=64, map_path=path)
    before = sharding.SlotMap.load(spark, path)
    grown = first.union(docs(spark, ["new " * 400] * 2))
    out = sharding.shard(grown, 4, slots=64, map_path=path).collect()
    after = sharding.SlotMap.load(spark, path)
    assert (before.version, after.version) == (1, 2) and {r.map_version for r in out} == {2}
    assert 0 < sum(a != b for a, b in zip(before.owner, after.owner)) < 20
    assert sharding.SlotMap.load(spark, path, 1).owner == before.owner
    with pytest.raises(ValueError, match="shards"):
        sharding.shard(grown, 5, slots=64, map_path=path)


def test_shards_of_nothing(spark):
    assert sharding.shard(docs(spark, []), 3).count() == 0


# --- 2 ---------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE_CHARS", 8)  # segments have several pieces
    random.seed(3)
    base = ["".join(random.choice("abé ") for _ in range(random.randint(20, 40))) for _ in range(12)] + ["z" * 20, "z" * 21, "y" * 700]
    def edited(s):
        i = random.randrange(len(s))
        return random.choice([s[:i] + s[i + 1 :], s[:i] + "X" + s[i:], s[:i] + "Q" + s[i + 1 :], s, s[:i] + "QQ" + s[i + 2 :]])
    texts = ["\n".join(random.choice([edited(random.choice(base)), "short", ""]) for _ in range(random.randint(0, 8))) for _ in range(40)] + [None, ""]
    seen, expected = [], []
    for t in texts:
        kept = []
        for line in t.split("\n") if t is not None else []:
            if len(line) < 20 or not any(abs(len(line) - len(s)) < 2 and edit_distance(line, s) <= 1 for s in seen):
                kept.append(line)
            if len(line) >= 20:
                seen.append(line)
        expected.append(None if t is None else "\n".join(kept))
    out = {r.doc_id: r.text for r in line_dedup.dedupe_lines(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == expected


def test_line_dedup_keeps_columns(spark):
    df = docs(spark, ["a" * 30, "a" * 30]).withColumns({"line": F.lit(1), "id": F.lit(2), "place": F.lit(3)})
    out = line_dedup.dedupe_lines(df).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a" * 30, ""] and out[0].place == 3 and out[1]["__kept"] == 0
    assert line_dedup.dedupe_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_short_lines(spark):
    long = "a" * 30
    df = docs(spark, ["Menu\n\nHome\n" + long, None, "Home\nMenu\nMenu \n \n" + long, "\nHome\n \nHomes"])
    out = {r.doc_id: (r.text, r["__lines"], r["__kept"]) for r in line_dedup.dedupe_lines(df, exact_short=True).collect()}
    assert out == {0: ("Menu\n\nHome\n" + long, 4, 4), 1: (None, 0, 0), 2: ("Menu \n ", 5, 2), 3: ("\n \nHomes", 4, 3)}
    assert line_dedup.dedupe_lines(docs(spark, []), exact_short=True).count() == 0


def test_line_dedup_of_repeated_ids(spark):
    line, other = "the same long line of text", "quite another long line of it"
    rows = [(1, line), (2, line), (2, other), (7, line), (7, line), (3, "x" * 30), (3, "x" * 30), (None, other), (None, "y" * 30), (None, "y" * 30), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).withColumn("__kept", F.lit("clash"))
    out = line_dedup.dedupe_lines(df)
    assert out.columns == [*DOCS.replace(",", "").split()[::2], "__lines", "__kept"]
    found = sorted(((r.doc_id, r.text, r["__kept"]) for r in out.collect()), key=repr)
    expected = [(1, line, 1), (2, "", 0), (2, other, 1), (7, "", 0), (7, "", 0), (3, "x" * 30, 1), (3, "", 0), (None, "", 0), (None, "y" * 30, 1), (None, "", 0), (4, None, 0), (4, None, 0), (5, "", 1)]
    assert found == sorted(expected, key=repr)
    assert line_dedup.dedupe_lines(out).columns == out.columns


def test_line_dedup_of_very_many_lines(spark):
    lines = [hashlib.md5(str(i).encode()).hexdigest() for i in range(200_000)]
    out = line_dedup.dedupe_lines(docs(spark, ["\n".join(lines + lines[:5]), lines[7]]).coalesce(1), exact_short=True)
    assert {r.doc_id: (r["__lines"], r["__kept"]) for r in out.collect()} == {0: (200_005, 200_000), 1: (1, 0)}


# --- 3 ---------------------------------------------------------------------------


def test_rollup(spark, tmp_path):
    tokenizers = {"words/1": token_counts.words()}
    df = docs(spark, ["a b", None, "", "c c c"], ["x", "x", None, "y"]).select("source", "lang", "text")
    counts = token_counts.counted(df, tokenizers)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    read = lambda: {r.source: (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert read() == {}
    assert rollup.commit("one", token_counts.inserts(counts)) and not rollup.commit("one", token_counts.inserts(counts))
    assert read() == {"x": (2, 2), None: (1, 0), "y": (1, 3)}
    rollup.compact()
    assert read() == {"x": (2, 2), None: (1, 0), "y": (1, 3)} and not rollup.commit("one", token_counts.inserts(counts))
    rollup.commit("two", token_counts.deletes(counts.where("source = 'y'")))
    revised = counts.where("source = 'x' AND tokens > 0").withColumns({"old": F.col("tokens"), "new": F.lit(9)})
    rollup.commit("three", token_counts.revisions(revised, "old", "new"))
    assert read() == {"x": (2, 9), None: (1, 0)}
    rollup.compact()
    assert read() == {"x": (2, 9), None: (1, 0)}
    with pytest.raises(ValueError, match="name"):
        rollup.commit("../x", token_counts.inserts(counts))


def test_token_report(spark):
    df = docs(spark, ["one two", "one two", "", None, "three"])
    out = {r.tokenizer: (r.documents, r.tokens) for r in token_counts.report(df, scratch_path(spark, "t")).collect()}
    assert out["words/1"] == (3, 3) and out["byte_bpe_50k/1"][0] == 3 and out["byte_bpe_50k/1"][1] >= 3
    assert token_counts.report(docs(spark, []), scratch_path(spark, "t")).count() == 0


def test_token_report_counts_a_text_once(spark):
    import base64
    import tiktoken

    rows = [(1, "one two", "a"), (1, "one two", "b"), (2, "one two", "c"), (None, "one two", "c"), (None, "three", "x"), (None, "three", "y"), (None, "three", None), (5, "w " * 20_000, "c"), (6, None, "d"), (7, "", "d")]
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)
    out = {(r.source, r.tokenizer): (r.documents, r.tokens) for r in token_counts.report(df, scratch_path(spark, "t")).collect()}
    lines = (line.split() for line in open(token_counts.VOCABULARY, "rb").read().splitlines() if line)
    encode = tiktoken.Encoding("v", pat_str=token_counts.PIECES, mergeable_ranks={base64.b64decode(t): int(r) for t, r in lines}, special_tokens={}).encode_ordinary
    expected = {}
    for source, text in (("a", "one two"), (None, "three"), ("c", "w " * 20_000), ("d", "")):
        for name, n in (("words/1", len(WORD.findall(text))), ("byte_bpe_50k/1", len(encode(text)))):
            d, t = expected.get((source, name), (0, 0))
            expected[source, name] = d + 1, t + n
    # of nulls the one without a source comes last
    expected = {("x" if s is None else s, n): v for (s, n), v in expected.items()}
    assert out == expected


# --- 4 ---------------------------------------------------------------------------


def contaminated(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = [(i, w[k : k + min(10, len(w))]) for i, t in items for w in [split(t)] if w for k in range(len(w) - min(10, len(w)) + 1)]
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(i)} if i is not None else set()
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_brute_force(spark, block_bytes):
    random.seed(5)
    word = lambda: random.choice(["a", "b", "Cd", "é1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 10, 25, 9, 3, 1, 0, 11])] + [(9, None), (None, "n0 n1 n2")]
    items[5] = (5, "solo")
    texts = ODD + [" ".join(word() for _ in range(random.randint(0, 60))) for _ in range(60)]
    texts += [f"xx {items[2][1].upper()}! yy", items[2][1][:-6], "SOLO.", "n0-n1,n2", items[0][1] + " " + items[0][1]]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: tuple(r)[1:] for r in decontamination.report(docs(spark, texts), table, block_bytes=block_bytes).collect()}
    assert [out[i] for i in range(len(texts))] == contaminated(texts, items)


@pytest.mark.parametrize("n", range(1, 10))
def test_decontamination_of_few_words(spark, n):
    words = "a b c d e f g h i j k l".split()
    for texts, items in (([" ".join(words[:n])], [(1, " ".join(words)), (2, "b c")]), ([" ".join(words)], [(1, " ".join(words[:n]))])):
        table = spark.createDataFrame(items, "item_id long, text string")
        out = [tuple(r)[1:] for r in decontamination.report(docs(spark, texts).coalesce(1), table).collect()]
        assert out == contaminated(texts, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_phrase_of_many_items(spark, block_bytes):
    phrase = " ".join(f"p{i}" for i in range(30))
    items = spark.createDataFrame([(i, phrase) for i in range(5000)] + [(5000 + i, "two words") for i in range(1000)], "item_id long, text string")
    texts = [f"x {phrase} y"] * 50 + ["two words", "clean text of no item", None]
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.report(docs(spark, texts), items, block_bytes=block_bytes * 100).collect()}
    assert out == {i: (32, 30, 5000) for i in range(50)} | {50: (2, 2, 1000), 51: (5, 0, 0), 52: (0, 0, 0)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_decontamination_keeps_clashing_columns(spark, block_bytes):
    items = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    df = docs(spark, ["so bad words here", "good", None, "", "good"]).withColumns({"__hit_from": F.lit(1), "k1": F.lit("k"), "t": F.lit(2)})
    out = decontamination.decontaminate(df, items, block_bytes=block_bytes)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4]
    assert decontamination.find_hits(df, items, block_bytes=block_bytes).where("__hit_from IS NOT NULL").count() == 1
    assert decontamination.report(docs(spark, []), items, block_bytes=block_bytes).count() == 0


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, ["a b", None]).withColumn("n_words", F.lit(1))
    assert decontamination.decontaminate(df, none).count() == 2
    assert decontamination.report(docs(spark, []), none).count() == 0


# --- 5 ---------------------------------------------------------------------------


def similar_components(texts, words, percent):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, n):
    random.seed(seed)
    texts = []
    for _ in range(n):
        base = [f"w{random.randrange(10**6)}" for _ in range(random.choice([1, 2, 3, 5, 8, 12, 20, 45, 130, 260]))]
        for _ in range(random.randint(1, 5)):
            t = list(base)
            for _ in range(random.randint(0, max(1, len(t) // 20))):
                t[random.randrange(len(t))] = f"e{random.randrange(10**6)}"
            texts.append(" ".join(t[: random.choice([len(t), len(t), max(1, len(t) - 3)])]))
    return texts


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_join_brute_force(spark, words, percent):
    texts = ODD + near_copies(words, 60)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs(spark, texts), words=words, percent=percent).collect()}
    assert [out[i] for i in range(len(texts))] == similar_components(texts, words, percent)


def test_join_in_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "UNIT", 5)
    texts = near_copies(11, 25) + [" ".join(f"c{i}" if i != k else "x" for i in range(120)) for k in range(40)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs(spark, texts), words=4, percent=85).collect()}
    assert [out[i] for i in range(len(texts))] == similar_components(texts, 4, 85)


def test_join_of_many_near_copies(spark, monkeypatch):
    """Near copies of one text, chains of texts that are only similar to the next, and pieces of a pivot."""
    monkeypatch.setattr(ngram_join, "PIECE", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    random.seed(29)
    base = [f"b{i}" for i in range(200)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 200, 3)]
    chain = [" ".join(f"c{i}" for i in range(k * 8, k * 8 + 160)) for k in range(25)]
    texts = near + chain + near_copies(31, 20)
    random.shuffle(texts)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs(spark, texts), words=4, percent=85).collect()}
    assert [out[i] for i in range(len(texts))] == similar_components(texts, 4, 85)


def test_bands_cover_all_similar_sizes():
    for percent in (80, 85):
        for y in range(1, 3000):
            x = -(-percent * y // 100)
            assert set(ngram_join.bands_of(x, percent)) & set(ngram_join.bands_of(y, percent))


@pytest.mark.parametrize(("percent", "common", "others"), [(80, 17, (2, 2)), (85, 23, (2, 2))])
def test_similar_sets_share_what_they_need(percent, common, others):
    import numpy as np

    rng = np.random.default_rng(19)
    band = max(set(ngram_join.bands_of(common + others[0], percent)) & set(ngram_join.bands_of(common + others[1], percent)), key=lambda b: b.k)
    assert 100 * common >= percent * (common + sum(others))
    sparse = 0
    for _ in range(8000):
        values = rng.integers(0, 1 << 64, common + sum(others), np.uint64)
        a, b = np.sort(values[: common + others[0]]), np.sort(np.concatenate([values[:common], values[common + others[0] :]]))
        (x, need_x), (y, need_y) = (band.signatures(v, ngram_join._sums(v)) for v in (a, b))
        sparse += len(x) != len(y)
        assert len(np.intersect1d(x, y)) >= max(need_x, need_y) >= 1
    assert sparse


def test_keep_first(spark):
    clash = {c: F.lit("k") for c in ("class", "n", "__kept", "__rows", "__class", "component", "c0")}
    df = docs(spark, ["a b c d e f", "a b c d e f", None, "", "z"]).withColumns(clash)
    assert ngram_join.keep_first(df).columns == df.columns
    df = df.union(df.where("doc_id = 0")).union(df.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id for r in ngram_join.keep_first(df).collect()), key=str) == [0, 2, 3, 4, None]
    assert ngram_join.keep_first(docs(spark, [])).count() == 0


def test_keep_first_of_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [
        (1, text("a")), (1, text("b")), (2, text("a")), (3, text("c")), (4, text("c")), (4, text("d")), (5, ""), (5, None), (6, text("e")), (6, text("e")),
        (7, text("f")), (7, text("f") + " end"), (8, text("c")), (8, ""), (None, text("a")), (9, text("g")),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    out = [(r.doc_id, r.text) for r in ngram_join.keep_first(df).collect()]
    seven = [t for i, t in out if i == 7]
    assert len(seven) == 1 and seven[0] in (text("f"), text("f") + " end")
    expected = [(1, text("a")), (1, text("b")), (3, text("c")), (4, text("d")), (5, ""), (5, None), (6, text("e")), (7, seven[0]), (8, ""), (9, text("g")), (None, text("a"))]
    assert sorted(out, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_components(spark, local_edges):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (50, 50), (None, 3)] + [(200, 300 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "x long, y long")
    out = {r.node: r.component for r in components.connected_components(df, local_edges).collect()}
    assert out == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100} | {200: 200} | {300 + i: 200 for i in range(40)}
    assert components.connected_components(df.limit(0), local_edges).count() == 0


# --- 6 ---------------------------------------------------------------------------


def test_quality_held_out(spark):
    random.seed(7)
    good = [" ".join(random.choice(["the", "river", "flows", "to", "sea", "and", "back"]) + random.choice(["", "", "."]) for _ in range(random.randint(5, 80))) for _ in range(400)]
    bad = [random.choice([("SPAM!! " * random.randint(5, 50)), " | ".join("ab" for _ in range(random.randint(5, 60))), "$$$ x### " * random.randint(3, 30)]) for _ in range(80)]
    texts = [*good, *bad, "", None]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(480)] + [(9999, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.report(df, labels).collect()}
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(i < 400, r.predicted) for i, r in out.items() if r.held_out and i < 480]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = quality.keep_good(df, quality.train(df, labels)).columns
    assert kept == df.columns


def test_quality_scales_by_all_texts(spark):
    import numpy as np
    import pyarrow as pa

    texts = [*ODD, *(f"word {i} " * (i % 40) + "X" * (i % 7) for i in range(300))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    model = quality.train(docs(spark, texts).repartition(3), labels, unlabelled=10)
    seen = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    x = quality.features(*quality.column_bytes(pa.array(seen, pa.string()))).astype(float)
    assert np.allclose(model.mean, x.mean(0), atol=1e-5) and np.allclose(model.scale, 1 / np.maximum(x.std(0), 1e-4), rtol=1e-3)


def plain_features(text):
    """The statistics of one text, counted in plain Python."""
    import math

    raw = text.encode()
    words = [w.encode() for w in WORD.findall(lower(text))]
    n, size = max(1, len(words)), max(1, len(raw))
    upper, low = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    spaces = sum(b == 32 or 9 <= b <= 13 for b in raw)
    count = {w: words.count(w) for w in set(words)}
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    shape = [
        math.log1p(len(words)), math.log1p((size - spaces) / n), len(count) / n, max(count.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(threes)) / len(threes) if threes else 0, upper / max(1, upper + low), math.log1p(sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / n),
        sum(48 <= b <= 57 for b in raw) / size, raw.count(10) / n, sum(b >= 128 for b in raw) / size, (upper + low) / size,
    ]
    return shape + [math.sqrt(raw.count(b) / size) for b in range(256)]


def test_quality_features_by_counting():
    import numpy as np
    import pyarrow as pa

    texts = [t or "" for t in ODD] + ["A b a b a B. 12\n\nx!", "same same same", "é" * 700_000 + " end"]
    found = quality.features(*quality.column_bytes(pa.array(texts)))
    assert np.allclose(found, [plain_features(t) for t in texts], atol=1e-5)


def test_quality_risk_is_least(spark):
    """The fitted risk against the definition, and against shifted weights."""
    import math

    import numpy as np
    import pyarrow as pa

    random.seed(23)
    texts = [" ".join(random.choice(["river", "sea", "X!!"] if i % 4 == 0 else ["river", "sea", "land"]) for _ in range(random.randint(1, 30))) for i in range(300)]
    x = quality.features(*quality.column_bytes(pa.array(texts))).astype(float)
    p, u = x[[i for i in range(300) if i % 4]][:100], np.random.default_rng(4).permutation(x)
    model = quality.fit(p.astype(np.float32), u.astype(np.float32), 0.75, x.mean(0), x.std(0), decay=0.0)
    z = lambda rows: np.clip((rows - model.mean) * model.scale, -6, 6)

    def risk(weight, bias):
        loss = lambda rows, sign: sum(math.log1p(math.exp(-sign * (sum(a * w for a, w in zip(r, weight)) + bias))) for r in z(rows)) / len(rows)
        return 0.75 * loss(p, 1) + max(0.0, loss(u, -1) - 0.75 * loss(p, -1))

    best = risk(model.weight, model.bias)
    assert abs(best - model.risk) < 0.02
    rng = np.random.default_rng(2)
    assert all(best < risk(model.weight + rng.normal(0, 1, len(model.weight)), model.bias) for _ in range(5)) and best < risk(model.weight * 0, 0.0)
    assert abs(quality.estimated_prior(p.astype(np.float32), u.astype(np.float32), x.mean(0), x.std(0)) - 0.75) < 0.15


def test_quality_of_one_sided_labels(spark):
    df = docs(spark, ["good text here", None, "", "bad"] * 20)
    zeros = spark.createDataFrame([(i, 0) for i in range(80)], "doc_id long, quality int")
    out = quality.report(df, zeros).collect()
    assert {(r.score, r.predicted) for r in out} == {(0.0, 0)} and quality.keep_good(df, quality.train(df, zeros)).count() == 0
    foreign = spark.createDataFrame([(i, 1) for i in range(1000, 1100)], "doc_id long, quality int")
    assert {r.score for r in quality.report(df, foreign).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.report(df, ones).collect())
    repeated = df.union(df.where("doc_id = 0")).union(df.where("doc_id = 3").withColumn("text", F.lit("another"))).withColumn("__score", F.lit("clash"))
    kept = quality.keep_good(repeated, quality.train(repeated, ones, positives=10, unlabelled=20))
    assert kept.columns == repeated.columns and {r["__score"] for r in kept.collect()} <= {"clash"}
    assert quality.keep_good(repeated, 0.5).count() == 82


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.report(docs(spark, ["a", None]), none).collect()} == {0.5}
    assert quality.report(docs(spark, []), none).count() == 0


# --- 8 ---------------------------------------------------------------------------


def test_fingerprints_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 300)
    random.seed(9)
    texts = ODD + ["".join(random.choice("abcdé ") for _ in range(random.randint(0, 90))) for _ in range(60)]
    df = docs(spark, texts).where("doc_id <> 5")
    ids = [i for i in range(len(texts)) if i != 5]
    out = {r.doc_id: r for r in fingerprints.report(df).collect()}
    assert sorted(out) == ids
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, n, r = texts[i] or "", texts[j] or "", out[i]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        like = lambda a, b: float(fingerprints.likeness(fingerprints.from_text(a), fingerprints.from_text(b))[0])
        assert r.near_next == like(r.fingerprint, out[j].fingerprint) and r.near_edited == like(r.fingerprint, r.edited_fingerprint)
    assert len({out[i].fingerprint for i in ids if texts[i] == "a"}) == 1
    single = fingerprints.fingerprint(docs(spark, ["abc abc", None])).orderBy("doc_id").collect()
    assert single[1].fingerprint == out[1].fingerprint and fingerprints.report(docs(spark, [])).count() == 0


def plain_digest(text):
    """The digest of a text by counting triplets one by one."""
    raw, counts = text.encode(), [0] * fingerprints.BUCKETS
    for x, y, z in zip(raw, raw[1:], raw[2:]):
        counts[fingerprints._TABLES[0][x] ^ fingerprints._TABLES[1][y] ^ fingerprints._TABLES[2][z]] += 1
    ordered = sorted(counts)
    quartile = [ordered[fingerprints.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    code = [sum(c > q for q in quartile) for c in counts]
    length = 0
    while 1.1**length < len(raw) + 1 - 1e-9:
        length += 1
    return code, min(255, length)


def test_digests_by_counting(spark):
    random.seed(21)
    texts = [t or "" for t in ODD] + ["".join(random.choice("abc déf\n") for _ in range(random.randint(0, 3000))) for _ in range(20)]
    out = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        code, length = plain_digest(t)
        bits = "".join(f"{c:02b}" for c in code)
        assert out[i] == f"{length:02x}" + "".join(f"{int(bits[k : k + 8], 2):02x}" for k in range(0, len(bits), 8))
    a, b = (plain_digest(texts[-k]) for k in (1, 2))
    steps = sum(abs(x - y) for x, y in zip(a[0], b[0])) + 4 * abs(a[1] - b[1])
    like = fingerprints.likeness(*(fingerprints.from_text(out[len(texts) - k]) for k in (1, 2)))[0]
    assert like == 1 - min(steps, 1280) / 1280


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_fingerprints_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 200)
    rows = [(i, f"text of row {i} " * 3) for i in range(40)] + [(None, "no id")] * 30 + [(7, ""), (7, "x y z"), (7, "x y z")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").withColumn("doc_id", F.col("doc_id").cast(kind))
    out = fingerprints.report(df)
    assert out.schema["doc_id"].dataType.simpleString() == df.schema["doc_id"].dataType.simpleString()
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(rows) and sum(r[0] is None for r in found) == 30
    # the copies without an id come first and follow one another
    assert sum(r[0] is None and r[6] == 1 for r in found) >= 29
    key = (lambda i: str(i)) if kind == "string" else (lambda i: i)
    order = sorted((key(i), t) for i, t in rows if i is not None and i != 7)
    edits = {str(r[0]): r[2] for r in found if r[0] is not None}
    seven = key(7)
    for (i, t), (j, n) in zip(order, order[1:]):
        if not i < seven < j:
            assert edits[str(i)] == hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()
    single = fingerprints.report(df.where("doc_id = 3")).collect()
    assert len(single) == 1 and single[0].near_next == 1


# --- 10 --------------------------------------------------------------------------


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % 3] for i, k in enumerate(order)}
    total, left, out = share * sum(sizes.values()), set(order), {}
    while left:
        scale = (total - sum(out.values())) / sum(weight[k] for k in left)
        over = {k for k in left if scale * weight[k] > most * sizes[k]}
        if not over:
            return out | {k: scale * weight[k] for k in left}
        out |= {k: most * sizes[k] for k in over}
        left -= over
    return out


def test_mixing(spark):
    random.seed(13)
    texts = ["w " * random.randint(0, 50) for _ in range(900)] + ODD
    sources = [random.choice(["b", "a", "hot", "hot", "hot", None, "tiny"]) if i % 40 else "zero" for i in range(len(texts))]
    texts = ["" if s == "zero" else t for t, s in zip(texts, sources)]
    df = docs(spark, texts, sources)
    out = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    again = {r.doc_id: r for r in mixing.mix_report(df.repartition(7)).collect()}
    assert out == again and len(out) == len(texts)
    size, taken = {}, {}
    for i, r in out.items():
        assert r.size == len(WORD.findall(texts[i] or "")) and r.taken <= 2 * r.size
        size[sources[i]] = size.get(sources[i], 0) + r.size
        taken[sources[i]] = taken.get(sources[i], 0) + r.taken
    want = targets(size)
    for i, r in out.items():
        assert r.source_size == size[sources[i]] and r.target == pytest.approx(want[sources[i]])
    biggest = max(r.size for i, r in out.items() if sources[i] == "hot")
    assert abs(taken["hot"] - want["hot"]) <= biggest
    rows = mixing.mix(df.withColumn("size", F.lit(5)))
    assert rows.columns == [*df.columns, "size"]
    emitted = [r.doc_id for r in rows.collect()]
    assert all(emitted.count(i) == r.taken // r.size for i, r in out.items() if r.size)
    assert mixing.mix_report(docs(spark, [])).count() == 0


def test_mixing_of_repeated_ids(spark):
    rows = [(1 if i % 3 else None, f"w{i} " * (i % 4), "en", None if i % 5 == 0 else "s", None) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    texts = lambda d: sorted(r.text for r in mixing.mix(d).collect())
    assert texts(df) == texts(df.repartition(7).orderBy(F.rand(3)))
    out = mixing.mix_report(df)
    assert out.count() == 300 and out.agg(F.sum("taken")).first()[0] == len(" ".join(texts(df)).split())
