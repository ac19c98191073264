"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldscape.llm import bpe, exact_dedup, graph, jaccard_join, line_dedup, packing, pretoken, quality, shards, suffix_dedup, toxicity, url_filter
from foldscape.llm.common import texts_of

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, late binary, component_id long"


def corpus(seed=0, n=60):
    """Prose of few words with copies, near copies, shared passages, repeated lines, and every odd case."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "fold", "Éclair", "ñu", "漢字", "x1", "don't", "we'll", "#tag", "a|b", "$5", "loser"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n\t ", "\n", "a", "one two three", "Zwölf Boxkämpfer\r\njagen  Viktor", "0" * 5000, "ab" * 900 + "\n" + "ab" * 300, "  x\x0b\x0cy  "]
    while len(texts) < n:
        kind = rng.random()
        own = [rng.choice(words) + rng.choice(["", ".", ",", "!"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 160))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in own)
        if kind < 0.2 and texts[-1]:
            text = texts[rng.randrange(len(texts))]
        elif kind < 0.4:
            base = (texts[rng.randrange(len(texts))] or "a b").split(" ")
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind < 0.6:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        elif kind < 0.7:
            text += "\nthis very line is found in many documents\n  This very LINE is found in many documents\t"
        texts.append(text)
    ids = list(range(3, 3 + 2 * len(texts), 2))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 7, "k", b"l", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 9


def norm(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, rows):
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    found = got(exact_dedup.exact_dedup(docs))
    assert len(found) == len(rows)
    for i, t in rows:
        group = by[norm(t)]
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(group), len(group), i == min(group))
        assert r["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()


def test_exact_dedup_of_hot_texts_in_two_steps(spark, docs, rows, monkeypatch):
    """One row a chunk and few representatives a task: the same result by the way that hot digests take."""
    want = {i: tuple(r) for i, r in got(exact_dedup.exact_dedup(docs)).items()}
    monkeypatch.setattr(exact_dedup, "HOT", 0)
    real = exact_dedup.chunks
    monkeypatch.setattr(exact_dedup, "chunks", lambda batches, limit: real(batches, 1))
    assert {i: tuple(r) for i, r in got(exact_dedup.exact_dedup(docs)).items()} == want
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    assert {i: tuple(r) for i, r in got(exact_dedup.exact_dedup(docs)).items()} == want


def test_names_tell_blocks_from_padding():
    texts = [b"", b"\0", b"\0\0", b"a", b"a" * 128, b"a" * 129, b"a" * 128 + b"\0", b"a" * 400, b"a" * 400, b"b" * 400, b"a" * 399 + b"b", b"\0" * 128]
    name = exact_dedup.names(texts)
    assert all((name[i] == name[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(len(texts)))
    assert len(exact_dedup.names([])) == 0


# --- 4


def slow_base(text):
    text = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts_and_verdict(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(k % 3 == 0), 0) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (rows[0][0], None, None)], "doc_id long, quality int, toxic int")
    found = got(quality.quality(docs, labels))
    target = {i for k, (i, _) in enumerate(rows) if k % 3 == 0}
    raw, good = Counter(), Counter()
    bits = quality.bits_for(sum(len((t or "").encode()) for _, t in rows))
    assert bits == quality.LEAST_BITS and quality.bits_for(10**9) == 17 and quality.bits_for(10**15) == quality.MOST_BITS

    def grams(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality.buckets(data, np.array([0, len(data)]), bits)[0].tolist()

    for i, t in rows:
        raw.update(grams(t))
        if i in target:
            good.update(grams(t))
    n_raw, n_good, b = sum(raw.values()), sum(good.values()), 1 << bits
    for i, t in rows:
        want = slow_base(t)
        r = found[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        own = grams(t)
        logs = [math.log((good[g] + b * (raw[g] + 1) / (n_raw + b)) / (n_good + b)) - math.log((raw[g] + 1) / (n_raw + b)) for g in own]
        score = sum(logs) / max(1, len(own))
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["held_score"] >= quality.THRESHOLD)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_quality_keeps_clean_rows_without_a_label(spark, sf):
    """Rows of plain prose pass whether a label names them or not; those of symbols, capitals and bars don't count here."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def plain(t):
        words = t.split()
        letters = sum(c.isalpha() for c in t) / max(1, sum(not c.isspace() for c in t))
        return letters > 0.8 and "|" not in t and sum(w.isupper() and len(w) > 1 for w in words) < 0.5 * len(words) and len(set(words)) > 0.3 * len(words)

    found = [r for r in quality.quality(docs, labels).collect() if not r["base_failed"]]
    good = [r for r in found if label.get(r["doc_id"]) == 1]
    clean = [r for r in found if label.get(r["doc_id"]) is None and plain(text[r["doc_id"]])]
    assert good and all(r["kept"] for r in good)
    assert len(clean) > 50 and sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_quality_keeps_a_large_group_of_equal_clean_rows(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clean = next(r["text"] for r in rows.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").collect() if len(r["text"].split()) > 100)
    many = spark.createDataFrame([(10**6 + i, clean + " thatched") for i in range(400)], "doc_id long, text string")
    docs = rows.union(many)
    found = got(quality.quality(docs, labels))
    assert all(found[10**6 + i]["kept"] for i in range(400))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    assert got(quality.quality(docs, labels)) == found


def test_quality_without_labels_and_stage_keeps_columns(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.0}
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.quality(docs, none).where("kept").collect()}
    assert quality.quality(empty, none).count() == 0 and quality.keep_good(empty, none).count() == 0


def test_quality_counts_every_labelled_row(spark, monkeypatch):
    """More than 20,000 labelled rows, some with copies with or without a label: all of them are in the target."""
    n = 20_100
    text = {i: f"w{i} x{i % 7}" for i in range(n)} | {n + i: f"w{i} x{i % 7}" for i in range(90)} | {2 * n + i: f"v{i} x{i % 7}" for i in range(500)}
    named = [i for i in text if i < n + 40]
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in named], "doc_id long, quality int, toxic int")
    found = got(quality.quality(docs, labels))
    bits = quality.bits_for(sum(map(len, text.values())))
    data = {i: quality.buckets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), bits)[0] for i, t in text.items()}
    b = 1 << bits
    raw = np.bincount(np.concatenate(list(data.values())), minlength=b)
    good = np.bincount(np.concatenate([data[i] for i in named]), minlength=b)
    p = (raw + 1) / (raw.sum() + b)
    ratio = np.log((good + p * b) / (good.sum() + b) / p)
    once = {t: data[i] for i, t in text.items()}
    trusted = {text[i] for i in named}
    raw_once = np.bincount(np.concatenate(list(once.values())), minlength=b)
    good_once = np.bincount(np.concatenate([once[t] for t in trusted]), minlength=b)
    for i, own in data.items():
        less = text[i] in trusted
        count = np.bincount(own, minlength=1)[own]
        p = (raw_once[own] - count + 1) / (raw_once.sum() - len(own) + b)
        logs = np.log((good_once[own] - count * less + 2.5) / (p * (good_once.sum() - len(own) * less) + 2.5))
        assert found[i]["score"] == pytest.approx(ratio[own].mean(), abs=1e-6) and found[i]["held_score"] == pytest.approx(logs.mean(), abs=1e-6)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    assert got(quality.quality(docs, labels)) == found


def test_quality_sums_travel_in_few_bytes():
    """Sums of a span come back as they were, negative differences and the largest numbers too; a task's are a few bytes a bucket."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2**34, quality.SPAN)
    parts = rows * quality.PARTS - rng.integers(-9, 2**40, quality.SPAN)
    whole = np.stack([rows, rows * quality.PARTS, parts, parts])
    assert (quality._unpack(quality._pack(whole)) == whole).all()
    few = rng.poisson(8, quality.SPAN)
    good = rng.binomial(few, 0.3)
    task = np.stack([few, good * quality.PARTS, few * quality.PARTS, good * quality.PARTS])
    assert (quality._unpack(quality._pack(task)) == task).all() and len(quality._pack(task)) < 2 * quality.SPAN


@pytest.mark.parametrize("groups", [10**6, -1])
def test_quality_stage_takes_labelled_rows_out_of_the_target(spark, monkeypatch, groups):
    """At a threshold in the midst of the labelled rows' scores the stage keeps the rows that the operator does."""
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", groups)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs, labels).where("not base_failed").collect()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    middle = sorted(r["held_score"] for r in found if r["doc_id"] in good)[len(good) // 2]
    want = sorted(r["doc_id"] for r in found if r["held_score"] >= middle)
    assert 0 < len(good & set(want)) < len(good)
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, labels, middle).collect()) == want


# --- 3


def slow_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(blanks).translate(lower)
            if len(key) >= 20:
                held.setdefault(key, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(k := x.strip(blanks).translate(lower), ())) >= 3 and max(held[k]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay).encode())
    return out


def checked_lines(df, rows):
    want = slow_lines(rows)
    found = got(df)
    assert {i: (r["n_lines"], r["n_dropped"], bytes(r["kept"])) for i, r in found.items()} == want


def test_line_dedup_and_its_reversal(spark, rows):
    first, second = rows[:40], rows[40:]
    a, b = texts_of(frame(spark, first)), texts_of(frame(spark, second))
    index = line_dedup.LineIndex().insert(a).insert(b)
    both = a.unionByName(b)
    checked_lines(index.resolve(both), rows)
    gone = {i for i, _ in rows[::3]}
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [(i, t) for i, t in rows if i not in gone]
    checked_lines(index.resolve(both.join(spark.createDataFrame([(i,) for i, _ in left], "doc_id long"), "doc_id")), left)
    fresh = got(line_dedup.LineIndex().insert(texts_of(frame(spark, left))).repeated(1), "key")
    assert {bytes(k): r["last"] for k, r in fresh.items()} == {bytes(r["key"]): r["last"] for r in index.repeated(1).collect()}


def test_line_index_in_arrivals_with_growing_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_POSTINGS", 20)
    docs = texts_of(frame(spark, rows))
    index = line_dedup.LineIndex().insert(docs, 5)
    assert index.n_shards > 2 and index.shards.count() > 2
    checked_lines(index.resolve(docs), rows)
    some = docs.where("doc_id % 7 < 3")
    index.delete(some.select("doc_id")).insert(some, 2)
    checked_lines(index.resolve(docs), rows)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    index.delete(some.select("doc_id")).insert(some)
    checked_lines(index.resolve(docs), rows)
    assert index.shards.inputFiles() and all(line_dedup.Shard(r.asDict()).filter.holds(line_dedup._hash(line_dedup.Shard(r.asDict()).keys)).all() for r in index.shards.collect())


def test_line_query_counts_rows_as_its_sql_does(spark, tmp_path):
    import duckdb

    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, f"x\n{line}"), (5, f"other line, also long enough\n{line.upper()}  "), (7, None), (7, "other line, also long enough")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = line_dedup.op3_line_index(spark, str(tmp_path))
    want = con.sql(line_dedup.SQL)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_cuckoo_filter_holds_deletes_and_grows():
    rng = np.random.default_rng(1)
    keys = np.array([rng.bytes(16) for _ in range(20_000)], "S16")
    own = line_dedup.Shard()
    ones = np.ones(len(keys), np.int64)
    own.insert(keys[:15_000], ones[:15_000], ones[:15_000])
    own.insert(keys[5_000:], ones[5_000:], 2 * ones[5_000:])
    assert own.filter.holds(line_dedup._hash(keys)).all()
    at, hit = own.find(keys)
    assert hit.all() and (own.refs[at] == np.where((np.arange(20_000) >= 5_000) & (np.arange(20_000) < 15_000), 2, 1)).all()
    own.delete(keys[:5_000], ones[:5_000], ones[:5_000])
    assert own.filter.holds(line_dedup._hash(keys[5_000:])).all() and not own.find(keys[:5_000])[1].any()
    assert own.filter.holds(line_dedup._hash(keys[:5_000])).mean() < 0.01


# --- 5


def slow_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in rows if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i, _ in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components(spark, seed):
    rows = corpus(seed, 90)
    found = got(jaccard_join.jaccard_components(frame(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == slow_components(rows)


def test_jaccard_chain_of_drifting_copies(spark):
    """Neighbours are linked, ends are far apart: windows and blocks must lose no link."""
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(200)]
    rows += [(1000 + i, " ".join(words[:80] + [f"z{i}_{j}" for j in range(22)])) for i in range(30)]  # share much, linked with none
    random.Random(4).shuffle(rows)
    found = got(jaccard_join.jaccard_components(frame(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == slow_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_region_recursion_is_exact(seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 6)
    rng = np.random.default_rng(seed)
    centres = [rng.choice(3000, 80, replace=False) for _ in range(12)]
    sets = []
    for _ in range(150):
        c = centres[rng.integers(12)].copy()
        c[rng.choice(80, rng.integers(0, 16), replace=False)] = rng.integers(3000, 9000, 1)
        sets.append(np.unique(c))
    n = np.array([len(s) for s in sets])
    links = jaccard_join.Region(np.arange(150), n, np.arange(150), sets).links()
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        root[find(a)] = find(b)
    for a in range(150):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
                assert find(a) == find(b)


def drifting(seed, families=2, docs=60):
    """Copies of templates from which much is changed: some are linked, most of a family lie a little too far apart."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(90)]
        for _ in range(docs):
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(90)] = f"x{rng.randrange(6)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("copies", [0, 4])
def test_regions_that_are_cut_across_tasks_lose_no_link(spark, monkeypatch, caplog, copies):
    """Pivots, windows and levels by shuffles, and blocks where cutting is of no use, with small regions, slices and blocks."""
    for name, value in (("REGION_DOCS", 12), ("SLICE_DOCS", 20), ("BLOCK_DOCS", 15), ("SMALL", 4), ("PIVOTS", 5), ("COPIES", copies), ("LEVELS", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = drifting(copies)
    with caplog.at_level("INFO", "foldscape"):
        found = got(jaccard_join.jaccard_components(frame(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == slow_components(rows)
    assert any("regions cut" in m and not m.startswith("level 0: 0 ") for m in caplog.messages)


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5}
    assert graph.components(links.limit(0)).count() == 0


# --- 10


def slow_passages(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed, 80)
    found = got(suffix_dedup.remove_repeats(frame(spark, rows)))
    want = slow_passages(rows)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in found.items()} == want


def test_suffix_dedup_with_several_texts_of_an_id(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=150))
    own = lambda: "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90)))
    rows = [(1, own() + passage), (2, own() + passage + own()), (2, "short"), (2, passage + own()), (5, own()), (5, None), (7, passage)]
    docs = frame(spark, rows)
    found = suffix_dedup.remove_repeats(docs).collect()
    assert len(found) == len(rows)
    assert all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in found)
    gone = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in found}
    want = {(i, len((t or "").encode())): 150 if t and passage in t and i > 1 else 0 for i, t in rows}
    assert gone.keys() == want.keys() and all(want[k] <= n <= want[k] + 20 for k, n in gone.items())
    cut = suffix_dedup.cut_repeats(docs).collect()
    assert sorted(len((r["text"] or "").encode()) for r in cut) == sorted(r["n_bytes"] - r["n_removed"] for r in found)


def test_stages_keep_columns_whatever_their_names(spark, rows):
    """Names that the operators use themselves, or that Spark gives to what a reader knows of files."""
    odd = ["_metadata", "foldscape_late", "foldscape0_late", "Foldscape1_x", "place", "late", "h", "copies", "_text_hash", "key.with.dots", "column_0", "back`tick", "part", "a"]
    docs = frame(spark, rows).drop("part", "late", "key").select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])
    labels = spark.createDataFrame([(rows[0][0], 1, 0)], "doc_id long, quality int, toxic int")
    for kept in (quality.keep_good(docs, labels, -9.0), exact_dedup.drop_copies(docs), jaccard_join.drop_near_copies(docs), suffix_dedup.cut_repeats(docs)):
        assert kept.columns == docs.columns
        out = kept.collect()
        assert out and all([r[c] for c in odd] == list(range(len(odd))) for r in out)


def test_suffix_dedup_spread_window_by_window(monkeypatch):
    """Anchors with many variants: the same verdicts when their windows are dealt out one by one."""
    rng = random.Random(5)
    passage = bytes(rng.choices(b"abcdefgh ", k=140))
    texts = [bytes(rng.choices(b"abcdefgh ", k=70)) + passage + bytes(rng.choices(b"abcdefgh ", k=70)) for _ in range(20)]
    import pyarrow as pa

    t = pa.table({"doc_id": pa.array(range(20), pa.int64()), "text": pa.array([x.decode() for x in texts])})

    class Key:
        def __init__(self, v):
            self.v = v

        def as_py(self):
            return self.v

    results = []
    for hot in (4096, 2):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        posted = pa.Table.from_batches(list(suffix_dedup._posted(8)(iter(t.to_batches()))))
        keys = sorted(set(posted["key"].to_pylist()))
        out = [suffix_dedup._sampled(8)([Key(k)], posted.filter(pa.compute.equal(posted["key"], k))) for k in keys]
        sampled = pa.concat_tables(out)
        spans = pa.concat_tables([suffix_dedup._by_doc(None, sampled)])
        asked = {r["doc_id"]: r["asked"] for r in spans.to_pylist() if r["asked"]}
        own = t.filter(pa.compute.is_in(t["doc_id"], pa.array(list(asked), pa.int64())))
        own = own.append_column("asked", pa.array([asked[i] for i in own["doc_id"].to_pylist()], pa.binary()))
        windows = pa.Table.from_batches(list(suffix_dedup._asked(8)(iter(own.to_batches()))))
        more = [suffix_dedup._bounded(8)(None, windows.filter(pa.compute.equal(windows["shard"], s))) for s in sorted(set(windows["shard"].to_pylist()))]
        late = {}
        for part in (sampled, *more):
            for r in suffix_dedup._by_doc(None, part).to_pylist():
                for s, w in np.frombuffer(r["late"], suffix_dedup._SPAN).tolist():
                    late.setdefault(r["doc_id"], set()).update(range(s, s + w))
        results.append(late)
    assert results[0] == results[1]
    seen = set()
    for i, x in enumerate(texts):
        want = set()
        for s in range(len(x) - 99):
            w = x[s : s + 100]
            want |= {s} if w in seen else set()
            seen.add(w)
        assert results[0].get(i, set()) == want


def test_levels_merge_geometrically():
    rng = np.random.default_rng(0)
    levels, seen = suffix_dedup.Levels(), set()
    for _ in range(40):
        some = np.array([rng.bytes(2).ljust(4, b"x") for _ in range(rng.integers(1, 300))], "S4")
        before = levels.add(some)
        for s, b in zip(some.tolist(), before.tolist(), strict=True):
            assert b == (s in seen)
            seen.add(s)
        sizes = [len(x) for x in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(seen)


def test_cut_repeats_keeps_columns_and_whole_characters(spark, rows, docs):
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    want = slow_passages(rows)
    for r in out.collect():
        kept = want[r["doc_id"]]
        original = dict(rows)[r["doc_id"]]
        assert r["text"] == (kept[3].decode("utf-8", "ignore") if kept[1] else original)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["part"] == 7


# --- 2 and 6


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "own"):
        library_ids.own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return library_ids.own.encode(text or "", add_special_tokens=False).ids


def slow_bins(lengths, capacity):
    import bisect

    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (capacity if i == len(rooms) else rooms.pop(i)) - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [7, 64, 1024])
def test_plan_is_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 250))]
        runs = packing.plan(dict(Counter(lengths)), capacity)
        fill, ranks = {}, Counter()
        for length, rank, first, offset, n in runs.tolist():
            assert rank == ranks[length]
            ranks[length] += n
            for i in range(n):
                fill.setdefault(first + i, []).append((offset, length))
        assert ranks == Counter(lengths)
        for bins in fill.values():
            end = 0
            for offset, length in sorted(bins):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(fill) == slow_bins(lengths, capacity)


def test_packing(spark, rows):
    rows = [*rows, (9001, "a <|endoftext|> b"), (9003, "word " * 3000), (9005, "tab\t\ttabs  \n\n spaces   ")]
    pieces = packing.pack(frame(spark, rows), P.path("byte_bpe_50k.json"), 256).toPandas()
    for i, t in rows:
        ids = [*library_ids(t), 2]
        own = pieces[pieces.doc_id == i].sort_values("piece")
        assert list(own.piece) == list(range(len(own))) and own.length.sum() == len(ids) and own.length.max() <= 256
        assert (own.length.iloc[1:] == 256).all() and len(own) == -(-len(ids) // 256)
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 256
    assert pieces.sequence_id.nunique() == slow_bins(pieces.length.tolist(), 256)


def test_split_is_the_pattern():
    import pyarrow as pa
    import regex

    rng = random.Random(2)
    alphabet = " \n\t 's't're've'm'll'dabZé1²٣!?-— 　\r漢\x1c\x85"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(20_000)] + [""]
    _, starts, counts = pretoken.split(pa.chunked_array([texts]))
    pattern, at = regex.compile(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}")), 0
    for i, t in enumerate(texts):
        assert (starts[counts[i] : counts[i + 1]] - at).tolist() == [m.start() for m in pattern.finditer(t)], repr(t)
        at += len(t)


def test_bpe_round_trip(spark, rows):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    rows = [*rows, (9001, "<|endoftext|> a"), (9003, "hottentottententententoonstelling" * 40)]
    found = got(bpe.encode_decode(frame(spark, rows), path))
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        r = found[i]
        assert (r["n_tokens"], r["ids"], bytes(r["decoded"])) == (len(ids), " ".join(map(str, ids)), (t or "").encode())


def tiktoken_ids(words):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    return [" ".join(map(str, own.encode_ordinary(w))) for w in words]


@pytest.mark.parametrize(("every", "many"), [(True, 0), (True, 256), (False, 0)])
def test_recursive_queries_agree_with_the_library(every, many, monkeypatch):
    monkeypatch.setattr(bpe, "MANY_ROUNDS", many)
    coder = bpe.coder(P.path("byte_bpe_50k.tiktoken"), every)
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ehtinos éZ", k=rng.randint(1, 60))) for _ in range(300)} | {"a" * 999, "ab" * 501, "aab" * 100, "x" * 64})
    coder.clear()
    coder.by_queries(words)
    assert coder.id_text == tiktoken_ids(words)
    assert coder.decoded == [w.encode() for w in words]
    coder.clear()


def test_vocabulary_is_regular():
    assert bpe.regular(P.path("byte_bpe_50k.tiktoken"))


def test_recursive_queries_hold_long_words_in_scripts_without_spaces():
    """16,384 distinct words of 32 CJK characters, Thai paragraphs, and a word of 1 MB, within the memory of a query."""
    coder = bpe.coder(P.path("byte_bpe_50k.tiktoken"), True)
    rng = random.Random(2)
    words = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(32)) for _ in range(16_384)]
    words += ["".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(400)) for _ in range(20)] + ["ACGT" * 250_000, "".join(rng.choices("ACGT", k=50_000))]
    coder.clear()
    coder.by_queries(words)
    assert coder.id_text == tiktoken_ids(words)
    assert coder.decoded == [w.encode() for w in words]
    coder.clear()


# --- 7


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(texts_of(docs), labels)
    scored = toxicity.toxicity(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").toPandas()
    sure = scored[scored.score >= toxicity.TOXIC_FROM]
    assert (sure.toxic == 1).mean() > 0.95
    assert (scored[scored.toxic == 1].score >= toxicity.TOXIC_FROM).mean() >= 0.9
    ranks = scored.score.rank()
    n = (scored.toxic == 1).sum()
    assert (ranks[scored.toxic == 1].sum() - n * (n + 1) / 2) / n / (len(scored) - n) > 0.93


def test_folding_and_exceptions():
    assert toxicity.folded("ІdІ0t! mоr​on, p@th3tic  L0SER$") == " idiot moron pathetic loser"
    assert toxicity.folded("") == " " and toxicity.folded("!!! ...") .strip() == ""
    found = toxicity.automaton({" idiot": 2.0, " scum": 1.0}, [" idiot proof "])
    assert toxicity.hits(found, toxicity.folded("1di0ts and scum")) == (3.0, 2, 3)
    assert toxicity.hits(found, toxicity.folded("an idiot proof lid")) == (0.0, 0, 4)
    assert toxicity.hits(found, toxicity.folded("an antiscum lid")) == (0.0, 0, 3)


def slow_score(model, text):
    """A score by looking for every term and exception at every word, one by one."""
    text = toxicity.folded(text or "")
    words = text.split(" ")[1:] if len(text) > 1 else []
    total, n_hits = [], 0
    for i in range(len(words)):
        rest = " " + " ".join(words[i:]) + " "
        if any(rest.startswith(p) for p in model.exceptions):
            continue
        for term, w in model.weights.items():
            if rest.startswith(term):
                total.append(w)
                n_hits += 1
    return model.score(math.fsum(total), len(words)), n_hits


def toxic_corpus():
    rng = random.Random(3)
    plain = ["the", "old", "mill", "stands", "by", "a", "river", "and", "bread", "is", "baked"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["scumbag", "ІDІ0T!", "l0sers"]))
        if not bad and i % 16 == 1:
            words += ["scumbag", "peak"] + ["and"] * (i % 32 == 1)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad)))
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2001, ""), (0, rows[0][1]), (2002, "scumbag peak"), (2003, "SCUMBAG! peaks")]
    labels += [(1000 + i, 1, 1) for i in range(50)] + [(None, 1, 1), (2000, None, None)]
    return rows, labels


def test_toxicity_against_brute_force_however_rows_are_dealt(spark):
    rows, labels = toxic_corpus()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    models = [toxicity.fit(texts_of(docs.repartition(n)), labels) for n in (1, 16)]
    model = models[0]
    assert (model.weights, model.exceptions, model.coefficients) == (models[1].weights, models[1].exceptions, models[1].coefficients)
    assert " scumbag peak " in model.exceptions and any(t.startswith(" idiot") for t in model.weights)
    scored = toxicity.toxicity(docs, model).collect()
    assert len(scored) == len(rows)
    texts = dict(rows)
    for r in scored:
        assert (r["score"], r["hits"]) == slow_score(model, texts[r["doc_id"]]), r["doc_id"]
    verdict = {r["doc_id"]: r["score"] >= toxicity.TOXIC_FROM for r in scored}
    assert sum(verdict[i] == (i % 3 == 0) for i in range(240)) >= 230


def test_toxicity_without_labels(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(texts_of(docs), none)
    scored = toxicity.toxicity(docs, model).collect()
    assert len(scored) == len(rows) and {r["score"] for r in scored} == {0.0}
    assert toxicity.toxicity(empty, model).count() == 0


# --- 1 and 8


def test_temporal_list(spark):
    entries = [("Spam.example", "2024-01-05", "add"), ("spam.example", "2024-02-01", "remove"), ("example", "2024-03-01", "add"), ("a.spam.example", "2024-01-10", "add"), ("a.spam.example", "2024-01-10", "remove"), (None, "2024-01-01", "add"), ("late.org", "2026-01-01", "add"), ("old.org", "2020-01-01", "add")]
    captures = [
        (1, "http://spam.example/x", "2024-01-04"), (2, "https://u:p@Spam.Example:80/x?y#z", "2024-01-05"), (3, "http://a.spam.example", "2024-01-31"), (4, "http://spam.example/", "2024-02-01"),
        (5, "http://spam.example/", "2024-03-02"), (6, None, "2024-01-06"), (7, "not a url", "2024-01-06"), (8, "http://notspam.example/", "2024-01-06"), (9, "http://spam.example/", None),
        (None, "http://spam.example/", "2024-01-06"), (11, "http://late.org", "2024-05-05"), (12, "http://old.org.", "2024-05-05"), (2, "https://u:p@Spam.Example:80/x?y#z", "2024-01-05"),
    ]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("pattern", F.lit("clash"))
    e = spark.createDataFrame(entries, "pattern string, day string, action string").withColumn("day", F.to_date("day"))
    out = url_filter.temporal_list_join(c, e).collect()
    assert len(out) == len(captures)
    assert sorted((r["page_id"] or -1, r["pattern"]) for r in out if r["blocked"]) == [(-1, "spam.example"), (2, "spam.example"), (2, "spam.example"), (3, "spam.example"), (5, "example"), (12, "old.org")]
    assert url_filter.temporal_list_join(c, e.limit(0)).where("blocked").count() == 0
    assert url_filter.temporal_list_join(c.limit(0), e).count() == 0


def stored(store, version=None):
    return sorted((tuple(r) for r in store.read(version).collect()), key=lambda r: r[0])


def test_store_compacts_by_size_and_keeps_versions(spark, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s", target_bytes=60_000, fanout=4)
    assert store.manifest()["version"] == 0 and store.read().count() == 0
    rng = random.Random(0)
    rows = [(i, None if i % 50 == 0 else "".join(rng.choices("abcdefghij", k=300)), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, manifest string")
    for i in range(6):
        store.append(df.where(F.col("doc_id") % 6 == i).repartition(2))
    assert len(store.manifest()["shards"]) == 12 and store.version() == 6
    done = store.compact()
    assert len(done["shards"]) < 12 and all(s["bytes"] < 90_000 for s in done["shards"])
    assert stored(store) == rows
    assert stored(store, 3) == [r for r in rows if r[0] % 6 < 3]  # a version from before the merges
    store.append(df.limit(0))
    assert store.read().count() == 600
    store.vacuum(0)
    assert stored(store, 3) == [r for r in rows if r[0] % 6 < 3]
    store.expire(1)
    store.vacuum(0)
    assert stored(store) == rows and store.versions() == [store.version()]


def test_store_keeps_columns_of_all_arrivals(spark, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s", fanout=2)
    first = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    more = spark.createDataFrame([(2, "b", "m", 5)], "doc_id long, text string, _metadata string, extra int")
    store.append(first.coalesce(1))
    store.append(more.coalesce(1))
    want = [(1, "a", None, None), (2, "b", "m", 5)]
    assert stored(store) == want and stored(store, 1) == [(1, "a")]
    assert len(store.compact()["shards"]) == 1
    store.append(first.coalesce(1))
    assert sorted(stored(store), key=str) == sorted([*want, want[0]], key=str)
    before = store.version()
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(3, 4)], "doc_id long, text long"))
    assert store.version() == before
    assert {(r["doc_id"], r["n_bytes"]) for r in shards.placed(store).collect()} == {(1, 1), (2, 1)}


def test_store_with_two_writers(spark, tmp_path, monkeypatch):
    """A commit goes on top of another one; a merge whose shards are gone leaves nothing; an uncommitted arrival survives."""
    monkeypatch.setattr(shards.time, "sleep", lambda s: None)
    store, other = (shards.Store(spark, f"file://{tmp_path}/s", target_bytes=60_000, fanout=2) for _ in range(2))
    row = lambda i: spark.createDataFrame([(i, f"text {i}")], "doc_id long, text string").coalesce(1)
    for i in range(3):
        store.append(row(i))
    flying = other._written(row(7))  # written, not committed yet
    real = store._merged

    def merged(base, groups):
        found = real(base, groups)
        if base["version"] == 3:
            other.append(row(3))  # somebody appends while the merge runs
        return found

    monkeypatch.setattr(store, "_merged", merged)
    store.compact()
    store.vacuum()
    other.commit(flying)
    assert [r[0] for r in stored(store)] == [0, 1, 2, 3, 7]
    with pytest.raises(shards.Conflict):
        store.commit([], ["run-none/part-0"])
    late = other.manifest()
    assert len(store.compact()["shards"]) == 1
    lost = real(late, [late["shards"]])
    with pytest.raises(shards.Conflict):
        other.commit(lost, [s["path"] for s in late["shards"]])
    assert [r[0] for r in stored(store)] == [0, 1, 2, 3, 7]


def test_store_stops_at_an_unfinished_manifest_until_it_is_repaired(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards.time, "sleep", lambda s: None)
    store = shards.Store(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    store.append(df)
    (tmp_path / "s/manifest/v0000000002.json").write_text('{"version": 2, "sha')
    assert store.version() == 1 and stored(store) == [(1, "a")]
    with pytest.raises(shards.Conflict):
        store.append(df)
    assert not store.repair() and store.repair(0)
    store.append(df)
    assert store.version() == 3 and stored(store) == [(1, "a")] * 2


def test_store_lists_changes_once_it_is_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "FULL_LIST", 2)
    monkeypatch.setattr(shards, "SNAPSHOT_EVERY", 4)
    store = shards.Store(spark, f"file://{tmp_path}/s", fanout=3)
    for i in range(7):
        store.append(spark.createDataFrame([(i, "x")], "doc_id long, text string").coalesce(1))
        assert len(store.manifest()["shards"]) == i + 1
    assert [r[0] for r in stored(store, 4)] == [0, 1, 2, 3]
    store.compact()
    store.append(spark.createDataFrame([(9, "x")], "doc_id long, text string").coalesce(1))
    store.expire(2)
    store.vacuum(0)
    assert [r[0] for r in stored(store)] == [*range(7), 9]


def test_size_tiered_query_against_the_files(spark, tmp_path, monkeypatch):
    """Each document once, in the shard that holds it, with that file's size and tier; several arrivals and tiers."""
    import glob
    import os

    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(shards, "SMALLEST", 16 << 10)
    monkeypatch.setattr(shards, "shared_dir", lambda s: f"file://{tmp_path}/store")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task a file
    try:
        found = got(shards.op8_size_tiered(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: r["n_bytes"] for i, r in found.items()} == {i: None if t is None else len(t.encode()) for i, t in texts.items()}
    seen = {}
    for f in glob.glob(f"{tmp_path}/store/data/run-*/part-*"):
        size = os.stat(f).st_size
        for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist():
            assert i not in seen
            seen[i] = (size, max(0, math.floor(math.log(size / (16 << 10), 4))))
            assert f"/{found[i]['shard']}" in f
    assert {i: (r["shard_bytes"], r["tier"]) for i, r in found.items()} == seen
    assert len(set(seen.values())) < 24
    store = shards.Store(spark, f"file://{tmp_path}/store")
    assert store.version() > shards.ARRIVALS and store._merges(store.manifest()["shards"]) == []


# --- all of them


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert line_dedup.LineIndex().insert(texts_of(empty)).resolve(texts_of(empty)).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.cut_repeats(empty).count() == 0
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_decode(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_repeated_rows_and_null_ids(spark, rows):
    """A row that repeats id and text gets the same result as the first; rows without an id are left out."""
    twice = frame(spark, [*rows[:25], *rows[10:20], (None, "no id"), (None, None)])
    n = 35
    a = exact_dedup.exact_dedup(twice).collect()
    assert len(a) == n and all(r["kept"] == (r["keep_id"] == r["doc_id"]) for r in a)
    b = jaccard_join.jaccard_components(twice).collect()
    want = slow_components(rows[:25])
    assert len(b) == n and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in b)
    c = suffix_dedup.remove_repeats(twice).collect()
    cut = slow_passages(rows[:25])
    assert len(c) == n and all((r["n_removed"], bytes(r["kept"])) == (cut[r["doc_id"]][1], cut[r["doc_id"]][3]) for r in c)
    d = packing.pack(twice, P.path("byte_bpe_50k.json"), 64)
    assert d.where("piece = 0").count() == n
    docs = texts_of(twice)
    e = line_dedup.LineIndex().insert(docs).resolve(docs)
    labels = spark.createDataFrame([(rows[0][0], 1, 1), (rows[1][0], 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.quality(twice, labels).collect()
    assert len(scored) == n and len({tuple(r) for r in scored}) == 25
    judged = toxicity.toxicity(twice, toxicity.fit(docs, labels)).collect()
    assert len(judged) == n and len({tuple(r) for r in judged}) == 25
    assert e.count() == n and bpe.encode_decode(twice, P.path("byte_bpe_50k.tiktoken")).count() == n


def long_rows():
    """Texts of 5 MB: of words, of one word a line, and a copy; and a word of 1 MB."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choices(words, k=800_000))[:5_000_000]
    return [(1, prose), (2, prose.replace(" ", "\n")), (3, "ab" * 500_000), (5, prose), (7, "short text"), (9, None)]


def test_very_long_texts(spark):
    """No operator fails on texts of megabytes, and what is easily known of the results holds."""
    rows = long_rows()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    size = {i: len((t or "").encode()) for i, t in rows}
    exact = got(exact_dedup.exact_dedup(docs))
    assert exact[5]["keep_id"] == 1 and exact[2]["keep_id"] == 1 and exact[3]["group_size"] == 1  # line breaks and spaces are one space
    lines = got(line_dedup.LineIndex().insert(texts_of(docs)).resolve(texts_of(docs)))
    assert lines[2]["n_lines"] == rows[1][1].count("\n") + 1 and lines[3]["n_dropped"] == 0
    near = got(jaccard_join.jaccard_components(docs))
    assert near[5]["component_id"] == near[2]["component_id"] == 1 and near[3]["component_id"] == 3
    cut = got(suffix_dedup.remove_repeats(docs))
    assert cut[5]["n_removed"] == size[5] and 0 < size[3] - cut[3]["n_removed"] < 200
    coded = got(bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken")))
    assert all(len(coded[i]["decoded"]) == n for i, n in size.items())
    packed = packing.pack(docs, P.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: len(library_ids(t)) + 1 for i, t in rows}
    good = got(quality.quality(docs, labels))
    assert good[1]["n_words"] == len(rows[0][1].split()) and good[3]["word_chars"] == size[3] and good[9]["base_failed"]
    assert toxicity.toxicity(docs, toxicity.fit(texts_of(docs), labels)).count() == len(rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert all(q(spark, str(tmp_path)).count() == 0 for q in (line_dedup.op3_line_index, shards.op8_size_tiered, quality.op4_llr_quality, toxicity.op7_folded_lexicon))


def test_pipeline_matches_brute_force_stages(spark):
    """run() over the smallest table: each stage's decisions, made again without Spark from what it was given."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, sf).persist()
        assert kept.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        items = list(before.items())
        if name == "quality":
            verdict = got(quality.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")))
            assert set(after) == {i for i, r in verdict.items() if r["kept"]}
        elif name == "exact":
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i]), i)
            assert set(after) == set(first.values())
        elif name == "near":
            assert set(after) == {i for i, (_, c) in slow_components(items).items() if c == i}
        else:
            want = slow_passages(items)
            assert after == {i: (want[i][3].decode("utf-8", "ignore") if want[i][1] else t) for i, t in before.items()}
    pieces = cp.run(spark, sf).toPandas()
    final = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(pieces.doc_id) == set(final)
    assert {i: n for i, n in pieces.groupby("doc_id").length.sum().items()} == {i: len(library_ids(t)) + 1 for i, t in final.items()}
    assert isinstance(pieces, pd.DataFrame) and pieces.sequence_id.nunique() == slow_bins(pieces.length.tolist(), 1024)
