"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import kmeans_tree, licences, mixing, packing, pseudo_likelihood, quality_classifier, quality_rules, sharding, simhash, suffix_dedup
from spanledger.llm.queries import tokenizer_path

RNG = np.random.default_rng(0)
WORDS = ["the", "of", "and", "river", "stone", "Licht", "été", "walks", "under", "MIT", "License", "x1", "night", "blue", "seven", "paper"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n)) if n else ""


LONG = prose(400)
TEXTS = [None, "", "  \n\t ", "one", LONG, LONG, LONG[:900] + " changed " + LONG[900:], prose(3000), prose(60) + "\n" + prose(5), "\n".join([prose(30)] * 4), "Released under the MIT License.\nmit license apache license", "é" * 500, "a" * 700, prose(120) + LONG[300:800] + prose(40)]
ROWS = [(i, t, ["en", "fr", None, "xx"][i % 4], [None, "b", "a", "ä"][i % 4], 7, "clash", 1) for i, t in enumerate(TEXTS)] + [(4, LONG, "en", "b", 7, "clash", 1), (None, "null id text", "en", "b", 7, "clash", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "n_chars", "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_packing(docs, none):
    path = tokenizer_path()
    ids = packing.Ids(path)
    rows = packing.packed(docs, path, 256, 4).collect()
    seen = collections.defaultdict(list)
    for r in rows:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    own = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        raw = ids.encode(t or "") + np.array([1], "<u4").tobytes()
        n = len(raw) // 4
        want.update((i, s, min(256, n - s), zlib.crc32(raw[4 * s : 4 * (s + 256)]), n) for s in range(0, n, 256))
    assert own == want and packing.packed(none, path).count() == 0


def test_ids_equal_the_tokenizer():
    ids = packing.Ids(tokenizer_path())
    signs = list(" \n\t'sabà1½!\x1c日\x85 .,")
    for t in ["a<|endoftext|>b  \n\n x", "", "'s 's  's\n's", *("".join(RNG.choice(signs, 40)) for _ in range(300))]:
        assert ids(t) == ids.encode(t)


def test_column_generation():
    demand = RNG.integers(0, 50, 64)
    used = packing.patterns(demand)
    assert (sum(n * p for n, p in used) == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for _, p in used)
    assert sum(n for n, _ in used) <= 1.03 * (demand @ np.arange(1, 65)) / 64 + 1
    values = RNG.random(30)
    best = [0.0]
    for c in range(1, 31):
        best.append(max([best[-1]] + [best[c - w] + values[w - 1] for w in range(1, c + 1)]))
    worth, pattern = packing.knapsack(values, 30)
    assert abs(worth - best[-1]) < 1e-12 and abs(values @ pattern - worth) < 1e-12


def test_suffix_arrays():
    data = np.frombuffer(b"".join(RNG.choice([b"ab", b"ba", b"abab"], 200)), np.uint8)
    starts = np.arange(len(data) - 40 + 1)
    order, same = suffix_dedup.suffix_order(data, starts, 40)
    strings = [data[s : s + 40].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings)
    earlier, other = suffix_dedup.previous_factors(order, same, starts)
    assert earlier.tolist() == [s in strings[:i] for i, s in enumerate(strings)] and other.tolist() == [strings.count(s) > 1 for s in strings]


def _cut(rows, length, keep_first):
    raw = [(t or "").encode() for _, t, *_ in rows]
    places = collections.defaultdict(set)
    for (i, t, *_), b in zip(rows, raw):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].add(((1 << 63) - 1 if i is None else i, p, hash(b)))
    count = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for (i, *_), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if min(places[s])[:2] != ((1 << 63) - 1 if i is None else i, p) if keep_first else count[s] > 1:
                gone[p : p + length] = True
        yield gone


@pytest.mark.parametrize("most", [1, 1024])
def test_suffix_dedup(docs, none, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    want = []
    for (i, t, *_), gone in zip(ROWS, _cut(ROWS, 60, False)):
        b = np.frombuffer((t or "").encode(), np.uint8)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    assert by_row(suffix_dedup.reports(docs, 60)) == sorted(want, key=repr)
    kept = collections.Counter(r["text"] for r in suffix_dedup.cleaned(docs, 60).collect())
    left = collections.Counter()
    for (_, t, *_), gone in zip(ROWS, _cut(ROWS, 60, True)):
        rest = None if t is None else np.frombuffer(t.encode(), np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if rest or not gone.any():
            left[rest] += 1
    assert kept == left and suffix_dedup.reports(none).count() == 0 and suffix_dedup.cleaned(docs, 60).columns == docs.columns


def test_long_texts_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rows = [(0, "ab" * 900, None, None, 0, "", 0), (1, LONG * 3, None, None, 0, "", 0)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.reports(spark.createDataFrame(rows, SCHEMA), 60).collect()}
    assert got == {i: int(g.sum()) for (i, *_), g in zip(rows, _cut(rows, 60, False))}


def test_bit_sliced_comparison():
    for words, radius in ((1, 2), (4, 47), (1, 0)):
        base = RNG.integers(0, 1 << 63, (12, words)).astype(np.uint64)
        prints = base[RNG.integers(0, 12, 200)].copy()
        for i in range(200):
            for _ in range(RNG.integers(0, 6 * words)):
                prints[i, RNG.integers(0, words)] ^= np.uint64(1) << np.uint64(RNG.integers(0, 64))
        keys = np.sort(RNG.integers(0, 4, 200))
        near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= radius) & (keys[:, None] == keys[None])
        label = np.arange(200)
        while True:
            new = np.array([label[near[i]].min() for i in range(200)])
            if (new == label).all():
                break
            label = new
        assert (simhash.linked(keys, prints, radius) == label).all()


@pytest.mark.parametrize("limit", [1, 1024])
def test_simhash(spark, docs, none, monkeypatch, limit):
    import xxhash

    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    near = [(100 + k, LONG.replace("stone", "Stone ", k), None, None, 0, "", 0) for k in range(6)]
    rows = ROWS + near

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2) for p in prints]
    ids = collections.defaultdict(list)
    for g, r in zip(group, rows):
        if r[0] is not None:
            ids[g].append(r[0])
    want = [(r[0], f"{p:016x}", min(ids[g], default=None)) for r, p, g in zip(rows, prints, group)]
    assert by_row(simhash.reports(spark.createDataFrame(rows, SCHEMA))) == sorted(want, key=repr)
    assert simhash.reports(none).count() == 0


def test_flips_and_components(spark):
    prints = sorted({int(x) for x in RNG.integers(-(1 << 63), 1 << 63, 20)} | {5, 4, 7, 15, -(1 << 63) + 0xFF00, -(1 << 63) + 0xFF01})
    links = simhash.flipped_links(spark.createDataFrame([(p,) for p in prints], "_node long"))
    label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    assert {p: label[p] for p in (4, 5, 7, 15)} == dict.fromkeys((4, 5, 7, 15), 4) and label[-(1 << 63) + 0xFF01] == -(1 << 63) + 0xFF00 and len(label) == 6
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["label"] for r in simhash.components(chain).collect()} == {0}


@pytest.mark.parametrize("limit", [2, 1024])
def test_survivors(docs, none, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    rows = simhash.survivors(docs, **simhash.STAGE).collect()
    kept = [r["doc_id"] for r in rows]
    assert kept.count(4) == 1 and 5 not in kept and 6 not in kept and {3, 7, 8, 10, None} <= set(kept) and len([i for i in kept if i in (0, 1, 2)]) == 1
    assert simhash.survivors(none).count() == 0


def test_copies_in_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", 8)
    monkeypatch.setattr(simhash, "band_keys", lambda hashes, bands, rows: np.arange(bands, dtype=np.uint64))  # every band is one bucket
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):  # six groups of eight near copies; at most one holds the bucket's least node
        words = [f"g{group}w{k}" for k in rng.integers(0, 10**6, 400)]
        for copy in range(8):
            own = list(words)
            own[10 * copy] = f"changed{copy}"
            rows.append((10 * group + copy, " ".join(own)))
    rows += [(1000 + i, " ".join(f"s{i}w{k}" for k in range(300))) for i in range(20)]
    got = {r["doc_id"] for r in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.STAGE).collect()}
    assert got == {10 * group for group in range(6)} | {1000 + i for i in range(20)}


@pytest.mark.parametrize("limit", [8, 1024])
def test_survivors_by_exact_similarity(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    rng = np.random.default_rng(11)
    rows = []
    for family in range(30):  # pages of one template that share 0.5 to 0.95 of their shingles
        words = [f"f{family}w{k}" for k in range(400)]
        for page in range(4):
            own = [*words[: int(rng.uniform(270, 395))]]
            rows.append((len(rows), " ".join(own + [f"p{len(rows)}w{k}" for k in range(400 - len(own))])))
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(t.split()) for _, t in rows]
    group = list(range(len(rows)))
    for _ in range(4):
        group = [min(group[j] for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)) for a in sets]
    got = {r["doc_id"] for r in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.STAGE).collect()}
    assert got == set(group)


def test_mixing(docs, none):
    rows = mixing.reports(docs).collect()
    assert by_row(mixing.reports(docs)) == sorted(map(tuple, rows), key=repr) and mixing.reports(none).count() == 0
    size = [len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for _, t, *_ in ROWS]
    sources = sorted({r[3] for r in ROWS}, key=lambda s: (s is None, s))
    total = {s: sum(n for n, r in zip(size, ROWS) if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, closed = {}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in closed)
        target = {s: 2.0 * total[s] if s in closed else left * weight[s] / sum(weight[x] for x in sources if x not in closed) for s in sources}
        over = {s for s in sources if s not in closed and target[s] > 2 * total[s]}
        if not over:
            break
        closed |= over
    own = collections.Counter((r[0], r[3]) for r in ROWS)
    for r in rows:
        assert any(r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 for s in {x[3] for x in ROWS if x[0] == r["doc_id"]})
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(rows) == sum(own.values())
    many = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    got = mixing.reports(many).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 6 for r in got)
    assert mixing.taken(docs).columns == docs.columns


def test_clashing_columns_and_ids_of_text(spark):
    """Columns named like the operators' own, ids of text, and repeated rows go through every stage unharmed."""
    odd = ["_size", "_total", "_id", "_node", "_k1", "_ranges", "_q", "_key", "_copies", "x0", "c0"]
    rows = [(f"d{i}", t, "en", "s", len(t or ""), *[f"{c}{i}" for c in odd]) for i, t in enumerate([None, "", prose(150), LONG, LONG, prose(300) + " " + LONG])]
    rows += [rows[3]] * 50
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in odd))
    same = lambda out: {tuple(r[5:]) for r in out} <= {tuple(r[5:]) for r in rows}
    once = simhash.survivors(df, **simhash.STAGE)
    kept = [tuple(r) for r in once.collect()]
    assert once.columns == df.columns and same(kept) and sorted(r[0] for r in kept) == ["d0", "d2", "d3", "d5"]
    cut = suffix_dedup.cleaned(df)
    found = [tuple(r) for r in cut.collect()]
    assert cut.columns == df.columns and same(found) and [r[1] for r in found if r[0] == "d3"] == [LONG] * 51 and all(r[0] != "d4" for r in found) and all(r[4] == len(r[1] or "") for r in found)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.reports(df).collect()}["d3"] == len(LONG.encode())
    taken = mixing.taken(df)
    again = [tuple(r) for r in taken.collect()]
    assert taken.columns == df.columns and same(again) and sorted(again, key=repr) == sorted(map(tuple, taken.collect()), key=repr)
    good = quality_rules.kept(df)
    assert good.columns == df.columns and same([tuple(r) for r in good.collect()])
    assert packing.packed(df, tokenizer_path()).where("start = 0").count() == len(rows)


def test_taken_orders_rows_of_one_id(spark):
    rows = [(1, f"{w} {w}", "s") for w in "abcdefghij"]
    texts = lambda parts: sorted(r["text"] for r in mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect())
    assert texts(1) == texts(5)


def test_quality_rules(docs, none):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.reports(docs).collect())
    want = collections.Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        w = t.split()
        windows = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = len({k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)})
        lines = [x for x in t.split("\n") if x.split()]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))] += 1
    assert got == want and quality_rules.reports(none).count() == 0 and quality_rules.kept(docs).columns == docs.columns


def test_every_language_has_its_reference(spark):
    import duckdb

    rng = np.random.default_rng(3)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(130))
    rows = [(i, text("abcdefgh"), f"l{i % 70}") for i in range(140)] + [(200, text("бвгджзклмн"), "rare"), (201, text("abc"), ""), (202, text("abc"), None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.reports(documents).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(quality_rules.SQL)
    names = [d[0] for d in found.description]
    for row in map(lambda r: dict(zip(names, r)), found.fetchall()):
        own = got[row["doc_id"]]
        assert own["kept"] == row["kept"] and abs(own["character_distance"] - row["character_distance"]) < 1e-8 and abs(own["word_distance"] - row["word_distance"]) < 1e-8
    assert got[200]["kept"] and 200 in {r["doc_id"] for r in quality_rules.kept(documents).collect()}


def test_verdicts_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_rules.reports(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, junk = rows.where("quality = 1"), rows.where("quality = 0")
    assert good.where("kept").count() == good.count() and junk.where("not kept").count() >= junk.count() / 3


def test_jensen_shannon(spark):
    row = spark.createDataFrame([([1, 0], [0, 3], [2, 2], [0, 0])], "a array<long>, b array<long>, c array<long>, d array<long>")
    js = lambda x, y: quality_rules.js_distance(F.col(x), F.col(y))
    far, same, half, empty = row.select(js("a", "b"), js("c", "c"), js("a", "c"), js("a", "d")).first()
    p, q = np.array([1.0, 0]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = np.sqrt((np.log2(1 / m[0]) + (q * np.log2(q / m)).sum()) / 2)
    assert (far, same, empty) == (1.0, 0.0, 0.0) and abs(half - want) < 1e-12


def test_sharding(docs, none, spark):
    assert sharding.reports(none).count() == 0
    many = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 9).cast("int"))).alias("text")).withColumnRenamed("id", "doc_id")
    for df, n, tolerance in ((docs.select("doc_id", "text"), len(ROWS), None), (many, 5000, 0.02)):
        rows = sharding.reports(df).collect()
        assert len(rows) == n
        shards = collections.defaultdict(list)
        texts = collections.defaultdict(set)
        own = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == own
        for r in rows:
            shards[r["shard"]].append(r)
            texts[(r["size"], r["text_crc32"])].add(r["shard"])
        assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values()) and all(len(x) == 1 for x in texts.values())
        if tolerance:
            sizes = [sum(r["size"] for r in x) for x in shards.values()]
            assert len(sizes) == 8 and max(sizes) - min(sizes) <= tolerance * sum(sizes) / 8


def test_licences(docs, none):
    rows = {r["doc_id"]: r for r in licences.reports(docs).collect()}
    r = rows[10]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (9, 3, 3, 7, "apache,mit", "apache,mit") and 0 < r["score"] <= 1
    assert rows[0]["n_words"] == 0 and rows[0]["labels"] == "" and rows[0]["first_word"] is None and licences.reports(none).count() == 0
    scan = licences.Scanner().scan
    assert scan("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")[5] == "apache,gpl,mit"
    assert scan("SPDX-License-Identifier: MIT OR OR")[5] == "" and scan("mit licenses, xmit license")[1] == 0
    assert scan("MIT  Lic" + "ense MIT license")[1:4] == (2, 0, 2) and scan("under CC-BY-NC 4.0")[4:6] == ("cc-by", "cc-by,cc-by-nc")
    postfix = lambda x: licences.postfix(x.replace("(", "( ").replace(")", " )").split())
    assert postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert all(postfix(x) is None for x in ("", "(a", "a)", "a b", "or a", "a or", "()"))


@pytest.mark.parametrize("text,labels,score,terms,openness", [
    ("<!-- SPDX-License-Identifier: MIT -->", "mit", 1.0, "mit", 0.9),
    ("SPDX-License-Identifier: MIT (see LICENSE)", "mit", 1.0, "mit", 0.9),
    ("x\nSPDX-License-Identifier: MIT.\ny", "mit", 1.0, "mit", 0.9),
    ("SPDX-License-Identifier: banana", "", 0.0, "", None),
    ("SPDX-License-Identifier: MIT OR GPL-2.0", "gpl,mit", 0.875, "mit gpl or", 0.9),
    ("SPDX-License-Identifier: MIT AND GPL-2.0", "gpl,mit", 1.0, "mit gpl and", 0.3),
    ("/* SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 */", "gpl", 1.0, "gpl classpath-exception-2.0 with", 0.5),
    ("SPDX-License-Identifier: MIT AND new-1.0", "mit", 1.0, "mit new-1.0 and", 0.0),
    ("(SPDX-License-Identifier: ISC) then SPDX-License-Identifier: LicenseRef-own", "isc,licenseref", 1.0, "isc; licenseref", 0.0),
])
def test_licence_tags(text, labels, score, terms, openness):
    assert licences.Scanner().scan(text)[5:] == (labels, score, terms, openness)


def test_licence_phrases_against_every_place():
    import re

    scan, rng = licences.Scanner().scan, np.random.default_rng(8)
    parts = ["gnu", "General", "public", "LICENSE", "apache", "cc", "by", "mit", "é", "nc", "the", "bsd"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", "-", ".\n", "", "  "]) for _ in range(rng.integers(0, 60)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
        found = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        more = {label for phrase, label in licences.MORE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()}
        at = [i for i, _ in found]
        base = {label for _, label in found}
        assert scan(text)[:6] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)))


def test_neighbours_of_unequal_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 12)) * rng.lognormal(0, 0.7, (4000, 1))
    x[:40] *= 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in kmeans_tree.neighbours(df, every=40, sample=2000).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q, near in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(near & set(np.argsort(-s)[:20].tolist()))
    assert len(found) == 100 and all(len(v) == 20 for v in found.values()) and hits >= 0.9 * 2000


def test_a_query_opens_leaves_until_they_hold_enough():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(2000, 4)) * 0.01, rng.normal(size=(70, 4)) * 50])
    tree = kmeans_tree.grown(x)
    held = np.bincount(tree.assign(x), minlength=len(tree.bins))
    opened = tree.visits(x[-1], 1, held, 21)
    assert held[opened].sum() >= 21 and tree.visits(x[-1], 1) == opened[:1]


def test_neighbours(spark):
    x = RNG.normal(size=(1500, 16))
    x[100:700] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (None, x[0].tolist(), 1), (2060, [1.0] * 3, 1), (2080, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long").repartition(4)
    got = kmeans_tree.neighbours(df, sample=1000).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, near in found.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        assert near == sorted(near, key=lambda p: (-p[1], p[0])) and all(abs(s[i] - v) < 1e-12 for i, v in near)
        hits += len({i for i, _ in near} & set(want.tolist()))
    assert hits / (20 * len(found)) >= 0.9
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert kmeans_tree.neighbours(empty).count() == 0 and [tuple(r) for r in kmeans_tree.neighbours(few).collect()] == [(0, 1, 1, 0.5)]


def _by_hand(model, counts, text):
    """log_prob of a text by loops over its tokens and all tokens of the network."""
    t, net, (k, side) = model.tokens, model.net, (model.tokens.edge, pseudo_likelihood.SIDE)
    ws = (text or "").encode().lower().split()
    own = {w: x for w, x in t.known.items() if x >= 0}
    of = lambda w: own.get(w, t.of_bucket[pseudo_likelihood.word_hash(w) % len(t.of_bucket)])
    line = [k] * side + [int(of(w)) for w in ws] + [k] * side
    total = 0.0
    for i, w in enumerate(ws):
        seen = np.concatenate([net.embed[x] for x in line[i : i + side] + line[i + side + 1 : i + 2 * side + 1]]).astype(float)
        hidden = np.tanh(seen @ net.inner[:-1] + net.inner[-1])
        kind = np.exp(net.kind[:, :-1] @ hidden + net.kind[:, -1])
        word = np.exp(net.word[:, :-1] @ hidden + net.word[:, -1])
        share = np.concatenate([kind[c] / kind.sum() * word[a:b] / word[a:b].sum() for c, (a, b) in enumerate(zip(t.starts, t.starts[1:]))])
        assert abs(share.sum() - 1) < 1e-6
        total += np.log(share[line[i + side]])
        if w not in own:
            bucket = pseudo_likelihood.word_hash(w) % len(t.of_bucket)
            total += np.log(counts.get(w, 0.5) / max(0.5, sum(n for x, n in counts.items() if x not in own and pseudo_likelihood.word_hash(x) % len(t.of_bucket) == bucket)))
    return len(ws), total


def test_pseudo_likelihood(docs, none):
    table = pseudo_likelihood.word_counts(docs).persist()
    counts = {bytes(r["word"]): r["n"] for r in table.collect()}
    assert counts == collections.Counter(w for _, t, *_ in ROWS for w in (t or "").encode().lower().split())
    model = pseudo_likelihood.fit(docs, table, 8, 4, 4)
    rows = collections.defaultdict(list)
    for r in pseudo_likelihood.reports(docs, model, table).collect():
        rows[r["doc_id"]].append(r)
    assert sum(map(len, rows.values())) == len(ROWS) and len(rows[4]) == 2
    for i, t, *_ in ROWS:
        n, total = _by_hand(model, counts, t)
        for r in rows[i]:
            assert r["n_tokens"] == n and abs(r["log_prob"] - total) < 1e-3 * max(1, n) and (r["mean_log_prob"] is None) == (n == 0)
    assert pseudo_likelihood.reports(none).count() == 0


def test_order_is_told_from_shuffles(spark):
    rng = np.random.default_rng(2)
    line = lambda: " ".join(f"{'abcdefgh'[(s + j) % 8]}{rng.integers(0, 3)}" for s in (int(rng.integers(0, 8)),) for j in range(80))
    train = spark.createDataFrame([(i, line()) for i in range(400)], "doc_id long, text string").repartition(2)
    model = pseudo_likelihood.fit(train, pseudo_likelihood.word_counts(train), 24, 2, 4)
    held = [line() for _ in range(20)]
    own = [model.score(t)[1] / 80 for t in held]
    mixed = [model.score(" ".join(rng.permutation(t.split())))[1] / 80 for t in held]
    assert min(own) > max(mixed) + 0.5


def test_quality_classifier(spark, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = quality_classifier.reports(docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0"), "doc_id")
    row = held.agg(F.avg(((F.col("p_quality") >= 0.5).cast("int") == F.col("quality")).cast("int")).alias("q"), F.avg(((F.col("p_toxic") >= 0.5).cast("int") == F.col("toxic")).cast("int")).alias("t"), F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("clean")).first()
    assert row["q"] > 0.93 and row["t"] > 0.93 and row["clean"] > 0.97
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    small = spark.createDataFrame(ROWS, SCHEMA)
    assert quality_classifier.reports(none, nothing).count() == 0 and quality_classifier.reports(small, nothing).count() == len(ROWS)


def test_labels_of_long_texts(spark):
    texts = ["calm " * 4200 + ("poison" if i % 2 else "water") for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    fitted = quality_classifier.fit(docs, labels)
    assert fitted.evidence(texts[1])[1] > 0 > fitted.evidence(texts[0])[1]
