"""The dealt operators against SQL, brute force, the tokenizers library and planted cases."""

import hashlib
import itertools
import math
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from gridloom.llm import ann, audit, bpe, licenses, mixing, prefixes, quality, simhash, suffix, toxicity, urls, warc
from gridloom.llm import jaccard as join
from gridloom.llm import queries as Q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def odd_texts():
    long = " ".join(f"wort{i % 977}" for i in range(60_000))
    return [None, "", " \n\t", "one", "two words", "Ünï cödé — “q” 日本語 <|endoftext|> it's 42nd  x", long, long, "same text here " * 30, "same text here " * 30, "a\x1fb\x85c d ab", "x" * 500]


@pytest.fixture(scope="session")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in con.execute(Q.ORACLE_SQL[name]).description]
    got = [tuple(r) for r in Q.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bpe_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary())
    tok.no_truncation()
    tok.no_padding()
    every = [t for _, t in texts] + odd_texts()
    got = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, every), Q.vocabulary(), ["doc_id"]).collect()}
    for i, text in enumerate(every):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids
        assert got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)


def brute_fingerprint(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_is_brute_force(spark, texts):
    every = [t for _, t in texts] + [t for t in odd_texts() if not t or len(t) < 10_000]
    bits = [brute_fingerprint(t) for t in every]
    label = components(len(every), lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, every)).collect()}
    assert [got[i]["fingerprint"] & (1 << 64) - 1 for i in range(len(every))] == bits
    assert [got[i]["component_id"] for i in range(len(every))] == label


def test_simhash_links_within_groups_of_many(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    bits = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))})
    label = components(len(bits), lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 3)
    links = simhash.links(spark.createDataFrame([(b,) for b in bits], "fingerprint long")).collect()
    at = {b: i for i, b in enumerate(bits)}
    pairs = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    assert components(len(bits), lambda i, j: (i, j) in pairs) == label


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_keep_one_keeps_one_of_similar_texts(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 4000, 250)] for _ in range(20)]
    every = []
    for words in base:
        every += [" ".join(words)] * 2
        for k in range(4):  # copies with single words changed: similarity over 0.8
            copy = list(words)
            for p in rng.integers(0, 250, 4):
                copy[p] = f"n{k}{p}"
            every.append(" ".join(copy))
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, every)).collect()}
    assert kept == {i * 6 for i in range(20)}


def five_word_sets(every):
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (split(t.lower()) for t in every)]


def test_keep_one_is_exact_at_its_limit(spark, monkeypatch):
    """Pairs just below and above 0.8, a copy with a passage repeated, and a chain of texts, in large and in small blocks."""
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    every = []
    for k in range(120):  # the last words differ: similarity (256 - n) / (256 + n), from 0.70 to 0.86
        words, n = fresh(260), 20 + k % 25
        every += [" ".join(words), " ".join(words[: 260 - n] + fresh(n))]
    for _ in range(10):
        words = fresh(300)
        every += [" ".join(words), " ".join(words[:150] + words[126:150] * 10 + words[150:])]
    words = fresh(2000)
    every += [" ".join(words[30 * k : 30 * k + 400]) for k in range(40)]
    sets = five_word_sets(every)
    label = components(len(every), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    for group in (1024, 4):
        monkeypatch.setattr(simhash, "GROUP", group)
        assert {r["doc_id"] for r in simhash.keep_one(docs_of(spark, every)).collect()} == set(label)


def test_similar_in_groups_of_many(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 4)
    rng = np.random.default_rng(6)
    bits = rng.integers(-(1 << 62), 1 << 62, (3, 8))
    rows = []
    for b in bits:
        for _ in range(20):
            x = b.copy()
            for p in rng.integers(0, 400, 20):
                x[p // 50] ^= 1 << int(p % 50)
            rows.append((len(rows), x.tolist(), [7]))
    links = simhash.similar_links(spark.createDataFrame(rows, "node long, bits array<long>, keys array<long>"), 60).collect()
    pairs = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    assert components(60, lambda i, j: (i, j) in pairs) == [i // 20 * 20 for i in range(60)]


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


def test_suffix_is_brute_force(spark, texts):
    passage = "a passage that many texts share, " * 12
    every = [t for _, t in texts][:120] + ["", None, "é" * 150 + passage, "head " + passage + "tail", passage, "ab" * 300, passage + " x " + passage]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs_of(spark, every), ["doc_id"]).collect()}
    want = brute_repeats(every)
    assert [hashlib.sha256(bytes(got[i]["kept"])).hexdigest() for i in range(len(every))] == [hashlib.sha256(w).hexdigest() for w in want]
    for i, t in enumerate(every):
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert sum(s["length"] for s in got[i]["spans"]) == got[i]["n_bytes"] - len(want[i])


def test_suffix_passage_with_many_borders(spark):
    """Runs at the borders of one passage differ in each text, and some agree for a few more bytes."""
    rng = np.random.default_rng(11)
    passage = "".join(rng.choice(list("abcdefghij klmnop"), 260))
    ends = ["".join(rng.choice(list("xy"), n)) for n in rng.integers(0, 180, 120)]
    every = [ends[i] + passage + ends[-1 - i] for i in range(60)] + [ends[3] + passage[:220], passage[40:] + ends[5], ends[3] + passage[:220]]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(docs_of(spark, every), ["doc_id"]).collect()}
    assert [got[i] for i in range(len(every))] == brute_repeats(every)


def test_suffix_over_any_partitions(spark):
    """Runs of one sample at the borders of range partitions, in groups of one to many, whatever the number of partitions."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdé"), 3)) for _ in range(50)]
    text = lambda n: " ".join(rng.choice(words, n))
    bases, every = [text(400) for _ in range(6)], []
    for _ in range(100):
        b, at = bases[rng.integers(6)], int(rng.integers(0, 1200))
        every.append(text(int(rng.integers(0, 60))) + b[at : at + int(rng.integers(0, 500))] + text(int(rng.integers(0, 60))) + b[: int(rng.integers(0, 260))])
    docs, was = docs_of(spark, every), spark.conf.get("spark.sql.shuffle.partitions")
    for length, partitions in ((50, 7), (50, 8), (203, 9), (8, 1)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(docs, ["doc_id"], length=length).collect()}
        assert [got[i] for i in range(len(every))] == brute_repeats(every, length)
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_suffix_repeated_rows_are_linear(spark):
    """A row repeated many times lists its runs once, and loses its text with its copies."""
    rng = np.random.default_rng(11)
    text = " ".join(f"w{rng.integers(10**6)}" for _ in range(250))
    sizes = []
    for n in (2, 300):
        docs = spark.createDataFrame([(1, text)] * n + [(2, "short")], "doc_id long, text string")
        keyed = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "text")
        sizes.append([r["n"] for r in suffix.repeats(keyed).select(F.size("runs").alias("n")).collect()])
        assert {(r["doc_id"], len(r["kept"])) for r in suffix.remove_repeats(docs, ["doc_id"]).collect()} == {(1, 0), (2, 5)}
    assert sizes[0] == sizes[1] and len(sizes[0]) == 1


def test_suffix_text_longer_than_a_block(spark):
    rng = np.random.default_rng(3)
    fill = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    part, passage = 1 << 20, fill(700)
    every = [fill(part - 350) + passage + fill(1000), fill(50) + passage[:420] + fill(300) + passage[500:], fill(part - 200) + passage[100:300] + fill(200)]
    got = {r["doc_id"]: (bytes(r["kept"]).decode(), [(s["first"], s["length"]) for s in r["spans"]]) for r in suffix.remove_repeats(docs_of(spark, every), ["doc_id"]).collect()}
    assert got[0][1] == [(part - 350, 700)] or got[0][1] == [(part - 350, 420), (part - 350 + 500, 200)]
    assert got[1][1] == [(50, 420), (770, 200)] and got[2][1] == [(part - 200, 200)]


def test_suffix_whole_characters(spark):
    shared = "é" * 99 + "ab"  # 200 bytes
    every = ["xä" + shared + "ö", "yäé" + shared + "ü"]
    for r in suffix.remove_repeats(docs_of(spark, every), ["doc_id"], characters=True).collect():
        bytes(r["kept"]).decode()


def brute_nearest(ids, x, k=5):
    u = np.array([v / np.abs(v).max() for v in x])
    u /= np.linalg.norm(u, axis=1)[:, None]
    out = {}
    for i in range(len(ids)):
        if ids[i] % 50 == 0 and ids[i] not in out:
            cos = u @ u[i]
            seen = {}
            for j in np.lexsort((ids, -cos.round(12))):
                if ids[j] != ids[i]:
                    seen.setdefault(int(ids[j]), cos[j])
            out[int(ids[i])] = list(seen.items())[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    frame = rows.toPandas()
    x = np.array(frame["embedding"].tolist(), np.float64)
    want = brute_nearest(frame["vec_id"].to_numpy(), x)
    found, hits = defaultdict(list), 0
    for r in sorted(ann.nearest(rows, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
        for v, cos in want[r["query_id"]]:
            assert v != r["vec_id"] or abs(r["score"] - cos) < 1e-12
    for q, near in want.items():
        assert len(found[q]) == 5
        hits += len({v for v, _ in near} & set(found[q]))
    assert hits / (5 * len(want)) >= 0.9


def test_ann_probes_a_share_of_the_rows():
    """The index prunes: on vectors without structure, where that is hardest, few rows are retrieved, and nearly all true neighbours."""
    rng = np.random.default_rng(4)
    u = ann.unit(rng.normal(size=(4000, 64)))
    near = np.argsort(-(u @ u[:300].T), axis=0)[1:6].T
    book = ann.learn(u)
    ann.set_radii(book, np.repeat(u[:100], 5, axis=0), u[near[:100].ravel()])
    codes, reach = book.encode(u), book.reach(ann.BITS // ann.WIDTH)
    probed = np.array([(np.bitwise_count(codes ^ codes[i]) <= reach).any(axis=1) for i in range(100, 300)])
    assert probed.mean() < 0.4
    assert np.take_along_axis(probed, near[100:300], axis=1).mean() > 0.92
    apart = np.bitwise_count(codes[None, :, :] ^ codes[100:300, None, :]).sum(axis=2)
    assert probed[apart <= book.radius].all()  # the pigeonhole principle


def test_ann_odd_rows(spark):
    """No direction, huge and tiny components, ties, repeated rows and ids, small tables."""
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, None]), (7, [-1.0, 0.0]), (8, [1e200, 1e200]), (4, [1.0, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (10, [1e-300, 1e-310]), (50, [1e200, 1e199]), (50, [1e200, 1e199]), (0, [0.0, 1.0])]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)), F.col("vec_id") % 50 == 0).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    half = round(0.5**0.5, 9)
    # of the two vectors of id 0, the least is asked for
    assert got[0] == [(4, half), (5, half), (8, half), (50, round(0.1 / 1.01**0.5, 9)), (10, 0.0)]
    # 8 points where 4 and 5 do, but for the rounding of its components
    assert [v for v, _ in got[50]][:2] == [10, 0] and {v for v, _ in got[50]} == {10, 0, 4, 5, 8}


def test_ann_tells_of_cut_codes(monkeypatch):
    """Near copies: where a group's nearest do not hold all codes within the radius, the query is marked; else all of them are found."""
    rng = np.random.default_rng(6)
    codes = np.zeros((40, ann.BITS // ann.WIDTH), np.uint16)
    codes[np.arange(40), rng.integers(1, codes.shape[1], 40)] = 1 << rng.integers(0, ann.WIDTH, 40)
    codes[0] = 0
    rows = pd.DataFrame({"place": 0, "head": 0, "node": np.arange(40), "code": [c.tobytes() for c in codes]})
    book = ann.Codebook(np.zeros(2), np.zeros((2, ann.BITS)), radius=8)
    for nearest, want in ((40, set(range(40))), (2, set(range(40))), (1, {0, ann.CUT})):  # 39 are equally near
        monkeypatch.setattr(ann, "NEAREST", nearest)
        assert set(ann._probe(rows.iloc[:1], rows, book, 0)["node"]) == want


def test_ann_leaves_nothing_out_within_the_loose_radius():
    """A group with more codes between the two radii than a query takes marks the query too."""
    codes = np.zeros((9, ann.BITS // ann.WIDTH), np.uint16)
    for i in range(1, 9):
        codes[i, 1 : i + 1] = 0xFFFF  # 16 * i bits away
    rows = pd.DataFrame({"place": 0, "head": 0, "node": np.arange(9), "code": [c.tobytes() for c in codes]})
    book = ann.Codebook(np.zeros(2), np.zeros((2, ann.BITS)), radius=8, loose=64)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "NEAREST", 5)
        assert set(ann._probe(rows.iloc[:1], rows, book, 0)["node"]) == set(range(5))  # all within the loose radius
        patch.setattr(ann, "NEAREST", 4)
        assert ann.CUT in set(ann._probe(rows.iloc[:1], rows, book, 0)["node"])


@pytest.mark.parametrize("spread", [0.02, 0.3, None])
def test_ann_recall_in_clusters(spark, spread):
    """8,000 rows: clusters of 400, tight, or such that members lie between the two radii, beside lone vectors; or no clusters."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8000, 64))
    if spread:
        x[:4000] = np.repeat(rng.normal(size=(10, 64)), 400, axis=0) + spread * x[:4000]
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": rng.permutation(8000), "embedding": x.tolist()}))
    frame = rows.toPandas()
    want = brute_nearest(frame["vec_id"].to_numpy(), np.array(frame["embedding"].tolist()))
    found = defaultdict(set)
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert sum(len(found[q] & {v for v, _ in near}) for q, near in want.items()) / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("cut", [False, True])
def test_ann_compares_all_rows_where_few_are_found_or_some_are_cut(spark, monkeypatch, cut):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]

    def candidates(nodes, asked, n, sample, k):
        asked = asked.select(F.col("node").alias("asked"))
        some = asked.crossJoin(nodes.select("node").orderBy("node").limit(10)).union(asked.withColumn("node", F.lit(ann.CUT)))
        return some if cut else asked.withColumn("node", F.col("asked"))

    monkeypatch.setattr(ann, "_candidates", candidates)
    want = brute_nearest(np.arange(300), np.array([v for _, v in rows]))
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == {q: [v for v, _ in near] for q, near in want.items()}


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = mixing.mix(docs, keep=["doc_id", "source"]).toPandas()
    again = mixing.mix(docs.repartition(7), keep=["doc_id", "source"]).toPandas()
    assert frame.set_index("doc_id")["taken"].to_dict() == again.set_index("doc_id")["taken"].to_dict()
    sizes = frame.groupby("source")["size"].sum().to_dict()
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left, open_ = left - sum(target[s] for s in full), open_ - full if full else set()
    for s, g in frame.groupby("source"):
        assert abs(g["target"].iloc[0] - target[s]) < 1e-6
        assert g["taken"].sum() == int(target[s] + 1e-9)
        assert (g["taken"] <= 2 * g["size"]).all()


def test_mix_deals_blocks_by_the_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dealt = {}
    for shards, seed in ((1, 42), (4, 42), (4, 7)):
        rows = mixing.mix(docs, keep=["doc_id", "source"], shards=shards, block_words=64, seed=seed).collect()
        per = Counter()
        for r in rows:
            for p in r["pieces"]:
                assert 0 <= p["shard"] < shards
                per[p["shard"]] += p["words"]
        dealt[shards, seed] = per
        total = sum(r["taken"] for r in rows)
        assert sum(per.values()) == total
        for n in per.values():  # documents lie whole where they begin: a shard is off by a few
            assert abs(n - total / shards) < 0.25 * total
    assert dealt[4, 42] != dealt[4, 7]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotas_add_up(spark, seed):
    sources = spark.createDataFrame([("a", 5000.0), ("b", 1999.5), (None, 700.0), ("c", 0.0)], "source string, target double")
    rows = mixing.shard_quotas(sources, 8, 10, seed).collect()
    ends = np.array([[max([q["upto"] for q in r["quotas"] if q["shard"] <= shard], default=0) for shard in range(8)] for r in rows])
    assert all(q["n"] > 0 for r in rows for q in r["quotas"])
    blocks = np.array([r["blocks"] for r in rows])
    assert (ends[:, -1] == blocks).all() and (np.diff(ends, axis=1) >= 0).all()
    shards = np.diff(np.concatenate([np.zeros((4, 1), int), ends], axis=1), axis=1).sum(axis=0)
    assert shards.max() - shards.min() <= 3 and shards.sum() == blocks.sum()
    own = ends[[r["source"] for r in rows].index("a")]
    assert np.diff(own).std() > 0  # drawn, not cut evenly


@pytest.mark.parametrize("fan_bits", [2, 3])
def test_quotas_of_groups_of_sources_add_up(spark, fan_bits):
    """Sources in groups of groups: every source and every shard gets exactly its blocks, drawn and not cut evenly."""
    sources = spark.range(100).select(F.format_string("s%03d", "id").alias("source"), (F.col("id") % 7 * 100).cast("double").alias("target"))
    rows = mixing.shard_quotas(sources, 8, 10, 3, fan_bits=fan_bits).collect()
    assert len(rows) == 100
    shards = Counter()
    for r in rows:
        assert r["blocks"] == int(r["source"][1:]) % 7 * 10 == sum(q["n"] for q in r["quotas"])
        assert [q["upto"] for q in r["quotas"]] == np.cumsum([q["n"] for q in r["quotas"]]).tolist()
        for q in r["quotas"]:
            shards[q["shard"]] += q["n"]
    assert max(shards.values()) - min(shards.values()) <= 3 and len(shards) == 8
    # a source of 60 blocks gets 7.5 a shard; the variance of a hypergeometric count, not of an even cut
    got = np.array([q["n"] for r in rows if r["blocks"] == 60 for q in r["quotas"]])
    assert 1 < got.std() < 4


def test_mix_by_host(spark):
    """20,000 sources, a third of the rows in one of them: targets, sizes and shards hold for each."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 30_000)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    mixed = mixing.mix(docs, keep=["doc_id", "source"], shards=32, block_words=4, bucket_rows=5_000)
    took = mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.first("source_size").alias("source_size"))
    found = took.toPandas()
    assert len(found) == 20_001 and (found["size"] == found["source_size"]).all()
    assert (found["taken"] == np.floor(found["target"])).all()
    pieces = mixed.select(F.explode("pieces").alias("p")).select("p.*")
    assert pieces.where("shard is null or shard not between 0 and 31").isEmpty()
    words = pieces.groupBy("shard").agg(F.sum("words").alias("n")).toPandas()["n"]
    assert len(words) == 32 and words.max() < 1.5 * words.min()


def test_mix_is_a_placing_in_python(spark):
    """The whole operator against lists: targets by filling, exact hypergeometric draws of the same uniform numbers, streams laid out word by word."""
    from fractions import Fraction

    sizes = [(i, ["x", "y", None, "z"][i * i % 4 if i % 3 else i % 4], 1 + i * 7 % 23) for i in range(300)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in sizes], "doc_id long, source string, text string")
    shards, words, seed = 8, 16, 42
    order = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, t, n in sizes if t == s) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(total.values()), list(order), {}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[t] for t in open_) > 2 * total[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
            break
        target |= {s: Fraction(2 * total[s]) for s in over}
        left, open_ = left - sum(2 * total[s] for s in over), [s for s in open_ if s not in over]
    blocks = {s: math.ceil(math.floor(target[s]) / words) for s in order}
    drawn = spark.createDataFrame([(v, k, s) for v in range(3) for k in range(1 << v) for s in order], "level int, node long, source string")
    u = {(r["level"], r["node"], r["source"]): r["u"] for r in drawn.withColumn("u", mixing.unit_hash(seed, F.col("level"), F.col("node"), F.col("source").isNull(), F.col("source"))).collect()}
    nodes = {0: dict(blocks)}
    for level in range(3):
        below = {}
        for node, have in nodes.items():
            n, got = sum(have.values()), {}
            d = -(-n // 2)
            for s in order:
                k, reached = have[s], Fraction(0)
                for x in range(max(0, d + k - n), min(k, d) + 1):
                    reached += Fraction(math.comb(k, x) * math.comb(n - k, d - x), math.comb(n, d))
                    if reached > u[level, node, s]:
                        break
                got[s], n, d = x, n - k, d - x
            below[2 * node], below[2 * node + 1] = got, {s: have[s] - got[s] for s in order}
        nodes = below
    place = {s: [shard for shard in range(shards) for _ in range(nodes[shard][s])] for s in order}
    named = spark.createDataFrame([(s is None, s or "") for s in order], "none boolean, of string")
    for r in named.withColumn("u", mixing.unit_hash(seed + 2, "none", "of")).collect():
        s = None if r["none"] else r["of"]
        turn = math.floor(r["u"] * blocks[s])
        place[s] = place[s][turn:] + place[s][:turn]
    keys = {r["doc_id"]: r["key"] for r in docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")).collect()}
    want = {}
    for s in order:
        at = 0
        for i, _, n in sorted((x for x in sizes if x[1] == s), key=lambda x: (keys[x[0]] % 64, keys[x[0]])):
            firsts = [(p, at + p * total[s]) for p in range(3)]
            want[i] = [(p, place[s][lo // words], min(n, math.floor(target[s]) - lo)) for p, lo in firsts if lo < math.floor(target[s])]
            at += n
    got = {r["doc_id"]: [(p["pass"], p["shard"], p["words"]) for p in r["pieces"]] for r in mixing.mix(docs, keep=["doc_id"], shards=shards, block_words=words, seed=seed).collect()}
    assert got == want


def test_mix_texts_hold_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs, shards=4)
    want = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    place = Counter((r["doc_id"], p["words"], p["shard"]) for r in mixed.collect() for p in r["pieces"])
    got, at = Counter(), Counter()
    for r in mixing.texts(docs, shards=4).withColumn("file", F.spark_partition_id()).collect():
        n = len(split(r["text"]))
        got[r["doc_id"]] += n
        at[r["doc_id"], n, r["file"]] += 1
    assert {d: n for d, n in want.items() if n} == dict(got)
    assert at == place


def test_hypergeometric_is_a_distribution(spark):
    us = spark.range(20_000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 20_000).alias("k"))
    found = {r["k"]: r["count"] / 20_000 for r in us.groupBy("k").count().collect()}
    from math import comb

    for k in range(11):
        assert abs(found.get(k, 0) - comb(20, k) * comb(30, 10 - k) / comb(50, 10)) < 1e-3


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").selectExpr("doc_id", "toxic as bad", "case when toxic = 1 then 2 - quality else 0 end as grade")
    joined = docs.join(labels, "doc_id")
    model = toxicity.fit(joined.where("doc_id % 5 <> 0"))
    held = toxicity.score(joined.where("doc_id % 5 = 0"), model, ["doc_id", "bad"]).toPandas()
    assert (held["toxic"] == (held["bad"] > 0)).mean() > 0.9
    assert len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()


def test_toxicity_sample_is_of_ids(spark):
    """A row there 20,000 times, under the id that is first by hash, is one of the sample; the model is that of the rows once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "toxic as grade")
    once = docs.join(labels, "doc_id")
    first = once.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(1).withColumn("text", F.substring("text", 1, 500))
    rest = once.join(first.select("doc_id"), "doc_id", "left_anti")
    many = rest.unionByName(first.crossJoin(spark.range(20_000)).drop("id"))
    a, b = toxicity.fit(rest.unionByName(first), sample=400), toxicity.fit(many, sample=400)
    assert (a.keys == b.keys).all() and len(a.keys) and np.allclose(a.weights, b.weights, atol=1e-9) and a.cut == b.cut


def test_toxic_severity_is_a_dense_sum(spark):
    """The whole query: features counted and chosen with dictionaries, every document's severity summed up from the model's weights."""
    docs = duckdb.sql("SELECT d.doc_id, text, toxic, quality FROM '/root/testdata/sf0.01/documents.parquet' d LEFT JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id)").fetchall()

    def features(text):
        out, word = Counter(), bytearray()
        for c in (text or "").lower().encode() + b" ":
            if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80:
                word.append(c)
            elif word:
                out.update([xxhash.xxh64_intdigest(bytes(word)), *(xxhash.xxh64_intdigest(bytes(word[:k]), k) for k in (4, 5, 6, 7, 8) if len(word) > k)])
                word = bytearray()
        return out

    counted = {d: features(t) for d, t, _, _ in docs}
    bad, good = Counter(), Counter()
    for d, _, toxic, _ in docs:
        if toxic is not None:
            (bad if toxic else good).update(counted[d].keys())
    n_bad, n_good = sum(x[2] == 1 for x in docs), sum(x[2] == 0 for x in docs)
    picked = set()
    for key, a in bad.items():
        b = good[key]
        odds = math.log((a + 0.5) / (n_bad - a + 0.5)) - math.log((b + 0.5) / (n_good - b + 0.5))
        z = odds / math.sqrt(sum(1 / (x + 0.5) for x in (a, n_bad - a, b, n_good - b)))
        if a >= 4 and z >= 4 and odds > 2:
            picked.add(key)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "case when toxic = 1 then case when quality = 0 then 2 else 1 end else toxic end as grade")
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").join(labels, "doc_id"))
    assert set(model.keys.tolist()) == picked and picked
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    rows = {r["doc_id"]: r for r in Q.op8_toxic_severity(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(docs)
    for d, *_ in docs:
        score = sum(weight[k] * (1 + math.log(n)) for k, n in counted[d].items() if k in weight)
        p = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(rows[d]["severity"] - sum(p)) < 1e-6 and rows[d]["toxic"] == (p[0] > model.cut)


def test_toxicity_learns_grades(spark):
    """Graded rows whose severity follows from the words they hold, and the expected severity of a dense sum over grades."""
    rng = np.random.default_rng(1)
    stems = ["zorn", "grimm", "hassen"]
    rows = []
    for i in range(1500):
        g = int(rng.integers(0, 4))
        rows.append((i, " ".join([f"w{x}" for x in rng.integers(0, 300, 30)] + [w for w in stems for _ in range(int(rng.poisson(2 * g)))]), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(df.where("doc_id % 3 <> 0"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    held = toxicity.score(df.where("doc_id % 3 = 0"), model, ["doc_id"]).toPandas().set_index("doc_id")
    truth = np.array([g for i, _, g in rows if i % 3 == 0])
    found = held["severity"].loc[[i for i, _, _ in rows if i % 3 == 0]].to_numpy()
    assert np.corrcoef(found, truth)[0, 1] > 0.85
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    for i, text, _ in rows[:60:3]:
        counts = Counter(k for w in text.split() for k in toxicity._keys(w.encode()))
        score = sum(weights.get(k, 0) * (1 + np.log(n)) for k, n in counts.items())
        least = [1.0, *(1 / (1 + np.exp(t - score)) for t in model.thresholds), 0.0]
        assert abs(sum(g * (least[g] - least[g + 1]) for g in range(4)) - held["severity"].loc[i]) < 1e-9


def test_ordinal_gradient_is_the_likelihoods():
    rng = np.random.default_rng(3)
    n, f = 12, 5
    x = rng.normal(size=(n, f)) * (rng.random((n, f)) < 0.6)
    row, at = np.nonzero(x)
    grade, times = rng.integers(0, 4, n), rng.random(n) + 0.5
    grade[:4] = range(4)
    params = [rng.normal(size=f), rng.normal(size=1), rng.normal(size=2)]
    value, grads = toxicity.likelihood(*params, row, at, x[row, at], grade, times, 0.02)
    cuts = params[1][0] + np.array([0, np.exp(params[2][0]), np.exp(params[2]).sum()])
    p = 1 / (1 + np.exp(cuts[None, :] - (x @ params[0])[:, None]))
    dense = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
    want = sum(times[i] * np.log(dense[i, grade[i]] - dense[i, grade[i] + 1]) for i in range(n)) - 0.01 * params[0] @ params[0]
    assert np.isclose(value, want)
    for q, g in zip(params, grads, strict=True):
        for i in range(len(q)):
            q[i] += 1e-6
            up = toxicity.likelihood(*params, row, at, x[row, at], grade, times, 0.02)[0]
            q[i] -= 1e-6
            assert abs((up - value) / 1e-6 - g[i]) < 1e-3


def test_license_blocks(spark):
    every = ["some text\nReleased under the MIT License.\nmore", "Licensed under CC BY-SA 4.0.", "no such words here", None, "", "This work is licensed under the GNU General Public License, version 3."]
    best = {r["doc_id"]: r["template"] for r in licenses.scan(docs_of(spark, every), ["doc_id"]).where("rank = 1 and confirmed").collect()}
    assert best == {0: "mit", 1: "cc-by-sa-4.0", 5: "gpl-3.0"}


def confirmed_in(spark, every):
    found = defaultdict(list)
    for r in licenses.scan(docs_of(spark, every), ["doc_id"]).where("confirmed").orderBy("doc_id", "first").collect():
        found[r["doc_id"]].append((r["template"], every[r["doc_id"]][r["first"] : r["first"] + r["length"]]))
    return found


def test_wrapped_licenses(spark):
    """License texts in lines of 75 columns, as comments, with blank lines, and at any place of a long line."""
    prose = "the use of words that say nothing about it and are to be read by any person "
    every, want = [], []
    for k in ("mit-text", "isc", "bsd-notice", "apache-2.0-header", "gpl-3.0-header"):
        lines = textwrap.wrap(licenses.TEMPLATES[k], 75)
        every += ["Copyright (c) 2020 A\n\n" + "\n".join(lines) + "\n\n" + prose, prose + "\n" + "\n".join(" * " + x for x in lines), lines[0] + "\n\n" + "\n".join(lines[1:])]
        every += [prose * n + "copyright " * 300 + licenses.TEMPLATES[k] + " licensed" * 300 + prose * 5 for n in (0, 17, 38)]
        want += [k] * 6
    found = confirmed_in(spark, every)
    assert [[t for t, _ in found[i]] for i in range(len(every))] == [[k] for k in want]
    for i, k in enumerate(want):
        assert licenses.words(found[i][0][1]) == licenses.words(licenses.TEMPLATES[k])


def test_license_alignment_is_brute_force():
    """The least number of differing words over all stretches, against a search of all of them."""

    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
        return best[-1]

    rng = np.random.default_rng(9)
    for _ in range(60):
        want = rng.integers(0, 6, rng.integers(2, 9))
        own = np.concatenate([rng.integers(-1, 6, 8), want[rng.random(len(want)) < 0.8], rng.integers(-1, 6, 6)])
        least = min(len(want) + hi - lo - 2 * common(want.tolist(), own[lo:hi].tolist()) for lo in range(len(own) + 1) for hi in range(lo, len(own) + 1))
        n, missing, added, lo, hi = licenses.align(want, own)
        assert n == least == len(missing) + len(added)
        kept = [w for i, w in enumerate(want) if i not in missing]
        assert kept == [w for j, w in enumerate(own[lo:hi].tolist(), lo) if j not in added]


def test_whole_license_texts(spark):
    t = licenses.TEMPLATES
    wrapped = lambda *ks: "Copyright (c) 2020 A\n\n" + "\n\n".join(textwrap.fill(t[k], 75) for k in ks)
    mit, bsd, isc = ["mit-text", "mit-warranty"], ["bsd-notice", "bsd-conditions", "bsd-3-clause", "bsd-warranty"], ["isc", "isc-warranty"]
    every = [wrapped(*mit), wrapped(*bsd), wrapped(*isc)]
    found = confirmed_in(spark, every)
    assert [[k for k, _ in found[i]] for i in range(3)] == [mit, bsd, isc]
    long = " ".join(f"clause {i} of the license says that w{i} and v{i * 7} are permitted;" for i in range(400))
    parts = licenses.sections("own", long)
    assert len(parts) > 5 and " ".join(parts.values()) == long
    got = licenses.scan(docs_of(spark, [textwrap.fill("Some words first. " + long, 80)]), ["doc_id"], templates=parts).where("confirmed").orderBy("first").collect()
    assert [r["template"] for r in got] == list(parts)


def test_many_notices_in_a_block(spark):
    names = ["cc-by-4.0", "cc-by-sa-4.0", "gpl-3.0", "mit", "gpl-2.0", "apache-2.0", "mit", "mpl-2.0", "cc-by-nc-4.0"]
    notices = [licenses.TEMPLATES[k] for k in names]
    changed = licenses.TEMPLATES["gpl-3.0-header"].replace("program", "library")
    every = ["\n".join(notices), " ".join(notices), "\n".join(notices[:4]), changed + " " + licenses.TEMPLATES["mit"]]
    found = confirmed_in(spark, every)
    assert [[t for t, _ in found[i]] for i in range(4)] == [names, names, names[:4], ["gpl-3.0-header", "mit"]]


def test_every_template_is_found(spark):
    """Each template alone, with changed words, and thousands of words behind a cue of another, whether or not it holds a word of licenses."""
    prose = " ".join(f"word{i % 313}" for i in range(3000))
    rng = np.random.default_rng(3)
    every, want = [], []
    for k, t in licenses.TEMPLATES.items():
        w = t.split()
        changed = list(w)
        for p in rng.choice(len(w), max(0, int(0.1 * len(w)) - 1), replace=False):
            changed[p] = "other"
        every += [t, " ".join(changed), f"Copyright 2020 {prose} {t} {prose}"]
        want += [k] * 3
    found = confirmed_in(spark, every)
    assert [[t for t, _ in found[i]] for i in range(len(every))] == [[k] for k in want]
    assert licenses.CUE.search(licenses.TEMPLATES["isc-warranty"]) is None


def test_runs_survive_all_that_may_differ():
    rng = np.random.default_rng(5)
    for n in range(1, 80):
        some = [f"w{i}" for i in range(n)]
        runs = licenses.own_runs(some)
        assert [w for r in runs for w in r] == some
        for _ in range(20):
            gone = set(rng.choice(n, int(licenses.MOST_DIFFERENT * n), replace=False).tolist())
            assert any(r and not gone & {int(w[1:]) for w in r} for r in runs)


def test_compression_ranks_what_alignment_confirms(monkeypatch):
    """Without any reduction nothing is a candidate; other reductions change the order."""
    t = licenses.TEMPLATES
    block = f"{t['mpl-2.0']} and then some more words {t['isc']}"
    order = lambda: [x[0] for x in licenses.Scanner(t).judge(block) if x[3]]
    assert order() == ["isc", "mpl-2.0"]
    keep = licenses.Scanner.spared
    monkeypatch.setattr(licenses.Scanner, "spared", lambda self, own: {k: 500 - b if b > 0 else 0 for k, b in keep(self, own).items()})
    assert order() == ["mpl-2.0", "isc"]
    monkeypatch.setattr(licenses.Scanner, "spared", lambda self, own: dict.fromkeys(self.words, 0))
    assert licenses.Scanner(t).judge(block) == []


def test_url_rules_nest(spark):
    rules = spark.createDataFrame([("com", "/", "block"), ("a.com", "/x/", "allow"), ("b.a.com", "/x/y/", "block")], "host string, path string, verdict string")
    pages = [(0, "http://com/"), (1, "https://A.com/x/1"), (2, "http://c.b.a.com/x/y/z?q"), (3, "http://xcom/"), (4, None), (5, "nothing"), (6, "http://b.a.com/x/z"), (7, "http://aa.com#f")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got == {0: ("com/", "block"), 1: ("a.com/x/", "allow"), 2: ("b.a.com/x/y/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("a.com/x/", "allow"), 7: (None, "allow")}


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [(1, "http://a.org/p", 1, "response", h(ETag='"x"', Server="s")), (2, "https://www.a.org/p/", 5, "revisit", h(etag='W/"x"', date="d", server="t")), (3, "http://a.org/p", 6, "response", h(ETag='"y"')), (4, "http://a.org/p", 7, "revisit", h(ETag='"x"')), (5, "http://b.org", 1, "revisit", None), (6, None, 1, "revisit", None), (7, "http://a.org/p#f", 8, "revisit", {})]
    got = {r["record_id"]: (r["refers_to"], r["state"], r["headers"]) for r in warc.resolve(spark.createDataFrame(rows, "record_id long, url string, time long, type string, headers map<string,string>")).collect()}
    assert got[2] == (1, "matched", {"etag": 'W/"x"', "server": "s", "date": "d"})
    assert got[4][:2] == (None, "mismatched") and got[5][1] == "missing" and got[6][1] == "missing" and got[7][:2] == (3, "unverified")


def test_archive_records_are_read(spark):
    def record(id, kind, uri, date, *http):
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{id}>", *([f"WARC-Target-URI: {uri}"] if uri else []), f"WARC-Date: {date}", "Content-Length: 9"]
        return "\r\n".join(head) + "\r\n\r\n" + "\r\n".join(http) + ("\r\n\r\nbody: of the page" if kind == "response" else "")

    raw = [
        record("a", "response", "http://a.org/p", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK", 'ETag: "x"', "Server: s", "Server: t:1"),
        record("b", "revisit", "https://www.a.org/p/", "2020-02-01T00:00:00Z", "HTTP/1.1 304 Not Modified", 'etag: W/"x"', "Date: d"),
        record("c", "revisit", "", "2020-02-01T00:00:00Z", "HTTP/1.1 304 Not Modified"),
        record("d", "warcinfo", "", "2019-01-01T00:00:00Z"),
        None,
        "",
    ]
    records = warc.read_records(spark.createDataFrame([(r,) for r in raw], "record string"))
    assert records.count() == 6
    got = {r["record_id"]: (r["refers_to"], r["state"], r["headers"]) for r in warc.resolve(records).collect()}
    assert got == {"<b>": ("<a>", "matched", {"etag": 'W/"x"', "server": "t:1", "date": "d"}), "<c>": (None, "missing", None)}


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_revisits_with_repeated_names_and_rows(spark, partitions):
    rows = [(1, "http://a.org/p", 1, "response", {"ETag": '"x"', "etag": '"y"', "Date": "d1"}), (2, "http://a.org/p", 2, "revisit", {"ETAG": '"x"', "Etag": '"y"', "date": "d2"}), (2, "http://a.org/p", 2, "revisit", {"ETAG": '"x"', "Etag": '"y"', "date": "d2"})]
    rows += [(k, None, k, "revisit" if k % 2 else "response", {"ETag": '"x"'}) for k in range(10, 20)]
    df = spark.createDataFrame(rows, "record_id long, url string, time long, type string, headers map<string,string>").withColumn("last", F.lit(1)).withColumn("pid", F.lit(0))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = [(r["record_id"], r["refers_to"], r["state"], r["headers"]) for r in warc.resolve(df).orderBy("record_id").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", was)
    # of names that differ in case, the last by code points counts
    assert got[:2] == [(2, 1, "matched", {"date": "d2", "etag": '"y"'})] * 2
    assert got[2:] == [(k, None, "missing", None) for k in range(11, 20, 2)]


def test_revisits_without_url_have_no_response(spark):
    rows = [(k, None, k, "revisit" if k % 2 else "response", {"ETag": '"x"'}) for k in range(40)]
    rows += [(100, "http://a.org/p", 1, "response", {"ETag": '"x"'}), (101, "http://a.org/p", 2, "revisit", {"ETag": '"x"'})]
    got = {r["record_id"]: (r["url"], r["refers_to"], r["state"], r["headers"]) for r in warc.resolve(spark.createDataFrame(rows, "record_id long, url string, time long, type string, headers map<string,string>")).collect()}
    assert got.pop(101)[1:3] == (100, "matched")
    assert got == {k: (None, None, "missing", None) for k in range(1, 40, 2)}


def test_texts_made_to_collide(spark):
    """Words and lines whose polynomial hashes agree modulo two to the power 64."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    every = [one + "\n" + two, f"{one} x y {two} x y", f"{one} x y {one} x y", f"{one}\n{two}\n{one}"]
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(docs_of(spark, every), ["doc_id"]).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 6), 3: (1, 0)}


def test_host_verdicts(spark):
    good, poor = "wort " * 1 + " ".join(f"w{i}" for i in range(80)), "# | $ " * 40 + " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [good, poor] * 200, ["good", "bad"])
    found = {r["source"]: r["kept"] for r in quality.judge(docs, ["doc_id", "source"]).select("source", "kept").distinct().collect()}
    assert found == {"good": True, "bad": False}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    """Nulls in any column, odd texts, repeated rows, clashing names, and no rows at all."""
    rows = [(i if i % 4 else None, t, None, ["a", None][i % 2], None) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([] if empty else rows + rows[:3], COLUMNS).withColumn("kept", F.lit("k")).withColumn("size", F.lit(1)).withColumn("label", F.lit(0)).withColumn("ids", F.lit(2)).withColumn("N_WORDS", F.lit(3))
    n = 0 if empty else len(rows) + 3
    assert quality.judge(docs, docs.columns, scratch=False).count() == n
    assert bpe.encode(docs, Q.vocabulary(), ["doc_id", "size"]).count() == n
    assert simhash.near_duplicates(docs, keep=["label"]).count() == n
    assert simhash.keep_one(docs).columns == docs.columns
    assert suffix.remove_repeats(docs, ["doc_id", "size"]).count() == n
    assert mixing.mix(docs, keep=["doc_id", "label"]).count() == n
    assert licenses.scan(docs, ["doc_id"]).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs.withColumn("grade", F.lit(None).cast("int"))), ["doc_id"]).count() == n
    assert urls.judge(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit(1).alias("key"), F.lit(2).alias("pid"))).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit(None).cast("string").alias("html"))
    assert warc.resolve(warc.page_records(pages)).count() == n
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_clashing_columns_stay(spark):
    """Columns named like anything that an operator makes come through the stages as they are."""
    import corpus_pipeline as P

    names = ["domain", "rejected", "_text", "size", "target", "taken", "pieces", "source_size", "n_words", "kept", "spans", "n_bytes", "row", "key", "node", "label", "fingerprint", "k1", "bits", "a.b", "bucket", "base_failed", "runs"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[-len(names) :] == names, name
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
    assert {"n_tokens", "ids", "decoded"} <= set(P.tokenize(spark, docs, SF).columns)
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("key", F.lit(5)).withColumn("host", F.lit(6)).withColumn("pid", F.lit(7))
    assert {(r["key"], r["pid"]) for r in urls.judge(pages, keep=["key", "pid"]).collect()} == {(5, 7)}


def test_near_duplicates_of_clashing_columns(spark):
    """Columns that share a name with a result give way to it; others stay."""
    docs = docs_of(spark, ["a b c d", "a b c d", "x y z"]).selectExpr("*", "'c' as component_id", "'f' as fingerprint", "'n' as node", "'l' as least", "doc_id as row")
    found = simhash.near_duplicates(docs, keep=["component_id", "fingerprint", "node", "least", "row"])
    assert found.columns == ["doc_id", "node", "least", "row", "fingerprint", "component_id"]
    assert {(r["doc_id"], r["component_id"], r["node"], r["least"], r["row"]) for r in found.collect()} == {(0, 0, "n", "l", 0), (1, 0, "n", "l", 1), (2, 2, "n", "l", 2)}


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = dict(P.STAGES)
    good = step["quality"](spark, docs, SF).cache()
    judged = {r["doc_id"]: r["kept"] for r in Q.op2_host_quality(spark, SF).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, k in judged.items() if k}
    one = step["near_dups"](spark, good, SF).cache()
    rows = good.orderBy("doc_id").collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (split((r["text"] or "").lower()) for r in rows)]
    close = components(len(rows), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    loose = components(len(rows), lambda i, j: jaccard(sets[i], sets[j]) >= 0.6)
    kept = {r["doc_id"] for r in one.collect()}
    most, least = {rows[i]["doc_id"] for i in close}, {rows[i]["doc_id"] for i in loose}
    assert least <= kept <= most
    cut = step["repeats"](spark, one, SF).cache()
    texts = one.orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in texts], brute_repeats([r["text"] for r in texts]), strict=True))
    for r in cut.collect():
        assert r["text"] == want[r["doc_id"]].decode(errors="ignore") and r["n_chars"] == len(r["text"])
    mixed = step["mix"](spark, cut, SF).cache()
    assert mixed.columns == cut.columns == docs.columns
    assert abs(sum(len(split(r["text"])) for r in mixed.collect()) / sum(len(split(r["text"])) for r in cut.collect()) - 1.5) < 0.01
    tokens = step["tokens"](spark, mixed, SF)
    assert tokens.count() == mixed.count()


def brute_trie(rows, every=100, most=6):
    """conv_id, depth: parent, members, children, leaves, saved, hash of each node, by sets of members."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(turns.get(c - int(math.fmod(c, every)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == k))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_prefix_trie_is_brute_force(spark, partitions, monkeypatch):
    """Nulls, ties, repeated rows, ids below zero, absent and short donors, many equal conversations, one long one, turnless ones."""
    monkeypatch.setattr(prefixes, "STRETCH", 3)
    rng = np.random.default_rng(1)
    rows = [(int(c), int(t), str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b", "Ünï \U0001F600"]))) for c in range(0, 330) if c not in (100, 205) for t in range(rng.integers(1, 7))]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(4)]  # copies, but for what they are given
    rows += [(c, 0, "u", "x") for c in range(2001, 2040)]  # some have no turns left; no donor
    rows += [(5000, t, "u", str(t)) for t in range(300)]
    rows += [(7, None, None, None), (7, None, None, "n"), (7, 2, "x", None), (7, 2, "x", None), (-150, 1, "r", ""), (-100, 1, "q", "t"), (None, 1, "r", "t")]
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
        made = prefixes.trie(*prefixes.rebuilt(prefixes.ordered(df), F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6, limit=5))
        none = prefixes.ordered(spark.createDataFrame([], TURNS))
        assert prefixes.trie(*prefixes.rebuilt(none, F.col("conv_id"), F.lit(1), 5)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    assert sorted(map(tuple, made.collect())) == brute_trie(rows)


def test_prefix_rounds_follow_what_is_shared(spark, monkeypatch):
    """Long equal conversations and long tails take no rounds: only what different conversations share does."""
    levels = []
    keep = prefixes.store
    monkeypatch.setattr(prefixes, "store", lambda df, name: levels.append(name) or keep(df, name))
    rows = [(c, t, "u", f"{t}") for c in (1, 2, 3) for t in range(60)] + [(4, 0, "u", "0"), (4, 1, "u", "other")] + [(4, t, "u", "tail") for t in range(2, 90)]
    made = prefixes.trie(*prefixes.rebuilt(prefixes.ordered(spark.createDataFrame(rows, TURNS)), F.col("conv_id") + 10_000, F.lit(0), 1))
    assert levels.count("active") == 2 and made.count() == 1 + 60 + 89


def brute_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    parts = defaultdict(list)
    for d, source, t in docs:
        t = t or ""
        w = split(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least.get(t, d)}
        parts[source or ""].append(({k for k, v in fails.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, rows in parts.items():
        total, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, k in enumerate(order, 1):
                gone, after = [r for r in left if k in r[0]], [r for r in left if k not in r[0]]
                total[k] += len(gone)
                steps.append((part, "".join(order), step, len(after), len(gone), sum(k in r[0] for r in rows) - len(gone), sum(r[0] == {k} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), k))
                left = after
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit_is_brute_force(spark):
    """Nulls in any column, repeated rows and ids, several labels, labels of nobody, texts of every kind of failure, no documents."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    texts = odd_texts() + ["A" * 40 + " " + " ".join(words[:60]), " ".join(words[:60]) + " #", "x y " * 40]
    texts += [" ".join(rng.choice(words, rng.integers(20, 120))) + str(rng.choice(["", " ABCDEFGH" * 8, " $"])) for _ in range(40)]
    docs = [(i if i % 9 else None, ["s", "t", None, ""][i % 4], t) for i, t in enumerate(texts)] + [(100 + i, "t", texts[i]) for i in range(0, 40, 3)]
    docs += docs[5:9] + [(7, "s", "another text of the same id")]
    labels = [(i, int(i % 2), int(i % 3 == 0)) for i in range(60)] + [(4, 1, 1), (9999, 1, 1), (None, 1, 1), (6, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("part", F.lit("x")).withColumn("fails", F.lit(3)).withColumn("digest", F.lit(3)).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").withColumn("id", F.lit(1))
    assert sorted(map(tuple, audit.audit(df, marks).collect())) == brute_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0
    assert audit.word_counts(b"a b a\x0bc \x1f ") == (5, 4)


def test_words_of_long_texts_are_counted_over_parts(monkeypatch):
    text = b" ".join(b"w%d" % (i % 70) for i in range(500))
    whole = audit.word_counts(text)
    monkeypatch.setattr(audit, "BLOCK", 16)
    assert audit.word_counts(text) == whole == (500, 70)
    hashes = join.word_hashes(text)
    monkeypatch.setattr(join, "BLOCK", 16)
    assert (join.word_hashes(text) == hashes).all() and len(hashes) == 500


def brute_join(docs, width, percent):
    sets = []
    for _, t in docs:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    near = lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if find(i) != find(j) and near(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("group, bucket", [(1024, 1 << 20), (4, 1 << 9)])
def test_jaccard_join_is_brute_force(spark, monkeypatch, group, bucket):
    """Pairs around the limit, chains of near copies, one hot group, equal prefixes, shared passages, odd and repeated rows; small blocks and many buckets."""
    for module in (join, simhash):
        monkeypatch.setattr(module, "GROUP", group)
    monkeypatch.setattr(join, "BUCKET", bucket)
    rng = np.random.default_rng(group)
    word = lambda: f"w{rng.integers(4000)}"
    base = [[word() for _ in range(rng.integers(30, 200))] for _ in range(8)]
    passage = [word() for _ in range(40)]
    texts = odd_texts()
    for b in base:
        now = list(b)
        for _ in range(10):  # a chain: neighbours are near, the ends are not
            now[rng.integers(len(now))] = word()
            texts.append(" ".join(now))
        for _ in range(6):  # variants, of which some are around the limit
            v = list(b)
            for k in rng.integers(len(v), size=rng.integers(1, 6)):
                v[k] = word()
            texts.append(" ".join(v).upper() if rng.integers(2) else "\n".join(v))
    for _ in range(12):
        texts.append(" ".join([word() for _ in range(rng.integers(5, 25))] + passage))
    hot = [word() for _ in range(120)]
    for k in range(60):
        v = list(hot)
        v[k] = word()
        texts.append(" ".join(v))
    docs = [(i if i % 10 else None, t) for i, t in enumerate(texts)] + [(3000 + i, texts[-i]) for i in range(1, 30)]
    docs += docs[20:24] + [(50, "one id with another text " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    df = df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("digest", "n", "row", "node", "id", "label", "n_shingles", "component_id")])
    got = [tuple(r) for r in join.similar(df, ["doc_id"]).collect()]
    assert sorted(got, key=repr) == brute_join(docs, 4, 85)
    assert join.similar(df, ["doc_id", "row", "node", "n_shingles"]).columns == ["doc_id", "row", "node", "n_shingles", "component_id"]
    assert join.similar(df.limit(0), ["doc_id"]).count() == 0


def test_jaccard_groups_hold_equal_prefixes(spark):
    """Sets of one prefix and size are one group, and its pairs come from the group, not from each of its keys."""
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(common[:k] + ["x"] + common[k:]) for k in range(1, 40)] * 2 + [" ".join(f"u{i}" for i in range(50))]
    nodes = join.prefixes(docs_of(spark, texts), "text", 4, 85, 4000)
    held = join.grouped(nodes).collect()
    keys = {r["node"]: (r["n"], tuple(r["keys"])) for r in nodes.where("whole").collect()}
    assert all(r["chief"] == (min(k for k, v in keys.items() if v == keys[r["node"]]) if r["whole"] else r["node"]) for r in held)
    for r in held:
        assert r["apart"] >= 0 and (r["node"] != r["chief"] or r["apart"] == 0)


def test_parity_bitmaps_never_leave_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)]))
        bits = join.parity(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        common = len(np.intersect1d(a, b))
        assert differ <= len(a) + len(b) - 2 * common
        words, n = bits.view(np.uint64).reshape(2, -1), np.array([len(a), len(b)])
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert join.may_links(n, words, np.zeros(2, np.int64), 0, 2, 85).all()


def test_frequent_words_keep_their_tokens_between_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    encoder = bpe.Encoder(Q.vocabulary())
    encoder.learn({f"word{k}" for k in range(30)})
    encoder.learn({"the", "word1", "word2"})
    assert {"the", "word1", "word2"} <= set(encoder.ids) and len(encoder.ids) < 20
    kept = encoder.ids["word1"]
    encoder.ids.update({f"{k}": b"" for k in range(20)})
    monkeypatch.setattr(encoder.vocabulary, "encode_sorted", lambda words: iter([]) if not words else 1 / 0)
    encoder.learn({"word1"})
    assert encoder.ids["word1"] is kept


def test_few_word_hashes_are_kept_between_texts():
    for k in range(3):
        join.word_hashes(b" ".join(b"w%d" % i for i in range(k * 100_000, k * 100_000 + 100_000)))
    assert len(join._HASHES) <= join.KEPT_WORDS + 100_000
