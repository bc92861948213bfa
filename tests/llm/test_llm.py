"""Corpus operators against brute force, round trips and held-out labels, and on awkward tables."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, exact_dedup, line_dedup, near_dedup, neighbours, packing, quality, secrets, sharding, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, rep long, row string"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns with names used inside."""
    rows = [(1, "a b c d e f g", "en", "s", 13, "x", 1, "r"), (1, "a b c d e f g", "en", "s", 13, "x", 1, "r"), (2, "", None, None, None, None, None, None), (3, None, "en", "s", 0, "y", 2, "q"), (None, "lonely text of a null id", "en", "s", 24, "y", 2, "q"), (4, LONG, "en", "s", len(LONG), "z", 3, "p"), (5, LONG + " more", "en", "s", len(LONG), "z", 3, "p"), (6, "a b c d e f g", "en", "s", 13, "x", 1, "r"), (7, "\n\n  \n", "en", "s", 5, "x", 1, "r")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.filter("false")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 10))
def test_banded_distance(a, b, most):
    want, got = distance(a, b), near_dedup.edit_distance(a, b, most)
    assert got == want if want <= most else got > most


def test_near_duplicates_brute_force(docs):
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    ids = sorted(texts)
    linked = missed = 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near_dedup.similar(texts[a], texts[b]):
                linked += 1
                missed += got[a] != got[b]
    assert linked and missed <= 0.02 * linked
    for a in ids:
        if got[a] != a:
            assert any(near_dedup.similar(texts[a], texts[b]) or texts[a] == texts[b] for b in ids if b != a and got[b] == got[a])


def test_near_duplicates_chain_and_shared_passage(spark):
    """In one bucket: a chain whose third text is unlike the first, and a passage that unlike texts share."""
    passage, texts = [f"p{j}" for j in range(40)], {}
    for k in range(30):
        a = [f"a{k}x{j}" for j in range(60)]
        b = [f"b{k}x{j}" for j in range(9)] + a[9:]
        c = b[:51] + [f"c{k}x{j}" for j in range(9)]
        own = passage + [f"o{k}x{j}" for j in range(30)]
        near = own[:]
        near[45:55] = [f"n{k}x{j}" for j in range(45, 55)]
        texts |= {10 * k + 1: a, 10 * k + 2: b, 10 * k + 3: c, 10 * k + 4: own, 10 * k + 5: near}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    ids = sorted(texts)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near_dedup.similar(texts[a], texts[b])]
    assert (1, 3) not in alike and (2, 3) in alike and len(alike) == 90
    missed = [p for p in alike if got[p[0]] != got[p[1]]]
    assert not missed and len(set(got.values())) == 60, missed


def test_near_duplicates_that_meet_in_crowded_buckets_only(spark):
    """Pairs of 300 texts with one long passage, whose edits leave some pairs no key but the passage's; picked members alone missed those."""
    rng, docs = random.Random(7), []
    passage = [f"p{i}" for i in range(40)]
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        edited = [w if j % 2 else f"e{rng.randrange(10**6)}" for j, w in enumerate(own)]
        edited[0] = own[0]
        docs += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(edited + passage))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_full_bins_still_rule_out():
    """One word said hundreds of times, among other words that differ: its full bin must not hide those."""
    hashed = lambda ws: near_dedup._mix(np.array(ws, np.uint64) + np.uint64(7))
    with np.errstate(over="ignore"):
        for size in (480, 540):  # bins as many, and twice as many
            a, b = [0] * 300 + list(range(1000, 1180)), [0] * 300 + list(range(5000, 4700 + size))
            bound = near_dedup.counts_apart(near_dedup.word_counts(hashed(a)).tobytes(), near_dedup.word_counts(hashed(b)).tobytes())
            assert 0.2 * size < bound <= distance(a[300:], b[300:])


def test_pairs_of_a_block(monkeypatch):
    """The same pairs as sizes and counts_apart leave one by one, in blocks of one part or two and however little is held at once."""
    rng, nodes = random.Random(3), []
    for i in range(120):
        base = random.Random(i % 7)
        words = [base.randrange(50) for _ in range(base.choice([8, 30, 60, 70, 130, 500]))] + [0] * (300 * (i % 7 == 6))
        words = [rng.randrange(50) if rng.random() < 0.08 else w for w in words][: len(words) - rng.randrange(3)]
        with np.errstate(over="ignore"):
            nodes.append((i % 5, i % 2, len(words), near_dedup.word_counts(near_dedup._mix(np.array(words, np.uint64) + np.uint64(7))).tobytes()))
    for parts, held in ((False, 1_000_000), (True, 1_000_000), (False, 2_000), (True, 2_000)):
        monkeypatch.setattr(near_dedup, "COMPARED", held)
        x, part, size, counts = zip(*nodes)
        part = np.array(part) * parts
        a, b = near_dedup.alike_in_block(np.array(x), part, np.array(size), list(counts))
        most = lambda i, j: int((1 - near_dedup.SIMILARITY) * max(size[i], size[j]) + 1e-9)
        want = {
            (i, j) for i in range(120) for j in range(i + 1, 120)
            if x[i] != x[j] and not (parts and part[i] == part[j]) and abs(size[i] - size[j]) <= most(i, j) and near_dedup.counts_apart(counts[i], counts[j]) <= most(i, j)
        }
        got = [(min(p), max(p)) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 3_000


def test_near_duplicates_in_parts_of_a_bucket(spark, monkeypatch):
    """A bucket of more members than a block: pairs across parts and within them are met."""
    monkeypatch.setattr(near_dedup, "PART", 40)
    test_near_duplicates_that_meet_in_crowded_buckets_only(spark)


def test_pairs_that_only_counts_allow_never_become_rows(monkeypatch):
    """Texts of the same words in another order: the counts allow every pair, and each pair was a row of the step before."""
    rng = random.Random(9)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(60)], 60)) for _ in range(40)]
    texts += [texts[3].replace("w7 ", "x "), texts[3].replace("w9 ", "y ")]
    counts = [near_dedup.word_counts(near_dedup._mix(np.array([int(w[1:] or 0) for w in t.split()], np.uint64) + np.uint64(7))).tobytes() for t in texts]
    n = len(texts)
    columns = {"key": [5] * n, "block": [0] * n, "part": [0] * n, "node": list(range(n)), "x": list(range(n)), "size": [60] * n, "counts": counts}
    batches = lambda **more: iter(pa.RecordBatch.from_pydict(columns | more).slice(i, 10) for i in range(0, n, 10))
    close = pa.Table.from_batches(near_dedup._close_in_blocks(batches())).to_pylist()
    assert [r["node"] for r in close] == list(range(n)) and {r["key"] for r in close} == {5}
    links = lambda keys: sorted((r["a"], r["b"]) for b in near_dedup._links_in_blocks(batches(keys=keys, text=texts)) for r in b.to_pylist())
    assert links([[5]] * n) == [(3, 40), (3, 41)]
    assert links([[2, 5], [2, 5], [5], [2, 5], *([[5]] * 36), [5], [2, 5]]) == [(3, 40), (40, 41)]  # 3 and 41 meet in the block of key 2
    monkeypatch.setattr(near_dedup, "PART", 2)
    assert near_dedup.met_before([[1, 9], [1, 2, 9], [2, 3, 9], [9], [3, 9]], 9).tolist() == [[i == j < 3 or i == j == 4 or {i, j} in ({0, 1}, {1, 2}, {2, 4}) for j in range(5)] for i in range(5)]


def test_near_duplicates_share_keys():
    """Pairs of similarity 0.8, the least there is: all short ones and nearly all long ones become candidates."""
    rng = np.random.default_rng(6)
    share = {}
    with np.errstate(over="ignore"):
        for size in (*range(5, near_dedup.SHORT + 1), 60, 200):
            hits = 0
            for _ in range(200):
                a = rng.integers(1, 2**62, size).astype(np.uint64)
                b, edits = a.copy(), int(0.2 * size + 1e-9)
                at = rng.choice(size, edits, replace=False)
                b[at] = rng.integers(1, 2**62, edits).astype(np.uint64)
                if rng.random() < 0.5:
                    b = np.delete(b, at)
                hits += bool(set(near_dedup.text_keys(a).tolist()) & set(near_dedup.text_keys(b).tolist()))
            share[size] = hits / 200
    assert all(x == 1 for n, x in share.items() if n <= near_dedup.SHORT), share
    assert share[60] >= 0.95 and share[200] >= 0.97, share


def test_near_duplicates_planted(spark):
    """Pairs with edits spread at random: of each similarity at least nine in ten share a class, and nothing else does."""
    rng, docs, pairs = random.Random(9), [], []
    for k in range(240):
        size, similarity = rng.choice([12, 40, 120, 400]), (0.8, 0.85, 0.9)[k % 3]
        text = [f"w{k}x{j}" for j in range(size)]
        near = text[:]
        for i in rng.sample(range(size), int((1 - similarity) * size + 1e-9)):
            near[i] = f"n{k}x{i}"
        docs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
        pairs.append((similarity, 2 * k, 2 * k + 1))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for similarity in (0.8, 0.85, 0.9):
        hits = [got[a] == got[b] for s, a, b in pairs if s == similarity]
        assert sum(hits) >= 0.9 * len(hits), (similarity, sum(hits), len(hits))
    assert all(got[d] // 2 == d // 2 for d in got)


def test_near_duplicates_repeated_ids(spark):
    """Two texts under one id are two nodes: each is linked to its own near copy."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = near_dedup.near_duplicates(spark.createDataFrame([(5, a), (5, b), (1, a + " x"), (2, b + " x")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in rows) == [(1, 1, True), (2, 2, True), (5, 1, False), (5, 2, False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=90), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 200), st.integers(0, 30)), max_size=20))
def test_counts_bound_the_distance(words, edits):
    other = words[:]
    for kind, at, word in edits:
        if kind == 0 and len(other) > 1:
            other.pop(at % len(other))
        elif kind == 1:
            other[at % len(other)] = word
        else:
            other.insert(at % (len(other) + 1), word)
    hashed = lambda ws: near_dedup._mix(np.array(ws, np.uint64) + np.uint64(7))
    with np.errstate(over="ignore"):
        assert near_dedup.counts_apart(near_dedup.word_counts(hashed(words)).tobytes(), near_dedup.word_counts(hashed(other)).tobytes()) <= distance(words, other)


def test_near_duplicates_awkward(awkward, empty):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == 9
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got[6] == got[1] == 1 and got[5] == got[4] == 4 and got[3] == got[2] == 2 and got[None] is None
    assert near_dedup.near_duplicates(empty).count() == 0


def test_lines_awkward(spark, awkward, empty):
    rows = line_dedup.line_dedup(awkward).collect()
    assert len(rows) == 9 and [r["text"] for r in rows if r["doc_id"] == 3] == [None] and [r["text"] for r in rows if r["doc_id"] == 6] == [""]
    assert sorted(line_dedup.line_dedup(awkward).columns) == sorted([*awkward.columns, "__lines", "__removed"])
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(18, 26))).strip("ab ") + "xyzxyzxyzxyzxyzxyzxyz"[: rng.randint(0, 9)] for _ in range(12)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(3):
            x = list(rng.choice(base))
            if x and rng.random() < 0.7:
                p = rng.randrange(len(x))
                x[p : p + rng.randint(0, 1)] = rng.choice(["", "q", "b"])
            lines.append("".join(x))
        texts.append((i, "\n".join(lines)))
    texts += [(60 + i, "\n".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(2))) for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    seen = []
    for i, text in texts:
        kept = []
        for line in text.split("\n"):
            x = line.strip(" \t\r")
            if not x or not any(abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1 for y in seen):
                kept.append(line)
            if x:
                seen.append(x)
        assert got[i] == "\n".join(kept), i


def test_exact_dedup(awkward, empty):
    rows = exact_dedup.exact_dedup(awkward, keep="max").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == 9 and by[1][0]["keep_id"] == 6 and by[1][0]["group_size"] == 3 and by[2][0]["keep_id"] == 3 and by[None][0]["kept"]
    assert by[3][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(awkward).filter("doc_id = 6").first()["keep_id"] == 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def scalar_jump(key, shards):
    """The published loop, on one key mixed as the operator mixes it."""
    mask = 2**64 - 1
    x = key & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    x ^= x >> 31
    shard, ahead = 0, 0
    while ahead < shards:
        shard = ahead
        x = (x * 2862933555777941757 + 1) & mask
        ahead = int((shard + 1) * (float(1 << 31) / ((x >> 33) + 1)))
    return shard


def test_sharding(awkward, empty, docs):
    rows = sharding.shard_documents(docs).collect()
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)
    assert sharding.shard_documents(awkward).count() == 9 and sharding.shard_documents(empty).count() == 0
    assert {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in rows} == {i: (scalar_jump(i, 24), scalar_jump(i, 25)) for i in texts}
    keys = np.arange(20_000)
    for n in (1, 2, 7, 24):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02 and np.bincount(a, minlength=n).min() > 0.8 * len(keys) / n


def test_bpe_equals_tiktoken(docs, awkward, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in byte_bpe.encode_documents(docs, path, P.PATTERN, outputs="ids").collect():
        assert r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN)
    for text in ("", "<|endoftext|>", "▁ a\u0000b \t\n x" + "é" * 300, "🙂👩‍👩‍👧 नमस्ते 你好", "x" * 5_000, "<unk> </s>"):
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    assert byte_bpe.encode_documents(awkward, path, P.PATTERN).count() == 9 and byte_bpe.encode_documents(empty, path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.sentencepiece_model({base64.b64decode("YQ=="): 1})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40))
def test_packing_block(sizes):
    sizes = np.array(sizes)
    bins, starts, fitted = packing.pack_block(sizes, (16, 32, 64), 4)
    for b in range(len(fitted)):
        own = np.flatnonzero(bins == b)
        spans = sorted((starts[i], starts[i] + sizes[i]) for i in own)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= fitted[b]
        assert fitted[b] == min(c for c in (16, 32, 64) if c >= spans[-1][1])
    assert fitted.sum() + 4 * len(fitted) <= sum(min(c for c in (16, 32, 64) if c >= s) + 4 for s in sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=8))
def test_packing_against_the_optimum(sizes):
    caps, opening, full = (16, 32, 64), 4, 1 << len(sizes)
    total = [sum(s for i, s in enumerate(sizes) if m >> i & 1) for m in range(full)]
    cost = [min((c for c in caps if c >= t), default=None) for t in total]
    best = [0] + [10**9] * (full - 1)
    for m in range(1, full):
        low, part = m & -m, m
        while part:
            if part & low and cost[part] is not None:
                best[m] = min(best[m], best[m ^ part] + cost[part] + opening)
            part = (part - 1) & m
    fitted = packing.pack_block(np.array(sizes), caps, opening)[2]
    assert fitted.sum() + opening * len(fitted) <= 1.15 * best[-1]


def test_packing_blocks_are_bounded(spark, monkeypatch):
    """Neither null ids nor very long documents crowd a block."""
    monkeypatch.setattr(packing, "BLOCK", 500)
    nulls = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).alias("n"))
    long = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(64 * 1_000).alias("n"))
    for rows, pieces in ((nulls, 4_000), (long, 4_000)):
        blocks = packing.pack_documents(rows, (16, 32, 64), length="n").groupBy("block").count().collect()
        assert sum(r["count"] for r in blocks) == pieces and max(r["count"] for r in blocks) < 700


def test_packing(awkward, empty, docs):
    rows = packing.pack_documents(awkward).collect()
    words = {4: 20_000, 5: 20_001, 1: 14, 6: 7, 2: 0, 3: 0, 7: 0, None: 6}
    for doc, n in words.items():
        assert sum(r["tokens"] for r in rows if r["doc_id"] == doc) == n
    assert all((r["bin"] is None) == (r["tokens"] == 0) for r in rows)
    assert packing.pack_documents(empty).count() == 0
    total = packing.pack_documents(docs).agg(F.sum("tokens")).first()[0]
    assert total == sum(len((r["text"] or "").split()) for r in docs.collect())


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    odd = spark.createDataFrame([(100_000, None, 0), (100_020, [0.0] * 64, 0), (100_040, [float("nan")] * 64, 0), (100_060, [], 0), (None, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int")
    same = vectors.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 200_000)
    rows = neighbours.nearest(vectors.unionByName(odd).unionByName(same)).collect()
    data = sorted((r["vec_id"], r["embedding"]) for r in vectors.unionByName(same).collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        score = (x * x[ids == q][0]).sum(1)
        others = ids != q
        best = np.lexsort((ids[others], -score[others]))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21))
        hit += len(set(ids[others][best]) & {g[1] for g in got})
        total += 20
    assert hit >= 0.9 * total and {r["query_id"] for r in rows} == set(ids[ids % 20 == 0].tolist())
    assert neighbours.nearest(odd.filter("false")).count() == 0


def test_neighbours_in_cells(spark, monkeypatch):
    """Many cells, parts, chunks and leaves: recall against brute force, and the stopping test saves most of the leaves."""
    for name, value in (("CELL", 700), ("CHUNK", 40), ("LEAF", 32)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 12_000)] + 0.1 * rng.standard_normal((12_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, every=40).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 12_000, 40):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(12_000), -score))[:20]
        assert [a for a, _, _ in sorted(got[q])] == list(range(1, 21))
        hit += len(set(best.tolist()) & {b for _, b, _ in got[q]})
    assert hit >= 0.9 * 20 * 300
    most = (x**2).sum(1).max() * (1 + 1e-12)
    found = neighbours.search(x, [np.array([i]) for i in range(12_000)], x[::200], 21, most)
    assert found.visited < 0.5 * found.leaves


def test_secrets(spark, awkward, empty, docs):
    words = ["thtionereast", "ouerndthingtionoreas", "4785380592391139", "plain", "text"]
    rng, rows, truth = random.Random(3), [], set()
    for i in range(400):
        parts = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if i % 8 else "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            parts[rng.randrange(30)] = f'token = "{key}"' if i % 8 else key
            truth.add((i, key))
        rows.append((i, " ".join(parts), "src"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    forest = secrets.train(df.filter("doc_id % 5 <> 0"))
    held = {(i, k) for i, k in truth if i % 5 == 0}
    found = secrets.scan(df.filter("doc_id % 5 = 0"), forest).collect()
    got = {(r["doc_id"], r["value"]) for r in found}
    assert len(held & got) >= 0.95 * len(held) and len(got - held) <= 0.05 * len(got)
    texts = dict((r[0], r[1]) for r in rows)
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["value"] for r in found)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df, forest).collect()}
    for i, text in texts.items():
        for doc, key in truth & {(i, k) for _, k in truth}:
            text = text.replace(key, "<secret>") if (doc, key) in got or doc % 5 else text
        assert clean[i].count("<secret>") <= 1 and (i % 4 == 0 or clean[i] == texts[i])
    assert secrets.redact(awkward, forest).columns == awkward.columns and secrets.redact(awkward, forest).count() == 9
    assert secrets.scan(empty, secrets.train(empty)).count() == 0
    rows = spark.createDataFrame([(1, 'password = "P@ss!w0rd#19x" then postgres://admin:S3cretPw9@db and Authorization: Bearer abcDEF1234567890xyz', "s"), (2, "a\u0001b token = 0123456789abcdef0123456789abcdef01234567 c", "s")], "doc_id long, text string, source string")
    found = secrets._candidates(rows.withColumn("path", F.col("source"))).select("doc_id", F.explode("candidates.value").alias("v")).collect()
    assert {(r["doc_id"], r["v"]) for r in found} == {(1, "P@ss!w0rd#19x"), (1, "S3cretPw9"), (1, "abcDEF1234567890xyz"), (2, "0123456789abcdef0123456789abcdef01234567")}
    labelled = df.filter("doc_id % 5 <> 0").select("doc_id", F.lit("x").alias("value"), F.lit(1).alias("is_secret"))
    assert secrets.train(df, labelled).trees == []  # no such findings


def test_secrets_planted_in_held_out_documents(docs):
    """The forest of one half of the documents tells what was planted in the other half by another seed from look-alikes."""
    texts = docs.select(F.coalesce("source", F.lit("")).alias("path"), "text", "doc_id").filter("text <> '' and n_chars < 5000")
    forest = secrets.train(docs.filter("doc_id % 2 = 0"))
    held = secrets.planted(texts.filter("doc_id % 2 = 1").select("path", "text", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("turn")), seed=7)
    scored = secrets._candidates(held).select("planted", "label", F.explode(secrets._scored(forest)).alias("x"))
    rows = scored.filter("x.c.value = planted").select("label", (F.col("x.score") >= 0.5).alias("found")).collect()
    secret, other = [r["found"] for r in rows if r["label"]], [r["found"] for r in rows if not r["label"]]
    assert len(secret) > 100 and len(other) > 60 and np.mean(secret) > 0.9 and np.mean(other) < 0.1


def test_toxicity(spark, awkward, empty):
    rng = random.Random(1)
    common, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["vile", "nasty", "awful"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        ws = [rng.choice(common) for _ in range(rng.randint(20, 80))] + ([rng.choice(bad) for _ in range(4)] if toxic else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert toxicity.score_toxicity(awkward, model).count() == 9 and toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.train(docs, labels.filter("toxic = 0")) == 0.0 and toxicity.train(empty, labels.filter("false")) == 0.0


def test_kneser_ney_brute_force(spark):
    """Ratios, and counts over all documents, against plain Python over every word and bigram, those of one document too."""
    rng = random.Random(2)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(12)] + (["vile", "scum"] if i % 4 == 0 else [])), int(i % 4 == 0), 0) for i in range(80)]
    rows.append((80, "once only vile", 1, 0))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int, tuning int")
    everything = sample.select("text").unionByName(spark.createDataFrame([("zz yy zz vile",), ("",), (None,)], "text string"))
    grams = toxicity._gram_counts(sample)
    ends = toxicity.continuations(everything, grams.words)
    spread = 1.0
    model = toxicity.KneserNey.fit(grams, ends, 0, 1, spread)
    assert 0 < len(model.pairs) < len(grams.before)
    model = __import__("pickle").loads(__import__("pickle").dumps(model))
    texts = [r["text"] or "" for r in everything.collect()]
    contexts = {}
    for t in texts:
        for h, w in zip(["", *toxicity.words(t)], toxicity.words(t)):
            contexts.setdefault(w, set()).add(h)
    known = sorted({w for _, t, _, _ in rows for w in toxicity.words(t)})
    other = sum(len(c) for w, c in contexts.items() if w not in known)
    total = sum(len(contexts[w]) + 0.5 for w in known) + other + 0.5
    share = lambda w: (len(contexts[w]) + 0.5 if w in known else other + 0.5) / total

    def count(c, gram):
        return sum(y == c and gram(t) for _, t, y, _ in rows)

    pairs = sorted({p for _, t, _, _ in rows for p in zip(["", *toxicity.words(t)], toxicity.words(t))})
    n = {c: {w: count(c, lambda t: w in toxicity.words(t)) for w in known} for c in (0, 1)}
    m = {c: {p: count(c, lambda t: p in set(zip(["", *toxicity.words(t)], toxicity.words(t)))) for p in pairs} for c in (0, 1)}
    whole = sum(sum(n[c].values()) for c in (0, 1))
    logs = {}
    for c in (1, 0):
        part = sum(n[c].values()) / whole

        def off(table, x):
            expected = part * (table[0].get(x, 0) + table[1].get(x, 0))
            return min(table[c].get(x, 0), expected + spread * (expected + 1) ** 0.5)

        mass = sum(off(n, w) for w in known)
        p1 = lambda w: (n[c].get(w, 0) - off(n, w) + mass * share(w)) / sum(n[c].values())

        def p2(h, w):
            after = {q: x for q, x in m[c].items() if q[0] == h}
            if not sum(after.values()):
                return p1(w)
            return (m[c].get((h, w), 0) - off(m, (h, w)) + sum(off(m, q) for q in after) * p1(w)) / sum(after.values())

        assert abs(sum(p1(w) for w in known) + mass * (other + 0.5) / total / sum(n[c].values()) - 1) < 1e-9
        logs[c] = [np.mean([np.log(p2(h, w)) for h, w in zip(["", *toxicity.words(t)], toxicity.words(t))]) if toxicity.words(t) else 0 for t in texts]
    got = model.ratio(*toxicity.hashed_words(texts), len(texts))
    assert np.allclose(got, np.array(logs[1]) - np.array(logs[0]), atol=5e-3)
    by_ratio = model.score(texts)[np.argsort(got, kind="stable")]
    assert (np.diff(by_ratio) >= 0).all()  # one slope and one offset


def test_bigrams_that_no_model_keeps_are_added_up(spark):
    """What comes to the driver grows with the bigrams that a model can keep; the others are one row for each first word and class, and change no model."""
    rng = random.Random(5)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(40)] + ["vile", "scum"] * (i % 3 == 0)), int(i % 3 == 0), int(i % 5 == 0)) for i in range(150)]
    grams = toxicity._gram_counts(spark.createDataFrame(rows, "doc_id long, text string, toxic int, tuning int"))
    want = {}
    for _, t, y, tuning in rows:
        ws = [int(np.searchsorted(grams.words, toxicity.hashed_words([w])[1][0])) for w in toxicity.words(t)]
        for p in set(zip([len(grams.words), *ws], ws)):
            want.setdefault(p, np.zeros(4, int))[[1 - y] + [3 - y] * (not tuning)] += 1
    rest = {}
    for (h, _), n in want.items():
        if n.max() < 2:
            rest[h, -1] = rest.get((h, -1), 0) + n
    few = {p: n for p, n in want.items() if n.max() > 1} | rest
    got = {(int(h), int(w)): n for h, w, n in zip(grams.before, grams.after, grams.pair_counts)}
    assert len(grams.before) == len(got) < len(want) / 4 and {p: tuple(n) for p, n in got.items()} == {p: tuple(n) for p, n in few.items()}
    size, pairs = len(grams.words), sorted(want)
    whole = toxicity.Grams(grams.words, grams.word_counts, *(np.array(x, np.int32) for x in zip(*pairs)), np.array([want[p] for p in pairs], np.int32))
    for spread in toxicity.SPREADS:
        a, b = (toxicity.KneserNey.fit(g, np.ones(size + 1), 0, 1, spread) for g in (grams, whole))
        assert (a.pairs == b.pairs).all() and np.allclose(a.pair, b.pair) and np.allclose(a.follow, b.follow)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op9_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic").collect()
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) >= 0.9


def test_labels_that_contradict(spark, docs):
    """An id labelled both ways takes no part."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(i, 1 - i % 2, 1 - i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    half = labels.filter("doc_id >= 100")
    a, b = toxicity.score_toxicity(docs, toxicity.train(docs, labels)), toxicity.score_toxicity(docs, toxicity.train(docs, half))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def auc(scores, labels):
    order = sorted((s, y) for s, y in zip(scores, labels))
    above = sum(y for _, y in order)
    wins = ties = 0.0
    seen = {}
    for s, y in order:
        seen.setdefault(s, [0, 0])[y] += 1
    below = 0
    for s in sorted(seen):
        wins += seen[s][1] * below
        ties += seen[s][1] * seen[s][0] / 2
        below += seen[s][0]
    return (wins + ties) / (above * below)


def test_quality(spark, awkward, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in held]) > 0.9
    both, text, metadata = (auc([r[c] for r in held], [r["quality"] for r in held]) for c in ("score", "text_score", "metadata_score"))
    assert both > 0.9 and both >= max(text, metadata) - 0.01, (both, text, metadata)
    assert quality.score_quality(awkward, model).count() == 9 and quality.score_quality(empty, model).count() == 0
    assert quality.train(docs, labels.filter("false")) == 1.0


@pytest.mark.parametrize("told", [0.0, 1.2])
def test_co_training_exchange(told):
    """A second view at chance hands nothing over and does no harm; one that tells something helps where labels are few."""
    plain, exchanged, text = [], [], []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = (rng.random(6_200) < 0.8).astype(float)
        views = tuple(rng.normal(size=(len(y), 40)) + np.outer(y - 0.5, np.where(np.arange(40) < 8, strength, 0)) for strength in (1.0, told))
        few, pool, held = slice(0, 200), slice(200, 3_200), slice(3_200, None)
        for rounds, out in ((0, plain), (quality.ROUNDS, exchanged)):
            model = quality.co_train(tuple(v[few] for v in views), y[few], np.arange(200) % 4 == 0, tuple(v[pool] for v in views), rounds)
            scores = model.scores(*(v[held] for v in views))
            out.append(auc(scores[2], y[held].astype(int)))
            if rounds == 0:
                text.append(auc(scores[0], y[held].astype(int)))
            elif not told:
                assert auc(scores[0], y[held].astype(int)) >= text[-1] - 1e-9
    print(np.round(plain, 4), np.round(exchanged, 4))
    assert np.mean(exchanged) >= np.mean(plain) - (0 if told else 0.002), (plain, exchanged)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from ledgerloom.scratch import table

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()


def test_pipeline_awkward(spark, awkward):
    """Every stage runs on what the one before kept of an awkward table, and of an empty one."""
    import corpus_pipeline

    from ledgerloom.scratch import table

    sf = "/root/testdata/sf0.001"
    for rows, kept in ((awkward, 9), (awkward.filter("false"), 0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = table(stage(spark, docs, sf), name)
            if name != "packing":
                assert docs.columns == awkward.columns
        assert docs.select("doc_id").distinct().count() <= kept  # packing gives a row for each piece
    # of a text with copies one document stays, of an id with two texts both
    rows = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "One two three four five six"), (1, "another text of its own here"), (None, "no id no id no id")], "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, rows, sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "no id no id no id"), (1, "another text of its own here"), (1, "one two three four five six")]


def test_bigrams_are_dealt_in_little_memory():
    """Dealing took seven times the bigrams it held, in every worker of an executor at once; the same bigrams come out, each in its bucket."""
    rng = np.random.default_rng(1)
    held = [np.unique(rng.integers(0, 2**62, 200_000).astype(np.uint64)) for _ in range(19)]
    held.append(held[0])
    want, size = np.unique(np.concatenate(held)), sum(x.nbytes for x in held)
    found, least = [], len(want)
    tracemalloc.start()
    for part in toxicity._dealt(held, 7):
        for bucket, packed in zip(part["bucket"], part["pairs"]):
            found.append((bucket, packed))
        least = min(least, part["bucket"].nunique())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert least == 7 and not held and peak < 4 * size
    got = [(b, toxicity._unpacked(p)) for b, p in found]
    assert all((x % np.uint64(7) == b).all() for b, x in got) and np.array_equal(np.sort(np.concatenate([x for _, x in got])), want)
