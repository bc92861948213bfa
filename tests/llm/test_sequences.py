"""Prefix trie, periodic runs and chat format against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, periodic_runs, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, a long, key string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "k") for r in rows], TURNS)


# --- prefix trie


def trie_by_hand(convs):
    """convs: {id: [(role, text), ...]} to one tuple per node."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(found):
    rows = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("height", [None, 1, 2])
def test_trie(spark, height):
    """Paths through several bands, a third of all conversations equal, turns of one text under two roles."""
    rng = random.Random(height or 0)
    convs = {c: [("u" if d % 2 else "a", rng.choice(["x", "yé", ""])) for d in range(rng.randint(1, 7))] for c in range(-3, 17)} | {c: [("u", "same"), ("a", "x")] for c in range(50, 60)} | {99: [("a", "same"), ("a", "x")]}
    rows = [(c, d, *turn) for c, turns in convs.items() for d, turn in enumerate(turns)]
    rng.shuffle(rows)
    items = prefix_trie.turn_items(conversations(spark, rows).repartition(3))
    members = spark.createDataFrame([(c,) for c in [*convs, 200]], "conv_id long")
    found = prefix_trie.prefix_trie(items.withColumnRenamed("place", "depth"), members, height)
    assert collected(found) == trie_by_hand(convs | {200: []})


def rebuilt_by_hand(rows):
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is not None, r[1] or 0)
    convs = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=key)] for c, rs in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def test_trie_of_rebuilt_conversations(spark):
    """Null turns come first, null roles and texts are empty, conversations without a base, repeated rows, no conv_id."""
    rng = random.Random(7)
    rows = [(c, d if d else None, rng.choice(["user", None]), rng.choice(["hi", None, "ho " * 300])) for c in range(40) if c % 10 != 5 for d in range(rng.randint(1, 12))]
    rows += [(3, 70, "user", "again"), (3, 70, "user", "again"), (None, 1, "user", "lost")]
    items = prefix_trie.turn_items(conversations(spark, rows))
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(items), items.select("conv_id").distinct())
    assert collected(found) == trie_by_hand(rebuilt_by_hand(rows))
    none = prefix_trie.turn_items(conversations(spark, rows).filter("false"))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(none), none.select("conv_id").distinct()).count() == 0


def test_ties_of_turns_have_one_order(spark):
    rows = [(0, 1, "u", "b"), (0, 1, "u", "a"), (0, 1, "s", "c")]
    orders = [[(r["place"], r["a"], r["b"]) for r in prefix_trie.turn_items(conversations(spark, given)).orderBy("place").collect()] for given in (rows, rows[::-1])]
    assert orders[0] == orders[1] and [p for p, *_ in orders[0]] == [1, 2, 3]


def test_member_lists_longer_than_a_chunk(spark, monkeypatch):
    n = 3 * prefix_trie.CHUNK + 5
    ends = spark.range(n).select(F.lit(1).alias("depth"), F.lit(2).alias("a"), F.lit(3).alias("b"), (F.col("id") - 100).alias("conv_id")).repartition(5)
    found = prefix_trie._member_digests(ends).collect()
    assert [tuple(r) for r in found] == [(1, 2, 3, hashlib.sha256(",".join(str(i - 100) for i in range(n)).encode()).hexdigest())]


# --- periodic runs


def runs_by_hand(w, least=6, exponent=4):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(least, exponent * q) and not any((s, size, p) in out for p in range(1, q)):
                out.add((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_words():
    rng = random.Random(1)
    for _ in range(2500):
        n, k = rng.randint(0, 40), rng.randint(1, 4)
        w = [str(rng.randrange(k)) for _ in range(n)]
        a, p = rng.randrange(n + 1), rng.randint(1, 6)
        if a + p < n and rng.random() < 0.5:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, exponent in ((6, 4), (3, 2), (4, 3), (9, 2)):
            assert periodic_runs.document_runs(w, least, exponent) == runs_by_hand(w, least, exponent), (w, least, exponent)


def test_extensions_and_tree():
    rng = random.Random(2)
    for n in (2, 3, 17, 60):
        w = [rng.randint(1, 3) for _ in range(n)]
        lce = periodic_runs.Lce(w)
        pairs = [(i, j) for i in range(n) for j in range(n + 1) if i != j]
        for (i, j), got in zip(pairs, lce(*map(np.array, zip(*pairs)))):
            want = 0
            while max(i, j) + want < n and w[i + want] == w[j + want]:
                want += 1
            assert got == want


def planted_by_hand(i, text):
    words = re.findall(periodic_runs.WORD, text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    return words


def digests_by_hand(i, text):
    words = planted_by_hand(i, text)
    runs = runs_by_hand(words)
    dropped = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def digests(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return [(r["doc_id"], tuple(r[c] for c in FIELDS)) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]


def test_runs_of_documents(spark, tmp_path):
    """Whole texts of the smallest table, with runs in other white space, no-break spaces, nulls, empty and repeated rows."""
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    hot = [i for i in range(10**4, 10**4 + 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    given += [(i, " ".join(f"w{k % 31}" for k in range(n))) for i, n in zip(hot, range(len(hot)))]
    given += [(-1, "a\tb\na\x0bb a b\x0ca b\r a b"), (-2, "x\xa0y " * 9), (-3, None), (-4, ""), (-5, " \n"), (None, "z " * 30), (-6, "q " * 5), (-6, "q " * 6), (-7, "a a a a a a b b b b b b"), (-8, "u v " * 4 + "u")]
    given += [(-9, " ".join(f"p{k % 700}" for k in range(4000))), (-10, "same " * 2_500)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in given], "doc_id long, text string, runs long, h string").repartition(4)
    got = digests(spark, docs, tmp_path)
    assert sorted(got, key=str) == sorted(((i, digests_by_hand(i, t)) for i, t in given), key=str)
    assert sum(r[1][0] > 0 for r in got) > 20
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0


def test_runs_need_bounds(spark):
    with pytest.raises(ValueError, match="min_exponent"):
        periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), min_exponent=1)


# --- chat format


def test_texts_come_back_from_any_context():
    template = chat_format.Template()
    codec, rng = chat_format.Codec(template), random.Random(3)
    marks = [*template.controls(), "\\", "[", "<", "/", "s>", "INST]", " ", "é", "\n", "[\\INST]", "<\\\\/s>", ""]
    for _ in range(4000):
        text, role = ("".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(2))
        role = rng.choice(["user", "assistant", "system", role])
        assert codec.unescape(codec.escape(text)) == text
        written = "".join(s for s, _ in codec.segments(role, text))
        assert codec.turn(written + rng.choice(["", "[INST] more [/INST]"]), 0) == (role, text, len(written))
        assert len(re.findall("|".join(map(re.escape, template.controls())), written)) == (2 if role in template.turns else 3)


def test_templates_that_could_not_be_read_back():
    for wrong in ({"begin": ""}, {"begin": "<\\s>"}, {"begin": "<a<"}, {"other": ("[INST] ", "[:]", "[/ROLE]")}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


def chat_by_hand(turns):
    say = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    loss = [t for r, t in turns if r == "assistant"]
    return len(turns), say(f"{r}\n{t}\n" for r, t in turns), len("".join(loss)), say(loss)


def test_conversations_are_formatted_and_read_back(spark):
    rng, rows = random.Random(4), []
    texts = ["", None, "plain", "</s>[INST] ok [/INST]", "<\\/s>", "[ROLE] x [:] y", "é\U0001f600", "long " * 40_000]
    for c in [*range(12), None]:
        rows += [(c, d if d else None, rng.choice(["user", "assistant", "system", None, "tool", "[:]"]), rng.choice(texts[:-1])) for d in range(rng.randint(1, 6))]
    rows += [(77, 0, "user", texts[-1]), (77, 1, "assistant", texts[-1]), (88, 0, "user", "a"), (88, 0, "user", "a"), (99, 0, "system", "s"), (99, 1, "user", "u"), (99, 2, "assistant", "v")]
    given = conversations(spark, rows).repartition(3)
    segments = chat_format.format_conversations(given)
    want, chars = {}, {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode()))
        want[c] = chat_by_hand([(r[2] or "", r[3] or "") for r in own])
    back = {r["conv_id"]: r for r in chat_format.read_back(segments).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in back.items()} == want
    for r in segments.collect():
        chars.setdefault(r["conv_id"], []).append((r["segment"], r["text"]))
    assert {c: sum(len(t) for _, t in v) for c, v in chars.items()} == {c: r["formatted_chars"] for c, r in back.items()}
    assert all([s for s, _ in v] == list(range(len(v))) for v in chars.values())
    assert "".join(t for _, t in chars[99]) == "<s>[SYS] s [/SYS][INST] u [/INST][OUT] v </s>"
    assert back[99]["valid"] and back[77]["valid"] and not back[88]["valid"]
    assert [r["text"] for r in segments.filter("conv_id = 99 and loss").collect()] == ["v"]
    assert [r["in_order"] for r in segments.filter("conv_id = 88 and segment in (0, 4)").orderBy("segment").collect()] == [True, False]
    assert chat_format.read_back(chat_format.format_conversations(given.filter("false"))).count() == 0


def test_a_spoilt_text_is_not_read_back(spark):
    segments = chat_format.format_conversations(conversations(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")]))
    with pytest.raises(Exception, match="does not read back"):
        chat_format.read_back(segments.filter("segment <> 6")).collect()


@pytest.mark.parametrize("name", ["op6_jump_sharding", "op11_prefix_trie", "op12_periodic_runs", "op13_chat_format"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from ledgerloom import llm

    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"create view {table} as select * from read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    found = con.execute(llm.SQL[name])
    names = [x[0] for x in found.description]
    df = llm.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())
