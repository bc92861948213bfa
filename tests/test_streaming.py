"""Replay-safe ingest of a landing folder, bucket by bucket."""

import json
import os

import pytest

from ledgerloom.operators.merges import first_rows
from ledgerloom.streaming.ingest import BUCKET, ingest, stored

SCHEMA = "seq long, tx string, amount long"


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "landing").mkdir()

    def land(name, rows):
        (tmp_path / "landing" / name).write_text("\n".join(json.dumps(dict(zip(("seq", "tx", "amount"), r))) for r in rows))

    return land, *(str(tmp_path / x) for x in ("landing", "target", "checkpoint"))


def run(spark, landing, target, checkpoint, merge=lambda rows: first_rows(rows, ["tx", "amount"])):
    ingest(spark, landing, SCHEMA, target, checkpoint, ["tx", "amount"], merge, buckets=8)


def rows(spark, target):
    return sorted(map(tuple, stored(spark, target, SCHEMA).select("seq", "tx", "amount").collect()), key=str)


def files(target):
    return {os.path.join(d, f) for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}


def test_ingest_is_replay_safe(spark, folders):
    land, *where = folders
    land("a.json", [(1, "x", 5), (2, "x", 5), (3, None, 5)])
    run(spark, *where)
    land("b.json", [(3, "x", 5), (4, "y", 6), (5, None, 5)])
    run(spark, *where)
    want = [(1, "x", 5), (3, None, 5), (4, "y", 6)]
    assert rows(spark, where[1]) == want
    run(spark, *where)  # nothing new
    land("c.json", [(4, "y", 6), (1, "x", 5)])  # the same rows under another name
    run(spark, *where)
    assert rows(spark, where[1]) == want


def test_untouched_buckets_keep_their_files(spark, folders):
    land, *where = folders
    land("a.json", [(i, f"t{i}", i) for i in range(40)])
    run(spark, *where)
    before = files(where[1])
    land("b.json", [(100, "t7", 7), (101, "new", 1)])
    run(spark, *where)
    after, touched = files(where[1]), {r[0] for r in stored(spark, where[1], SCHEMA).filter("tx in ('t7', 'new')").select(BUCKET).collect()}
    folder = lambda path: int(path.split(f"{BUCKET}=")[1].split("/")[0])
    assert len(before) == len(after) == 8 and len(touched) <= 2
    assert {f for f in before if folder(f) not in touched} == {f for f in after if folder(f) not in touched}
    assert not {f for f in before if folder(f) in touched} & after
    assert len(rows(spark, where[1])) == 41
    plan = stored(spark, where[1], SCHEMA).filter(f"{BUCKET} = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan


def test_a_batch_that_was_cut_off_is_put_in_place_again(spark, folders):
    """The driver is lost after half of the partitions were replaced: the replay takes what the batch had written."""
    land, *where = folders
    land("a.json", [(i, f"t{i}", i) for i in range(20)])
    run(spark, *where)
    land("b.json", [(50 + i, f"t{i}", i) for i in range(20)] + [(99, "z", 0)])
    want = sorted([(i, f"t{i}", i) for i in range(20)] + [(99, "z", 0)], key=str)

    class Lost(Exception):
        pass

    writer = type(spark.range(1).write)
    plain = writer.partitionBy

    def lost(self, *columns):
        raise Lost

    writer.partitionBy = lost
    try:
        with pytest.raises(Exception, match="Lost"):
            run(spark, *where)
    finally:
        writer.partitionBy = plain
    gone = sorted(files(where[1]))[0]
    os.remove(gone)  # a partition that was being replaced
    called = []
    run(spark, *where, merge=lambda r: called.append(1) or first_rows(r, ["tx", "amount"]))
    assert rows(spark, where[1]) == want and not called


def test_nothing_landed(spark, folders):
    _, *where = folders
    run(spark, *where)
    assert not os.path.exists(where[1])
