"""Landed intelligence files: sanctions lists, tag packs, manifests; numbers beyond 64 bits."""

import hashlib

from pyspark.sql import functions as F

from ledgerloom.operators import enrichment as e
from ledgerloom.sources import intelligence as p

ADDRESS = "0x" + "ab" * 20


def test_sanctions_file(spark, tmp_path):
    entry = lambda uid, body: f"<sdnEntry><uid>{uid}</uid>{body}</sdnEntry>"
    ids = lambda kind, number: f"<idList><id><uid>9</uid><idType>{kind}</idType><idNumber>{number}</idNumber></id></idList>"
    eth = p.DIGITAL_CURRENCY + "ETH"
    text = "<sdnList><publshInformation><Publish_Date>01/02/2026</Publish_Date></publshInformation>" + "\n".join([
        entry(1, "<firstName>Ann</firstName><lastName>LEE</lastName><sdnType>Individual</sdnType><programList><program> CYBER2 </program></programList>" + ids(eth, ADDRESS.upper().replace("0X", "0x"))),
        entry(2, "<lastName>CORP</lastName><sdnType>Entity</sdnType>" + ids(p.DIGITAL_CURRENCY + "XMR", "4x")),
        entry(3, "<lastName>BAD</lastName><sdnType>Entity</sdnType>" + ids(eth, "0x12")),
        entry(4, "<lastName>NONE</lastName><sdnType>Entity</sdnType>" + ids("Passport", "P")),
    ]) + "</sdnList>"
    (tmp_path / "list.xml").write_text(text)
    rows = p.adapt_sanctions(p.read_sanctions(spark, f"file://{tmp_path}/list.xml"), {"ETH": "ethereum"}).collect()
    assert {r["uid"]: (r["outcome"], r["address"], r["rationale"]) for r in rows} == {"1": ("ok", ADDRESS, "OFAC SDN: LEE, Ann (CYBER2)"), "2": ("unsupported", None, "OFAC SDN: CORP"), "3": ("error", None, "OFAC SDN: BAD")}


def test_tagpack_inherits(spark):
    levels = p.adapt_confidence(spark.createDataFrame([("# note",), ("id,level",), ("web_crawl,20",), ("",)], "value string"))
    pack = '{"title": "t", "source": "link", "header": {"currency": "eth", "confidence": "web_crawl"}, "tags": [{"address": "%s", "label": "X", "abuse": "scam", "actor": "a1", "is_cluster_definer": "true"}, {"address": "%s", "label": "Y", "currency": "DOGE"}, {"label": "Z"}]}' % (ADDRESS, ADDRESS)
    tags = p.adapt_tagpack(spark.createDataFrame([(pack,)], "payload string"), levels, {"ETH": "ethereum"})
    assert [(r["outcome"], r["confidence"], r["note"]) for r in tags.orderBy("tag").collect()] == [("ok", 0.2, "source: link | confidence: web_crawl"), ("unsupported", 0.2, "source: link | confidence: web_crawl"), ("error", 0.2, "source: link | confidence: web_crawl")]
    assert [tuple(r) for r in e.tag_risks(tags).collect()] == [("ethereum", ADDRESS, "scam", "X — link")]
    actors = p.adapt_actorpack(spark.createDataFrame([('{"actors": [{"id": "a1", "label": "Actor", "categories": ["exchange"]}, {"id": "", "label": "none"}]}',)], "payload string"))
    assert [tuple(r) for r in e.actor_entities(actors, tags).collect()] == [("a1", "Actor", "exchange")]
    assert [tuple(r) for r in e.actor_memberships(tags).collect()] == [("a1", "ethereum", ADDRESS, 0.2, "cluster-definer")]


def test_long_hex_numbers(spark):
    rows = spark.createDataFrame([("0x" + "f" * 64,), ("0x10",), (None,), ("0xzz",), ("0x",)], "x string")
    assert [r["n"] for r in rows.select(p.hex_to_decimal("x").alias("n")).collect()] == [str(2**256 - 1), "16", "0", None, None]


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for name, data in (("case.db", b"a"), ("raw/x.json", b"b"), ("raw/y.tmp", b"c"), ("manifest.json", b"{}")):
        (tmp_path / name).write_bytes(data)
    manifest = p.build_manifest(spark, f"file://{tmp_path}")
    assert {r["path"]: r["digest"] for r in manifest.collect()} == {"case.db": hashlib.sha256(b"a").hexdigest(), "raw/x.json": hashlib.sha256(b"b").hexdigest()}
    refs = spark.createDataFrame([("raw/x.json",), ("../etc",), ("/abs",), ("raw/none",), ("",)], "path string")
    assert {tuple(r) for r in p.check_references(refs, manifest).collect()} == {("../etc", "unsafe"), ("/abs", "unsafe"), ("raw/none", "absent")}
    parts = {r["part"]: r["ok"] for r in p.verify_bundle(manifest, manifest.withColumn("digest", F.lit("x")), refs.limit(1), spark.createDataFrame([("c", True)], "check string, ok boolean")).collect()}
    assert parts == {"manifest": False, "references": True, "audits": True}
