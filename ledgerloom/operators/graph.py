"""The graph read model: projection, bounded views, grouping, communities, and edits of entities (GRF-05, GRF-19 to GRF-22, GRF-24, TOP-02)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cap, short
from ..scratch import discard, new_folder, table
from .clustering import resolve_merges
from .components import connected_components
from .rosters import numbered

#: Counterparties that an expanded bundle shows, and members that make a pool; fixed values.
REVEALED, LEAST_POOL = 50, 2


def build_edges(movements: DataFrame, inputs: DataFrame) -> DataFrame:
    """GRF-20, edges: id, kind, source, target, asset, amount, value, no_price, seq, source_name.

    movements: subject_type, id, tx_id, src, dst, asset, amount, value, seq, source_name. Transfers run from address to
    address; an output runs from its transaction, an input to it, and no input is tied to an output. An end that is not
    known is the node 'external'.
    """
    address = lambda c: F.coalesce(F.concat(F.lit("addr:"), c), F.lit("external"))
    tx = F.concat(F.lit("tx:"), F.col("tx_id").cast("string"))
    output = F.col("subject_type") == "tx_output"
    moved = movements.select(
        F.concat(F.when(output, "out:").otherwise("mv:"), F.col("id").cast("string")).alias("id"), F.when(output, "tx_output").otherwise("transfer").alias("kind"),
        F.when(output, tx).otherwise(address(F.col("src"))).alias("source"), address(F.col("dst")).alias("target"), "asset", "amount", "value", F.col("value").isNull().alias("no_price"), "seq", "source_name",
    )
    spent = inputs.select(
        F.concat(F.lit("in:"), F.col("id").cast("string")).alias("id"), F.lit("tx_input").alias("kind"), address(F.col("address")).alias("source"), tx.alias("target"), "asset", "amount",
        F.lit(None).cast("long").alias("value"), F.lit(True).alias("no_price"), "seq", "source_name",
    )
    return moved.unionByName(spent)


def mark_edges(edges: DataFrame, settled: DataFrame, contested: DataFrame, unverified: DataFrame, poison: DataFrame) -> DataFrame:
    """GRF-20: edges with finality, contested, unverified and poison.

    settled: one row, settled: the greatest height that is final; an edge above it, or without a height, is provisional. contested and poison: id of
    edges whose valuations differ, and of poisoning suspects. unverified: asset of tokens that nobody vouches for; it marks transfers without a price.
    """
    marked = edges.join(contested.select("id").distinct().withColumn("contested", F.lit(True)), "id", "left").join(poison.select("id").distinct().withColumn("poison", F.lit(True)), "id", "left")
    marked = marked.join(unverified.select("asset").distinct().withColumn("__token", F.lit(True)), "asset", "left").join(settled.select("settled"))  # one row
    flag = lambda c: F.coalesce(c, F.lit(False))
    return marked.select(
        *edges.columns, F.when(F.col("seq").isNull() | (F.col("seq") > F.col("settled")), "provisional").otherwise("final").alias("finality"), flag(F.col("contested")).alias("contested"),
        (flag(F.col("__token")) & (F.col("kind") == "transfer") & F.col("no_price")).alias("unverified"), flag(F.col("poison")).alias("poison"),
    )


def trace_overlay(links: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-20 with TRC-04: effective trace links (source_id, dest_id, source, target, amount) as edges of kind trace, in the columns of `edges`."""
    node = lambda c: F.coalesce(F.concat(F.lit("addr:"), c), F.lit("external"))
    own = {"id": F.concat_ws("-", F.lit("trace"), "source_id", "dest_id"), "kind": F.lit("trace"), "source": node(F.col("source")), "target": node(F.col("target")), "asset": F.lit("BTC"), "amount": F.col("amount"), "no_price": F.lit(True)}
    no = {"contested", "unverified", "poison"}
    return links.select(*(own.get(f.name, F.lit(False) if f.name in no else F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.schema.fields))


class EdgeStore:
    """GRF-20, GRF-21: edges in folders by a hash of their source and, a second time, of their target, so that a step from some nodes reads only the folders
    that these fall into, whatever the size of the graph. Give as many folders as the graph has pieces that a task may read."""

    def __init__(self, edges: DataFrame, buckets: int = 64):
        self.spark, self.buckets, self.path, self.schema = edges.sparkSession, buckets, new_folder(edges.sparkSession, "edge-store"), edges.schema
        for end in ("source", "target"):
            edges.withColumn("__bucket", self._bucket(F.col(end))).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{end}")

    def _bucket(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def incident(self, nodes: list[str], end: str) -> DataFrame:
        """The edges whose `end` is one of the nodes."""
        places = self.spark.createDataFrame([(n,) for n in nodes], "n string").select(self._bucket(F.col("n")).alias("b")).distinct().collect()
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        stored = self.spark.read.schema(f"{ddl}, __bucket int").parquet(f"{self.path}/{end}")
        return stored.filter(F.col("__bucket").isin([r["b"] for r in places]) & F.col(end).isin(nodes)).drop("__bucket")


def build_nodes(edges: DataFrame, custom: DataFrame, entities: DataFrame, risks: DataFrame) -> DataFrame:
    """GRF-20, nodes: id, kind, label, custom_label, risk, attributed for every end of an edge.

    custom and entities: address, label; risks: address. A label of the investigator's own wins over the entity, which
    stands above the short form of the address; a transaction has its short form, the outside '(external)'.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    name = F.regexp_replace("id", "^(addr|tx):", "")
    kind = F.when(F.col("id").startswith("addr:"), "address").when(F.col("id").startswith("tx:"), "transaction").otherwise("external")
    nodes = ends.select("id", kind.alias("kind"), F.when(kind == "address", name).alias("address"), short(name).alias("alias"))
    one = lambda rows, label: rows.groupBy("address").agg(F.min("label").alias(label))
    nodes = nodes.join(one(custom, "own"), "address", "left").join(one(entities, "entity"), "address", "left").join(risks.select("address").distinct().withColumn("risk", F.lit(True)), "address", "left")
    label = F.when(F.col("own").isNotNull(), cap(F.col("own"), 28)).when(F.col("entity").isNotNull(), F.concat(cap(F.col("entity"), 28), F.lit("\n"), "alias")).when(F.col("kind") == "external", "(external)").otherwise(F.col("alias"))
    return nodes.select("id", "kind", label.alias("label"), F.col("own").isNotNull().alias("custom_label"), F.coalesce("risk", F.lit(False)).alias("risk"), F.col("entity").isNotNull().alias("attributed"))


def default_focus(edges: DataFrame, seed: str | None = None) -> str | None:
    """TOP-02: the seed if it has one, else the address of the highest (degree, id); None without addresses."""
    if seed is not None:
        return seed
    degree = edges.select(F.explode(F.array("source", "target")).alias("node")).filter(F.col("node").startswith("addr:")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = degree.orderBy(F.desc("degree"), F.desc("node")).first()
    return top["node"] if top else None


def find_focus(nodes: DataFrame, texts: list[str], default: str | None) -> DataFrame:
    """FLT-10: text, node, how for each text that a user asks for: the node of that id, else that of the address, else of an address that begins so, without
    regard to case and outer spaces, the least id of several; else the default focus. nodes: id, address. One pass over the nodes for all texts."""
    said = [(t, t.strip().lower()) for t in texts]
    address = F.lower(F.coalesce("address", F.lit("")))
    least = lambda when, name: F.min(F.when(when, F.col("id"))).alias(name)
    found = nodes.agg(F.count(F.lit(1)).alias("n"), *(c for i, (t, q) in enumerate(said) for c in (least(F.col("id") == t, f"id{i}"), least((address == q) & F.lit(q != ""), f"exact{i}"), least(address.startswith(q) & F.lit(q != ""), f"prefix{i}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("text"), *(F.col(f"{how}{i}").alias(how) for how in ("id", "exact", "prefix"))) for i, (t, _) in enumerate(said))))
    how = F.when(F.col("r.id").isNotNull(), "id").when(F.col("r.exact").isNotNull(), "exact").when(F.col("r.prefix").isNotNull(), "prefix").otherwise("default")
    return found.select(rows.alias("r")).select("r.text", F.coalesce("r.id", "r.exact", "r.prefix", F.lit(default)).alias("node"), how.alias("how"))


def neighbour_order(edges: DataFrame, anchor: str, mode: str = "value") -> DataFrame:
    """WIN-10: node, asset, key, place, tray: the neighbours of an anchor in the order of their best edge, by value, by sequence (height) or by native amount.

    Only movements count, not traces or bundles. A neighbour's key is its greatest; native amounts are ordered within their asset (ties of a
    neighbour's best go to the least asset), the others on one scale. Neighbours without a key have no place and lie in the tray.
    """
    key = {"value": F.col("value"), "sequence": F.col("seq"), "native": F.when(F.col("amount") > 0, F.col("amount"))}[mode]
    other = F.when(F.col("source") == anchor, F.col("target")).when(F.col("target") == anchor, F.col("source"))
    own = edges.filter(F.col("kind").isin("transfer", "tx_input", "tx_output")).select(other.alias("node"), (F.coalesce("asset", F.lit("?")) if mode == "native" else F.lit("")).alias("asset"), key.cast("long").alias("key")).filter(F.col("node") != anchor)
    best = own.groupBy("node").agg(F.max("key").alias("key"), F.min_by("asset", F.when(F.col("key").isNotNull(), F.struct(-F.col("key"), "asset"))).alias("asset"))
    placed = numbered(best.filter("key is not null").select("node", "asset", "key"), ["asset", "key", "node"])
    tray = best.filter("key is null").select("node", F.lit("").alias("asset"), "key", F.lit(None).cast("long").alias("place"))
    return placed.withColumn("place", F.col("place").cast("long")).unionByName(tray).withColumn("tray", F.col("key").isNull())


def magnitude(basis: str = "usd") -> Column:
    """FLT-09: the number an edge is judged by: its value, null without a price, or in native basis its amount."""
    return F.col("amount") if basis == "native" else F.col("value")


@dataclass
class View:
    """A bounded view: nodes (id, depth), edges (all columns), folds (hub, direction, bucket, edges, others, value, no_price), and what bounded it."""

    nodes: DataFrame
    edges: DataFrame
    folds: DataFrame
    focus: str
    bounded: bool


def build_view(
    nodes: DataFrame, edges: DataFrame | EdgeStore, focus: str, hops: int = 1, node_cap: int = 150, basis: str = "usd", group_dust: bool = True, dust_value=0, dust_amount=0, least_value=None,
    kinds: list[str] | None = None, fold_value=None, fold_amounts: dict[str, int] | None = None, only_flagged: bool = False, show_unverified: bool = False, fold_poison: bool = True, expand: tuple[str, ...] = (),
) -> View:
    """GRF-21: the neighbourhood of a focus, at most node_cap nodes; what is folded away is counted, never dropped.

    nodes: id, kind, flagged; edges: those of build_edges with unverified and poison. Around each hub, first edges in, then
    out, every edge falls in one bucket, in this order of tests: flagged counterparties and trace edges are significant;
    unverified tokens; poison suspects; dust by value, or by amount without a price; edges below the fold of their asset
    or of all; the rest is significant. Significant edges are ranked (without a price above the others, then by magnitude,
    ties by id), those beyond the room left are dust. Hubs of one hop share the room in the order in which they were
    reached. Buckets named in `expand` ("dust:<hub>:<direction>", or with :more) show their first REVEALED members, or
    all that there is room for. Only addresses and transactions are walked on from.

    What comes to the driver are kept nodes and edges, node_cap at most for each hub and direction. Incident edges are
    found in the folders of an EdgeStore, or in a plain table of edges by a filter on the hubs, which reaches the scan; buckets
    are aggregates with map-side combine.
    """
    around = edges.incident if isinstance(edges, EdgeStore) else lambda hubs, end: edges.filter(F.col(end).isin(hubs))
    near = F.col("value") if basis != "native" else F.lit(None).cast("long")
    small = F.when(near.isNotNull(), near < dust_value).otherwise(F.coalesce("amount", F.lit(0)) < dust_amount)
    mag = magnitude(basis)
    usable = F.lit(True) if not kinds else F.col("kind").isin(kinds)
    if least_value is not None:
        usable &= mag.isNull() | (mag >= least_value)
    usable |= F.col("kind") == "trace"
    below = F.lit(None).cast("string")
    for asset, most in (fold_amounts or {}).items():
        below = F.when((F.col("asset") == asset) & (F.coalesce("amount", F.lit(0)) < most), F.lit(f"fold:{asset}")).otherwise(below)
    below = F.coalesce(below, F.when(mag < fold_value, "fold")) if fold_value is not None else below
    shown = F.coalesce("flagged", F.lit(False)) | (F.col("kind") == "trace")
    bucket = F.when(shown, "significant")
    bucket = bucket if show_unverified else bucket.when(F.col("unverified"), "unverified")
    bucket = bucket.when(F.col("poison"), "poison") if fold_poison else bucket
    bucket = bucket.when(small, "dust") if group_dust else bucket
    bucket = bucket.when(below.isNotNull(), below)
    bucket = bucket.when(F.lit(only_flagged), "dust").otherwise("significant")
    flags = nodes.select(F.col("id").alias("other"), F.col("flagged"), F.col("kind").alias("other_kind"))
    rank = [F.when(near.isNull() & F.lit(basis != "native"), 1).otherwise(0).desc(), F.coalesce(mag, F.col("amount"), F.lit(0)).desc(), F.col("id")]

    depth, frontier, bounded = {focus: 0}, [focus], False
    kept_edges: dict[str, int] = {}
    folds: list[DataFrame] = []
    for hop in range(hops):
        reached: list[str] = []
        for direction, end, other in (("in", "target", "source"), ("out", "source", "target")):
            incident = around(frontier, end).filter(usable & (F.col(end) != F.col(other))).withColumnsRenamed({end: "hub", other: "other"})
            dealt = incident.join(flags, "other", "left").withColumn("bucket", bucket)
            dealt = table(dealt.select("id", "kind", "hub", "other", "other_kind", "asset", "amount", "value", "no_price", "bucket"), "view-edges")
            turn = F.array_position(F.lit(frontier), F.col("hub"))

            def keep(chosen: DataFrame, room: int) -> DataFrame:
                """Keeps the first `room` edges in the order of hubs and ranks; returns those that are left."""
                nonlocal bounded
                first = chosen.withColumn("turn", turn).withColumn("n", F.row_number().over(W.partitionBy("hub").orderBy(*rank))).filter(F.col("n") <= room)
                rows = first.orderBy("turn", "n").limit(room).select("id", "other", "other_kind").collect() if room > 0 else []
                for r in rows:
                    kept_edges[r["id"]] = hop
                    if r["other"] not in depth:
                        depth[r["other"]] = hop + 1
                        if r["other_kind"] in ("address", "transaction"):
                            reached.append(r["other"])
                left = chosen.filter(~F.col("id").isin([r["id"] for r in rows])) if rows else chosen
                return left

            rest = keep(dealt.filter("bucket = 'significant'"), max(0, node_cap - len(depth)))
            rest = rest.withColumn("bucket", F.lit("dust")).unionByName(dealt.filter("bucket <> 'significant'"))
            for hub in frontier:
                for name in sorted({x.rsplit(":more", 1)[0] for x in expand if f":{hub}:{direction}" in x}):
                    label = name[: -len(f":{hub}:{direction}")]
                    own = rest.filter((F.col("hub") == hub) & (F.col("bucket") == label))
                    room = max(0, node_cap - len(depth))
                    left = keep(own, room if f"{name}:more" in expand else min(REVEALED, room))
                    rest = rest.filter(~((F.col("hub") == hub) & (F.col("bucket") == label))).unionByName(left.withColumn("bucket", F.lit(f"{label}:more")))
            folded = table(
                rest.groupBy("hub", F.lit(direction).alias("direction"), "bucket").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("other").alias("others"), F.sum("value").alias("value"), F.count_if("no_price").alias("no_price")), "view-folds"
            )
            bounded = bounded or not folded.isEmpty()
            folds.append(folded)
        frontier = reached
        if not frontier:
            break
    spark = nodes.sparkSession
    inside = list(depth)
    kept = around(inside, "source").filter(usable & F.col("target").isin(inside) & (F.col("id").isin(list(kept_edges)) | (F.col("kind") == "trace")))
    counted = folds[0]
    for f in folds[1:]:
        counted = counted.unionByName(f)
    return View(spark.createDataFrame(list(depth.items()), "id string, depth int"), kept, counted, focus, bounded)


def group_parents(members: DataFrame) -> DataFrame:
    """GRF-22: node, parent. members: node, group. A node has one parent: the least of its groups that then has two members or more.

    Groups are settled in order of their id, many at a time: a group is ready when no node in it could still go to a
    lesser one. Each round is an aggregate and two joins; every round settles the least group that is left.
    """
    left, settled = table(members.select("node", "group").distinct(), "group-members"), []
    while not left.isEmpty():
        least = left.groupBy("node").agg(F.min("group").alias("least"))
        ready = left.join(least, "node").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("least") < F.col("group")).alias("open")).filter("open = 0")
        taken = table(left.join(ready.filter("n >= 2"), "group", "left_semi").select("node", F.col("group").alias("parent")), "group-parents")
        settled.append(taken)
        left = table(left.join(ready, "group", "left_anti").join(taken, "node", "left_anti").select("node", "group"), "group-members")
    out = members.sparkSession.createDataFrame([], members.select("node", F.col("group").alias("parent")).schema)
    for t in settled:
        out = out.unionByName(t)
    return out


def denomination_parents(edges: DataFrame, focus: str, parents: DataFrame, least: int = LEAST_POOL) -> DataFrame:
    """GRF-24: node, parent, pool_size of the focus's counterparties that share one exact amount of one asset; parents that are set win.

    A counterparty of several pools goes to the last of them by (asset, amount).
    """
    other = F.when(F.col("source") == focus, F.col("target")).when(F.col("target") == focus, F.col("source"))
    moved = edges.filter(F.col("kind").isin("transfer", "tx_input", "tx_output") & (F.coalesce("amount", F.lit(0)) != 0)).select(other.alias("node"), "asset", "amount").filter(F.col("node").startswith("addr:"))
    free = moved.distinct().join(parents.select("node"), "node", "left_anti")
    pools = free.groupBy("asset", "amount").agg(F.count(F.lit(1)).alias("pool_size")).filter(F.col("pool_size") >= least)
    best = free.join(pools, ["asset", "amount"]).groupBy("node").agg(F.max(F.struct("asset", "amount", "pool_size")).alias("p"))
    return best.select("node", F.concat_ws(":", F.lit("dgrp"), F.lit(focus), "p.asset", F.col("p.amount").cast("string")).alias("parent"), F.col("p.pool_size").alias("pool_size"))


def view_parents(view_nodes: DataFrame, view_edges: DataFrame, entities: DataFrame, focus: str, resolution: float = 1.0, least: int = LEAST_POOL) -> DataFrame:
    """GRF-24: node, parent, kind of the nodes of a bounded view: the entity wins over the pool of one denomination, that over the community.

    view_nodes: id; view_edges: those of the view; entities: node, parent. Communities are those of the view's own edges between addresses that
    have no parent yet; the focus has none. A view is bounded, so this is small work whatever the graph.
    """
    inside = view_nodes.select(F.col("id").alias("node")).filter(F.col("node") != focus)
    own = table(entities.join(inside, "node", "left_semi").groupBy("node").agg(F.min("parent").alias("parent")).withColumn("kind", F.lit("entity")), "view-entities")
    pools = denomination_parents(view_edges, focus, own, least).join(inside, "node", "left_semi").select("node", "parent", F.lit("denomination").alias("kind"))
    settled = table(own.unionByName(pools), "view-parents")
    free = inside.filter(F.col("node").startswith("addr:")).join(settled, "node", "left_anti").select("node")
    among = view_edges.join(free.withColumnRenamed("node", "source"), "source", "left_semi").join(free.withColumnRenamed("node", "target"), "target", "left_semi")
    found = communities(among.select("source", "target"), resolution)
    return settled.unionByName(found.select("node", F.concat(F.lit("comm:"), "community").alias("parent"), F.lit("community").alias("kind")))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 10) -> DataFrame:
    """GRF-19: node, community: groups of two nodes or more that are linked more densely than their degrees let expect, and connected.

    edges: source, target; parallel edges add up, direction does not count, loops go. In levels: nodes move to the neighbouring community of the
    best gain in modularity (_moves); each community is refined, by moves within it that start from single nodes, into parts that are
    connected; the parts are contracted into the nodes of a smaller weighted graph, which start from the communities they came from.
    It ends when nothing contracts or modularity stops rising; the best level's communities are projected back and split into connected parts.
    A level is a bounded number of joins and aggregates over its edges, and levels shrink. All weights are whole, so sums and the result don't
    depend on partitions. A partition of its own, not that of another algorithm; structure, not ownership.
    """
    a, b = F.least("source", "target"), F.greatest("source", "target")
    named = table(edges.select(a.alias("x"), b.alias("y")).filter("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "community-named")
    names = _numbered(named.select(F.col("x").alias("name")).unionByName(named.select(F.col("y").alias("name"))).distinct())
    end = lambda name, out: names.select(F.col("name").alias(name), F.col("node").alias(out))
    graph = table(named.join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b", "w"), "community-edges")
    nodes = table(_both(graph).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")).withColumn("label", F.col("node")), "community-nodes")
    total = nodes.agg(F.sum("degree")).first()[0] or 1.0
    place = nodes.select(F.col("node").alias("origin"), "node")
    best, found = None, None
    for _ in range(levels):
        moved = _moves(graph, nodes, total, resolution, rounds)
        ends = table(_ends(graph, moved), "community-ends")
        across = ends.filter("x <> y").agg(F.sum("w")).first()[0] or 0.0
        mass = moved.groupBy("label").agg(F.sum("degree").alias("mass")).agg(F.sum(F.col("mass") * F.col("mass"))).first()[0] or 0.0
        quality = (total - 2 * across) / total - resolution * mass / total**2  # modularity, as weights within a node never leave it
        if best is not None and quality <= best:
            break
        inside = ends.filter("x = y").select("a", "b", "w")
        best, found = quality, (place, inside)
        parts = _moves(inside, nodes.withColumn("label", F.col("node")), total, resolution, 2)
        linked = _ends(inside, parts).filter("x = y").select("a", "b")
        single = moved.join(connected_components(linked), "node", "left").select("node", "degree", "label", F.coalesce("component", "node").alias("part"))
        single = table(single, "community-parts")
        size, was = single.select("part").distinct().count(), nodes.count()
        if size == was:
            break
        name = single.groupBy("label").agg(F.min("part").alias("name"))
        nodes = table(single.join(name, "label").groupBy(F.col("part").alias("node")).agg(F.sum("degree").alias("degree"), F.min("name").alias("label")), "community-nodes")
        across = _ends(graph, single.select("node", F.col("part").alias("label"))).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")
        graph = table(across.groupBy("a", "b").agg(F.sum("w").alias("w")), "community-edges")
        place = table(place.join(single.select("node", "part"), "node").select("origin", F.col("part").alias("node")), "community-places")
        found = place, _ends(graph, nodes).filter("x = y").select("a", "b", "w")  # the same communities on the smaller graph
    place, inside = found
    joined = connected_components(inside.select("a", "b"))  # a node is connected and named by its least member, whatever the level
    members = table(place.join(joined, "node", "left").select("origin", F.coalesce("component", "node").alias("group")), "community-members")
    several = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("group")
    called = several.join(names.select(F.col("node").alias("group"), F.col("name").alias("community")), "group")
    return members.join(called, "group").join(names.select(F.col("node").alias("origin"), F.col("name").alias("node")), "origin").select("node", "community")


def _numbered(names: DataFrame) -> DataFrame:
    """name, node: whole numbers from 0 in the order of the names, whatever the partitions. Only their sizes meet in one task."""
    ordered = table(names.orderBy("name").withColumn("at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return table(ordered.withColumn("part", part).join(starts, "part").select("name", (F.col("at") - F.shiftleft("part", 33) + F.col("start")).alias("node")), "numbered")


def _both(weights: DataFrame) -> DataFrame:
    return weights.unionByName(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _ends(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels x and y of their ends."""
    return weights.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")


def modularity(weights: DataFrame, labels: DataFrame, resolution: float = 1.0, total: float | None = None) -> float:
    """Newman's modularity of labels (node, label) on undirected weights (a, b, w; each pair once, no loops). A node without a label is one by itself."""
    degrees = _both(weights).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    total = total or degrees.agg(F.sum("degree")).first()[0] or 1.0
    within = _ends(weights, labels).filter("x = y").agg(F.sum("w")).first()[0] or 0.0
    named = degrees.join(labels, "node", "left").withColumn("group", F.struct("label", F.when(F.col("label").isNull(), F.col("node"))))
    mass = named.groupBy("group").agg(F.sum("degree").alias("mass")).agg(F.sum(F.col("mass") * F.col("mass"))).first()[0] or 0.0
    return 2 * within / total - resolution * mass / total**2


def _moves(weights: DataFrame, nodes: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """nodes (node, degree, label) after moves to the neighbouring label of the best gain, ties to staying, then to the lesser label.

    A round moves one half of the nodes and then the other, by a hash that changes from round to round, as neighbours that move at once would swap
    for ever. It ends when a round moves none. Edges are shuffled for the labels of one end, where those are not broadcast, and once by the
    other; the rest is work on nodes.
    """
    both, labels = _both(weights), nodes.select("node", "degree", "label")
    for turn in range(2 * rounds):
        half = lambda node: F.pmod(F.xxhash64(node, F.lit(turn // 2)), F.lit(2)) == turn % 2  # noqa: B023, E731
        placed = labels.join(labels.groupBy("label").agg(F.sum("degree").alias("mass")), "label")
        own = placed.filter(half("node")).select("node", "degree", F.col("label").alias("was"), F.col("mass").alias("own"))
        near = both.filter(half("a")).join(placed.select(F.col("node").alias("b"), "label", "mass"), "b").select(F.col("a").alias("node"), "label", "mass", "w")
        towards = near.repartition("node").groupBy("node", "label").agg(F.sum("w").alias("w"), F.first("mass").alias("mass"))
        loss = lambda mass, w: F.round(resolution * F.col("degree") * mass / total - w, 9)
        other = F.col("label") != F.col("was")
        offers = towards.join(own, "node").groupBy("node").agg(
            F.min(F.when(other, F.struct(loss(F.col("mass"), F.col("w")).alias("loss"), "label"))).alias("to"), F.sum(F.when(~other, F.col("w")).otherwise(0.0)).alias("w"),
            F.first("degree").alias("degree"), F.first("own").alias("own"),
        )
        best = offers.filter(F.col("to.loss") < loss(F.col("own") - F.col("degree"), F.col("w"))).select("node", F.col("to.label").alias("to"))
        moved = labels.join(best, "node", "left").select("node", "degree", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("goes"))
        old, labels = labels, table(moved, "community-labels")
        went = labels.agg(F.count_if("goes")).first()[0]
        labels = labels.drop("goes")
        if turn:
            discard(old)
        if turn % 2 and not went and not before:
            break
        before = went
    return labels


def merge_entities(entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-05, merge: entities (id, merged_into) after a batch of merges (into, from), and those that were rejected, with the reason.

    The pointer of `from` goes to the terminal of `into`. An unknown id, a merge of an entity into itself or into one that resolves back to it
    (cycle) is rejected; one that is in force already changes nothing. Of several merges of one entity the least target counts.
    """
    asked = merges.select(F.col("into"), F.col("from")).distinct()
    terminals = resolve_merges(entities).select("id", "terminal")
    ends = entities.select("id").join(terminals, "id", "left").select("id", F.coalesce("terminal", "id").alias("terminal"))
    placed = asked.join(ends.select(F.col("id").alias("into"), F.col("terminal").alias("target")), "into", "left").join(ends.select(F.col("id").alias("from"), F.col("terminal").alias("source")), "from", "left")
    why = F.when(F.col("target").isNull() | F.col("source").isNull(), "unknown entity").when(F.col("target") == F.col("source"), "already merged").when(F.col("target") == F.col("from"), "cycle")
    judged = table(placed.withColumn("why", why), "entity-merges")
    chosen = judged.filter("why is null").groupBy(F.col("from").alias("id")).agg(F.min("target").alias("to"))
    merged = table(entities.join(chosen, "id", "left").select("id", F.coalesce("to", "merged_into").alias("merged_into"), F.col("to").isNotNull().alias("new")), "entities")
    looped = resolve_merges(merged.select("id", "merged_into")).filter("cyclic").select("id").join(merged.filter("new").select("id"), "id", "left_semi").withColumn("looped", F.lit(True))
    looped = table(looped, "entity-cycles")  # merges of one batch that only together make a cycle
    kept = merged.join(looped, "id", "left").join(entities.select("id", F.col("merged_into").alias("old")), "id").select("id", F.when(F.col("looped"), F.col("old")).otherwise(F.col("merged_into")).alias("merged_into"))
    rejected = judged.filter("why is not null").select("into", "from", "why").unionByName(judged.filter("why is null").join(looped.select(F.col("id").alias("from")), "from", "left_semi").select("into", "from", F.lit("cycle").alias("why")))
    return kept, rejected


def split_addresses(memberships: DataFrame, retractions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-05, split: memberships (id, entity, address) and retractions (id) after each asked membership (id) is retracted and its address put in an entity of its own.

    Rows are only added. The new entity and membership have ids that depend on the split alone; unknown memberships and repeated splits change nothing.
    """
    out = memberships.join(asked.select("id").distinct().join(retractions, "id", "left_anti"), "id", "left_semi")
    digest = lambda prefix: F.sha2(F.concat(F.lit(f"{prefix}|"), F.col("id").cast("string")), 256)
    fresh = out.select(digest("membership").alias("id"), digest("entity").alias("entity"), "address")
    return memberships.select(F.col("id").cast("string").alias("id"), F.col("entity").cast("string").alias("entity"), "address").unionByName(fresh), retractions.unionByName(out.select("id"))


def canonical_choice(memberships: DataFrame, retractions: DataFrame, terminals: DataFrame, asked: DataFrame) -> DataFrame:
    """GRF-05, canonical choice: entity, membership, outcome for choices (entity, membership). terminals: id, terminal.

    A membership is accepted if it belongs to the entity that the chosen one resolves to and is not retracted.
    """
    end = lambda name, out: terminals.select(F.col("id").alias(name), F.col("terminal").alias(out))
    known = memberships.select(F.col("id").alias("membership"), F.col("entity").alias("owner")).join(retractions.select(F.col("id").alias("membership"), F.lit(True).alias("gone")), "membership", "left")
    rows = asked.join(known, "membership", "left").join(end("entity", "a"), "entity", "left").join(end("owner", "b"), "owner", "left")
    outcome = F.when(F.col("owner").isNull() | (F.coalesce("a", "entity") != F.coalesce("b", "owner")), "not of this entity").when(F.col("gone"), "retracted").otherwise("accepted")
    return rows.select("entity", "membership", outcome.alias("outcome"))


def entity_roster(entities: DataFrame, memberships: DataFrame, retractions: DataFrame) -> DataFrame:
    """AGG-29: entity, name, members of canonical entities with an active membership; memberships of merged entities count for their terminal."""
    ends = entities.select("id").join(resolve_merges(entities).select("id", "terminal"), "id", "left").select(F.col("id").alias("entity"), F.coalesce("terminal", "id").alias("terminal"))
    active = memberships.join(retractions.select("id"), "id", "left_anti").join(ends, "entity")
    n = active.groupBy(F.col("terminal").alias("entity")).agg(F.countDistinct("member").alias("members"))
    return n.join(entities.select(F.col("id").alias("entity"), "name"), "entity").select("entity", "name", "members")
