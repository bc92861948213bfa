"""The declared schema: tables, natural keys, references and what a removal does to them; audits and cascades follow the declaration (AUD-01, AUD-03, AUD-04, LIF-04)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import table


@dataclass(frozen=True)
class Reference:
    """column of a row names the id of a row of `to`, or of kinds[row[kind]] where kinds are given (a polymorphic reference).

    on_removal: the row goes with its target ("cascade"), loses the reference and what `clears` lists ("clear"), or keeps it ("keep").
    """

    column: str
    to: str | None = None
    kind: str | None = None
    kinds: dict[str, str] = field(default_factory=dict, hash=False)
    on_removal: str = "keep"
    clears: dict[str, object] = field(default_factory=dict, hash=False)

    def targets(self) -> dict[str | None, str]:
        return dict(self.kinds) if self.kind else {None: self.to}


@dataclass(frozen=True)
class Declared:
    """A table with its natural key, its references, and whether its rows must cite a source query ("always", "unless investigator" or "never")."""

    key: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()
    cites: str = "never"


def _moves(cites: str, *more: Reference, key: tuple[str, ...]) -> Declared:
    return Declared(key, (Reference("transaction_id", "transaction_", on_removal="cascade"), *more), cites)


#: Kinds of targets and the tables that hold them; fixed values.
SUBJECTS = {"transfer": "transfer", "tx_output": "tx_output"}
FINDING_TARGETS = {"address": "address", "transfer": "transfer", "transaction": "transaction_", "tx_output": "tx_output", "trace": "trace", "exhibit": "exhibit", "entity": "entity"}
ANNOTATION_TARGETS = {"address": "address", "transfer": "transfer", "transaction": "transaction_", "tx_output": "tx_output", "trace": "trace", "entity": "entity", "finding": "finding"}
TAG_TARGETS = {"address": "address", "entity": "entity"}
LABEL_TARGETS = {"address": "address", "trace": "trace", "transaction": "transaction_", "transfer": "transfer", "tx_output": "tx_output"}

CATALOGUE: dict[str, Declared] = {
    "source_query": Declared(),
    "exhibit": Declared(),
    "asset": Declared(("chain", "contract"), cites="always"),
    "address": Declared(("chain", "address"), cites="always"),
    "transaction_": Declared(("chain", "tx_hash"), cites="always"),
    "transfer": _moves("always", Reference("from_address_id", "address"), Reference("to_address_id", "address"), Reference("asset_id", "asset"), key=("transaction_id", "transfer_type", "from_address_id", "to_address_id", "asset_id", "amount", "occurrence")),
    "tx_output": _moves("always", Reference("address_id", "address"), Reference("spending_tx_id", "transaction_", on_removal="clear", clears={"spent": False}), key=("transaction_id", "output_index")),
    "tx_input": _moves("always", Reference("address_id", "address"), Reference("prev_output_id", "tx_output", on_removal="clear"), key=("transaction_id", "input_index")),
    "attribution": Declared((), (Reference("address_id", "address"),), "unless investigator"),
    "risk_assessment": Declared((), (Reference("address_id", "address"),), "always"),
    "risk_detail": Declared(("risk_assessment_id", "signal"), (Reference("risk_assessment_id", "risk_assessment"),), "always"),
    "valuation": Declared((), (Reference("subject_id", kind="subject_type", kinds=SUBJECTS, on_removal="cascade"),), "always"),
    "balance_snapshot": Declared((), (Reference("address_id", "address"),), "always"),
    "entity": Declared((), (Reference("merged_into", "entity"),)),
    "entity_membership": Declared((), (Reference("entity_id", "entity"), Reference("address_id", "address")), "unless investigator"),
    "entity_membership_retraction": Declared((), (Reference("membership_id", "entity_membership"),), "unless investigator"),
    "trace": Declared(),
    "trace_transfer": Declared((), (Reference("trace_id", "trace"), Reference("transfer_id", "transfer", on_removal="cascade"))),
    "trace_btc_link": _moves("never", Reference("trace_id", "trace"), Reference("source_output_id", "tx_output", on_removal="cascade"), Reference("dest_output_id", "tx_output", on_removal="cascade"), key=()),
    "trace_bridge_link": Declared((), (Reference("trace_id", "trace"), *(Reference(f"{side}_subject_id", kind=f"{side}_subject_type", kinds=SUBJECTS) for side in ("source", "dest")))),
    "finding": Declared(),
    "finding_ref": Declared((), (Reference("finding_id", "finding"), Reference("ref_id", kind="ref_type", kinds=FINDING_TARGETS))),
    "annotation": Declared((), (Reference("target_id", kind="target_type", kinds=ANNOTATION_TARGETS),)),
    "tag": Declared((), (Reference("target_id", kind="target_type", kinds=TAG_TARGETS),)),
    "investigator_label": Declared((), (Reference("target_id", kind="target_type", kinds=LABEL_TARGETS),)),
}


def _known(tables: dict[str, DataFrame]) -> dict[str, Declared]:
    if strange := sorted(set(tables) - set(CATALOGUE)):
        raise ValueError(f"not in the catalogue: {strange}")
    return {name: CATALOGUE[name] for name in CATALOGUE if name in tables}


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unproven(tables: dict[str, DataFrame]) -> DataFrame:
    """AUD-01: table, id, reason of every row of a citing table whose source_query_id is null or leads to no source query. Rows by an investigator may have none.

    All tables are one union with one anti-join against source_query, whose ids are unique.
    """
    rows = [
        t.select(F.lit(name).alias("table"), _text("id").alias("id"), _text("source_query_id").alias("q"), (F.col("source").eqNullSafe("investigator") if d.cites == "unless investigator" and "source" in t.columns else F.lit(False)).alias("free"))
        for name, d in _known(tables).items() if d.cites != "never" for t in [tables[name]]
    ]
    cited = _union(rows)
    missing = cited.filter("q is null and not free").withColumn("reason", F.lit("missing"))
    dangling = cited.filter("q is not null").join(tables["source_query"].select(_text("id").alias("q")), "q", "left_anti").withColumn("reason", F.lit("unresolvable"))
    return missing.unionByName(dangling).select("table", "id", "reason")


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """AUD-03: table, reference, id, target of every reference, plain or polymorphic, that is not null and leads to no row; a kind that is not declared leads nowhere.

    References to one table are one union and one anti-join with its ids. References to tables that are not given are not judged.
    """
    to: dict[str, list[DataFrame]] = {}
    strange = []
    for name, declared in _known(tables).items():
        for ref in declared.references:
            rows = tables[name].select(F.lit(name).alias("table"), F.lit(ref.column).alias("reference"), _text("id").alias("id"), _text(ref.column).alias("target"), (F.col(ref.kind) if ref.kind else F.lit(None).cast("string")).alias("kind")).filter("target is not null")
            for kind, target in ref.targets().items():
                if target in tables:
                    to.setdefault(target, []).append(rows if kind is None else rows.filter(F.col("kind") == kind))
            if ref.kind:
                strange.append(rows.filter(~F.coalesce(F.col("kind"), F.lit("")).isin(*ref.kinds)))
    lost = [_union(parts).join(tables[target].select(_text("id").alias("target")), "target", "left_anti") for target, parts in to.items()]
    return _union([*lost, *strange]).select("table", "reference", "id", "target")


def natural_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """AUD-04: table, rows, keys, ok for every table with a natural key: rows and distinct keys, which must agree; null is a key like any other."""
    keyed = [tables[name].groupBy(*d.key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, d in _known(tables).items() if d.key]
    return _union(keyed).groupBy("table").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).withColumn("ok", F.col("rows") == F.col("keys"))


def cascade(tables: dict[str, DataFrame], removed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """LIF-04: the tables after rows (id) of some of them are removed.

    Tables are taken in order of their dependencies: a row whose cascading reference loses its target goes too, and takes its own dependents with it;
    references that clear become null, with what they clear. Two anti-joins or joins per reference that leads to a table that lost
    something; other tables come back as they are. Several transactions may go at once.
    """
    known = _known(tables)
    gone: dict[str, DataFrame] = {}
    out = dict(tables)
    for name in _in_order(known):
        rows = tables[name]
        lost = [removed[name].select(_text("id").alias("id"))] if name in removed else []
        for ref in (r for r in known[name].references if r.on_removal == "cascade"):
            for kind, target in ref.targets().items():
                if target in gone:
                    own = rows if kind is None else rows.filter(F.col(ref.kind) == kind)
                    lost.append(own.join(gone[target].select(F.col("id").alias("__gone")), _text(ref.column) == F.col("__gone"), "left_semi").select(_text("id").alias("id")))
        if lost:
            gone[name] = table(_union(lost).distinct(), "cascade")
            out[name] = rows.join(gone[name].select(F.col("id").alias("__gone")), _text("id") == F.col("__gone"), "left_anti")
    for name, declared in known.items():
        for ref in (r for r in declared.references if r.on_removal == "clear" and r.to in gone):
            rows = out[name]
            mark = gone[ref.to].select(F.col("id").alias("__gone"))
            hit = F.col("__gone").isNotNull()
            new = {ref.column: F.when(~hit, F.col(ref.column)), **{c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in ref.clears.items() if c in rows.columns}}
            out[name] = rows.join(mark, _text(ref.column) == F.col("__gone"), "left").withColumns(new).select(*rows.columns)
    return out


def _in_order(known: dict[str, Declared]) -> list[str]:
    """Names so that what a cascading reference leads to comes first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in known and name not in order:
            for ref in known[name].references:
                if ref.on_removal == "cascade":
                    for target in ref.targets().values():
                        visit(target)
            order.append(name)

    for name in known:
        visit(name)
    return order
