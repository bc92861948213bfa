"""Audits and cascades over the declared catalogue, on tables with seeded faults."""

import pytest

from ledgerloom.operators import catalogue as c
from ledgerloom.plans.catalogue import _case
from ledgerloom.plans.fixtures import Ledger


@pytest.fixture(scope="module")
def case(spark):
    def rows(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return {
        "source_query": rows("id long", (1,), (2,)),
        "address": rows("id string, chain string, address string, source_query_id long", ("a", "e", "x", 1), ("b", "e", "x", None), ("c", "f", None, 9), ("d", "f", None, 2)),
        "transaction_": rows("id long, chain string, tx_hash string, source_query_id long", (10, "e", "h", 1), (11, "e", "i", 1)),
        "transfer": rows("id long, transaction_id long, transfer_type string, from_address_id string, to_address_id string, asset_id string, amount string, occurrence long, source_query_id long", (100, 10, "n", "a", "b", "E", "5", 0, 1), (101, 11, "n", "a", "zz", "E", "5", 0, 1), (102, 77, "n", None, "b", "E", "5", 0, 1)),
        "tx_output": rows("id long, transaction_id long, address_id string, output_index long, spending_tx_id long, spent boolean, source_query_id long", (200, 10, "a", 0, 11, True, 1), (201, 11, "b", 0, None, False, 1), (202, 11, "b", 1, 10, True, 1)),
        "tx_input": rows("id long, transaction_id long, address_id string, prev_output_id long, input_index long, source_query_id long", (300, 11, "a", 200, 0, 1), (301, 10, "b", 202, 0, 1)),
        "attribution": rows("id string, address_id string, source string, source_query_id long", ("t", "a", "investigator", None), ("u", "a", "feed", None), ("v", "q", "investigator", 9)),
        "valuation": rows("id long, subject_type string, subject_id long, source_query_id long", (1, "transfer", 100, 1), (2, "tx_output", 100, 1), (3, "tx_output", 201, 1), (4, "planet", 100, 1), (5, None, 100, 1), (6, "transfer", None, 1)),
        "trace_transfer": rows("id string, trace_id string, transfer_id long", ("e1", None, 100), ("e2", None, 101)),
        "trace_btc_link": rows("id string, trace_id string, transaction_id long, source_output_id long, dest_output_id long", ("l1", None, 11, 200, 201), ("l2", None, 11, 202, 201), ("l3", None, 10, 202, 200)),
    }


def test_provenance(case):
    assert {tuple(r) for r in c.unproven(case).collect()} == {("address", "b", "missing"), ("address", "c", "unresolvable"), ("attribution", "u", "missing"), ("attribution", "v", "unresolvable")}


def test_references(case):
    assert {tuple(r) for r in c.dangling(case).collect()} == {
        ("transfer", "to_address_id", "101", "zz"), ("transfer", "transaction_id", "102", "77"), ("attribution", "address_id", "v", "q"),
        ("valuation", "subject_id", "2", "100"), ("valuation", "subject_id", "4", "100"), ("valuation", "subject_id", "5", "100"),
    }


def test_natural_keys(case):
    found = {r["table"]: (r["rows"], r["keys"], r["ok"]) for r in c.natural_keys(case).collect()}
    assert found["address"] == (4, 2, False) and found["transfer"] == (3, 3, True) and set(found) == {"address", "transaction_", "transfer", "tx_output", "tx_input"}


def test_cascade(spark, case):
    """Transaction 10 goes: its movements, their valuations and traces go too, what it spent is unspent, what spent its outputs loses the link."""
    left = c.cascade(case, {"transaction_": spark.createDataFrame([(10,)], "id long")})
    ids = lambda name: {r["id"] for r in left[name].collect()}
    assert ids("transaction_") == {11} and ids("transfer") == {101, 102} and ids("trace_transfer") == {"e2"} and ids("trace_btc_link") == {"l2"}
    assert ids("valuation") == {2, 3, 4, 5, 6}
    assert {(r["id"], r["spending_tx_id"], r["spent"]) for r in left["tx_output"].collect()} == {(201, None, False), (202, None, False)}
    assert {(r["id"], r["prev_output_id"]) for r in left["tx_input"].collect()} == {(300, None)}
    assert left["address"] is case["address"] and all(left[n].columns == case[n].columns for n in case)
    judged = {n: left[n] for n in left if n not in ("transfer", "attribution", "valuation")}
    assert c.dangling(judged).count() == 0
    same = c.cascade(case, {"transaction_": spark.createDataFrame([], "id long")})
    assert {n: same[n].count() for n in same} == {n: case[n].count() for n in case}


def test_unknown_tables_are_refused(case):
    with pytest.raises(ValueError, match="nowhere"):
        c.natural_keys({"nowhere": case["transfer"]})


def test_a_case_projects_movements_once(spark):
    """Movements and valuations are kept as tables, so that no audit goes back to the given lines for them."""
    tables = _case(Ledger(spark, "/root/testdata/sf0.001"))
    for name in ("transfer", "tx_output", "tx_input", "valuation", "balance_snapshot"):
        assert not any("lineitem" in file for file in tables[name].inputFiles()), name
