"""Sketches against exact figures, within the error that they promise."""

from collections import defaultdict

from quire.plans import registry


def test_sketches_are_within_their_error(spark, sf):
    orders, quantities = defaultdict(set), defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_quantity").collect():
        orders[r.l_returnflag].add(r.l_orderkey)
        quantities[r.l_returnflag].append(r.l_quantity)
    rows = registry.queries()["e4_sketches"](spark, sf).collect()
    assert {r.l_returnflag for r in rows} == set(orders)
    for r in rows:
        assert abs(r.orders - len(orders[r.l_returnflag])) <= 3 * 0.05 * len(orders[r.l_returnflag])  # three standard deviations
        values = sorted(quantities[r.l_returnflag])
        for q, got in zip((0.5, 0.9), r.quantiles):
            slack = max(1, len(values) // 1000)
            at = int(q * len(values))
            assert values[max(0, at - slack)] <= got <= values[min(len(values) - 1, at + slack)]
