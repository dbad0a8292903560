"""Orders of searches and inserts."""

import pytest

from lodestore.encoders import PassthroughEncoder
from lodestore.operators.stats import latency_summary
from lodestore.plans import workload
from lodestore.plans.engine import Engine


def order(mode, inserts=(4, 4, 4), searches=(2, 2), ratio=(1, 1)):
    return "".join(k[0] for k, _ in workload.schedule(mode, inserts, searches, ratio))


def test_orders():
    assert order("paired") == "sisii" and order("paired", (1,), (1, 1, 1)) == "siss"
    assert order("searches_first") == "ssiii" and order("head_search") == "siii"
    assert order("search_only") == "ss" and order("insert_only") == "iii" and order("search_then_last_insert") == "ssi"
    assert order("ratio") == "issii" and order("ratio", ratio=(1, 4)) == "isiis"
    assert order("ratio", (), (2, 2)) == "ss"
    with pytest.raises(ValueError):
        order("other")
    assert workload.batches([1, 2, 3], 2) == [[1, 2], [3]]


def test_drive(spark):
    e = Engine(spark, PassthroughEncoder(2, normalize=False))
    index = e.create_index("w", "l2")
    items = [(str(i), [float(i), 1.0]) for i in range(4)]
    out = workload.drive(e, index, items, [[0.0, 1.0]], "ratio", insert_batch=2, search_batch=1, ops_per_run=2)
    assert e.resolve(index).rows.count() == 4
    assert {r["kind"] for r in latency_summary(out).collect()} <= {"insert", "search"}


def test_stored_items_stay_in_their_table(spark):
    """Slices are numbered like those of a list; the driver holds none of the rows."""
    rows = spark.range(300, 340).selectExpr("id", "array(cast(id as float), 1f) as data").repartition(3)
    kept, plain = workload.Stored.of(rows, "id"), [(str(i), [float(i), 1.0]) for i in range(300, 340)]
    assert len(kept) == 40 and list(kept) == plain and kept[7] == plain[7] and kept[-1] == plain[-1]
    for part in (slice(3, 9), slice(None, None, 2), slice(35, 99), slice(50, 60)):
        assert list(kept[part]) == plain[part] and len(kept[part]) == len(plain[part])
    assert list(kept[::2][5:8]) == plain[::2][5:8]
    e = Engine(spark, PassthroughEncoder(2, normalize=False))
    index, hits = e.create_index("s", "l2"), []
    run = e.run
    e.run = lambda: hits.append(run()) or hits[-1]
    workload.drive(e, index, kept, kept[::2], "ratio", insert_batch=20, search_batch=10, ratio=(1, 2))
    assert e.resolve(index).rows.count() == 40
    found = [{(r["query_idx"], r["ext_id"]) for r in h.hits.where("rank = 1").collect()} for h in hits if h.requested.get("search")]
    assert found == [{(i, str(300 + 2 * i)) for i in range(10)}, {(i, str(320 + 2 * i)) for i in range(10)}]
