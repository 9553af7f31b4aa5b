"""Queries over whole tables, on small fixtures."""

import random
from decimal import ROUND_HALF_UP, Context, Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairforge import queries as Q
from pairforge.functions import order


def test_leakage_and_tolerance_probe_all_rows(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(3, 5), (4, 5), (5, 11), (6, 11), (9, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(4, 0.05), (5, 0.09)], "l_suppkey long, l_discount double").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(4,), (5,), (6,)], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    got = {(r.left_split, r.right_split, r.value) for r in Q.QUERIES["leakage_overlap_all"](spark, at).collect()}
    assert got == {("train", "val", "5"), ("train", "test", "11")}
    assert {r.run_id: r.status for r in Q.QUERIES["tolerance_check_all"](spark, at).collect()} == {"4": "PASS", "5": "FAIL", "6": "SKIP"}


def test_contamination_probes_all_documents_and_the_benchmark(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (5, "c"), (6, None), (7, None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("i", "b")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    assert sorted(r.doc_id for r in Q.QUERIES["contamination_all"](spark, at).collect()) == [1, 2, 3]


@pytest.fixture
def many_tasks(spark):
    """Scans of a task for each row group of a small file."""
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in sizes]
    for k in sizes:
        spark.conf.set(k, "1000")
    yield
    for k, v in zip(sizes, before, strict=True):
        spark.conf.set(k, v)


def tied_items(at):
    """30 suppliers whose mean discount is 0.0495: cents of 600 rows, 2970 in all, their rows mixed."""
    rng, rows = random.Random(8), []
    for supplier in range(30):
        cents = [rng.randint(0, 10) for _ in range(600)]
        while (left := 2970 - sum(cents)) != 0:
            i = rng.randrange(600)
            cents[i] = min(10, max(0, cents[i] + (left > 0) - (left < 0)))
        rows += [(supplier, c / 100) for c in cents]
    rng.shuffle(rows)
    keys, values = zip(*rows, strict=True)
    pq.write_table(pa.table({"l_suppkey": pa.array(keys, "int64"), "l_discount": values}), f"{at}/lineitem.parquet", row_group_size=600)
    pq.write_table(pa.table({"s_suppkey": pa.array(range(31), "int64")}), f"{at}/supplier.parquet")


def sql_in_order(name, at, items="lineitem.parquet"):
    """What the SQL gives where one thread adds up rows as they are stored."""
    con = duckdb.connect(config={"threads": 1})
    for t, path in (("lineitem", items), ("supplier", "supplier.parquet")):
        con.execute(f"create view {t} as select * from '{at}/{path}'")
    return sorted((run, float(expected), *rest) for run, expected, *rest in con.execute(Q.SQL[name]).fetchall())


def test_means_on_a_tie_round_as_in_sql(spark, tmp_path, many_tasks):
    tied_items(tmp_path)
    want = sql_in_order("tolerance_check", tmp_path)
    assert {r[2] for r in want} == {0.049, 0.05, None}
    assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 10
    got = Q.QUERIES["tolerance_check"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("run_id", "expected", "observed", "status").collect()) == want


def test_means_on_a_tie_round_as_in_sql_over_several_files(spark, tmp_path, many_tasks):
    tied_items(tmp_path)
    items = pq.read_table(f"{tmp_path}/lineitem.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(7):
        pq.write_table(items.slice(i * 2600, 2600), f"{tmp_path}/lineitem.parquet/part-{i}.parquet", row_group_size=500)
    want = sql_in_order("tolerance_check_all", tmp_path, "lineitem.parquet/*.parquet")
    assert len(want) == 31 and {r[2] for r in want} == {0.049, 0.05, None}
    got = Q.QUERIES["tolerance_check_all"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("run_id", "expected", "observed", "status").collect()) == want


@pytest.mark.parametrize("few", [0, 50_000])
def test_rounded_means_are_those_of_sums_in_order(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW_GROUPS", few)
    rng = random.Random(9)
    rows = [(g, rng.choice([None, *[c / 100 for c in range(-10, 11)]]), i) for i, g in enumerate(rng.choices([None, *"abcdefgh"], k=4000))] + [("one", 0.0005, 5000), ("none", None, 5001), ("huge", 1e300, 5002), ("huge", -3e299, 5003)]
    want = {}
    for g, v, _ in rows:
        total, n = want.get(g, (0.0, 0))
        want[g] = (total + v, n + 1) if v is not None else (total, n)
    got = order.rounded_means(spark.createDataFrame(rows, "g string, v double, i long").repartition(7), ["g"], "v", 3, ["i"])
    assert {r.g: r.v for r in got.collect()} == {g: float(Decimal(repr(t / n)).quantize(Decimal("0.001"), ROUND_HALF_UP, Context(prec=400))) if n else None for g, (t, n) in want.items()}
