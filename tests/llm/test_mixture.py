import random

import duckdb
import pytest
from pyspark.sql import functions as F

from voxhive.llm import mixture


def table(rng_seed=1):
    rng = random.Random(rng_seed)
    rows = []
    for k, n in enumerate([300, 40, 5, 120, 1, 60, 0]):
        rows += [(1000 * k + i, "w " * rng.randint(0, 40), None, f"s{k}" if k != 5 else None) for i in range(n)]
    return rows


def test_rows_equal_sql_and_targets_are_met(documents):
    docs = documents(table(), clash=False)
    got = sorted(tuple(r) for r in mixture.mixed_rows(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.execute(mixture.ROWS_SQL).fetchall())
    assert got == want
    rows = {r[0]: r for r in table()}
    by_source = {}
    for doc, size, whole, target, taken in got:
        assert taken <= 2 * size
        by_source.setdefault(rows[doc][3], [whole, target, 0])[2] += taken
    for whole, target, taken in by_source.values():
        assert target <= 2 * whole and abs(taken - target) <= 40
    assert sum(t for _, t, _ in by_source.values()) == pytest.approx(1.5 * sum(w for w, _, _ in by_source.values()))


def test_demand_time_inverts_the_integral(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("t"))
    for a, b in mixture.SCHEDULES:
        share = (a * F.col("t") + (b - a) * F.col("t") * F.col("t") / 2) / ((a + b) / 2)
        back = mixture.demand_time(share * 70, F.lit(70.0), F.lit(a), F.lit(b))
        assert df.select(F.max(F.abs(back - F.col("t")))).first()[0] < 1e-9


def test_stream_is_in_curriculum_order(documents):
    docs = documents(table())
    plan = {r.doc_id: r for r in mixture.plan(docs).collect()}
    stream = mixture.training_stream(docs)
    assert stream.columns == docs.columns
    ids = [r.doc_id for r in stream.collect()]
    assert {i: ids.count(i) for i in set(ids)} == {i: r.copies for i, r in plan.items() if r.copies}
    left = {i: list(r.positions) for i, r in plan.items() if r.copies}
    times = [left[i].pop(0) for i in ids]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = mixture.mixed_rows(docs).collect()
    assert len(got) == len(odd_rows) and all(r.taken == 0 for r in got if r.size == 0)
    assert len({(r.size, r.taken) for r in got if r.doc_id == 2}) == 1
    assert mixture.mixed_rows(documents([])).count() == 0 and mixture.training_stream(documents([])).count() == 0
