"""The pipeline stage by stage against brute force, and queries against their SQL."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from check import compare, connect
from conftest import CLASHES

import __spark_entry__ as contract
from listmill.llm import registry
from listmill.llm.common import written


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf, name):
    n, faults = compare(spark, connect(sf), registry.QUERIES[name], registry.ORACLES[name], sf)
    assert n and not faults


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in registry.QUERIES if q.startswith("op")}
    assert registry.QUERIES.items() <= contract.queries().items()


def test_stages(spark, sf, docs):
    frame, rows = docs, [tuple(r) for r in docs.collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = written(stage(spark, frame, sf), "stage")
        before, rows = rows, [tuple(r)[:5] for r in frame.collect()]
        seen[name] = (before, rows)
        assert frame.columns[:5] == docs.columns
    assert frame.columns[5:] == ["shard", "slot"]

    before, after = seen["quality rules"]
    kept = {r[0] for r in after}
    for r in before:
        assert not (r[0] in kept and brute.quality_base(r[1])[5])
    plain = [r[0] for r in before if not brute.quality_base(r[1])[5] and brute.quality_base(r[1])[2] == 0 and "!!" not in r[1]]
    assert set(plain) <= kept

    before, after = seen["near duplicates"]
    parts = brute.components({r[0]: brute.shingles(r[1]) for r in before})
    assert Counter(after) == Counter(r for r in before if parts[r[0]] == r[0])

    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {r[0] for r in before if any(brute.overlaps([(r[0], r[1])], [i]) for i in items if i[1][:25] in r[1])}
    assert leaks and leaks & {r[0] for r in after} == set()
    assert len(after) >= len(before) - len(leaks) - 3

    before, after = seen["mixing"]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    assert sum(len(brute.WORD.findall(r[1])) for r in after) <= sum(len(brute.WORD.findall(r[1])) for r in before)
    assert Counter(seen["sharding"][0]) == Counter(seen["sharding"][1])


def test_stages_take_odd_tables(spark, sf, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf).count() == 0
        result = stage(spark, odd, sf)
        assert result.columns == odd.columns and result.count() > 0, name
        # The documents' own columns keep their values, whatever names the operators use.
        for r in result.collect():
            assert all(r[c] == f"x{i}" for i, c in enumerate(CLASHES)), (name, r)
    last = corpus_pipeline.STAGES[-1][1](spark, odd, sf)
    assert last.count() == odd.count()
    assert {r["own_shard"] for r in last.collect()} == {f"x{CLASHES.index('shard')}"}
