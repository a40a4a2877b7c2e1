"""Cells are never sent through the driver."""

import re

from tests.test_fixtures import tape
from tickloom.operators import heatmap as h


def test_cells_meet_their_column_by_shuffle(spark, tmp_path):
    rows = [(n * 0.5, 6 + n % 2, 100 + (n * 7) % 13 + n % 2, n % 5, "U") for n in range(400)]
    h.heat_intervals(tape(spark, rows), 1_000_000).write.parquet(f"{tmp_path}/spans")
    spans = spark.read.parquet(f"{tmp_path}/spans")
    out = h.heatmap_cells(h.liquidity_heatmap(spans), h.heatmap_scale(spans), h.price_window(spans))
    assert out.count() > 0
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = re.findall(r"(\w+Join)\b.*?\[(instrument_id#\d+(?:, col#\d+L?)?)\]", plan)
    assert any(kind == "SortMergeJoin" and "col#" in key for kind, key in joins), plan
    assert not any(kind == "BroadcastHashJoin" and "col#" in key for kind, key in joins), plan
