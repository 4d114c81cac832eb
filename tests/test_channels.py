"""The kernels run over all channels of the series."""

from __future__ import annotations

import pytest
from oracle import SF

from seqloom import registry
from seqloom.plans import fixtures as fx


@pytest.mark.parametrize("name", ["ssm_scan", "iir_filter", "cauchy_sum"])
def test_kernels_cover_all_channels(spark, name):
    found = registry.queries()[name](spark, SF).select("vec_id", "ch").distinct()
    series = fx.series(spark, SF).select("vec_id", "ch").distinct()
    assert series.where("ch > 0").count() > 0 and found.exceptAll(series).isEmpty() and series.exceptAll(found).isEmpty()


def test_recurrences_of_all_channels(spark):
    rows = fx.series(spark, SF).where("vec_id % 50 = 0").collect()
    got = {(r.vec_id, r.ch, r.t): r.y for r in registry.queries()["iir_filter"](spark, SF).where("vec_id % 50 = 0").collect()}
    y, last = 0.0, None
    for r in sorted(rows, key=lambda r: (r.vec_id, r.ch, r.t)):
        y = 0.2 * r.value + 0.8 * (y if last == (r.vec_id, r.ch) else 0.0)
        last = r.vec_id, r.ch
        assert got[r.vec_id, r.ch, r.t] == pytest.approx(y, abs=1e-6)
    assert len(got) == len(rows)
