"""Names of regimes that a rule gives, with and without days."""

import pytest

from barlab.operators.clusters import every_regime, name_clusters
from barlab.operators.panel import MARKET_FEATURES


@pytest.mark.parametrize("seen", [[1], [0, 1], [0, 1, 2], []])
def test_every_regime_has_a_name_of_its_own(spark, seen):
    columns = list(MARKET_FEATURES)
    rows = [(c, *[1.0 * (c + 1)] * len(columns)) for c in seen]
    z = spark.createDataFrame(rows, "cluster_id int, " + ", ".join(f"{c} double" for c in columns))
    named = {r.cluster_id: r.cluster_name for r in name_clusters(every_regime(z, "cluster_id", (0, 1, 2)), "cluster_id").collect()}
    assert sorted(named) == [0, 1, 2] and len(set(named.values())) == 3
    assert all(named[c].startswith("baseline_regime") == (c not in seen) for c in named)
