"""What rows are dealt by the moves between seats."""

import numpy as np

from gridspark.operators import shapley as H


def test_givers_undo_receivers():
    for n in (1, 2, 7, 1000, 100_003):
        for _, _, factor, shift in [*H.seat_moves(2, 3, 42), (0, 0, n * 3, 5)]:
            seat = np.arange(n)
            to = H._receivers(seat, n, factor, shift)
            assert sorted(to) == list(range(n))
            np.testing.assert_array_equal(H._givers(to, n, factor, shift), seat)


def test_parcels_over_several_blocks(spark, monkeypatch):
    """Every row gets the features of the row on the giving seat, also over many blocks, null folds and features that are no numbers."""
    monkeypatch.setattr(H, "BLOCK_SEATS", 7)
    rows = [(i, None if i % 3 == 0 else i % 3, float(i), f"t{i}" if i % 5 else None, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b string, w double")
    groups = {"x": ["a", "b"], "y": ["w"]}
    out = H.permuted_rows(df, "id", groups, "fold", 3).collect()
    assert len(out) == 100 * 2 * 3
    own = {r[0]: r for r in rows}
    for rep in range(3):
        part = [r for r in out if r.rep == rep and r.feature_group == "x"]
        assert sorted(r.a for r in part) == [float(i) for i in range(100)]
        assert all(own[int(r.a)][3] == r.b and own[int(r.a)][1] == r.fold for r in part)
    assert any(r.a != r.id for r in out)
