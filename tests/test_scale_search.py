"""The rounds of the 4-bit scale search against a plain restatement of one tensor at a time."""

import numpy as np

from weft.operators import kernels


def whole(x, first):
    """Best (loss, scale, bytes) of the usual state and of all states of three rounds."""
    scale, seen, best = first, [first], None
    for _ in range(3):
        bytes_, errors, (cross, norm) = kernels.search_states(x, seen)
        scale = float(np.clip(np.float32(cross / norm), np.float32(first / 4), np.float32(first * 4)))
        seen = [*seen, scale]
    bytes_, errors, _ = kernels.search_states(x, seen)
    for k in range(7):
        loss = float(errors[k].sum())
        if best is None or loss < best[0]:
            best = (loss, seen[k // 2], bytes_[k].tolist())
    return best


def test_scale_search_refits_the_tensor_scale(spark):
    r = np.random.default_rng(8)
    tensors = {name: (r.standard_t(3, size=(6, 40)) * size).astype(np.float32) for name, size in (("a", 1), ("b", 0.01))}
    table = [(name, i, row.tolist()) for name, x in tensors.items() for i, row in enumerate(x)] + [("zero", 0, [0.0] * 40)]
    rows = spark.createDataFrame(table, "tensor string, row_id long, v array<float>")
    first = {name: float(np.float32(np.abs(x).max() / 2688)) for name, x in tensors.items()}
    got = kernels.scale_search(rows, spark.createDataFrame([*first.items(), ("zero", 0.0)], "tensor string, tensor_scale double")).collect()
    for name, x in tensors.items():
        blocks = np.pad(x, ((0, 0), (0, 8))).reshape(-1, 16)
        loss, scale, bytes_ = whole(blocks, first[name])
        own = sorted((g for g in got if g.tensor == name), key=lambda g: g.row_id)
        assert {g.tensor_scale for g in own} == {scale} and scale != first[name]
        assert [b for g in own for b in g.bytes] == bytes_ and abs(sum(g.error for g in own) - loss) < 1e-9 * loss
        once = kernels.search_states(blocks, [first[name]])[1]
        assert loss < once[1].sum() < once[0].sum()
    assert [(set(g.bytes), g.tensor_scale, g.error) for g in got if g.tensor == "zero"] == [({127}, 0.0, 0.0)]
