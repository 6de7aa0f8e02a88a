"""The numpy kernels against plain loops, on rows of several widths, null rows and rows wider than a step."""

import numpy as np
import pyarrow as pa
import pytest

from weft.operators import dense, quantize

SCHEMA = "tensor string, row_id long, v array<float>"


def send(spark, tensors):
    return spark.createDataFrame([(t, k, None if v is None else [float(x) for x in v]) for t, rows in tensors.items() for k, v in enumerate(rows)], SCHEMA)


def by_row(made):
    return {(r.tensor, r.row_id): r for r in made.collect()}


def int8_row_loop(v):
    q = np.float32(127) * (np.float32(1) / max(np.float32(1e-12), max(abs(np.float32(x)) for x in v)))
    return [int(min(127, max(-127, np.rint(np.float32(x) * q)))) for x in v], float(np.float32(1) / q)


def test_rows_of_several_widths(spark):
    r = np.random.default_rng(1)
    tensors = {"a": [*r.normal(size=(3, 5)), None], "b": [*r.normal(size=(2, 7))], "wide": [*r.normal(size=(2, 20_000))]}
    got = by_row(quantize.int8_row(send(spark, tensors)))
    assert len(got) == 8 and got["a", 3].codes is None and got["a", 3].scales is None
    for (t, k), row in got.items():
        if tensors[t][k] is not None:
            codes, scale = int8_row_loop(tensors[t][k])
            assert row.codes == codes and row.scales == [scale]


@pytest.mark.parametrize("size", [2, 4])
def test_tiles(spark, size):
    x = np.random.default_rng(2).normal(size=(8, 12)).astype(np.float32)
    got = by_row(quantize.int8_block(send(spark, {"a": x}), size))
    for k in range(8):
        for c in range(12):
            tile = x[k // size * size : k // size * size + size, c // size * size : c // size * size + size]
            s = max(np.abs(tile).max() / np.float32(127), np.float32(1e-8))
            assert got["a", k].scales[c // size] == float(s) and got["a", k].codes[c] == int(np.rint(x[k, c] / s))


def test_batches_are_encoded_in_steps(monkeypatch):
    v = np.random.default_rng(3).normal(size=(9, 6)).astype(np.float32)
    batch = pa.record_batch({"tensor": pa.array(["a"] * 9), "row_id": pa.array(range(9)), "v": pa.array(v.tolist(), pa.list_(pa.float32()))})
    whole = pa.Table.from_batches(dense._encoded(batch, dense.mxfp8(1.0), quantize.VALUED | {"n": "int"}))
    monkeypatch.setattr(dense, "ELEMENTS", 12)
    parts = list(dense._encoded(batch, dense.mxfp8(1.0), quantize.VALUED | {"n": "int"}))
    assert len(parts) == 5 and pa.Table.from_batches(parts).combine_chunks() == whole.combine_chunks()


def test_values_on_the_grid_keep_their_bytes():
    values = np.array([(b % 8) * 2.0**-9 if b < 8 else (1 + b % 8 / 8) * 2.0 ** (b // 8 - 7) for b in range(127)])
    assert dense.e4m3_codes(dense.e4m3(values)).tolist() == list(range(127))
    assert dense.e4m3_codes(dense.e4m3(-values[1:])).tolist() == list(range(129, 255))
    middle = (values[1:] + values[:-1]) / 2
    assert dense.e4m3_codes(dense.e4m3(middle)).tolist() == [b + b % 2 for b in range(126)]
    assert dense.e4m3_codes(dense.e4m3(np.array([464.0, np.inf, -np.inf, np.nan]))).tolist() == [126, 126, 254, 127]
    assert dense.e2m1_codes(np.array([0.25, 0.75, 1.25, 1.75, 2.5, 3.5, 5, 5.1, -0.25, -9, np.nan])).tolist() == [0, 2, 2, 4, 4, 6, 6, 7, 8, 15, 4]


def test_many_tensors_are_not_broadcast(spark, monkeypatch):
    x = send(spark, {"a": [[1.0, -2.0]], "b": [[4.0, 0.5]]})
    few = by_row(quantize.int8_tensor(x))
    monkeypatch.setattr(dense, "TENSORS", 1)
    assert by_row(quantize.int8_tensor(x)) == few and few["a", 0].codes == [64, -127]
