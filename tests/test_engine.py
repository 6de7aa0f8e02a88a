"""Numeric formats, quantizers, kernels, plans, containers and streaming."""

from __future__ import annotations

import json
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import names
from weft.functions import numeric as N
from weft.functions.numeric import SPARK
from weft.functions.names import canonical
from weft.operators import kernels, quantize, superblocks
from weft.plans import catalog, policy, validate, verify
from weft.plans.descriptors import hash_payload
from weft.plans.methods import BLOCKS, METHODS, scheme_id
from weft.sources import gguf, safetensors


def matrix(spark, rows):
    return spark.createDataFrame([("t", i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)], "tensor string, row_id long, v array<float>")


def test_small_floats_against_bits(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=2000) * 10.0 ** r.integers(-6, 6, 2000), 2.0 ** np.arange(-20, 20), [0, 464, 463.9, 448, 1e9, 0.25, 0.75, 1.25, 1.75, 2.5, 3.5, 5, 6]]).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x float")
    got = df.select("i", F.expr(N.bf16(SPARK, "x")).alias("b"), F.expr(N.e4m3(SPARK, "x")).alias("e"), F.expr(N.e2m1_value(N.e2m1_code("x"))).alias("m")).orderBy("i").collect()
    assert [g.b for g in got] == kernels.bf16_values(kernels.bf16_bits(x)).tolist()
    grid = np.concatenate([kernels._E4M3[:127], [math.inf]])
    for v, g in zip(x.tolist(), got, strict=True):
        assert abs(abs(g.e) - min(abs(v), 448)) <= np.abs(grid[:127] - min(abs(v), 448)).min() + 1e-12 and abs(g.e) in grid
        assert abs(abs(g.m) - min(abs(v), 6)) <= np.abs(kernels.GRID - min(abs(v), 6)).min() + 1e-12
    codes = df.select(F.expr(N.e4m3_code(N.e4m3(SPARK, "x"))).alias("c"), F.expr(N.e4m3(SPARK, "x")).alias("e")).collect()
    assert all((kernels._E4M3[c.c % 128] if c.c < 128 else -kernels._E4M3[c.c % 128]) == c.e for c in codes)


def test_int8_schemes_bound_the_error(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(32, 32)).astype(np.float32)
    rows = matrix(spark, x)
    for made, size in ((quantize.int8_row(rows), None), (quantize.int8_tensor(rows), None), (quantize.int8_block(rows, 16), 16)):
        assert made.where("exists(codes, c -> c < -127 or c > 127)").count() == 0
        e = quantize.errors(rows, quantize.int8_dequantize(made, size)).first()
        assert e.relative < 2e-4
    clipped = quantize.errors(rows, quantize.int8_dequantize(quantize.int8_row(rows, 0.5))).first()
    assert clipped.relative > 1e-2  # a broken variant must show


def test_zero_and_nan(spark):
    zero = matrix(spark, [[0.0] * 32, [0.0] * 32])
    for made in (quantize.int8_row(zero), quantize.int8_tensor(zero), quantize.int8_block(zero, 2), quantize.fp8_row(zero), quantize.fp8_tensor(zero)):
        assert {(tuple(set(r.codes)), tuple(set(r.scales))) for r in made.collect()} == {((0,), (1.0,))}
    assert {tuple(set(r.codes)) for r in quantize.mxfp8(zero).collect()} == {(0,)}
    assert {(tuple(set(r.codes)), tuple(set(r.scales))) for r in quantize.nvfp4(zero).collect()} == {((4,), (127.0,))}
    odd = matrix(spark, [[math.nan, 1.0, -2.0, 0.5] * 8])
    assert quantize.int8_row(odd).first().codes[:4] == [0, 64, -127, 32]
    assert quantize.incoherence(zero).first().gamma is None
    assert matrix(spark, []).count() == quantize.int8_row(matrix(spark, [])).count() == 0


def test_odd_numbers(spark):
    """NaN, infinities, subnormal numbers and -0 in every scheme."""
    inf = math.inf
    rows = matrix(spark, [[1.0, math.nan, -2.0, -0.0, 1e-42, 3.0, -1e-42, 0.5] * 4, [1.0, inf, -2.0, -inf, 1e-42, 3.0, 0.25, 0.5] * 4])
    nan, endless = (rows.where(f"row_id = {k}") for k in (0, 1))
    for made in (quantize.int8_row(nan), quantize.int8_tensor(nan)):
        assert made.first().codes[:8] == [42, 0, -85, 0, 0, 127, 0, 21]
    assert quantize.int8_row(endless).first().codes[:8] == [0] * 8 and quantize.int8_row(endless).first().scales == [inf]
    assert quantize.fp8_row(nan).first().codes[:4] == [113, 127, 249, 0] and quantize.fp8_tensor(nan).first().codes[1] == 127
    assert quantize.fp8_row(endless).first().codes[:4] == [0, 127, 0, 127]
    assert quantize.mxfp8(nan).first().codes[1] == 127 and quantize.mxfp8(nan).first().scales == [120.0]
    assert quantize.mxfp8(endless).first().scales == [254.0]
    made = quantize.nvfp4(nan).first()
    assert set(made.codes) == {4} and set(made.scales) == {127.0} and math.isnan(made.tensor_scale)
    assert set(quantize.nvfp4(endless).first().codes) == {4}
    assert quantize.q8_0(nan).first().codes[:4] == [42, 0, -85, 0] and set(quantize.q8_0(endless).first().codes) == {0}
    assert quantize.q4_0(endless).first().scale == -inf or quantize.q4_0(endless).first().scale == inf
    for made in (quantize.int8_dequantize(quantize.int8_row(rows)), quantize.fp8_dequantize(quantize.fp8_row(rows)), quantize.mxfp8_dequantize(quantize.mxfp8(rows)), quantize.nvfp4_dequantize(quantize.nvfp4(rows))):
        assert made.count() == 2


def test_e4m3_by_byte(spark):
    """Every byte's value is its own nearest; ties go to the even one; what is beyond 448 stays there."""
    def value(b):
        return (b % 8) * 2.0**-9 if b < 8 else (1 + b % 8 / 8) * 2.0 ** (b // 8 - 7)

    sent = [(b, value(b)) for b in range(127)] + [(128 + b, -value(b)) for b in range(1, 127)]
    sent += [(b + b % 2, (value(b) + value(b + 1)) / 2) for b in range(126)] + [(126, 464.0), (126, 1e30), (254, -1e30), (126, math.inf), (127, math.nan)]
    df = spark.createDataFrame(sent, "b int, x double").selectExpr("b", f"{N.e4m3(N.SPARK, 'x')} AS y").selectExpr("b", f"{N.e4m3_code('y')} AS c")
    assert [r for r in df.collect() if r.b != r.c] == []


def test_tiles_that_do_not_divide(spark):
    rows = matrix(spark, [[1.0, -2.0, 3.0], [0.5, 0.25, -8.0], [0.0, 0.0, 0.0]])
    with pytest.raises(Exception, match="multiples of 2"):
        quantize.int8_block(rows, 2).collect()
    by_row = {r.row_id: (r.scales, r.codes) for r in quantize.fp8_row(rows).collect()}
    assert {r.row_id: (r.scales, r.codes) for r in quantize.fp8_block(rows, 2).collect()} == by_row
    assert quantize.fp8_dequantize(quantize.fp8_block(rows, 2), 2).count() == 3


def test_wrapped_names(spark):
    names = {"model.language_model.lm_head.weight": "output.weight", "model.model.lm_head.weight": "output.weight", "lm_head.weight": "output.weight", "model.language_model.model.layers.0.self_attn.q_proj.weight": "blk.0.attn_q.weight", "model.model.model.embed_tokens.weight": "token_embd.weight", "model.language_model.layers.12.mlp.down_proj.weight": "blk.12.ffn_down.weight", "model.model.model.model.embed_tokens.weight": None, "model.lm_head.weight": None}
    got = {r.name: r.canonical for r in canonical(spark.createDataFrame([(n, "llama") for n in names], "name string, arch string")).collect()}
    assert got == names


def test_formats_decode_close(spark):
    r = np.random.default_rng(3)
    rows = matrix(spark, r.normal(size=(20, 40)).astype(np.float32))
    limits = {"fp8": (quantize.fp8_dequantize(quantize.fp8_row(rows)), 2e-3), "mx": (quantize.mxfp8_dequantize(quantize.mxfp8(rows)), 2e-3), "nv": (quantize.nvfp4_dequantize(quantize.nvfp4(rows)), 2e-2)}
    for decoded, limit in limits.values():
        assert quantize.errors(rows, decoded).first().relative < limit
        assert {len(x.v) for x in decoded.collect()} == {40}


def test_swizzle_is_a_bijection(spark):
    grid = spark.range(256).withColumnRenamed("id", "row").select("row", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("col"))
    flat = sorted(x.f for x in grid.select(F.expr(quantize.swizzled("row", "col", "8")).alias("f")).collect())
    assert flat == list(range(2048))


def test_rotation_keeps_norms_and_is_its_inverse():
    h = kernels.hadamard(64).astype(np.float64)
    assert np.allclose(h @ h.T, np.eye(64))
    with pytest.raises(ValueError):
        kernels.hadamard(32)
    x = np.random.default_rng(4).normal(size=(5, 128)).astype(np.float32)
    assert np.allclose((kernels.rotate(x, 64) ** 2).sum(), (x**2).sum(), rtol=1e-5)


def test_scale_search_never_loses():
    x = np.random.default_rng(5).standard_t(3, size=(200, 16))
    scale = np.abs(x).max() / 2688
    _, wide = kernels.search_scales(x, scale)
    _, none = kernels.search_scales(x, scale, reach=0)
    assert (wide <= none + 1e-12).all() and wide.sum() < 0.95 * none.sum()


def test_uneven_levels_beat_even_ones():
    x = np.random.default_rng(6).normal(size=(200, 32))
    scale, codes = kernels.iq4_nl(x)
    e = ((x - scale[:, None] * kernels.LEVELS[codes]) ** 2).sum() / (x * x).sum()
    d = np.abs(x).max(axis=1, keepdims=True) / 8
    even = ((x - np.clip(np.rint(x / d), -8, 7) * d) ** 2).sum() / (x * x).sum()
    assert e < even < 0.01 and kernels.iq4_nl(np.zeros((1, 32)))[0][0] == 0


def test_casts():
    x = np.array([1.0, -2.5, 3.14159, 0.0], np.float32)
    assert kernels.cast(x.tobytes(), "F32", "F32") == x.tobytes()
    assert np.frombuffer(kernels.cast(x.tobytes(), "F32", "F16"), np.float16).tolist() == x.astype(np.float16).tolist()
    back = kernels.cast(kernels.cast(x.tobytes(), "F32", "BF16"), "BF16", "F32")
    assert np.abs(np.frombuffer(back, np.float32) - x).max() < 0.01
    assert kernels.cast(b"abc", "U8", "F16") == b"abc"
    with pytest.raises(ValueError):
        kernels.cast(np.array([1e6], np.float32).tobytes(), "F32", "F16")
    assert kernels.cast(np.array([np.inf], np.float32).tobytes(), "F32", "F16")
    with pytest.raises(ValueError):
        kernels.cast(b"\0" * 8, "F64", "F32")


def test_bias_correction_moves_by_the_mean_error(spark):
    x = np.random.default_rng(7).normal(size=(8, 16)).astype(np.float32)
    rows, biases = matrix(spark, x), spark.createDataFrame([("t", i, 1.0) for i in range(8)], "tensor string, row_id long, bias float")
    same = kernels.bias_correction(rows, rows, biases)
    assert {r.bias for r in same.collect()} == {1.0}
    off = rows.withColumn("v", F.expr("transform(v, x -> CAST(x + 1 AS FLOAT))"))
    want = 1 + kernels.calibration_mean(16, 233983427).sum()
    assert all(abs(r.bias - want) < 1e-4 for r in kernels.bias_correction(rows, off, biases).collect())


def test_default_config_hash(spark):
    payload = hash_payload("'int8'", "'block'", "128", "false", "256", "233983427", "true")
    assert spark.sql(f"SELECT substring(sha2({payload}, 256), 1, 16) AS h").first().h == "56920c6553cfa241"


def test_names_and_categories(spark):
    rows = [("llama", "model.layers.3.self_attn.v_proj.weight"), ("gemma2", "model.layers.0.post_attention_layernorm.weight"), ("llama", "model.language_model.layers.1.mlp.down_proj.bias"), ("llama", "lm_head.weight"), ("llama", "model.layers.0.self_attn.rotary_emb.inv_freq"), ("lfm2", "layers.2.conv.conv.weight"), ("llama", "weird")]
    got = [r.canonical for r in names.canonical(spark.createDataFrame(rows, "arch string, name string")).collect()]
    assert got == ["blk.3.attn_v.weight", "blk.0.post_attention_norm.weight", "blk.1.ffn_down.bias", "output.weight", None, "blk.2.shortconv.conv.weight", None]
    with pytest.raises(ValueError):
        names.checked_pattern("(?=x)")


def test_policy_of_eight_layers(spark):
    parts = [("token_embd.weight", 2), ("output.weight", 2), ("output_norm.weight", 1)] + [(f"blk.{i}.{p}.weight", 2) for i in range(8) for p in ("attn_v", "ffn_down", "attn_q")]
    t = spark.createDataFrame([(1, i, n, d, 256, 1) for i, (n, d) in enumerate(parts)], "model int, pos int, gguf_name string, ndim int, width int, gqa int")
    got = {r.gguf_name: r.stored for r in policy.assign(t, "q4_k_m").collect()}
    assert got["token_embd.weight"] == "Q6K" and got["output_norm.weight"] == "F32" and got["blk.3.attn_q.weight"] == "Q4K"
    assert [got[f"blk.{i}.attn_v.weight"] for i in range(8)] == ["Q6K", "Q4K", "Q4K", "Q6K", "Q4K", "Q4K", "Q6K", "Q6K"]
    skipped = {r.gguf_name: r.scheme for r in policy.assign(t, "q4_k_m", rules=[("blk[.]0[.]attn_v", "Q8_0")]).collect()}
    assert skipped["blk.0.attn_v.weight"] == "Q8_0" and skipped["blk.1.attn_v.weight"] == "Q6K"  # counters don't move with a rule


def test_recipes_and_methods():
    rules, default = policy.parse_recipe(["# x", "attn_v=q8_0", " ffn=q4_k_s # y", "q6_k"])
    assert rules == [("attn_v", "Q8_0"), ("ffn", "Q4K")] and default == "Q6K"
    for bad in (["q6_k", "a=q8_0"], ["a=nothing"], ["(?!x)=q8_0"]):
        with pytest.raises(ValueError):
            policy.parse_recipe(bad)
    assert sum(m.usable for m in METHODS) == 34 and len(METHODS) == 38 and all(m.default in BLOCKS for m in METHODS)
    assert scheme_id("Q4K") == "q4_k_m"


def test_row_fallback(spark):
    got = spark.sql(f"SELECT {policy.demoted(names.text('Q6K'), '96')} a, {policy.demoted(names.text('IQ2_S'), '32')} b, {policy.demoted(names.text('Q4K'), '33')} c, {policy.demoted(names.text('Q8_0'), '64')} d").first()
    assert tuple(got) == ("Q8_0", "IQ4_NL", "F16", "Q8_0")


def test_validation_of_one_layer(spark):
    def issues(parts, fmt, group=None, per_row=False):
        t = spark.createDataFrame([("m", f"l.{n}", d, s) for n, d, s in parts], "model string, name string, dtype string, shape array<long>")
        m = spark.createDataFrame([("m", "l", fmt, group, per_row)], "model string, layer string, format string, group_size int, per_row boolean")
        return {r.code for r in validate.structure(t, m).collect()}

    mark = ("comfy_quant", "U8", [9])
    assert issues([("weight", "I8", [256, 128]), ("weight_scale", "F32", [2, 1]), ("input_scale", "F32", []), mark], "int8_blockwise", 128) == set()
    assert issues([("weight", "I8", [128, 128]), ("weight_scale", "F32", []), ("input_scale", "F32", []), mark], "int8_blockwise", 128) == set()
    assert issues([("weight", "I8", [256, 128]), ("weight_scale", "F32", [2, 1]), ("input_scale", "F32", []), mark], "int8_blockwise") == {"scale_shape_unknown"}
    assert issues([("weight", "U8", [128, 32]), ("weight_scale", "F8_E4M3", [128, 4]), ("weight_scale_2", "F32", [1]), mark], "nvfp4") == {"scale_2_shape"}
    assert issues([("weight", "I8", [4, 8, 2]), ("weight_scale", "F32", []), mark], "int8_tensorwise") == {"weight_dims"}


def test_block_classes(spark):
    rows = [("m", "dead", "Q8_0", 0.0, 0.0, False, False), ("m", "same", "Q8_0", 1.0, 1.0, False, False), ("m", "rule", "Q8_0", 1.0, 2.0, False, False), ("m", "equal", "Q8_0", 1.0, 1.0, True, True), ("m", "nan", "NVFP4", 127.0, 126.0, False, True), ("m", "nv", "NVFP4", 127.0, 126.0, False, False), ("m", "k", "Q4K", 1.0, 1.0, False, False)]
    got = verify.blocks_class(spark.createDataFrame(rows, "model string, name string, dtype string, ours_scale double, ref_scale double, same boolean, codes_same boolean"))
    assert {r.name: r.kind for r in got.collect()} == {"dead": "dead_block", "same": "genuine", "rule": "scale_rule", "equal": "byte_exact", "nan": "format_conformance", "nv": "genuine", "k": "genuine"}


def test_selection(spark):
    t = spark.createDataFrame([(1, 1, "a.weight", "F32", 256, 256, 2), (1, 2, "a.bias", "F32", 256, None, 1), (1, 3, "b.weight", "F32", 100, 256, 2), (1, 4, "norm.weight", "F32", 256, None, 1)], "model int, pos int, name string, dtype string, d0 long, d1 long, ndim int")
    assert {r.name: r.action for r in catalog.plan(t).collect()} == {"a.weight": "quantize", "a.bias": "bias_correct", "b.weight": "cast", "norm.weight": "copy"}
    assert {r.name: r.action for r in catalog.plan(t, only=("b.",)).collect()}["a.weight"] == "cast"
    assert catalog.plan(t, exclude="^a").where("chosen").count() == 0


@pytest.fixture
def formats(spark):
    safetensors.register(spark)


def test_container_round_trip(spark, formats, tmp_path):
    r = np.random.default_rng(8)
    tensors = [(k, f"t{k}", "F32", [2, k + 1], r.normal(size=(2, k + 1)).astype("<f4").tobytes()) for k in range(7)] + [(7, "empty", "I8", [0, 3], b""), (8, "scalar", "F32", [], b"\0\0\x80?")]
    df = spark.createDataFrame([(k, n, d, s, bytearray(x)) for k, n, d, s, x in tensors], "pos long, name string, dtype string, shape array<long>, data binary").repartition(3)
    target = f"{tmp_path}/model.safetensors"
    df.write.format("safetensors").option("metadata", json.dumps({"format": "pt"})).mode("append").save(target)
    assert sorted(os.listdir(tmp_path)) == ["model.safetensors"]
    back = spark.read.format("safetensors").option("payload", "true").load(target).orderBy("pos").collect()
    assert [(b.pos, b.name, b.dtype, list(b["shape"]), bytes(b.data)) for b in back] == tensors
    assert safetensors.open_header(target)[1] == {"format": "pt"}
    assert "data" not in spark.read.format("safetensors").load(target).columns


def test_shards_in_index_order(spark, formats, tmp_path):
    for n in ("a", "b"):
        head = safetensors.header_bytes([{"name": f"x{n}", "dtype": "U8", "shape": [3], "start": 0, "end": 3}], {})
        (tmp_path / f"{n}.safetensors").write_bytes(head + b"abc")
    (tmp_path / "m.safetensors.index.json").write_text(json.dumps({"weight_map": {"xb": "b.safetensors", "xa": "a.safetensors"}}))
    got = spark.read.format("safetensors").load(str(tmp_path)).orderBy("shard").collect()
    assert [(r.shard, r.name) for r in got] == [(0, "xb"), (1, "xa")]


@pytest.mark.parametrize(
    "raw",
    [b"", b"\1\0", struct.pack("<Q", 16) + b"{}", struct.pack("<Q", 8) + b"not json", struct.pack("<Q", 8) + b"[]      ", struct.pack("<Q", 4) + b"{}  ", safetensors.header_bytes([{"name": "x", "dtype": "F32", "shape": [2], "start": 0, "end": 4}], {}) + b"abcd", safetensors.header_bytes([{"name": "x", "dtype": "F9", "shape": [1], "start": 0, "end": 4}], {}) + b"abcd"],
)
def test_broken_containers(raw, tmp_path):
    path = tmp_path / "x.safetensors"
    path.write_bytes(raw)
    with pytest.raises(safetensors.ContainerError):
        safetensors.open_header(str(path))


def test_gguf_round_trip(spark, formats, tmp_path):
    path = f"{tmp_path}/m.gguf"
    tensors = [("a", "F32", [2, 4], np.arange(8, dtype="<f4").tobytes()), ("b", "Q8_0", [1, 64], bytes(68)), ("c", "F16", [3], bytes(6))]
    gguf.write(path, {"general.architecture": "llama", "n": 7, "x": 0.5, "flag": True, "names": ["p", "q"]}, iter(tensors))
    meta, _, _ = gguf.read_header(path)
    assert meta == {"general.architecture": "llama", "n": 7, "x": 0.5, "flag": True, "names": ["p", "q"]}
    got = spark.read.format("gguf").option("payload", "true").load(path).orderBy("pos").collect()
    assert [(g.name, g.dtype, list(g["shape"]), bytes(g.data)) for g in got] == tensors
    with pytest.raises(ValueError):
        gguf.write(path, {}, iter([("a", "Q8_0", [1, 33], b"")]))


def test_importance_files(tmp_path):
    old = tmp_path / "old.dat"
    old.write_bytes(struct.pack("<i", 1) + struct.pack("<i", 1) + b"w" + struct.pack("<ii", 2, 3) + np.array([2, 4, 6], "<f4").tobytes())
    assert gguf.read_importance(str(old))["w"].tolist() == [1, 2, 3]
    new = f"{tmp_path}/new.gguf"
    meta = {"imatrix.datasets": ["d"], "imatrix.chunk_count": 1, "imatrix.chunk_size": 512}
    gguf.write(new, meta, iter([("w.in_sum2", "F32", [4], np.array([2, 4, 9, 9], "<f4").tobytes()), ("w.counts", "F32", [2], np.array([2, 0], "<f4").tobytes())]))
    assert gguf.read_importance(new)["w"].tolist() == [1, 2, 1, 1]
    gguf.write(new, meta, iter([("w.in_sum2", "F32", [1], b"\0\0\0\0")]))
    with pytest.raises(ValueError):
        gguf.read_importance(new)


def test_stream_quantizes_each_file_once(spark, tmp_path):
    from weft.streaming.ingest import quantize_stream

    rows = matrix(spark, np.random.default_rng(9).normal(size=(6, 32)).astype(np.float32))
    for k in range(2):
        rows.where(f"row_id % 2 = {k}").write.mode("append").parquet(f"{tmp_path}/in")
        quantize_stream(spark, f"{tmp_path}/in", rows.schema, lambda b: b, lambda b: quantize.mxfp8(b), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("row_id", "codes").orderBy("row_id").collect()
    assert [tuple(r.codes) for r in got] == [tuple(r.codes) for r in quantize.mxfp8(rows).orderBy("row_id").collect()]


@pytest.mark.parametrize(("kind", "size", "loss"), [("q2_k", 84, 0.12), ("q3_k", 110, 0.04), ("q4_k", 144, 0.01), ("q5_k", 176, 0.003), ("q6_k", 210, 0.001)])
def test_superblocks(spark, kind, size, loss):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(20, 512)), 10 * r.uniform(-1, 1, size=(5, 512)), np.zeros((1, 512)), np.full((1, 512), 2.0)]).astype(np.float32)
    w = r.uniform(0.1, 3, size=512).astype(np.float32)
    rows = matrix(spark, x.tolist())
    got = superblocks.superblocks(rows, kind).orderBy("row_id").collect()
    data = np.stack([np.frombuffer(g.data, np.uint8) for g in got])
    assert data.shape == (27, 2 * size)
    back = superblocks.decode(kind, data.reshape(-1, size)).reshape(x.shape)
    assert (((back - x) ** 2).sum(axis=1) <= loss * (x**2).sum(axis=1) + 1e-12).all()
    weighted = superblocks.superblocks(rows, kind, spark.createDataFrame([("t", w.tolist())], "tensor string, w array<float>")).orderBy("row_id").collect()
    better = superblocks.decode(kind, np.concatenate([np.frombuffer(g.data, np.uint8) for g in weighted]).reshape(-1, size)).reshape(x.shape)
    assert (w * (better - x) ** 2)[:20].sum() <= (w * (back - x) ** 2)[:20].sum()
    with pytest.raises(Exception, match="whole super-blocks"):
        superblocks.superblocks(matrix(spark, [[1.0] * 100]), kind).collect()


def test_searches_against_loops():
    """The group searches, element by element in 32-bit steps."""
    f = np.float32
    r = np.random.default_rng(8)
    x, w = r.normal(size=(30, 16)).astype(f), r.uniform(0.1, 2, size=(30, 16)).astype(f)
    scales, lows, codes = superblocks.search_affine(x, w, 3)
    signed, levels = superblocks.search_symmetric(x, w, 4)

    def total(values):
        out = f(0)
        for v in values:
            out = f(out + v)
        return out

    for n in range(30):
        low, high = min(f(0), x[n].min()), x[n].max()
        sw, sx = total(w[n]), total([f(a * b) for a, b in zip(w[n], x[n], strict=True)])
        best, kept = None, None
        for t in [None, *range(37)]:
            stretch = f(3) if t is None else f(f(f(-0.9) + f(f(0.05) * f(t))) + f(3))
            inverse = f(stretch / f(high - low))
            q = [min(max(int(np.rint(f(inverse * f(v - low)))), 0), 3) for v in x[n]]
            if t is None:
                s, m = f(1) / inverse, low
            else:
                wq = [f(a * f(c)) for a, c in zip(w[n], q, strict=True)]
                sq, sqq, sxq = total(wq), total([f(a * f(c)) for a, c in zip(wq, q, strict=True)]), total([f(a * v) for a, v in zip(wq, x[n], strict=True)])
                det = f(f(sw * sqq) - f(sq * sq))
                if det <= 0:
                    continue
                s, m = f(f(f(sw * sxq) - f(sx * sq)) / det), f(f(f(sqq * sx) - f(sq * sxq)) / det)
                if m > 0:
                    s, m = f(sxq / sqq), f(0)
            loss = total([f(a * f(f(f(f(s * f(c)) + m) - v) ** 2)) for a, c, v in zip(w[n], q, x[n], strict=True)])
            if best is None or loss < best:
                best, kept, low = loss, (s, q), m if t is not None else low
        assert (kept[0], -low, kept[1]) == (scales[n], lows[n], codes[n].tolist())
        top = x[n][np.abs(x[n]).argmax()]
        best = None
        for t in [0, *range(-9, 0), *range(1, 10)]:
            inverse = f(-f(f(4) + f(f(0.1) * f(t))) / top)
            q = [min(max(int(np.rint(f(inverse * v))), -4), 3) for v in x[n]]
            cross, norm = total([f(f(a * v) * f(c)) for a, v, c in zip(w[n], x[n], q, strict=True)]), total([f(f(a * f(c)) * f(c)) for a, c in zip(w[n], q, strict=True)])
            if best is None or f(cross * cross) > f(best * norm):
                s = f(cross / norm)
                best, kept = f(s * cross), (s, [c + 4 for c in q])
        assert kept == (signed[n], levels[n].tolist())
