"""Queries of descriptors, validation, comparison and importance weights; faults are put in, and the oracles say what they must show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import numeric as N
from weft.functions.names import text
from weft.functions.numeric import DUCK
from weft.operators import quantize as Q
from weft.plans import catalog, policy, validate, verify
from weft.plans import descriptors as D
from weft.plans.catalog import TENSORS_SQL
from weft.queries_catalog import tensors
from weft.queries_quantize import LONG, matrix, wide
from weft.registry import query, table

# Outputs of the made-up models: one format for each model, one fault for some of the layers.
_FORMAT = "CASE model % 7 " + " ".join(f"WHEN {i} THEN {text(f)}" for i, f in enumerate(D.FORMATS)) + " END"
_BASE = f"SELECT *, regexp_replace(name, '[.]weight$', '') AS layer, {_FORMAT} AS format, (model + pos) % 13 AS fault, model % 2 = 0 AS per_row FROM ({{0}}) t WHERE {catalog.quantizable(size=64)}"
_BASE_SQL = _BASE.format(TENSORS_SQL)


def outputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, markers) with faults."""
    rows = tensors(spark, folder).where(catalog.quantizable(size=64))
    rows = rows.withColumns({"layer": F.regexp_replace("name", "[.]weight$", ""), "format": F.expr(_FORMAT), "fault": F.expr("(model + pos) % 13"), "per_row": F.expr("model % 2 = 0")})
    up = validate.roundup
    shape = f"""CASE WHEN fault = 3 THEN array(7L, 7L) WHEN format = 'int8_tensorwise' AND per_row THEN array(d0, 1L) WHEN format IN ('int8_tensorwise', 'float8_e4m3fn') THEN array() WHEN format = 'float8_e4m3fn_rowwise' THEN array(d0)
      WHEN format = 'mxfp8' THEN array({up('d0', 128)}, {up('d1 / 32', 4)}) WHEN format = 'nvfp4' THEN array({up('d0', 128)}, {up('d1 / 16', 4)}) ELSE array(d0 div 64, d1 div 64) END"""
    parts = [
        f"if(fault = 8, NULL, struct('weight' AS part, if(fault = 0, 'F32', {D.weight_dtype('format')}) AS dtype, array(d0, if(format = 'nvfp4', d1 div 2, d1)) AS shape))",
        f"if(fault = 1, NULL, struct('weight_scale' AS part, if(fault = 2, 'BF16', {D.scale_dtype('format')}) AS dtype, {shape} AS shape))",
        "if(format = 'nvfp4' AND fault <> 6, struct('weight_scale_2' AS part, 'F32' AS dtype, CAST(array() AS ARRAY<BIGINT>) AS shape), NULL)",
        "if(format = 'int8_blockwise' AND fault <> 7, struct('input_scale' AS part, 'F32' AS dtype, CAST(array() AS ARRAY<BIGINT>) AS shape), NULL)",
        "struct('bias' AS part, if(fault = 5, 'I8', 'F32') AS dtype, array(d0) AS shape)",
        "if(fault = 4, NULL, struct('comfy_quant' AS part, 'U8' AS dtype, array(64L) AS shape))",
    ]
    made = rows.select("model", "layer", F.explode(F.expr(f"array_compact(array({', '.join(parts)}))")).alias("p")).select("model", F.concat_ws(".", "layer", "p.part").alias("name"), "p.dtype", "p.shape")
    markers = rows.where("fault <> 4").select("model", "layer", "format", F.when(F.col("format").isin(*D.BLOCKWISE), 64).alias("group_size"), "per_row")
    return made, markers


_ISSUES = """SELECT model, layer, unnest(CASE fault WHEN 0 THEN ['weight_dtype'] WHEN 1 THEN ['missing_scale', 'orphan_marker'] WHEN 2 THEN ['scale_dtype'] WHEN 3 THEN ['scale_shape'] WHEN 4 THEN ['orphan_scale'] WHEN 5 THEN ['bias_quantized']
  WHEN 6 THEN CASE WHEN format = 'nvfp4' THEN ['scale_2_missing'] ELSE [] END WHEN 7 THEN CASE WHEN format = 'int8_blockwise' THEN ['input_scale_missing'] ELSE [] END WHEN 8 THEN ['missing_weight'] ELSE [] END) AS code"""


@query("validate_structure", f"{_ISSUES} FROM ({_BASE_SQL})")
def validate_structure(spark: SparkSession, folder: str) -> DataFrame:
    return validate.structure(*outputs(spark, folder))


@query("validate_issue_counts", f"SELECT code, count(*) AS n, count(DISTINCT model) AS models FROM ({_ISSUES} FROM ({_BASE_SQL})) GROUP BY code")
def validate_issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return validate.structure(*outputs(spark, folder)).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"))


_LOADABLE = "format IN ('int8_tensorwise', 'float8_e4m3fn', 'mxfp8', 'nvfp4')"


@query("loader_contract", f"SELECT model, layer, unnest(CASE WHEN fault = 4 THEN [] WHEN NOT {_LOADABLE} THEN ['unknown_format'] WHEN fault = 0 THEN ['weight_dtype'] WHEN fault = 1 THEN ['missing_weight_scale'] WHEN fault = 6 AND format = 'nvfp4' THEN ['missing_weight_scale_2'] WHEN fault = 8 THEN ['missing_weight'] ELSE [] END) AS code FROM ({_BASE_SQL})")
def loader_contract(spark: SparkSession, folder: str) -> DataFrame:
    return validate.loadable(*outputs(spark, folder))


_SIZE = "d0 * CASE WHEN format = 'nvfp4' THEN d1 // 2 ELSE d1 END"


@query("validate_summary", f"SELECT *, round(100 * quantized_params / (quantized_params + full_precision_params), 3) AS share FROM (SELECT model, count(*) FILTER (WHERE fault <> 4) AS quantized_matrices, count(*) FILTER (WHERE fault = 4) AS full_precision_weights, CAST(coalesce(sum({_SIZE}) FILTER (WHERE fault <> 4), 0) AS BIGINT) AS quantized_params, CAST(coalesce(sum({_SIZE}) FILTER (WHERE fault = 4), 0) AS BIGINT) AS full_precision_params FROM ({_BASE_SQL}) WHERE fault <> 8 GROUP BY model)")
def validate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return validate.summary(*outputs(spark, folder))


def _payload(dtype: str) -> str:
    return "CASE " + " ".join(f"WHEN {dtype} = {text(k)} THEN {v}" for k, v in validate.ELEMENT.items()) + " END"


_PLACED = "SELECT model, name, pos, dtype, elements, CAST(coalesce(sum(bytes) OVER before, 0) AS BIGINT) AS start, CAST(sum(bytes) OVER (PARTITION BY model ORDER BY pos) + CASE WHEN pos % 17 = 3 THEN 2 ELSE 0 END AS BIGINT) AS \"end\", CAST(sum(bytes) OVER (PARTITION BY model) - CASE WHEN model % 5 = 0 THEN 4 ELSE 0 END AS BIGINT) AS length FROM (SELECT *, d0 * coalesce(d1, 1) AS elements, d0 * coalesce(d1, 1) * {0} AS bytes FROM ({1})) WINDOW before AS (PARTITION BY model ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("header_validate", f"WITH p AS ({_PLACED.format(_payload('dtype'), TENSORS_SQL)}) SELECT model, name, 'range' AS code FROM p WHERE \"end\" > length UNION ALL SELECT model, name, 'size' FROM p WHERE pos % 17 = 3")
def header_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets that run past the data or don't fit the shape."""
    rows = tensors(spark, folder).withColumn("elements", F.expr("d0 * coalesce(d1, 1)")).withColumn("bytes", F.expr(f"elements * {_payload('dtype')}"))
    rows = rows.withColumns({"end": F.expr("sum(bytes) over (partition by model order by pos)"), "length": F.expr("sum(bytes) over (partition by model) - if(model % 5 = 0, 4, 0)")})
    rows = rows.withColumn("start", F.col("end") - F.col("bytes")).withColumn("end", F.expr("`end` + if(pos % 17 = 3, 2, 0)"))
    return validate.header(rows, _payload("dtype"), "length")


_GRID = "SELECT fmt, scaling, block, rotate, efficient, exclude FROM (SELECT unnest(['int8', 'fp8', 'mxfp8', 'nvfp4']) AS fmt), (SELECT unnest(['tensor', 'row', 'block']) AS scaling), (SELECT unnest([64, 128, 256]) AS block), (SELECT unnest([false, true]) AS rotate), (SELECT unnest([false, true]) AS efficient), (SELECT unnest([NULL, 'norm|head']) AS exclude)"
_PAYLOAD = D.hash_payload("fmt", "scaling", "block", "rotate", "256", "233983427", "efficient", "exclude")


@query("config_hash", f"SELECT fmt, scaling, block, rotate, efficient, exclude, substring(sha256({_PAYLOAD}), 1, 16) AS hash FROM ({_GRID})")
def config_hash(spark: SparkSession, folder: str) -> DataFrame:
    grid = spark.range(1)
    for name, values in (("fmt", ["int8", "fp8", "mxfp8", "nvfp4"]), ("scaling", ["tensor", "row", "block"]), ("block", [64, 128, 256]), ("rotate", [False, True]), ("efficient", [False, True]), ("exclude", [None, "norm|head"])):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id").withColumn("hash", F.substring(F.sha2(F.expr(_PAYLOAD), 256), 1, 16))


_DESCRIPTOR = D.descriptor("format", "'torch.bfloat16'", "grp", "d0", "d1", "per_row", "CASE WHEN format = 'int8_tensorwise' AND pos % 3 = 0 THEN 256 END")
_GROUP = "CASE format WHEN 'mxfp8' THEN 32 WHEN 'nvfp4' THEN 16 ELSE 64 END"


def described(spark: SparkSession, folder: str) -> DataFrame:
    rows = tensors(spark, folder).where(catalog.quantizable(size=64))
    rows = rows.withColumns({"layer": F.regexp_replace("name", "[.]weight$", ""), "format": F.expr(_FORMAT), "per_row": F.expr("model % 2 = 0")}).withColumn("grp", F.expr(_GROUP)).withColumn("per_row", F.expr("per_row AND format = 'int8_tensorwise'"))
    return rows.withColumn("descriptor", F.expr(_DESCRIPTOR))


_DESCRIBED_SQL = f"SELECT *, {_DESCRIPTOR} AS descriptor FROM (SELECT * REPLACE (per_row AND format = 'int8_tensorwise' AS per_row), {_GROUP} AS grp FROM ({_BASE_SQL}))"


@query("layer_descriptors", f"SELECT model, layer, descriptor FROM ({_DESCRIBED_SQL})")
def layer_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).select("model", "layer", "descriptor")


@query("file_metadata", f"SELECT model, concat('{{\"format_version\": \"1.0\", \"layers\": {{', string_agg(concat('\"', layer, '\": ', descriptor), ', ' ORDER BY layer), '}}}}') AS metadata FROM ({_DESCRIBED_SQL}) WHERE format IN ('mxfp8', 'nvfp4') GROUP BY model")
def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata of files in the micro-scaled formats: all layers by name."""
    rows = described(spark, folder).where("format in ('mxfp8', 'nvfp4')")
    parts = F.expr("array_join(transform(array_sort(collect_list(struct(layer, descriptor))), x -> concat('\"', x.layer, '\": ', x.descriptor)), ', ')")
    return rows.groupBy("model").agg(parts.alias("s")).select("model", F.concat(F.lit('{"format_version": "1.0", "layers": {'), "s", F.lit("}}")).alias("metadata"))


@query("descriptor_parse", f"SELECT model, layer, json_extract_string(descriptor, '$.format') AS format, CAST(json_extract(descriptor, '$.group_size') AS BIGINT) AS group_size, CAST(json_extract(descriptor, '$.convrot_groupsize') AS BIGINT) AS rotation, coalesce(CAST(json_extract(descriptor, '$.per_row') AS BOOLEAN), false) AS per_row, coalesce(json_array_length(json_extract(descriptor, '$.orig_shape')), 0) AS dims FROM ({_DESCRIBED_SQL})")
def descriptor_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptors read back."""
    parsed = F.from_json("descriptor", "format string, group_size bigint, orig_shape array<bigint>, per_row boolean, convrot_groupsize bigint")
    rows = described(spark, folder).select("model", "layer", parsed.alias("j"))
    return rows.select("model", "layer", "j.format", "j.group_size", F.col("j.convrot_groupsize").alias("rotation"), F.coalesce("j.per_row", F.lit(False)).alias("per_row"), F.coalesce(F.size("j.orig_shape"), F.lit(0)).cast("long").alias("dims"))


_STEM = D.output_stem("arch", "fmt", "CASE WHEN model % 2 = 0 THEN 16 END", "model % 3 = 0", "model % 5 = 0", "CASE WHEN model % 7 = 0 THEN 128 END", "model % 11 = 0")
_FMT = "CASE model % 3 WHEN 0 THEN 'int8_convrot' WHEN 1 THEN 'nvfp4_rot16' ELSE 'mxfp8' END"


@query("output_names", f"SELECT model, {_STEM} AS stem FROM (SELECT *, {_FMT} AS fmt FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in catalog.MODEL.items())} FROM part))")
def output_names(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.models(table(spark, folder, "part")).withColumn("fmt", F.expr(_FMT)).select("model", F.expr(_STEM).alias("stem"))


@query("verify_full_outer", f"""SELECT model, name, CASE WHEN pos % 11 = 0 THEN 'ours_only' WHEN pos % 11 = 4 THEN 'ref_only' WHEN dtype = 'F32' OR pos % 11 = 1 AND ndim = 3 THEN 'skipped_f32' WHEN pos % 11 = 1 THEN 'dtype_mismatch'
  WHEN pos % 11 = 2 THEN 'dims_mismatch' WHEN pos % 11 = 3 THEN 'different' ELSE 'byte_exact' END AS class FROM ({TENSORS_SQL})""")
def verify_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    t = tensors(spark, folder).withColumn("digest", F.sha2(F.concat_ws(",", "model", "name").cast("binary"), 256))
    ref = t.where("pos % 11 <> 0").withColumns({"dtype": F.expr("CASE WHEN pos % 11 = 1 THEN CASE WHEN ndim = 3 THEN 'F32' WHEN dtype = 'F32' THEN dtype ELSE 'I8' END ELSE dtype END"), "d0": F.expr("if(pos % 11 = 2, d0 + 1, d0)"), "digest": F.expr("if(pos % 11 = 3, 'x', digest)")})
    return verify.compare(t.where("pos % 11 <> 4"), ref)


_BLOCKS = "SELECT l_suppkey AS model, l_orderkey AS name, CASE l_suppkey % 3 WHEN 0 THEN 'Q8_0' WHEN 1 THEN 'Q4_0' ELSE 'NVFP4' END AS dtype, CASE WHEN l_suppkey % 3 = 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 127 ELSE 126 END ELSE l_tax * (l_orderkey % 2) END AS ours_scale, CASE WHEN l_suppkey % 3 = 2 THEN CASE WHEN l_linenumber % 4 < 2 THEN 127 ELSE 126 END ELSE l_discount * (l_orderkey % 2) END AS ref_scale, l_quantity > 40 AS same, l_quantity > 5 AS codes_same FROM lineitem"


@query("verify_classes", f"""WITH b AS ({_BLOCKS}), g AS (SELECT model, name, dtype, count(*) FILTER (WHERE NOT same) AS diff_blocks, count(*) AS total_blocks, count(*) FILTER (WHERE NOT same AND NOT (ours_scale = 0 AND ref_scale = 0)) AS live, count(*) FILTER (WHERE NOT same AND ours_scale = ref_scale) AS eq,
  count(*) FILTER (WHERE NOT same AND NOT (codes_same AND abs(ours_scale - ref_scale) = 1)) AS other FROM b GROUP BY ALL)
SELECT model, name, CASE WHEN diff_blocks = 0 THEN 'byte_exact' WHEN dtype = 'NVFP4' THEN CASE WHEN other = 0 THEN 'format_conformance' ELSE 'genuine' END WHEN live = 0 THEN 'dead_block' WHEN dtype = 'Q8_0' AND eq > 0 THEN 'genuine' ELSE 'scale_rule' END AS kind, diff_blocks, total_blocks FROM g""")
def verify_classes(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "lineitem").createOrReplaceTempView("weft_lineitem")
    return verify.blocks_class(spark.sql(_BLOCKS.replace("FROM lineitem", "FROM weft_lineitem")))


_RATIOS = "SELECT l_linenumber AS candidate, l_returnflag AS profile, l_extendedprice AS base, l_extendedprice * (1 - l_discount * (l_linenumber - 3)) AS new FROM lineitem"


@query("quality_decision", f"WITH r AS ({_RATIOS}), p AS (SELECT candidate, profile, sum(base) AS b, sum(new) AS n FROM r GROUP BY ALL) SELECT candidate, count(*) FILTER (WHERE n < b) AS wins, round(max(n / b - 1), 9) AS worst, round(1 - sum(n) / sum(b), 9) AS gain, count(*) FILTER (WHERE n < b) >= 3 AND max(n / b - 1) <= 0.01 AND 1 - sum(n) / sum(b) >= 0.02 AS adopted FROM p GROUP BY candidate")
def quality_decision(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "lineitem").createOrReplaceTempView("weft_lineitem")
    found = verify.decision(spark.sql(_RATIOS.replace("FROM lineitem", "FROM weft_lineitem")))
    return found.select("candidate", "wins", F.round("worst", 9).alias("worst"), F.round("gain", 9).alias("gain"), "adopted")


def _block_oracle(d: str, code: str) -> str:
    q = N.two_to(f"greatest({N.exponent(f'greatest(abs({N.f64("d")}), {N.two_to("-40")})')}, -14) - 10")
    return f"""{LONG}, m AS (SELECT tensor, row_id, i // 32 AS slice, max(abs(x)) AS top, arg_max(x, abs(x) - i * 1e-12) AS lead FROM e GROUP BY ALL),
b AS (SELECT e.*, m.slice, {d} AS d FROM e JOIN m ON e.tensor = m.tensor AND e.row_id = m.row_id AND e.i // 32 = m.slice),
c AS (SELECT tensor, row_id, slice, i, {DUCK.round(f'{N.f64("d")} / ({q})')} * ({q}) AS scale, {code} AS code FROM (SELECT *, {N.mul('x', N.div('1', 'd'))} AS y FROM b))
SELECT tensor, row_id, CAST(slice AS INT) AS slice, max(scale) AS scale, string_agg(CAST(code AS VARCHAR), ',' ORDER BY i) AS codes FROM c GROUP BY tensor, row_id, slice"""


def _codes(df: DataFrame) -> DataFrame:
    return df.withColumn("codes", F.expr("array_join(transform(codes, c -> cast(c as string)), ',')"))


@query("q8_0_blocks", _block_oracle(N.div("m.top", "127"), "CAST(sign(y) * floor(abs(CAST(y AS DOUBLE)) + 0.5) AS INT)"))
def q8_0_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(Q.q8_0(matrix(spark, folder)))


@query("q4_0_blocks", _block_oracle(N.div("m.lead", "-8"), f"least(15, CAST(trunc({N.f32('y + CAST(8.5 AS FLOAT)')}) AS INT))"))
def q4_0_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(Q.q4_0(matrix(spark, folder)))


_HALF = "CASE WHEN abs({0}) < pow(2.0::DOUBLE, -14) THEN round_even({0} * pow(2.0::DOUBLE, 24), 0) / pow(2.0::DOUBLE, 24) ELSE round_even({0} / pow(2.0::DOUBLE, floor(log2(abs({0}))) - 10), 0) * pow(2.0::DOUBLE, floor(log2(abs({0}))) - 10) END"


def _offset_sql(levels: int) -> str:
    """Written out by hand: 32 elements from their minimum up in equal steps."""
    return f"""WITH e AS (SELECT label AS tensor, vec_id AS row_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
s AS (SELECT *, i // 32 AS slice, min(x) OVER w AS low, max(x) OVER w AS high FROM e WINDOW w AS (PARTITION BY row_id, i // 32)),
d AS (SELECT *, CAST(CAST(CAST(CAST(high AS DOUBLE) - low AS FLOAT) AS DOUBLE) / {levels} AS FLOAT) AS d FROM s),
y AS (SELECT *, CAST(CAST(CAST(x AS DOUBLE) - low AS FLOAT)::DOUBLE * CAST(1 / d::DOUBLE AS FLOAT) AS FLOAT) AS y FROM d),
c AS (SELECT *, least({levels}, floor(CAST(y::DOUBLE + 0.5 AS FLOAT)))::INT AS code FROM y)
SELECT tensor, row_id, slice::INT AS slice, max({_HALF.format('d::DOUBLE')}) AS scale, max({_HALF.format('low::DOUBLE')}) AS low, string_agg(code::VARCHAR, ',' ORDER BY i) AS codes FROM c GROUP BY ALL"""


@query("q4_1_blocks", _offset_sql(15))
def q4_1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(Q.q4_1(matrix(spark, folder)))


@query("q5_1_blocks", _offset_sql(31))
def q5_1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(Q.q5_1(matrix(spark, folder)))


@query("q5_0_blocks", _block_oracle(N.div("m.lead", "-16"), f"least(31, CAST(trunc({N.f32('y + CAST(16.5 AS FLOAT)')}) AS INT))"))
def q5_0_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(Q.q5_0(matrix(spark, folder)))


_TERNARY = f"""WITH e AS (SELECT vec_id // 4 AS row_id, unnest(embedding) AS x, vec_id % 4 * 64 + unnest(range(len(embedding))) AS i FROM embeddings),
t AS (SELECT *, max(abs(x)) OVER (PARTITION BY row_id) AS d FROM e), y AS (SELECT *, CAST(x::DOUBLE * CAST(1 / d::DOUBLE AS FLOAT) AS FLOAT)::DOUBLE AS y FROM t)
SELECT 0 AS tensor, row_id, 0 AS slice, max({_HALF.format('d::DOUBLE')}) AS scale, string_agg((sign(y) * floor(abs(y) + 0.5) + 1)::INT::VARCHAR, ',' ORDER BY i) AS codes FROM y GROUP BY row_id"""


@query("tq2_0_blocks", _TERNARY)
def tq2_0_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(Q.tq2_0(wide(spark, folder)))


@query("importance_weights", f"WITH e AS (SELECT vec_id AS name, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, label FROM embeddings) SELECT name, i, CASE WHEN (label + i // 16) % 4 > 0 THEN {N.f64(N.div(N.mul('x', 'x'), '(label + i // 16) % 4'))} ELSE 1 END AS w FROM e")
def importance_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of squares over counts, a count for each 16 columns."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("name"), F.expr(f"transform(embedding, x -> {N.mul('x', 'x')})").alias("sums"), F.expr("transform(sequence(0, 3), k -> (label + k) % 4)").alias("counts"))
    return Q.importance(rows).select("name", F.posexplode("w").alias("i", "w")).select("name", F.col("i").cast("long").alias("i"), F.col("w").cast("double").alias("w"))


_GATE = "CASE WHEN width_w IS NULL THEN CASE WHEN stored LIKE 'IQ%' AND gguf_name NOT IN ('token_embd.weight', 'output.weight') THEN 'missing' WHEN ndim >= 2 THEN 'note' END WHEN width_w <> width THEN CASE WHEN gguf_name = 'token_embd.weight' THEN 'dropped' ELSE 'mismatch' END ELSE 'used' END"


@query("importance_gate", f"SELECT model, gguf_name, stored, {_GATE} AS outcome FROM (SELECT *, CASE WHEN pos % 5 = 0 THEN NULL WHEN pos % 7 = 0 OR pos = -2 THEN width + 1 ELSE width END AS width_w FROM ({policy.assign_sql(catalog.NAMED_SQL, 'iq2_m')}))")
def importance_gate(spark: SparkSession, folder: str) -> DataFrame:
    """What importance weights mean for each tensor: used, dropped, missing where they must be, or of the wrong width."""
    rows = policy.assign(catalog.named(tensors(spark, folder)), "iq2_m")
    # The made-up weights are a function of the tensor's place; as a table to be joined they would be as long as the catalog.
    rows = rows.withColumn("width_w", F.expr("CASE WHEN pos % 5 = 0 THEN NULL WHEN pos % 7 = 0 OR pos = -2 THEN width + 1 ELSE width END"))
    return rows.select("model", "gguf_name", "stored", F.expr(_GATE).alias("outcome"))
