"""Catalogs of tensors: (model, arch, pos, name, dtype, d0, d1, ndim), one row for each tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.names import avoided, canonical, canonical_sql, text

# Parts of the layers of the made-up models: place, name, rows and columns in units of the width, dimensions.
LAYER = [
    (0, "input_layernorm.weight", 1, 0, 1),
    (1, "self_attn.q_proj.weight", 1, 1, 2),
    (2, "self_attn.k_proj.weight", 1, 1, 2),
    (3, "self_attn.v_proj.weight", 1, 1, 2),
    (4, "self_attn.o_proj.weight", 1, 1, 2),
    (5, "self_attn.q_proj.bias", 1, 0, 1),
    (6, "self_attn.rotary_emb.inv_freq", 1, 0, 1),
    (7, "post_attention_layernorm.weight", 1, 0, 1),
    (8, "mlp.gate_proj.weight", 3, 1, 2),
    (9, "mlp.up_proj.weight", 3, 1, 2),
    (10, "mlp.down_proj.weight", 1, 3, 2),
    (11, "conv.conv.weight", 1, 1, 3),
]
OUTER = [(-2, "embed_tokens.weight", 8, 1, 2), (9000, "norm.weight", 1, 0, 1), (9001, "lm_head.weight", 8, 1, 2)]

MODEL = {
    "model": "p_partkey",
    "layers": "1 + p_partkey % 8",
    "width": "64 * (2 + p_size % 5) - CASE WHEN p_partkey % 7 = 0 THEN 8 ELSE 0 END",
    "arch": "CASE p_partkey % 5 WHEN 0 THEN 'llama' WHEN 1 THEN 'qwen2' WHEN 2 THEN 'gemma' WHEN 3 THEN 'gemma2' ELSE 'lfm2' END",
    "prefix": "CASE p_partkey % 3 WHEN 0 THEN 'model.' WHEN 1 THEN 'model.language_model.' ELSE 'model.model.' END",
    "gqa": "1 + p_partkey % 6",
}
TENSOR = {
    "pos": "CASE WHEN layer IS NULL THEN place ELSE layer * 100 + place END",
    "name": "CASE WHEN part = 'lm_head.weight' THEN part WHEN layer IS NULL THEN concat(prefix, part) ELSE concat(prefix, 'layers.', CAST(layer AS VARCHAR(20)), '.', part) END",
    "d0": "rows * width",
    "d1": "CASE WHEN ndim > 1 THEN cols * width END",
}
DTYPE = "CASE WHEN ndim = 1 THEN 'F32' WHEN pos % 4 = 1 THEN 'F16' ELSE 'BF16' END"


def _structs(parts: list[tuple]) -> str:
    return "array(" + ", ".join(f"named_struct('place', {k}L, 'part', {text(n)}, 'rows', {r}L, 'cols', {c}L, 'ndim', {d})" for k, n, r, c, d in parts) + ")"


def models(parts: DataFrame) -> DataFrame:
    """A made-up model for each row of ``part``."""
    return parts.select(*[F.expr(v).alias(k) for k, v in MODEL.items()])


def tensors(parts: DataFrame) -> DataFrame:
    """The catalog of the made-up models.

    A model becomes dozens of tensors, but a table of models is too small for Spark to split, and it takes the catalog to be as small; so the
    models are dealt out first, by model: what is made of them is made by all cores, and windows over a model's tensors shuffle nothing more.
    """
    dealt = models(parts).repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model")
    layers = dealt.select("*", F.explode(F.expr("sequence(-1L, greatest(coalesce(layers, 0L), 0L) - 1)")).alias("layer"))  # -1: outside of layers
    both = layers.select("*", F.explode(F.expr(f"if(layer < 0, {_structs(OUTER)}, {_structs(LAYER)})")).alias("p"))
    both = both.select("model", "arch", "prefix", "width", "gqa", F.expr("nullif(layer, -1L)").alias("layer"), "p.*")
    rows = both.select("model", "arch", "gqa", "ndim", *[F.expr(v).alias(k) for k, v in TENSOR.items()])
    return rows.withColumn("dtype", F.expr(DTYPE))


def _values(parts: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"(CAST({k} AS BIGINT), {text(n)}, CAST({r} AS BIGINT), CAST({c} AS BIGINT), {d})" for k, n, r, c, d in parts) + ") v(place, part, rows, cols, ndim)"


#: The same in DuckDB.
TENSORS_SQL = f"""SELECT *, {DTYPE} AS dtype FROM (SELECT model, arch, gqa, ndim, {', '.join(f'{v} AS {k}' for k, v in TENSOR.items())} FROM (
  SELECT * FROM (SELECT *, unnest(range(layers)) AS layer FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in MODEL.items())} FROM part)), {_values(LAYER)}
  UNION ALL BY NAME SELECT *, CAST(NULL AS BIGINT) AS layer FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in MODEL.items())} FROM part), {_values(OUTER)}))"""

NAMED = {"gguf_name": "coalesce(canonical, name)", "width": "coalesce(d1, d0)"}


def named(tensors: DataFrame) -> DataFrame:
    """Adds the canonical name (the name itself, if there is none) and the row width."""
    return canonical(tensors).withColumns({k: F.expr(v) for k, v in NAMED.items()}).drop("canonical")


NAMED_SQL = f"SELECT * EXCLUDE (canonical), {', '.join(f'{v} AS {k}' for k, v in NAMED.items())} FROM ({canonical_sql(TENSORS_SQL)})"


def indivisible(size: str) -> str:
    """Not a matrix, or a side that is smaller than the block or doesn't divide by it."""
    return f"(ndim <> 2 OR d0 < {size} OR d1 < {size} OR d0 % {size} <> 0 OR d1 % {size} <> 0)"


def probe_block(fmt: str, scaling: str, size: int) -> int:
    """The block size that the efficiency rule asks for."""
    return {"mxfp8": 32, "nvfp4": 16}.get(fmt, 64 if fmt == "fp8" and scaling != "block" else size)


def quantizable(fmt: str = "int8", scaling: str = "block", size: int = 128, exclude: str | None = None, only: tuple[str, ...] = (), efficient: bool = True, rotate: int | None = None, matches: str = "{0} RLIKE {1}") -> str:
    """Whether a tensor is quantized, cheapest tests first."""
    tests = ["name LIKE '%.weight'"]
    if exclude:
        tests.append(f"NOT ({matches.format('name', text(exclude))})")
    if only:
        tests.append("(" + " OR ".join(f"name LIKE {text(p + '%')}" for p in only) + ")")
    if fmt in ("mxfp8", "nvfp4"):
        tests.append(f"NOT {avoided('name')}")
    tests.append("ndim = 2 AND d0 > 0 AND d1 > 0")
    if efficient:
        b = str(rotate or probe_block(fmt, scaling, size))
        tests.append(f"NOT (d1 < {b} OR d1 % {b} <> 0)" if rotate else f"NOT {indivisible(b)}")
    return "(" + " AND ".join(tests) + ")"


def action(chosen: str, target: str = "BF16") -> str:
    """What becomes of a tensor: quantize, cast (matrices that weren't chosen), correct (their biases come later) or copy."""
    cast = f"name LIKE '%.weight' AND ndim = 2 AND d0 > 0 AND d1 > 0 AND dtype IN ('F32', 'F16', 'BF16') AND dtype <> {text(target)}"
    return f"CASE WHEN {chosen} THEN 'quantize' WHEN {cast} THEN 'cast' ELSE 'copy' END"


def plan(tensors: DataFrame, target: str = "BF16", **options) -> DataFrame:
    """``tensors`` with ``chosen`` and ``action``; a bias whose weight is quantized is corrected.

    A window finds the weight: the list of weights grows with the catalog, and Spark, which takes it for small, would broadcast it.
    """
    chosen = tensors.withColumn("chosen", F.expr(quantizable(**options))).withColumn("action", F.expr(action("chosen", target)))
    rows = chosen.withColumn("base", F.regexp_replace("name", "[.](weight|bias)$", ""))
    rows = rows.withColumn("sibling", F.expr("bool_or(chosen) over (partition by model, base) and model is not null"))
    return rows.withColumn("action", F.expr("CASE WHEN name LIKE '%.bias' AND sibling THEN 'bias_correct' ELSE action END")).drop("base", "sibling")


def plan_sql(target: str = "BF16", **options) -> str:
    chosen = quantizable(matches="regexp_matches({0}, {1})", **options)
    return f"""WITH c AS (SELECT *, {chosen} AS chosen, {action(chosen, target)} AS plain, regexp_replace(name, '[.](weight|bias)$', '') AS base FROM ({TENSORS_SQL}))
SELECT c.* EXCLUDE (plain, base), CASE WHEN c.name LIKE '%.bias' AND EXISTS (SELECT 1 FROM c w WHERE w.chosen AND w.model = c.model AND w.base = c.base) THEN 'bias_correct' ELSE plain END AS action FROM c"""


def first_wins(tensors: DataFrame) -> DataFrame:
    """Of tensors with one name in several shards (shard, pos) the first."""
    rank = F.expr("row_number() over (partition by model, name order by shard, pos)")
    return tensors.withColumn("n", rank).where("n = 1").drop("n")


def remaining(tensors: DataFrame, done: DataFrame) -> DataFrame:
    """What is left to do: tensors that aren't in (model, name) of ``done``, null names too.

    ``done`` may be as long as the catalog, so it isn't broadcast: a window over both finds it.
    """
    both = tensors.withColumn("done", F.lit(False)).unionByName(done.select("model", "name").withColumn("done", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("done", F.expr("bool_or(done) over (partition by model, name)")).where("not done").drop("done")


def finished_prefix(tensors: DataFrame) -> DataFrame:
    """The tensors before the first that isn't ``present``, in the order of pos."""
    missing = F.expr("sum(CASE WHEN present THEN 0 ELSE 1 END) over (partition by model order by pos rows unbounded preceding)")
    return tensors.withColumn("missing", missing).where("missing = 0").drop("missing")


def draw_order(tensors: DataFrame, by_name: bool) -> DataFrame:
    """(model, d1, draw): the order in which input widths are first met, in file order or by name."""
    first = tensors.groupBy("model", "d1").agg(F.min("name" if by_name else "pos").alias("first"))
    return first.select("model", "d1", F.expr("row_number() over (partition by model order by first)").alias("draw"))
