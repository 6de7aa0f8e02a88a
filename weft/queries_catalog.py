"""Queries of catalogs, names, selection, policies and recipes, over made-up models (one for each row of ``part``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names
from weft.plans import catalog, policy
from weft.plans.catalog import NAMED_SQL, TENSORS_SQL
from weft.plans.methods import BLOCKS, BY_ID, METHODS, scheme_id
from weft.registry import query, table


def tensors(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.tensors(table(spark, folder, "part"))


def named(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.named(tensors(spark, folder))


@query("tensor_catalog", TENSORS_SQL)
def tensor_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return tensors(spark, folder)


_CAT = names.category("gguf_name")


@query("canonical_names", f"SELECT model, pos, name, canonical AS gguf_name, {names.gemma_plus_one('arch', 'name')} AS plus_one FROM ({names.canonical_sql(TENSORS_SQL)})")
def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    return names.canonical(tensors(spark, folder)).select("model", "pos", "name", F.col("canonical").alias("gguf_name"), F.expr(names.gemma_plus_one("arch", "name")).alias("plus_one"))


@query("tensor_category", f"SELECT arch, {_CAT} AS category, count(*) AS n, count(DISTINCT gguf_name) AS names FROM ({NAMED_SQL}) GROUP BY ALL")
def tensor_category(spark: SparkSession, folder: str) -> DataFrame:
    return named(spark, folder).withColumn("category", F.expr(_CAT)).groupBy("arch", "category").agg(F.count("*").alias("n"), F.countDistinct("gguf_name").alias("names"))


_CLASSES = ", ".join(f"({names.text(c)})" for c in [*names.ARCHS, "NovelForCausalLM", "Thing"])


@query("arch_of_class", f"SELECT cls, {names.arch_of('cls')} AS arch FROM (VALUES {_CLASSES}) v(cls)")
def arch_of_class(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(f"SELECT cls, {names.arch_of('cls')} AS arch FROM VALUES {_CLASSES} AS v(cls)")


SELECTIONS = {
    "select_int8": {},
    "select_int8_small_blocks": {"size": 64},
    "select_fp8_row": {"fmt": "fp8", "scaling": "row"},
    "select_mxfp8": {"fmt": "mxfp8"},
    "select_nvfp4": {"fmt": "nvfp4"},
    "select_excluded": {"size": 64, "exclude": "q_proj|layers[.][0-2][.]mlp"},
    "select_only": {"size": 64, "only": ("model.layers.0.", "model.layers.1.")},
    "select_rotated": {"rotate": 256},
    "select_all_matrices": {"efficient": False},
}
for _name, _options in SELECTIONS.items():
    _columns = "model, pos, name, dtype, d0, d1, chosen, action"

    @query(_name, f"SELECT {_columns} FROM ({catalog.plan_sql(**_options)})")
    def _select(spark: SparkSession, folder: str, options: dict = _options) -> DataFrame:
        return catalog.plan(tensors(spark, folder), **options).select(_columns.split(", "))


_SHARDED = "SELECT *, pos % 3 AS shard, dtype AS stored FROM ({0}) UNION ALL SELECT *, 3 - pos % 2 AS shard, 'F32' AS stored FROM ({0}) WHERE pos % 5 = 0"


def sharded(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog dealt over shards, with some tensors in a second shard too."""
    t = tensors(spark, folder)
    return t.withColumn("shard", F.expr("pos % 3")).withColumn("stored", F.col("dtype")).union(t.where("pos % 5 = 0").withColumn("shard", F.expr("3 - pos % 2")).withColumn("stored", F.lit("F32")))


@query("shard_union_first_wins", f"SELECT model, name, min(shard) AS shard, arg_min(stored, shard * 100000 + pos) AS stored FROM ({_SHARDED.format(TENSORS_SQL)}) GROUP BY model, name")
def shard_union_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.first_wins(sharded(spark, folder)).select("model", "name", "shard", "stored")


@query("shard_order", f"SELECT model, shard, row_number() OVER (PARTITION BY model ORDER BY min(pos), shard) AS place, count(*) AS tensors FROM ({_SHARDED.format(TENSORS_SQL)}) GROUP BY model, shard")
def shard_order(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in the order in which the index first names them."""
    first = sharded(spark, folder).groupBy("model", "shard").agg(F.min("pos").alias("first"), F.count("*").alias("tensors"))
    return first.select("model", "shard", F.expr("row_number() over (partition by model order by first, shard)").alias("place"), "tensors")


@query("resume_remaining", f"SELECT model, pos, name FROM ({TENSORS_SQL}) EXCEPT SELECT model, pos, name FROM ({TENSORS_SQL}) WHERE pos % 4 = 0")
def resume_remaining(spark: SparkSession, folder: str) -> DataFrame:
    t = tensors(spark, folder)
    return catalog.remaining(t, t.where("pos % 4 = 0").select("model", "name")).select("model", "pos", "name")


@query("resume_prefix", f"WITH t AS ({TENSORS_SQL}) SELECT model, pos, name FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.model = t.model AND o.pos <= t.pos AND (o.pos + o.model) % 17 = 3)")
def resume_prefix(spark: SparkSession, folder: str) -> DataFrame:
    t = tensors(spark, folder).withColumn("present", F.expr("(pos + model) % 17 <> 3"))
    return catalog.finished_prefix(t).select("model", "pos", "name")


for _name, _by in (("calibration_order_file", "pos"), ("calibration_order_sorted", "name")):

    @query(_name, f"SELECT model, d1, row_number() OVER (PARTITION BY model ORDER BY min({_by})) AS draw FROM ({TENSORS_SQL}) WHERE {catalog.quantizable(size=64)} GROUP BY model, d1")
    def _draws(spark: SparkSession, folder: str, by_name: bool = _by == "name") -> DataFrame:
        return catalog.draw_order(tensors(spark, folder).where(catalog.quantizable(size=64)), by_name)


RULES = [("attn_(q|k)", "Q4K"), ("^blk[.]0[.]", "Q8_0"), ("ffn_", "Q3K")]
POLICIES = {f"policy_{m.id}": {"method_id": m.id} for m in METHODS if m.usable}
POLICIES |= {
    "policy_recipe": {"method_id": "q4_k_m", "rules": RULES},
    "policy_recipe_default": {"method_id": "q4_k_m", "rules": RULES, "default": "Q5K"},
    "policy_overrides": {"method_id": "q2_k", "rules": RULES, "embedding": "q8_0", "output": "q6_k"},
    "policy_unquantized": {"method_id": "bf16", "rules": RULES, "embedding": "q8_0"},
}
_SHOWN = "model, pos, gguf_name, category, scheme, stored"
for _name, _options in POLICIES.items():

    @query(_name, f"SELECT {_SHOWN} FROM ({policy.assign_sql(NAMED_SQL, **_options)})")
    def _policy(spark: SparkSession, folder: str, options: dict = _options) -> DataFrame:
        return policy.assign(named(spark, folder), **options).select(_SHOWN.split(", "))


@query("row_fallback", f"SELECT scheme, width, {policy.demoted('scheme', 'width')} AS stored FROM (VALUES {', '.join(f'({names.text(s)})' for s in BLOCKS)}) s(scheme), (SELECT unnest([16, 32, 48, 96, 128, 200, 256, 288, 512]) AS width)")
def row_fallback(spark: SparkSession, folder: str) -> DataFrame:
    grid = spark.createDataFrame([(s,) for s in BLOCKS], "scheme string").select("scheme", F.explode(F.array(*[F.lit(w) for w in (16, 32, 48, 96, 128, 200, 256, 288, 512)])).alias("width"))
    return grid.withColumn("stored", F.expr(policy.demoted("scheme", "width")))


_ASSIGNED = policy.assign_sql(NAMED_SQL, "q4_k_m")


@query("stored_sizes", f"SELECT model, stored, count(*) AS tensors, CAST(sum(d0 * coalesce(d1, 1)) AS BIGINT) AS elements, CAST(sum(floor(d0 * coalesce(d1, 1) / {policy.block_size('stored')}) * {policy.block_bytes('stored')}) AS BIGINT) AS bytes FROM ({_ASSIGNED}) GROUP BY model, stored")
def stored_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of the stored types of each model, with elements and bytes."""
    rows = policy.assign(named(spark, folder), "q4_k_m").withColumn("n", F.expr("d0 * coalesce(d1, 1)")).withColumn("b", F.expr(f"floor(n / {policy.block_size('stored')}) * {policy.block_bytes('stored')}"))
    return rows.groupBy("model", "stored").agg(F.count("*").alias("tensors"), F.sum("n").alias("elements"), F.sum("b").alias("bytes"))


@query("spec_audit", f"SELECT model, gguf_name, scheme, width FROM ({_ASSIGNED}) WHERE {policy.block_size('scheme')} > 1 AND width % {policy.block_size('scheme')} <> 0")
def spec_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Tensors whose rows don't hold whole blocks of the scheme that the policy asked for."""
    rows = policy.assign(named(spark, folder), "q4_k_m").withColumn("block", F.expr(policy.block_size("scheme")))
    return rows.where("block > 1 and width % block <> 0").select("model", "gguf_name", "scheme", "width")


@query("dtype_histogram", f"SELECT arch, dtype, count(*) AS n, CAST(sum(d0 * coalesce(d1, 1)) AS BIGINT) AS elements FROM ({TENSORS_SQL}) GROUP BY arch, dtype")
def dtype_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return tensors(spark, folder).groupBy("arch", "dtype").agg(F.count("*").alias("n"), F.sum(F.expr("d0 * coalesce(d1, 1)")).alias("elements"))


_IDS = ", ".join(f"({i}, {names.text(m.id)}, {names.text(m.default)}, {str(m.usable).upper()}, {str(m.weights).upper()})" for i, m in enumerate(METHODS))


@query("recipe_canonical_id", f"SELECT \"default\" AS scheme, arg_min(id, n) AS id FROM (VALUES {_IDS}) m(n, id, \"default\", usable, weights) WHERE usable GROUP BY ALL")
def recipe_canonical_id(spark: SparkSession, folder: str) -> DataFrame:
    schemes = sorted({m.default for m in METHODS if m.usable})
    return spark.createDataFrame([(s, scheme_id(s)) for s in schemes], "scheme string, id string")


@query("usable_methods", f"SELECT id, \"default\" AS scheme, weights FROM (VALUES {_IDS}) m(n, id, \"default\", usable, weights) WHERE usable")
def usable_methods(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(m.id, m.default, m.weights, m.usable) for m in METHODS], "id string, scheme string, weights boolean, usable boolean")
    return rows.where("usable").drop("usable")


_MODELS_MATCHED = "bool_or(regexp_matches(gguf_name, 'ffn_gate_exps|blk[.]5[.]'))"


@query("recipe_unmatched_warning", f"SELECT model, count(*) AS tensors FROM ({NAMED_SQL}) GROUP BY model HAVING NOT {_MODELS_MATCHED}")
def recipe_unmatched_warning(spark: SparkSession, folder: str) -> DataFrame:
    """Models in which no rule of a recipe matches anything."""
    hit = F.expr(policy.SPARK_MATCH.format("gguf_name", "'ffn_gate_exps|blk[.]5[.]'"))
    return named(spark, folder).groupBy("model").agg(F.count("*").alias("tensors"), F.bool_or(hit).alias("hit")).where("not hit").drop("hit")


@query("emitted_recipe", f"SELECT model, pos, concat('^', gguf_name, '$=', id) AS line FROM ({policy.assign_sql(NAMED_SQL, 'q3_k_m')}) JOIN (SELECT \"default\" AS scheme, arg_min(id, n) AS id FROM (VALUES {_IDS}) m(n, id, \"default\", usable, weights) WHERE usable GROUP BY ALL) USING (scheme)")
def emitted_recipe(spark: SparkSession, folder: str) -> DataFrame:
    """A line for each tensor that gives it the scheme that the policy chose."""
    ids = names.case("scheme", {s: i for s in BLOCKS if (i := scheme_id(s))})
    return policy.assign(named(spark, folder), "q3_k_m").select("model", "pos", F.expr(f"concat('^', gguf_name, '$=', {ids})").alias("line"))


__all__ = ["BY_ID"]
