"""Which scheme each tensor gets: overrides, recipes, engines with running counters, and fallbacks for odd rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.names import case, category, checked_pattern, lookup, one_of, text
from weft.plans.methods import BLOCKS, BY_ID, UNQUANTIZED, Method

VALUES = "category IN ('attention_v', 'attention_qkv', 'attention_kv_b')"


def more_bits(i: str, n: str) -> str:
    """The first and the last eighth of the layers, and every third between."""
    return f"({i} < floor({n} / 8) OR {i} >= floor(7 * {n} / 8) OR ({i} - floor({n} / 8)) % 3 = 2)"


def _choose(cases: list[tuple[str, str]], otherwise: str) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {s}' for c, s in cases)} ELSE {otherwise} END"


def engine(method: Method, gqa: str = "gqa") -> str:
    """The engine's scheme from category, i_v, n_v, i_down, n_down (running counts and totals) and the query groups."""
    top, values, down = "category IN ('output', 'token_embd')", VALUES, "category = 'ffn_down'"
    first = "i_down < floor(n_down / 8)"
    by_count = lambda i, n, a, b: f"CASE WHEN {more_bits(i, n)} THEN {text(a)} ELSE {text(b)} END"
    two = [(values, f"CASE WHEN {gqa} >= 4 THEN 'Q4K' ELSE 'Q3K' END"), (down, "'Q3K'")]
    match method.engine:
        case "more_bits":
            base, more = method.default, method.more
            return _choose([(top, text("Q8_0" if base == "Q8_0" else "Q6K")), (values, by_count("i_v", "n_v", more, base)), (down, by_count("i_down", "n_down", more, base))], text(base))
        case "q2_k":
            return _choose([(top, "'Q6K'"), *two], "'Q2K'")
        case "q2_k_l":
            return _choose([(top, "'Q8_0'"), *two], "'Q2K'")
        case "q3_k_m":
            return _choose([(top, "'Q6K'"), ("category = 'attention_output'", "'Q5K'"), ("category IN ('attention_q', 'attention_k', 'attention_v')", "'Q4K'"), (down, by_count("i_down", "n_down", "Q6K", "Q4K"))], "'Q3K'")
        case "q3_k_l":
            return _choose([(top, "'Q6K'"), ("category IN ('attention_output', 'ffn_down')", "'Q5K'")], "'Q3K'")
        case "iq2_m":
            return _choose([("category = 'output'", "'Q5K'"), ("category = 'token_embd'", "'IQ3_S'"), (values, f"CASE WHEN {gqa} >= 4 THEN 'Q4K' ELSE 'IQ3_S' END"), (f"{down} AND {first}", "'IQ3_S'")], "'IQ2_S'")
        case "iq3_m":
            return _choose([("category = 'output'", "'Q6K'"), (f"{values} OR category = 'attention_output'", "'Q4K'"), (f"{down} AND {first}", "'Q4K'")], "'IQ3_S'")
        case _:
            rules = [(f"contains(gguf_name, {text(p)})", text(s)) for p, s in method.rules]
            return _choose([("gguf_name IN ('token_embd.weight', 'output.weight')", text(method.embedding)), *rules], text(method.default))


def recipe_scheme(rules: list[tuple[str, str]], default: str | None, matches: str) -> str:
    """The scheme of the first rule (pattern, scheme) that is found in gguf_name; ``matches`` is the engine's way to say so."""
    cases = [(matches.format("gguf_name", text(checked_pattern(p))), text(s)) for p, s in rules]
    return _choose(cases, text(default) if default else "CAST(NULL AS VARCHAR(20))") if cases else text(default) if default else "CAST(NULL AS VARCHAR(20))"


SPARK_MATCH, DUCK_MATCH = "{0} RLIKE {1}", "regexp_matches({0}, {1})"

_DEMOTED = {"IQ1_S": "IQ4_NL", "IQ1_M": "IQ4_NL", "IQ2_XXS": "IQ4_NL", "IQ2_XS": "IQ4_NL", "IQ2_S": "IQ4_NL", "IQ3_XXS": "IQ4_NL", "IQ3_S": "IQ4_NL", "IQ4_XS": "IQ4_NL", "Q2_0": "Q4_0", "Q2K": "Q4_0", "Q3K": "Q4_0", "TQ1_0": "Q4_0", "TQ2_0": "Q4_0", "Q4K": "Q5_0", "Q5K": "Q5_1", "Q6K": "Q8_0"}


def block_size(scheme: str) -> str:
    return f"CAST({case(scheme, {k: str(v[0]) for k, v in BLOCKS.items()})} AS BIGINT)"


def block_bytes(scheme: str) -> str:
    return f"CAST({case(scheme, {k: str(v[1]) for k, v in BLOCKS.items()})} AS BIGINT)"


def demoted(scheme: str, width: str) -> str:
    """The scheme, or a smaller block's if the row doesn't divide, or F16 if that doesn't either."""
    wide = [s for s, (n, _) in BLOCKS.items() if n > 32 and s not in _DEMOTED]
    second = f"CASE WHEN {one_of(scheme, wide)} THEN 'F16' ELSE coalesce({case(scheme, _DEMOTED)}, {scheme}) END"
    return f"(CASE WHEN {width} % {block_size(scheme)} = 0 THEN {scheme} WHEN {width} % {block_size(f'({second})')} = 0 THEN {second} ELSE 'F16' END)"


def demoted_flat(scheme: str, width: str) -> str:
    """The same for Spark, as lookups by the scheme: ``demoted`` repeats the second choice in each of its branches, which is too long to be compiled."""
    second = {s: "F16" if n > 32 and s not in _DEMOTED else _DEMOTED.get(s, s) for s, (n, _) in BLOCKS.items()}
    first, then = lookup(scheme, {s: n for s, (n, _) in BLOCKS.items()}), lookup(scheme, {s: BLOCKS[t][0] for s, t in second.items()})
    return f"(CASE WHEN {width} % {first} = 0 THEN {scheme} WHEN {width} % {then} = 0 THEN {lookup(scheme, second)} ELSE 'F16' END)"


# Columns that the steps add, as SQL text over (model, pos, gguf_name, ndim, width, gqa); each list refers to the one before.
def steps(method_id: str, rules: list[tuple[str, str]] | None = None, default: str | None = None, embedding: str | None = None, output: str | None = None, matches: str = SPARK_MATCH, fallback: Callable[[str, str], str] = demoted_flat) -> list[dict[str, str]]:
    """Precedence: vectors stay F32; overrides of embedding and output; methods that don't quantize; recipe; engine.

    The engine's counters advance only with tensors that it decides, while its totals count all of the model's.
    """
    method = BY_ID[method_id]
    overrides = []
    if embedding:
        named = " OR ".join(matches.format("gguf_name", text(p)) for p, _ in rules or []) or "FALSE"
        overrides.append((f"category = 'token_embd' AND NOT (gguf_name = 'per_layer_token_embd.weight' AND ({named}))", text(BY_ID[embedding].default)))
    if output:
        overrides.append(("category = 'output'", text(BY_ID[output].default)))
    plain = [("TRUE", text(method.default))] if method.default in UNQUANTIZED else []
    recipe = recipe_scheme(rules or [], default, matches)
    fixed = _choose([("ndim < 2", "'F32'"), *overrides, *plain], recipe)
    before = "OVER (PARTITION BY model ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    count = lambda c: f"CAST(coalesce(sum(CASE WHEN fixed IS NULL AND {c} THEN 1 ELSE 0 END) {before}, 0) AS BIGINT)"
    total = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (PARTITION BY model) AS BIGINT)"
    return [
        {"category": category("gguf_name")},
        {"fixed": fixed},
        {"i_v": count(VALUES), "n_v": total(VALUES), "i_down": count("category = 'ffn_down'"), "n_down": total("category = 'ffn_down'")},
        {"scheme": f"coalesce(fixed, {engine(method)})"},
        {"stored": fallback("scheme", "width")},
    ]


def assign(tensors: DataFrame, method_id: str, **options) -> DataFrame:
    """``tensors`` (model, pos, gguf_name, ndim, width, gqa) with scheme and, after demotion of odd rows, stored."""
    for step in steps(method_id, **options):
        tensors = tensors.withColumns({k: F.expr(v) for k, v in step.items()})
    return tensors


def assign_sql(source: str, method_id: str, **options) -> str:
    """The same as DuckDB SQL over the table expression ``source``."""
    for step in steps(method_id, matches=DUCK_MATCH, fallback=demoted, **options):
        source = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({source})"
    return source


def parse_recipe(lines: list[str]) -> tuple[list[tuple[str, str]], str | None]:
    """Rules and default of a recipe: lines pattern=method, # comments, and at most one bare method, the last line."""
    rules, default = [], None
    for number, line in enumerate(lines, 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if default is not None:
            raise ValueError(f"line {number}: nothing may follow the default")
        pattern, eq, method = line.rpartition("=")
        if method.strip() not in BY_ID:
            raise ValueError(f"line {number}: unknown method {method.strip()}")
        if eq:
            rules.append((checked_pattern(pattern.strip()), BY_ID[method.strip()].default))
        else:
            default = BY_ID[method.strip()].default
    return rules, default
