"""Tensor names: canonical names, categories and selection, as SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def one_of(x: str, values) -> str:
    return f"{x} IN ({', '.join(map(text, values))})"


def case(x: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    return f"CASE {x} {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in table.items())} ELSE {otherwise} END"


def lookup(x: str, table: dict[str, str | int]) -> str:
    """``case`` for Spark alone: one lookup in a constant map.  Long chains make methods of more than 8000 bytes, which the JVM never compiles."""
    return f"element_at(map({', '.join(f'{text(k)}, {text(v) if isinstance(v, str) else f"{v}L"}' for k, v in table.items())}), {x})"


# Canonical names of the parts of a layer, by their names in checkpoints.
PARTS = {
    "self_attn.q_proj": "attn_q",
    "self_attn.k_proj": "attn_k",
    "self_attn.v_proj": "attn_v",
    "self_attn.o_proj": "attn_output",
    "self_attn.out_proj": "attn_output",
    "self_attn.q_layernorm": "attn_q_norm",
    "self_attn.k_layernorm": "attn_k_norm",
    "self_attn.q_norm": "attn_q_norm",
    "self_attn.k_norm": "attn_k_norm",
    "mlp.gate_proj": "ffn_gate",
    "mlp.up_proj": "ffn_up",
    "mlp.down_proj": "ffn_down",
    "mlp.gate": "ffn_gate_inp",
    "input_layernorm": "attn_norm",
    "pre_feedforward_layernorm": "ffn_norm",
    "post_feedforward_layernorm": "post_ffw_norm",
    "conv.conv": "shortconv.conv",
    "conv.in_proj": "shortconv.in_proj",
    "conv.out_proj": "shortconv.out_proj",
    "feed_forward.w1": "ffn_gate",
    "feed_forward.w2": "ffn_down",
    "feed_forward.w3": "ffn_up",
    "operator_norm": "attn_norm",
    "ffn_norm": "ffn_norm",
}
# Tensors outside of layers; architectures with a norm of their own after attention.
TOP = {"embed_tokens.weight": "token_embd.weight", "norm.weight": "output_norm.weight", "embedding_norm.weight": "token_embd_norm.weight"}
POST_ATTENTION_ARCHS = ("gemma2", "gemma3", "gemma3n")
# Categories by the first part of a canonical name that is found, in this order.
CATEGORIES = [
    ("attn_qkv.weight", "attention_qkv"),
    ("attn_kv_b.weight", "attention_kv_b"),
    ("attn_v.weight", "attention_v"),
    ("attn_k.weight", "attention_k"),
    ("attn_q.weight", "attention_q"),
    ("attn_output.weight", "attention_output"),
    ("ffn_up", "ffn_up"),
    ("ffn_gate", "ffn_gate"),
    ("ffn_down", "ffn_down"),
]
# Names with any of these parts keep full precision in the micro-scaled formats.
AVOID = """norm bias embed_tokens lm_head shared patch_embedding audio_model.patch_embedding ref_conv control_adapter
motion_encoder.enc.net_app face_encoder.conv pose_patch_embedding motion_encoder.enc.fc img_emb.proj k_norm q_norm
motion_encoder.dec head.modulation casual_audio_encoder cond_encoder frame_packer norm_k norm_q tekken_model
multi_modal_projector patch_conv ln_pre input_layernorm attention_norm post_attention_layernorm mm_in_projection_weight""".split()
# Architectures by class name; others are the lower-case part before "For".
ARCHS = {
    "LlamaForCausalLM": "llama", "MistralForCausalLM": "llama", "MixtralForCausalLM": "llama", "Qwen2ForCausalLM": "qwen2", "Qwen3ForCausalLM": "qwen2",
    "GemmaForCausalLM": "gemma", "Gemma2ForCausalLM": "gemma2", "Gemma3ForCausalLM": "gemma3", "PhiForCausalLM": "phi", "Phi3ForCausalLM": "phi",
    "GPT2LMHeadModel": "gpt2", "BloomForCausalLM": "bloom", "FalconForCausalLM": "falcon", "StableLmForCausalLM": "stablelm", "LFM2ForCausalLM": "lfm2",
    "Lfm2ForCausalLM": "lfm2", "LFM2VLForConditionalGeneration": "lfm2", "Lfm2VLForConditionalGeneration": "lfm2",
}


def canonical_steps(among: Callable[[str, dict[str, str]], str]) -> list[dict[str, str]]:
    """Steps to the canonical name, columns over (name, arch); each step refers to the one before.  ``among`` looks a value up in a table."""
    return [
        {"unwrapped": "regexp_replace(name, '^(model[.]language_model[.]|model[.]model[.])', '')"},
        {"bare": "regexp_replace(unwrapped, '^model[.]', '')"},
        {"tail": "regexp_extract(bare, '^layers[.][0-9]+[.](.*)$', 1)", "layer": "regexp_extract(bare, '^layers[.]([0-9]+)[.]', 1)"},
        {"core": "regexp_replace(tail, '[.](weight|bias)$', '')", "suffix": "regexp_extract(tail, '([.](weight|bias))$', 1)"},
        {"part": f"CASE WHEN core = 'post_attention_layernorm' THEN CASE WHEN {one_of('arch', POST_ATTENTION_ARCHS)} THEN 'post_attention_norm' ELSE 'ffn_norm' END ELSE {among('core', PARTS)} END"},
        {"canonical": f"CASE WHEN unwrapped = 'lm_head.weight' THEN 'output.weight' WHEN {one_of('bare', TOP)} THEN {among('bare', TOP)} WHEN part IS NOT NULL THEN concat('blk.', CAST(CAST(layer AS BIGINT) AS VARCHAR(20)), '.', part, suffix) END"},
    ]


HELPERS = ("unwrapped", "bare", "tail", "layer", "core", "suffix", "part")


def canonical(tensors: DataFrame) -> DataFrame:
    """Adds ``canonical``: null if the name has none (rotary caches and whatever isn't known)."""
    for step in canonical_steps(lookup):
        tensors = tensors.withColumns({k: F.expr(v) for k, v in step.items()})
    return tensors.drop(*HELPERS)


def canonical_sql(source: str) -> str:
    """The same as DuckDB SQL over the query ``source``."""
    for step in canonical_steps(case):
        source = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({source})"
    return f"SELECT * EXCLUDE ({', '.join(HELPERS)}) FROM ({source})"


def category(name: str) -> str:
    found = " ".join(f"WHEN {name} LIKE {text(f'%{p}%')} THEN {text(c)}" for p, c in CATEGORIES)
    return f"(CASE WHEN {name} = 'output.weight' THEN 'output' WHEN {name} IN ('token_embd.weight', 'per_layer_token_embd.weight') THEN 'token_embd' {found} ELSE 'other' END)"


def avoided(name: str) -> str:
    return "(" + " OR ".join(f"contains({name}, {text(p)})" for p in AVOID) + ")"


def arch_of(cls: str) -> str:
    return f"coalesce({case(cls, ARCHS)}, lower(regexp_replace({cls}, 'For.*$', '')))"


def gemma_plus_one(arch: str, name: str) -> str:
    """Norm weights that are stored less one."""
    return f"({arch} LIKE 'gemma%' AND {name} LIKE '%norm.weight')"


def checked_pattern(pattern: str) -> str:
    """The pattern, if it has neither look-around nor back-references, which not all engines know; else an error."""
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern}")
    re.compile(pattern)
    return pattern
