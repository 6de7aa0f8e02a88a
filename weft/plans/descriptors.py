"""Layer descriptors, file metadata and configuration hashes, as SQL text; the JSON is spelt by hand, as its spacing counts."""

from __future__ import annotations

from weft.functions.names import case, text

# Descriptor formats, the storage types of their weights and scales, and what each must have.
FORMATS = {
    "int8_tensorwise": ("I8", "F32"),
    "int8_blockwise": ("I8", "F32"),
    "float8_e4m3fn": ("F8_E4M3", "F32"),
    "float8_e4m3fn_rowwise": ("F8_E4M3", "F32"),
    "float8_e4m3fn_blockwise": ("F8_E4M3", "F32"),
    "mxfp8": ("F8_E4M3", "U8"),
    "nvfp4": ("U8", "F8_E4M3"),
}
BLOCKWISE = ("int8_blockwise", "float8_e4m3fn_blockwise")
MICRO = {"mxfp8": 32, "nvfp4": 16}
# Formats that loaders know, the storage types that they take, and the scales that they need.
LOADABLE = {
    "float8_e4m3fn": (("F8_E4M3", "U8"), ("weight_scale",)),
    "float8_e5m2": (("F8_E4M3", "U8"), ("weight_scale",)),
    "nvfp4": (("U8",), ("weight_scale", "weight_scale_2")),
    "mxfp8": (("F8_E4M3", "U8"), ("weight_scale",)),
    "int8_tensorwise": (("I8",), ("weight_scale",)),
    "convrot_w4a4": (("I8",), ("weight_scale",)),
    "asym_w4a8_int8": (("I8",), ("weight_s_rel", "weight_s_channel")),
}


def weight_dtype(fmt: str) -> str:
    return case(fmt, {k: v[0] for k, v in FORMATS.items()})


def scale_dtype(fmt: str) -> str:
    return case(fmt, {k: v[1] for k, v in FORMATS.items()})


def descriptor(fmt: str, dtype: str, group: str, d0: str, d1: str, per_row: str, rotation: str) -> str:
    """JSON text of a layer's descriptor: its key order and fields depend on the family of the format.

    ``per_row`` is a condition, ``rotation`` the group size of a rotation or null, ``group`` the block size.
    """
    number = lambda x: f"CAST({x} AS VARCHAR(20))"
    head = f"concat('{{\"format\": \"', {fmt}, '\", \"orig_dtype\": \"', {dtype}, '\"')"
    blocks = f"concat({head}, ', \"group_size\": ', {number(group)}, '}}')"
    rotated = f"concat({head}, ', \"convrot\": true, \"convrot_groupsize\": ', {number(rotation)}, ', \"per_row\": true}}')"
    rows = f"concat({head}, ', \"per_row\": true}}')"
    micro = f"concat('{{\"format\": \"', {fmt}, '\", \"group_size\": ', {number(group)}, ', \"orig_dtype\": \"', {dtype}, '\", \"orig_shape\": [', {number(d0)}, ', ', {number(d1)}, ']}}')"
    return f"CASE WHEN {fmt} IN ('mxfp8', 'nvfp4') THEN {micro} WHEN {fmt} IN ('int8_blockwise', 'float8_e4m3fn_blockwise') THEN {blocks} WHEN {rotation} IS NOT NULL THEN {rotated} WHEN {per_row} THEN {rows} ELSE concat({head}, '}}') END"


def hash_payload(fmt: str, scaling: str, block: str, rotate: str, rotation: str, seed: str, efficient: str, exclude: str = "NULL", only: str = "NULL", quality: str = "NULL") -> str:
    """What a configuration's hash is taken of; keys beyond the basic ones are there only if they are set."""
    truth = lambda x: f"CASE WHEN {x} THEN 'true' ELSE 'false' END"
    number = lambda x: f"CAST({x} AS VARCHAR(20))"
    size = f"CASE {fmt} WHEN 'mxfp8' THEN 32 WHEN 'nvfp4' THEN 16 ELSE {block} END"
    mode = f"CASE WHEN {fmt} IN ('mxfp8', 'nvfp4') THEN 'block' ELSE {scaling} END"
    extra = "".join(f", CASE WHEN {v} IS NULL THEN '' ELSE concat('\"{k}\": \"', {v}, '\", ') END" for k, v in (("quality_tuning", quality), ("exclude_layers", exclude), ("only_prefix", only)))
    return (
        f"concat('{{\"block_size\": ', {number(size)}, ', \"calib_seed\": ', {number(seed)}, ', \"convrot\": ', {truth(rotate)}, ', \"convrot_group_size\": ', {number(rotation)}, "
        f"', \"int8\": ', {truth(f'{fmt} = {text("int8")}')}, ', \"no_learned_rounding\": true, '{extra}, '\"scaling_mode\": \"', {mode}, '\", \"skip_inefficient\": ', {truth(efficient)}, ', \"target_format\": \"', {fmt}, '\"}}')"
    )


def output_stem(base: str, fmt: str, rotation: str, simple: str, low_memory: str, samples: str, efficient: str) -> str:
    """Name of an output: the base and what changes its bytes."""
    tags = [f"CASE WHEN {fmt} IN ('int8_convrot', 'nvfp4_rot16') AND {rotation} IS NOT NULL THEN concat('-gs', CAST({rotation} AS VARCHAR(20))) ELSE '' END"]
    tags += [f"CASE WHEN {c} THEN '-{t}' ELSE '' END" for c, t in ((simple, "simple"), (low_memory, "lowmem"))]
    tags += [f"CASE WHEN {samples} IS NOT NULL THEN concat('-calib', CAST({samples} AS VARCHAR(20))) ELSE '' END", f"CASE WHEN {efficient} THEN '-heur' ELSE '' END"]
    return f"concat({base}, '-', {fmt}, {', '.join(tags)})"
