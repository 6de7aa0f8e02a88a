"""Storage schemes and methods: block sizes, defaults, rules and engines."""

from __future__ import annotations

from typing import NamedTuple

# Elements and bytes of a block of each scheme.
BLOCKS = {
    "F32": (1, 4), "F16": (1, 2), "BF16": (1, 2), "Q8_0": (32, 34), "Q4_0": (32, 18), "Q4_1": (32, 20), "Q5_0": (32, 22), "Q5_1": (32, 24),
    "Q2K": (256, 84), "Q3K": (256, 110), "Q4K": (256, 144), "Q5K": (256, 176), "Q6K": (256, 210), "Q8K": (256, 292),
    "IQ2_XXS": (256, 66), "IQ2_XS": (256, 74), "IQ2_S": (256, 82), "IQ3_XXS": (256, 98), "IQ3_S": (256, 110), "IQ1_S": (256, 50), "IQ1_M": (256, 56),
    "IQ4_NL": (32, 18), "IQ4_XS": (256, 136), "TQ1_0": (256, 54), "TQ2_0": (256, 66), "Q1_0": (128, 18), "Q2_0": (128, 34),
}
UNQUANTIZED = ("F32", "F16", "BF16")
IQ = ("IQ1_S", "IQ1_M", "IQ2_XXS", "IQ2_XS", "IQ2_S", "IQ3_XXS", "IQ3_S", "IQ4_NL", "IQ4_XS")


class Method(NamedTuple):
    id: str
    default: str
    bits: float | None = None
    engine: str = "flat"
    more: str = ""  # the better scheme of the engine "more_bits"
    embedding: str = "F16"
    rules: tuple[tuple[str, str], ...] = ()
    weights: bool = False  # needs importance weights
    usable: bool = True


_V = (("attn_v", "Q4K"),)
# The methods, in order.
METHODS = [
    Method("f16", "F16", 16.0),
    Method("q8_0", "Q8_0", 8.6),
    Method("q6_k", "Q6K", 6.6),
    Method("q5_k_m", "Q5K", 5.5, "more_bits", "Q6K"),
    Method("q5_k_s", "Q5K", 5.5),
    Method("q5_0", "Q5_0", 5.5),
    Method("q5_1", "Q5_1", 5.5),
    Method("q4_k_m", "Q4K", 4.85, "more_bits", "Q6K"),
    Method("q4_k_s", "Q4K"),
    Method("q4_0", "Q4_0", 4.55),
    Method("q4_1", "Q4_1", 4.8),
    Method("q4_nl", "IQ4_NL", usable=False),
    Method("q3_k_m", "Q3K", 3.9, "q3_k_m"),
    Method("q3_k_l", "Q3K", 4.0, "q3_k_l"),
    Method("q3_k_s", "Q3K", 3.5),
    Method("q3_k_xs", "Q3K", 3.3, rules=_V),
    Method("q2_k", "Q2K", 2.96, "q2_k", rules=_V),
    Method("q2_k_l", "Q2K", 3.0, "q2_k_l", embedding="Q8_0", rules=_V),
    Method("iq4_nl", "IQ4_NL", 4.5, weights=True),
    Method("iq2_m", "IQ2_S", 2.7, "iq2_m", weights=True),
    Method("iq3_m", "IQ3_S", 3.66, "iq3_m", weights=True),
    Method("iq3_xxs", "IQ3_XXS", 3.06, weights=True),
    Method("iq2_xxs", "IQ2_XXS", 2.06, weights=True),
    Method("iq2_xs", "IQ2_XS", 2.31, weights=True),
    Method("f32", "F32", 32.6, embedding="F32"),
    Method("bf16", "BF16", 16.6, embedding="BF16"),
    Method("iq1_s", "IQ1_S", 1.56, weights=True),
    Method("iq1_m", "IQ1_M", 1.75, weights=True),
    Method("iq2_s", "IQ2_S", 2.5, weights=True),
    Method("iq3_s", "IQ3_S", 3.44, weights=True),
    Method("iq4_xs", "IQ4_XS", 4.25, weights=True),
    Method("tq1_0", "TQ1_0", 1.69),
    Method("tq2_0", "TQ2_0", 2.06),
    Method("q1_0", "Q1_0", 1.7),
    Method("q2_0", "Q2_0", 2.7),
    Method("q4_k_xl", "Q4K", usable=False),
    Method("q3_k_xl", "Q3K", usable=False),
    Method("q2_k_xl", "Q2K", usable=False),
]
BY_ID = {m.id: m for m in METHODS}


def scheme_id(scheme: str) -> str | None:
    """The first usable method whose default is the scheme."""
    return next((m.id for m in METHODS if m.usable and m.default == scheme), None)
