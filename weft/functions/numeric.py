"""32-bit float semantics and small float formats as SQL text.

Every function returns an expression that Spark and DuckDB read alike; ``rint`` is the one name that differs.  Products and
quotients of two floats are taken as doubles and cast back, which rounds exactly once; powers of two keep all other steps exact.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    rint: str

    def round(self, x: str) -> str:
        return self.rint.format(x)


SPARK = Dialect("rint({0})")
DUCK = Dialect("round_even({0}, 0)")


def f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def f64(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def mul(a: str, b: str) -> str:
    return f32(f"{f64(a)} * {f64(b)}")


def div(a: str, b: str) -> str:
    return f32(f"{f64(a)} / {f64(b)}")


INFINITE = "CAST('Infinity' AS DOUBLE)"
NAN = "CAST('NaN' AS DOUBLE)"


def inverse(x: str) -> str:
    """1 / x of a float from 0 up; infinite for 0, which division refuses."""
    return f"CASE WHEN {x} = 0 THEN {f32(INFINITE)} ELSE {div('1', x)} END"


def clamp(x: str, most: str) -> str:
    return f"greatest(least({x}, {most}), -({most}))"


def two_to(e: str) -> str:
    return f"pow({f64('2')}, {e})"


def exponent(ax: str) -> str:
    """floor(log2(ax)) of a positive double; log2 may be off by one next to powers of two, which is put right."""
    e = f"floor(log2({ax}))"
    return f"(CASE WHEN {ax} < {two_to(e)} THEN {e} - 1 WHEN {ax} >= {two_to(e + ' + 1')} THEN {e} + 1 ELSE {e} END)"


def _on_grid(d: Dialect, x: str, q: str) -> str:
    return f"{d.round(f'({x}) / ({q})')} * ({q})"


def bf16(d: Dialect, x: str) -> str:
    """Value of a normal float rounded to 8 significant bits, ties to even; zeros, infinities and NaN are as they are."""
    ax = f"abs({f64(x)})"
    return f32(f"CASE WHEN {x} = 0 OR isnan({x}) OR {ax} = {INFINITE} THEN {f64(x)} ELSE {_on_grid(d, f64(x), two_to(exponent(ax) + ' - 7'))} END")


def e4m3(d: Dialect, x: str) -> str:
    """Value nearest to x with 4 exponent and 3 mantissa bits, ties to even, at most 448 in size; NaN stays NaN."""
    ax = f"abs({f64(x)})"
    steps = " ".join(f"WHEN {ax} < {f64(repr(2.0 ** (e + 1)))} THEN {_on_grid(d, f64(x), f64(repr(2.0 ** (e - 3))))}" for e in range(-6, 8))
    return f"(CASE WHEN isnan({f64(x)}) THEN {NAN} WHEN {ax} >= 464 THEN sign({f64(x)}) * 448 {steps} ELSE {_on_grid(d, f64(x), f64('32'))} END)"


def e4m3_code(v: str) -> str:
    """Byte of a value on the E4M3 grid (plus zero for zero, 127 for NaN)."""
    av = f"abs({v})"
    steps = " ".join(f"WHEN {av} < {f64(repr(2.0 ** (e + 1)))} THEN {(e + 6) * 8} + {av} * {f64(repr(8 * 2.0**-e))}" for e in range(-6, 8))
    body = f"CASE WHEN {av} < {f64(repr(2.0**-6))} THEN {av} * 512 {steps} ELSE 112 + {av} * {f64(repr(8 * 2.0**-8))} END"
    return f"CAST(CASE WHEN isnan({v}) THEN 127 ELSE CASE WHEN {v} < 0 THEN 128 ELSE 0 END + {body} END AS INT)"


def e2m1_code(x: str) -> str:
    """Nibble of x on the grid 0, .5, 1, 1.5, 2, 3, 4, 6; ties to the even code, at most 6 in size."""
    ax = f"abs({f64(x)})"
    size = f"CASE WHEN {ax} <= 0.25 THEN 0 WHEN {ax} < 0.75 THEN 1 WHEN {ax} <= 1.25 THEN 2 WHEN {ax} < 1.75 THEN 3 WHEN {ax} <= 2.5 THEN 4 WHEN {ax} < 3.5 THEN 5 WHEN {ax} <= 5 THEN 6 ELSE 7 END"
    return f"({size} + CASE WHEN {x} < 0 THEN 8 ELSE 0 END)"


def e2m1_value(code: str) -> str:
    """Value of a nibble."""
    size = f"({code} % 8)"
    return f"((CASE WHEN {code} >= 8 THEN -1 ELSE 1 END) * CAST(CASE WHEN {size} < 4 THEN {size} * 0.5 WHEN {size} < 6 THEN {size} - 2 ELSE {size} * 2 - 8 END AS DOUBLE))"


def e8m0(block_max: str, compensate: str = "1") -> str:
    """Exponent byte of the power of two at or above block_max / 448 (times ``compensate``), as 32-bit logarithms give it; 254 for infinity."""
    need = f"greatest({f32(f'{f64(div(block_max, "448"))} * ({compensate})')}, {f32(two_to('-127'))})"
    return f"CASE WHEN {f64(need)} = {INFINITE} THEN 254 ELSE CAST(greatest(least(ceil({f32(f'log2({f64(need)})')}) + 127, 254), 0) AS INT) END"


def e8m0_value(e: str) -> str:
    return f"(CASE WHEN {e} = 0 THEN {f64('0')} ELSE {two_to(f'{e} - 127')} END)"


def int8_code(d: Dialect, x: str) -> str:
    return f"CAST({clamp(d.round(f64(x)), '127')} AS INT)"
