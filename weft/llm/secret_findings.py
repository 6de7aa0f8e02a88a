"""Labelled findings to train the secret filter on: made up from public formats of keys, and of things like them."""

from __future__ import annotations

import random
import string

_HEX, _ALNUM, _B64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung sch ich ein lich eau eux tion ment ci ar os do za que".split()
_SECRET_WORDS = ["token", "secret", "api_key", "apikey", "password", "auth", "access_key", "client_secret", "bearer", "credential", "private_key"]
_PLAIN_WORDS = ["commit", "sha1", "checksum", "md5", "uuid", "id", "digest", "build", "version", "page", "image", "example", "hash", "url", "order"]
_SECRET_PATHS = ["src/config.py", "app/settings.yml", ".env", "deploy/prod.env", "main.tf", "src0", "src7", "", "notes.txt"]
_PLAIN_PATHS = ["tests/test_api.py", "docs/example.md", "test/fixtures/data.json", "package-lock.json", "src3", "src12", "", "README.md"]


def _pick(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


def _word(r: random.Random, least: int) -> str:
    out = ""
    while len(out) < least:
        out += r.choice(_SYLLABLES)
    return out


def _secret(r: random.Random) -> str:
    return r.choice(
        [
            lambda: _pick(r, _HEX, r.choice([32, 40, 40, 64])),
            lambda: "AKIA" + _pick(r, string.ascii_uppercase + string.digits, 16),
            lambda: "ghp_" + _pick(r, _ALNUM, 36),
            lambda: "sk_live_" + _pick(r, _ALNUM, 24),
            lambda: "xoxb-" + _pick(r, string.digits, 12) + "-" + _pick(r, _ALNUM, 24),
            lambda: "AIza" + _pick(r, _ALNUM + "_-", 35),
            lambda: _pick(r, _B64, 40),
            lambda: _pick(r, _ALNUM, r.randint(20, 48)),
        ]
    )()


def _plain(r: random.Random) -> str:
    return r.choice(
        [
            lambda: _word(r, 14) + str(r.randint(0, 99)),
            lambda: _word(r, 8) + "_" + _word(r, 6) + "_" + str(r.randint(1, 999)),
            lambda: _pick(r, string.digits, r.randint(16, 22)),
            lambda: "-".join(_pick(r, _HEX, n) for n in (8, 4, 4, 4, 12)),
            lambda: _word(r, 6) + "." + str(r.randint(1, 99)) + ".example." + r.choice(["com", "org"]) + "/" + _word(r, 5),
            lambda: f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}.{r.randint(0, 59):02d}.00",
            lambda: "x" * r.randint(16, 30) + "1",
            lambda: _pick(r, _HEX, 40),
        ]
    )()


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """n rows (token, text before, text after, path, label), half of them secrets; equal for equal arguments."""
    r, out = random.Random(seed), []
    for i in range(n):
        words = " ".join(_word(r, 2) for _ in range(3))
        if i % 2:
            token, quote = _secret(r), r.choice(['"', '"', "'", ""])
            before = f"{words} {r.choice(_SECRET_WORDS)}{r.choice([' = ', '=', ': '])}{quote}"
            out.append((token, before, f"{quote} {_word(r, 4)}", r.choice(_SECRET_PATHS), 1))
        else:
            token, quote = _plain(r), r.choice(['"', "", "", ""])
            word = r.choice(_PLAIN_WORDS) if len(token) == 40 and "-" not in token or r.random() < 0.5 else _word(r, 4)
            before = f"{words} {word}{r.choice([' ', ' ', '=', ': '])}{quote}"
            out.append((token, before, f"{quote} {_word(r, 4)}", r.choice(_PLAIN_PATHS + _SECRET_PATHS[-3:]), 0))
    return out
