"""Candidates by what stands before them."""

import pyarrow as pa

from weft.llm import kernel
from weft.llm.secrets_scan import candidates


def test_values_after_key_words_are_candidates():
    texts = ['password = "hunter$two"', "é api_key: abcdefghijklmnopqrst and more", "token=a1b2c3d4e5f6g7h8i9!j0$k pin=12345678", "key = 0123456789abcdef0123", "see 0123456789abcdef0123 key=short key: longenough 0123456789abcdef9999", ""]
    data, off = kernel.bytes_of(pa.array(texts).cast(pa.large_binary()))
    got = [(d, bytes(data[a:b]).decode()) for d, a, b in candidates(data, off)]
    assert got == [(0, "hunter$two"), (1, "abcdefghijklmnopqrst"), (2, "a1b2c3d4e5f6g7h8i9!j0$k"), (3, "0123456789abcdef0123"), (4, "0123456789abcdef0123"), (4, "longenough"), (4, "0123456789abcdef9999")]
