"""The shortest line that the README says is linked after one changed character."""

from weft.llm.line_dedup import char_shingles


def test_shortest_line_with_a_changed_character():
    from pathlib import Path

    def linked(n):
        line = "".join(chr(200 + k) for k in range(n))
        a, b = (set(char_shingles([x])[0].tolist()) for x in (line, line[: n // 2] + "x" + line[n // 2 + 1 :]))
        return 100 * len(a & b) >= 80 * len(a | b)

    assert linked(79) and not linked(78)
    assert "fewer than 79 characters" in (Path(__file__).parents[2] / "README.md").read_text()
