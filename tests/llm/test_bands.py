"""How surely similar lines become candidates."""

from weft.llm import line_dedup


def test_recall_of_bands_at_the_threshold():
    def met(s):
        return 1 - (1 - s**line_dedup.ROWS) ** line_dedup.BANDS

    assert met(0.8) >= 0.998 and met(0.85) >= 0.9998
