"""The README claims no survey item that it lists as a gap."""

import re
from pathlib import Path


def test_gaps_are_not_claimed():
    claimed, gaps = (Path(__file__).parent.parent / "README.md").read_text().split("### Gaps")
    gaps = gaps.split("## Scale")[0]
    assert {"A26", "A31", "K7"} <= set(re.findall(r"\b[AK]\d+\b", gaps))
    table = claimed.split("| survey items |")[1]
    assert not re.search(r"\b(A26|A31|K7)\b", table)
