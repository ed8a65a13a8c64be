"""What the operators bring to the driver: only these, and why each is bounded."""

import re
from pathlib import Path

import doctables.llm as llm

COLLECTS = {
    "langid.py": 2,  # rows counted per language; at most 400 training texts of 163 bytes for each of these languages
    "packing.py": 1,  # how many pieces have each length: one row per length up to a sequence
    "quality.py": 1,  # moments of two classes: (statistics + 1)^2 sums each
    "resampling.py": 1,  # features per bucket: one row per bucket
}


def test_collects_are_known():
    for f in Path(llm.__file__).parent.glob("*.py"):
        text = f.read_text()
        assert not re.search(r"\.(toPandas|toLocalIterator|localCheckpoint|crossJoin|rdd)\b", text), f
        assert len(re.findall(r"\.collect\(", text)) == COLLECTS.get(f.name, 0), f
