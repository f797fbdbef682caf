"""What reaches the driver is bounded, and named here; nothing is pinned to one executor."""

import os
import re

ROOT = os.path.join(os.path.dirname(__file__), "..", "..", "weightloom", "llm")
#: File: reads into the driver, with the bound of each.
READS = {
    "decontaminate.py": 1,  # benchmark phrases, a block of bounded bytes at a time
    "hmm.py": 3,  # frequent tokens (each has a least share of the corpus), sums of a model of fixed size, one row of totals
    "langid.py": 3,  # a name for each language, sizes by power of two, MAX_COSTS costs
    "negatives.py": 2,  # a block of anchors, their few positives
    "substrings.py": 1,  # anchors with more than HOT_SHARE of all pieces: fewer than 1 / HOT_SHARE
    "toxicity.py": 2,  # MAX_WINDOWS windows of each label, one row for each of MAX_DOCUMENTS documents
    "urlfilter.py": 1,  # the labelled URLs of the fit, a bounded sample
}


def test_reads_are_the_named_ones():
    for f in sorted(os.listdir(ROOT)):
        if f.endswith(".py"):
            text = open(os.path.join(ROOT, f)).read()
            found = len(re.findall(r"\.toPandas\(|\.toLocalIterator\(|\.toArrow\(", text))
            assert found == READS.get(f, 0), f
            assert "localCheckpoint" not in text and ".collect()" not in text and "crossJoin" not in text, f
