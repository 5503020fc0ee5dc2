import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

#: Names that operators use inside, here with values of other types.
CLASHES = ["h1", "h2", "size", "shard", "block", "part", "slot", "hash", "bucket", "component", "text_key", "pattern", "signature", "words", "spans", "rank", "vector", "formatted", "id", "copies"]


@pytest.fixture()
def clashing():
    return lambda df: df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="session")
def texts():
    import numpy as np

    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeéfgh"), rng.integers(2, 7)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = prose(60), prose(120).split()
    out = [None, "", "  \n\t", "a b c", "A b  C", "x", prose(300), prose(300) + "\n" + passage, passage + " " + prose(40), prose(50) + passage[5:], "q" * 1000, "ab " * 300, prose(20_000)]
    for k in range(6):
        edited = list(base)
        for at in rng.integers(0, 120, k):
            edited[at] = f"Q{rng.integers(9999)}"
        out.append(" ".join(edited))
    return [*out, out[6], out[6]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
