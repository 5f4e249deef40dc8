import random

import pytest

_WORDS = "the of and committee granted river stone market winter letter number system people water theory school music garden family".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, bytes string, _key int, kept boolean, n int, word string"


def rows():
    """Nulls, empty and long texts, repeated rows, ties, odd characters, and columns with names that operators use."""
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(_WORDS) + rng.choice(["", "s", "ed", ""]) for _ in range(n))
    base = prose(120)
    texts = [
        None, "", "   \n\t", "one", "two words", base, base, base + " more", base.replace("river", "lake", 1), prose(300), "Licensed under CC BY-NC 4.0.\nAll rights reserved. ALL RIGHTS RESERVED",
        "The GNU General Public License, version 3.", "日本語のテキスト です 日本語", "İstanbul ΣΑΣ é ́x \x00z 😀", "a<|endoftext|>b don't I'LL we'd 12ab", "x" * 30_000, prose(6000), "  lead  double\n\ntrail  ", "Released under the MIT license", "$$$ !!! ???", "12345 67890", "▁a▁▁b", base.upper(), prose(40),
    ]
    out = [(i, t, None if i % 7 == 0 else ("en" if i % 2 else "fr"), "s", None, i, "b", i, True, 1, "w") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, "en", None, None, 1, "b", 1, False, 1, "w"), (None, "no id here", None, None, None, 1, "b", 1, False, 1, "w"), (9_000_000_000, "far away id", "en", "s", 11, 0, "", 0, None, 0, "")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
