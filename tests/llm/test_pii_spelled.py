import pytest

from tidemark.llm import pii

CASES = [
    "jane.doe(at)example.org",
    "jane.doe[at]example.org",
    "jane.doe (at) example.org",
    "jane.doe at example.org",
    "jane(at)example(dot)org",
    "jane at example dot org",
]


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("address", CASES)
def test_spelled_out_address_without_digits(field, address):
    text = f"Write to {address} for more."
    base, every = pii.find(text, field)
    assert base == [] and pii.mask_text(text, every) == "Write to [EMAIL] for more.", every


@pytest.mark.parametrize("text", ["We met at noon (at last) and left.", "Look at the dot on the map. At home.", "See the site at once.", ""])
def test_plain_words_stay(field, text):
    assert pii.find(text, field) == ([], [])


def test_islands_are_linear():
    for t in ("z" * 300000 + " 1", "z" * 300000 + "1", "1 " * 150000, " at a" * 60000, "(at)" * 70000, " dot a" * 50000, "1" + " dot a" * 50000):
        pii.islands(t)
    assert pii.islands("a b1 c2  d3 x") == [(2, 7), (9, 11)]
