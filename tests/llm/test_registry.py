import pytest

from ledgerloom.llm import registry

from ..oracle import compare, database

LARGE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    compare(registry.queries()[name](spark, sf_dir), database(sf_dir), registry.oracle_sql()[name])


def test_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]


def test_guard():
    """Nothing else in the library imports the subpackage."""
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for source in root.rglob("*.py"):
        if "llm" not in source.parts:
            assert "llm" not in source.read_text().replace("ledgerloom", "")
