"""Rules against published values."""

import pytest

from verilane.plans import fixtures


@pytest.mark.parametrize("name", sorted(fixtures.VECTORS))
def test_published_values(spark, name):
    run, rows = fixtures.VECTORS[name]
    assert sorted(map(tuple, run(spark, "").collect()), key=repr) == sorted(rows, key=repr)


def test_published_citations(spark):
    assert sorted(map(tuple, fixtures.parsed_vectors(spark, "").collect()), key=repr) == sorted(fixtures.PARSED.rows, key=repr)
