import pytest
from conftest import SF, same

from granula.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(name, spark, duck):
    same(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_nothing_outside_imports_the_training_package():
    from conftest import ROOT

    for p in (ROOT / "granula").rglob("*.py"):
        if "llm" not in p.parts:
            assert "granula.llm" not in p.read_text(), p
