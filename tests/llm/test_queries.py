"""The queries on training text run on the smallest tables; those with SQL agree with it."""

import os

import pytest

from corvina.llm.queries import oracle_sql, queries
from tests.test_entry import DATA, test_sql_agrees

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
__all__: list[str] = []
agrees = test_sql_agrees
del test_sql_agrees
COLUMNS = {
    "p1_found": ["id"], "p3_found": ["id_a", "id_b"], "p4_found": ["id", "linha"], "p5_found": ["id"], "p6_found": ["veiculo_id", "autor_a", "autor_b"],
    "p7_found": ["id", "linha"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agreement(spark, name):
    agrees(spark, name)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = queries()[name](spark, DATA)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows) > 0


def test_mixture_uses_repetition(spark):
    report = queries()["p9_mix_all"](spark, DATA).collect()
    assert len(report) == 20 and max(r.most_uses for r in report) > 1


def test_mixture_shares(spark):
    report = queries()["p9_mix"](spark, DATA).collect()
    assert len(report) == 20 and sum(r.share for r in report) == pytest.approx(1, abs=1e-3)
