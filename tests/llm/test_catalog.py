"""The registered queries against their SQL, and the contract columns of those without one."""

import pytest

from tests.check import connect, diff, oracle
from tidegauge.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, con, name):
    assert diff(catalog.queries()[name](spark, SF).toPandas(), oracle(con, catalog.oracle_sql()[name])) is None


def test_chat_matches_sql(spark, con):
    from tidegauge.llm.chat import SQL

    want = oracle(con, SQL)
    assert diff(catalog.op9_chat(spark, SF).select(*want.columns).toPandas(), want) is None


@pytest.mark.parametrize(
    "name,columns",
    [
        ("op2_token_counts", {"doc_id", "n_bytes", "n_tokens", "over_limit"}),
        ("op4_near_dup", {"doc_id", "class_id"}),
        ("op6_language", {"doc_id", "held_out", "lang_pred", "score"}),
        ("op8_sentencepiece", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
        ("op9_chat", {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}),
    ],
)
def test_columns(spark, name, columns):
    df = catalog.queries()[name](spark, SF)
    assert columns <= set(df.columns) and df.count() > 0


def test_pipeline_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert "pipeline" not in entry.oracle_sql()
