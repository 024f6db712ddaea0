"""A store and the texts restored from it come from one audit."""

from auditflow.plans.queries import QUERIES
from tests.conftest import SF


def test_texts_are_not_audited_again(spark):
    files = QUERIES["restore_from_store"](spark, SF).inputFiles()
    assert files and not [f for f in files if "documents.parquet" in f]
