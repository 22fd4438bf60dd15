"""Registered queries beside their SQL on the smallest tables; ``SEQLOOM_ALL=1`` runs all."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUICK = """scan_lines tokenize token_counts vocab_fit vocab_shared encode_cut decode_ids oov_tokens argmax_label topk_ids
softmax_scores nan_guard attention_pool label_check vector_split cross_entropy scan_parallel scan_features features_known
feature_vectors bag_of_words tag_predict accuracy length_batches wraparound_fill seeded_shuffle stream_metrics stream_tag
events_next alignment_header lexicon_fit interpolate_scores model_roundtrip""".split()
NO_SQL: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


TRAINING = re.compile(r"op\d+_|pipeline$")  # tested with their subpackage
NAMES = [n for n in entry.queries() if not TRAINING.match(n)]


def test_every_query_has_sql():
    assert set(NAMES) - set(entry.oracle_sql()) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES if os.environ.get("SEQLOOM_ALL") else QUICK)
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    if name in NO_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = compare(got, con.execute(entry.oracle_sql()[name]).df())
    assert result.startswith("ok"), result
