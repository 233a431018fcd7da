"""Every query with an oracle against DuckDB on the smallest tables; the others run and give rows."""

import duckdb
import numpy as np
import pytest

from specloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"figures", "majority_vote"}  # nothing of the kind in the smallest tables


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, list | tuple | np.ndarray):
        return str([canon(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs
    assert ours or name in EMPTY


@pytest.mark.parametrize("name", ["encoding_rules", "specification_sentences", "paragraphs", "similar_match", "content_changes", "word_diffs", "page_fidelity"])
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
