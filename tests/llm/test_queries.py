"""The queries on the smallest tables, against their SQL where there is one; the pipeline against its stages' rules."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from quillstone.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:  # null integers become floats on either side
        if pd.api.types.is_numeric_dtype(want[c]):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["op5_html_rendering", "op7_source_mixing", "op8_token_files", "op2_simhash_near_dedup", "op4_toxicity"])
def test_query_has_a_row_for_each(spark, name):
    table = "pages" if name == "op5_html_rendering" else "documents"
    assert queries.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns
        docs = after.checkpoint()
        sizes.append(docs.count())
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "source_mixing" or len(ids) == len(set(ids))
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(i := [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in docs.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
