import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_some_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "events", "nation", "customer", "part", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name in ("contact_spans", "contact_masked", "document_registry", "dictionary_hits", "consensus", "bundle_masked", "resolved_overlaps"):
        got = e.queries()[name](spark, SMALL).toPandas()
        want = con.execute(e.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name
