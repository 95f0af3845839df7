"""Comparison with DuckDB."""


def plain(rows, columns):
    """Rows as sorted tuples of text, columns by name."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: str(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare_with_duckdb(spark, query, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = query(spark, sf_dir)
    wanted = con.execute(sql)
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert plain(found.collect(), found.columns) == plain(wanted.fetchall(), columns)
