def same_rows(df, relation):
    """Assert that both have the same columns and rows, whatever their order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)
