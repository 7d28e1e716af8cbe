"""Index mathematics beyond 64 bits, where the queries' SQL ends with an overflow."""

import pytest

from gridloom import catalog


def cubes(spark, path, keys):
    spark.createDataFrame([(k, k + 3) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    want = sorted((i, i**3) for i in (k * 37 + (1 << (k + 3) % 40) % 100003 for k in keys))
    return catalog.queries()["i01_index_math"](spark, str(path)).select("i", "cube", "back"), want


@pytest.mark.parametrize("keys, kind", [((1, 7, 50_000), "bigint"), ((1, 7, 149_999, 36_000_000), "decimal(38,0)")])
def test_cubes_are_whole(spark, tmp_path, keys, kind):
    df, want = cubes(spark, tmp_path, keys)
    rows = df.collect()
    assert dict(df.dtypes)["cube"] == kind and sorted((r.i, int(r.cube)) for r in rows) == want and all(r.i == r.back for r in rows)


# 9,000 and 14,999: a bigint holds the place, but a double or the product before it is halved doesn't
@pytest.mark.parametrize("keys, kind", [((1, 2, 9_000, 14_998, 14_999), "bigint"), ((1, 2, 14_999, 899_999, 900_000), "decimal(38,0)")])
def test_packed_places_are_whole(spark, tmp_path, keys, kind):
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    df = catalog.queries()["i12_closed_forms"](spark, str(tmp_path))
    want = sorted((n, n + (n + 3) * (n + 4) // 2) for n in (1 + 17 * k * k for k in keys))
    assert dict(df.dtypes)["packed"] == kind and sorted((r.n, int(r.packed)) for r in df.select("n", "packed").collect()) == want
