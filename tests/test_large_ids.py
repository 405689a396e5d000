"""Float lanes of events whose ids are those of larger tables: products of ids are beyond the integers a double holds."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lamina.plans import registry
from test_queries import plain

NAMES = "cast_f32_si16 cast_f64_si32 cast_convert_lanes_f32_si16 cast_convert_lanes_f64_si32 div div_keep div_zero equal equal_masked greater_than greater_than_masked greater_than_or_equal greater_than_or_equal_masked hadd_masked".split()
IDS = [0, 1, 2, 3_393_327, 3_393_391, 3_393_967, 3_776_239, 3_843_311]  # from 3,393,223 on, id * 2,654,435,761 exceeds 2**53


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("large_ids")
    pq.write_table(pa.table({"event_id": pa.array(IDS, pa.int64())}), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_lanes_of_large_ids(spark, folder, name):
    df = registry.QUERIES[f"p_{name}"](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{folder}/events.parquet'")
    want = duck.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[f'p_{name}']})").fetchall()
    texts = lambda rows: sorted(tuple(str(plain(x)) for x in r) for r in rows)
    assert texts(df.collect()) == texts(want)
