"""Line items that show one id are images of their own: rows of the queries against SQL on such a table."""
import os

import duckdb
import pytest
from check_oracles import normal

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: With the few shown ids that occur twice, once with another date, once as an equal row, once with other keys.
REPEATED = f"""SELECT * FROM (SELECT * FROM '{FOLDER}/lineitem.parquet' LIMIT 90)
    UNION ALL SELECT * REPLACE (l_shipdate + INTERVAL 3 DAY AS l_shipdate) FROM (SELECT * FROM '{FOLDER}/lineitem.parquet' LIMIT 40)
    UNION ALL SELECT * FROM (SELECT * FROM '{FOLDER}/lineitem.parquet' LIMIT 20)
    UNION ALL SELECT * REPLACE (l_orderkey + 5000000 AS l_orderkey) FROM (SELECT * FROM '{FOLDER}/lineitem.parquet' LIMIT 30)"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", ["parse_rendered_dates", "adjacent_day_join", "nearest_year_join", "fallback_tiers", "rule_ablation"])
def test_lines_with_one_id_are_images_of_their_own(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY ({REPEATED}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = normal(entry.queries()[name](spark, str(tmp_path)).toPandas())
    assert got == normal(con.execute(entry.oracle_sql()[name]).df())
