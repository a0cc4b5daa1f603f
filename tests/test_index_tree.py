import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as contract


def test_chunks_of_one_offset_count_once(spark, tmp_path):
    """A short sentence before a very long one begins two chunks: one is stored, and the SQL counts it once."""
    texts = ["Short. " + "long " * 600 + "end. Tail.", "One. Two.", "First. " + "a " * 2000 + "end. " + "b " * 2000 + "end."]
    rows = {"doc_id": range(3, 6), "source": ["s"] * 3, "lang": ["en"] * 3, "text": texts}
    pq.write_table(pa.table({k: list(v) for k, v in rows.items()}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    wanted = sorted(con.execute(contract.oracle_sql()["p13_index_tree"]).fetchall())
    assert [r[2] for r in wanted] == [2, 1, 2]
    assert sorted(map(tuple, contract.queries()["p13_index_tree"](spark, str(tmp_path)).collect())) == wanted
