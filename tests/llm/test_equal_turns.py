"""Turns that are equal in their number, dealt over many tasks, against the SQL."""

import duckdb

from folioforge.llm import chat, queries


def test_equal_turns_over_tasks(spark, tmp_path):
    rows = [(7, 1, f"role{(i * 7) % 40:02d}" if i % 9 else None, f"{'same start ' * 8 if i % 2 else ''}text {(i * 31) % 6000}") for i in range(12_000)]
    rows += [(7, 1, "assistant", "said again")] * 3000 + [(8, None, "assistant", None), (8, None, "", "x"), (8, None, None, "w")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = queries.op7_chat_format(spark, str(tmp_path))
        names = got.columns
        made = chat.format_chats(spark.read.parquet(f"{tmp_path}/conversations.parquet")).selectExpr("spark_partition_id() AS p").distinct().count()
        got = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op7_chat_format"])
    at = [want.columns.index(n) for n in names]
    assert made > 4
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
