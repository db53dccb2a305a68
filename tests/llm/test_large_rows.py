"""Rows of a megabyte or more: what a task holds of them is bounded."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quizweave.llm import common, lm


def test_batches_of_lists_are_cut_by_their_bytes():
    texts = [[b"x" * 500_000, None, b""] * 4, [], None, [b"y"], [b"z" * (common.PIECE + 1)], [b"a"]] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(18)), pa.array(texts, pa.list_(pa.binary()))], names=["i", "texts"]).slice(1)
    cut = list(common.pieces(batch))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    size = lambda row: sum(len(x or b"") for x in row or [])
    assert len(cut) >= 6 and all(p.num_rows == 1 or sum(map(size, p.column(1).to_pylist())) <= common.PIECE for p in cut)


def test_groups_of_documents_are_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    seen, plain = [], common.written

    def watched(df, *args, **more):
        out = plain(df, *args, **more)
        if df.columns[0] == "group_id":
            seen.extend(pq.ParquetFile(f).metadata for f in Path(out.written_to.removeprefix("file:")).glob("*.parquet"))
        return out

    monkeypatch.setattr(lm, "written", watched)
    docs = spark.range(20).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), F.lit(lm.PROBED_AT_ONCE)).alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    got = lm.score_documents(spark.read.parquet(f"{tmp_path}/docs"), F.lit(True), filter_bytes=0).collect()
    assert len(got) == 20 and sum(m.num_rows for m in seen) == 20
    assert max(m.row_group(i).num_rows for m in seen for i in range(m.num_row_groups)) <= 8
