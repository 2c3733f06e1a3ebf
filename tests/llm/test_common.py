import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardstat.llm.common import GROUP_BYTES, READ_ROWS, cut, small_batches

ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def test_scans_decode_few_rows_at_once(spark):
    other = spark.newSession()
    small_batches(other)
    assert int(other.conf.get(ROWS)) == READ_ROWS
    own = spark.newSession()
    own.conf.set(ROWS, "100")
    small_batches(own)
    assert own.conf.get(ROWS) == "100"


def test_row_groups_of_a_cut_are_bounded(spark):
    noise = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)).cast("string"), 256)
                       for k in range(64)])
    wide = spark.range(0, 20_000, 1, 1).select("id", noise.alias("text"))
    written = cut(wide)
    assert written.agg(F.sum("id")).first()[0] == sum(range(20_000))
    files = [f for x in written.inputFiles()
             for f in glob.glob(os.path.join(x.removeprefix("file://"))) if f.endswith(".parquet")]
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in files
              for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 20_000
    assert max(sum(g.column(c).total_compressed_size for c in range(2))
               for g in groups) < 1.5 * GROUP_BYTES
