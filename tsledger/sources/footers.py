"""Storage of a device by column, from the footers of its Parquet files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.manifest import Catalog

SEGMENTS = "path string, column string, rows long, stored long, raw long, nulls long, encodings string, codec string, low string, high string"


def segments(catalog: Catalog, device: str) -> DataFrame:
    """A row per file and column: sizes, nulls, encodings, codec and bounds.  Footers are read on the executors."""
    spark, own = catalog.files.spark, [f.path for m in catalog.manifests for f in m.files if f.device == device]
    if not own:
        return spark.createDataFrame([], SEGMENTS)
    shape = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SEGMENTS.split(", "))])

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                meta = pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata
                for k in range(meta.num_columns):
                    chunks = [meta.row_group(g).column(k) for g in range(meta.num_row_groups)]
                    stats = [c.statistics for c in chunks if c.statistics is not None]
                    bounds = [s for s in stats if s.has_min_max]
                    rows.append({
                        "path": path, "column": chunks[0].path_in_schema, "rows": meta.num_rows, "stored": sum(c.total_compressed_size for c in chunks), "raw": sum(c.total_uncompressed_size for c in chunks),
                        "nulls": sum(s.null_count or 0 for s in stats), "encodings": "+".join(sorted({e for c in chunks for e in c.encodings})), "codec": chunks[0].compression,
                        "low": str(min(s.min for s in bounds)) if bounds else None, "high": str(max(s.max for s in bounds)) if bounds else None,
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    files = spark.read.format("binaryFile").load([catalog.files.url(p) for p in own])
    return files.select("path", "content").mapInArrow(run, SEGMENTS)


def storage_by_column(catalog: Catalog, device: str) -> DataFrame:
    """``column, rows, stored, raw, bits`` (stored bits a point) over all files, superseded ones too."""
    total = segments(catalog, device).groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("stored").alias("stored"), F.sum("raw").alias("raw"), F.concat_ws(", ", F.array_sort(F.collect_set("encodings"))).alias("encodings"), F.first("codec").alias("codec"))
    return total.withColumn("bits", 8 * F.col("stored") / F.col("rows"))
