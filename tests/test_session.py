"""What the session's settings bound."""

from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    """A worker holds a batch several times over, so 30 MB of texts must not come as one."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("ten bytes "), 1000).alias("text"))
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < BATCH_BYTES


def test_batches_of_arrow_functions_are_bounded_by_bytes(spark):
    """The grids of the look-alike photos are made by such a function over whole texts."""
    import pyarrow as pa

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts))

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("ten bytes "), 1000).alias("text"))
    assert texts.select(size("text").alias("size")).agg(F.max("size")).first()[0] < BATCH_BYTES
