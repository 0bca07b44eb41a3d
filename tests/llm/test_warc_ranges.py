"""Lookups in bundles: by range, whole payloads for revisits, and against read_record."""

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import warc_bundles as wb


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def test_a_frame_is_read_by_range():
    import zstandard

    rnd = random.Random(1)
    raw = [rnd.randbytes(5000) for _ in range(40)]
    data = wb.bundle([(zstandard.ZstdCompressor().compress(x), len(x)) for x in raw])
    for k in (0, 17, 39):
        file = Counting(data)
        assert wb.read_frame(pa.PythonFile(file, "r"), len(data), k) == raw[k]
        assert file.bytes_read < 6000 < len(data) / 30
    for k in (-1, 40):
        with pytest.raises(IndexError):
            wb.read_frame(pa.PythonFile(io.BytesIO(data), "r"), len(data), k)
    with pytest.raises(ValueError):
        wb.read_frame(pa.PythonFile(io.BytesIO(b"x" * 50), "r"), 50, 0)


def test_lookup_gives_whole_payloads(spark, tmp_path):
    rnd = random.Random(2)
    pages = [(k, "u", "".join(rnd.choice("abcé \n") for _ in range(rnd.choice([0, 10, 3000])))) for k in range(60)]
    pages += [(100 + k, "v", "<p>same</p>" * 200) for k in range(50)] + [(7, "again", "another row of page 7"), (2**60 + 1, "w", None), (None, "w", "no id")]
    path = f"{tmp_path}/w"
    wb.write_bundles(spark.createDataFrame(pages, "page_id long, url string, html string"), path, bundle_bytes=4000)
    index = wb.index_bundles(spark, path)
    every = wb.lookup(spark, path, index, spark.createDataFrame([(p,) for p, _, _ in pages] + [(3,), (3,), (9999,)], "page_id long"))
    assert sorted((r.page_id, r.html) for r in every.collect()) == sorted((p, h or "") for p, _, h in pages if p is not None)
    assert index.where("refers_to is not null").count() == 49  # their payloads came from the response
    assert wb.lookup(spark, path, index, every.where(F.lit(False))).collect() == []
