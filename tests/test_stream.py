"""Headers from a stream equal those of all rows, however the rows come and whatever fails between."""

from __future__ import annotations

import pytest

from conftest import rows_of
from mendline import HeaderStream
from mendline.operators.headers import block_headers


@pytest.fixture
def rows(sales):
    return sales(*((i, [f"2023-0{1 + i % 4}", None, ""][0 if i % 9 else i % 2 + 1], (i * 7) % 23 - 5) for i in range(120)))


def stream_of(spark, source, files):
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(source.path)


@pytest.mark.parametrize("files", [1, 100])
def test_any_split_into_batches(spark, table, rows, tmp_path, files):
    source, path = table(), str(tmp_path / "stream")
    assert HeaderStream(spark, path).headers().count() == 0
    for part in rows.randomSplit([0.3, 0.3, 0.4], seed=files):
        source.append(part.coalesce(1), layout="keep")
        HeaderStream(spark, path).catch_up(stream_of(spark, source, files))  # each time a new stream, from the checkpoint
        assert rows_of(HeaderStream(spark, path).headers()) == rows_of(block_headers(source.read()))
    kept = HeaderStream(spark, path)._versions()
    assert len(kept) == 2 and (files > 1 or kept[-1] > 3)
    HeaderStream(spark, path).catch_up(stream_of(spark, source, files))  # nothing new
    assert rows_of(HeaderStream(spark, path).headers("sha256")) == rows_of(block_headers(rows, "sha256"))


@pytest.mark.parametrize("after", [False, True])
def test_a_batch_that_fails_counts_once(spark, table, rows, tmp_path, after):
    """The second batch dies before or after its totals are written, and is run again."""
    source, path = table(rows), str(tmp_path / "stream")
    merge, died = HeaderStream._merge, []

    def dying(self, changes, batch):
        if batch == 1 and not died:
            died.append(batch)
            if after:
                merge(self, changes, batch)
            raise RuntimeError("lost")
        merge(self, changes, batch)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(HeaderStream, "_merge", dying)
        with pytest.raises(Exception, match="lost"):
            HeaderStream(spark, path).catch_up(stream_of(spark, source, 2))
    assert died == [1]
    HeaderStream(spark, path).catch_up(stream_of(spark, source, 2))
    assert rows_of(HeaderStream(spark, path).headers()) == rows_of(block_headers(rows))
