"""The landing log: batches that die, new checkpoints, packing and removal."""

import os

import pytest

from strata.sources.schemas import MATTER
from strata.streaming import log as log_module
from strata.streaming.landing import batches, compact, land, landed
from strata.streaming.log import BatchLog
from test_medallion import FIRST, SECOND, matter, rows, write


def zone(tmp_path, numbers, day=FIRST):
    for n in numbers:
        write(f"{tmp_path}/raw", "matters", day, n, matter(n, "Passed"))


def settings(tmp_path, checkpoint):
    return {"source": f"{tmp_path}/raw/matters", "ddl": MATTER, "key": "file_number", "target": f"{tmp_path}/b", "checkpoint": f"{tmp_path}/{checkpoint}"}


def test_a_killed_batch_is_landed_by_a_new_checkpoint(spark, tmp_path, monkeypatch):
    zone(tmp_path, "12")
    land(spark, **settings(tmp_path, "c1"))
    zone(tmp_path, "345", SECOND)
    with monkeypatch.context() as m:
        m.setattr(BatchLog, "record", lambda self, *a: 1 / 0)  # dies after the write, before the log
        with pytest.raises(Exception, match="STREAM_FAILED|division"):
            land(spark, **settings(tmp_path, "c1"))
    assert rows(landed(spark, f"{tmp_path}/b", MATTER), "file_number") == [("1",), ("2",)] and len(batches(spark, f"{tmp_path}/b")) == 1
    found = land(spark, **settings(tmp_path, "c2"))
    assert found.rows == 3 and rows(landed(spark, f"{tmp_path}/b", MATTER), "file_number") == [(k,) for k in "12345"]
    left = [n for n in os.listdir(f"{tmp_path}/b") if n.startswith("batch=")]
    assert len(left) == 3 and BatchLog(spark, f"{tmp_path}/b").vacuum() == 1
    assert landed(spark, f"{tmp_path}/b", MATTER).count() == 5


def test_the_same_query_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    zone(tmp_path, "12")
    with monkeypatch.context() as m:
        m.setattr(BatchLog, "record", lambda self, *a: 1 / 0)
        with pytest.raises(Exception, match="STREAM_FAILED|division"):
            land(spark, **settings(tmp_path, "c1"))
    assert landed(spark, f"{tmp_path}/b", MATTER).count() == 0
    assert land(spark, **settings(tmp_path, "c1")).rows == 2 and landed(spark, f"{tmp_path}/b", MATTER).count() == 2


def test_packing_keeps_rows_batches_and_readers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_module, "ENTRIES", 3)
    zone(tmp_path, "1234567")
    write(f"{tmp_path}/raw", "matters", FIRST, "broken", "{ no")
    land(spark, **settings(tmp_path, "c1"), files_per_batch=1, quarantine=f"{tmp_path}/q")
    target = f"{tmp_path}/b"
    names, reader = batches(spark, target), landed(spark, target, MATTER)
    assert len(names) == 8
    one = landed(spark, target, MATTER, names[:1]).union(landed(spark, target, MATTER, names[1:2])).collect()
    assert len(one) in (1, 2) and landed(spark, target, MATTER, names).count() == 7
    assert compact(spark, target, MATTER) == 8
    assert batches(spark, target) == names and rows(landed(spark, target, MATTER), "file_number") == [(k,) for k in "1234567"]
    assert rows(landed(spark, target, MATTER, names[:2]), "file_number") == sorted((r.file_number,) for r in one)
    assert reader.count() == 7  # the old folders are still there
    log = BatchLog(spark, target)
    assert len({f for f, _ in log.folders().values()}) == 1
    zone(tmp_path, "89", SECOND)
    assert land(spark, **settings(tmp_path, "c2")).rows == 2  # a new query takes only what the log hasn't
    assert compact(spark, target, MATTER) == 2 and log.vacuum() > 0
    assert compact(spark, target, MATTER) == 0
    assert rows(landed(spark, target, MATTER), "file_number") == [(k,) for k in "123456789"]
    assert compact(spark, f"{tmp_path}/nothing", MATTER) == 0 and landed(spark, f"{tmp_path}/nothing", MATTER).count() == 0


def test_many_rows_are_packed_by_several_tasks(spark, tmp_path, monkeypatch):
    for n in "12345678":
        zone(tmp_path, n)
        land(spark, **settings(tmp_path, "c1"))
    monkeypatch.setattr(log_module, "PACK_ROWS", 2, raising=False)
    target = f"{tmp_path}/b"
    assert compact(spark, target, MATTER) == 8
    pack = next(n for n in os.listdir(target) if n.startswith("pack="))
    assert sum(f.endswith(".parquet") and f[0] != "." for _, _, names in os.walk(f"{target}/{pack}") for f in names) > 1
    assert rows(landed(spark, target, MATTER), "file_number") == [(k,) for k in "12345678"]
