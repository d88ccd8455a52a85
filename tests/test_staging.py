"""Stored tables follow their sources."""

import os
import shutil

import pyarrow.parquet as pq

from ledgerlens.bindings import fundamentals

SF = "/root/testdata/sf0.001"


def test_a_changed_source_is_seen(spark, tmp_path):
    folder = f"{tmp_path}/sf"
    os.makedirs(folder)
    for name in os.listdir(SF):
        shutil.copyfile(f"{SF}/{name}", f"{folder}/{name}")
    before = fundamentals.QUERIES["stock_info"](spark, folder).count()
    suppliers = pq.read_table(f"{folder}/supplier.parquet")
    pq.write_table(suppliers.slice(0, 3), f"{folder}/supplier.parquet")
    after = fundamentals.QUERIES["stock_info"](spark, folder).count()
    assert before == 10 and after == 3
