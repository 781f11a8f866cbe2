import logging
import random
import re

from tallyspark.llm import packing


def test_certificates_are_logged(spark, caplog):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.randint(1, 400), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    with caplog.at_level(logging.INFO, logger=packing.__name__):
        out = packing.pack(df, target=50)
    first = re.search(r"turn 1: (\d+) of (\d+) partitions certified, (\d+) bins", caplog.text)
    assert first and 0 < int(first[1]) <= int(first[2]) == 6
    assert out.select("sequence_id").distinct().count() <= int(first[3])
