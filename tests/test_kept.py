import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgersieve.plans.audit import publish_audit, run_audit
from ledgersieve.sources.kept import _cleaned_up, kept, scope, shared_folder


def held(spark):
    folder = shared_folder(spark).removeprefix("file:") + "/kept"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_nothing_is_left_of_a_published_audit(spark, ledger, tmp_path):
    rows = ledger({"counterparty": "Asha"}, {"counterparty": "Asha"}, {"amount": 50_000.0})
    before = held(spark)
    paths = publish_audit(str(tmp_path / "scoped"), rows, fmt="parquet")
    assert held(spark) == before
    other = run_audit(rows).publish(str(tmp_path / "plain"), "parquet")
    for name, path in paths.items():
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(
            map(tuple, spark.read.parquet(other[name]).collect()))


def test_scopes_end_with_errors_and_leave_other_tables(spark):
    outer = kept(spark.range(3), "outer")
    before = held(spark)
    with pytest.raises(ValueError), scope(spark):
        with scope(spark):
            kept(spark.range(2), "inner")
        still = kept(spark.range(4), "still")
        assert still.count() == 4
        raise ValueError
    assert held(spark) == before and outer.count() == 3


def test_a_kept_table_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}

    counts = spark.range(0, 100_000, 1, 4).selectExpr("id % 1000 as k").groupBy("k").count()
    before = shuffled()
    assert counts.collect() and shuffled() - before
    before = shuffled()
    table = kept(counts, "counts")
    assert not shuffled() - before
    assert spark.conf.get(setting, "false") == "false" and table.count() == 1000


def test_tables_written_side_by_side_put_the_setting_back(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    tables = [spark.range(0, 1000 * (n % 4 + 1), 1, 2).groupBy("id").count() for n in range(12)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(kept, tables))
    assert spark.conf.get(setting, "false") == before
    # the second to start saw what the first had set, and left it so when it ended last
    with _cleaned_up(spark):
        inner = _cleaned_up(spark)
        inner.__enter__()
    assert spark.conf.get(setting) == "true"
    inner.__exit__(None, None, None)
    assert spark.conf.get(setting, "false") == before
