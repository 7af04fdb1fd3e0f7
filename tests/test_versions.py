import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelframe.sources.versions import Versions

DAYS = [dt.date(2024, 1, i) for i in range(1, 6)]


def rows(spark, days, value, entities=3):
    return spark.createDataFrame([(e, d, float(value)) for d in days for e in range(entities)], "entity long, d date, v double")


def content(df):
    return sorted(map(tuple, df.collect()))


def test_a_reader_sees_one_version(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t")
    assert t.manifest() is None and t.dates() == []
    with pytest.raises(FileNotFoundError):
        t.read()
    t.replace(rows(spark, DAYS, 1))
    old, was = t.read(), content(t.read())
    t.upsert(rows(spark, DAYS[3:], 2, 2), ["entity", "d"])
    assert content(old) == was  # made before: goes on reading what it was made from
    new = content(t.read())
    assert {r[2] for r in new if r[1] in DAYS[3:] and r[0] < 2} == {2.0} and len(new) == len(was)
    t.compact()
    assert content(t.read()) == new and content(old) == was
    t.drop(DAYS[0])
    assert t.dates() == [str(d) for d in DAYS[1:]] and content(t.read(version=1)) == was
    assert content(t.read(DAYS[1], DAYS[2])) == [r for r in was if r[1] in DAYS[1:3]]


def test_between_the_data_and_the_commit_nothing_changes(spark, tmp_path, monkeypatch):
    t = Versions(spark, str(tmp_path / "t"))
    t.replace(rows(spark, DAYS, 1))
    was, seen = content(t.read()), []
    real = Versions._commit

    def late(self, *a, **b):
        seen.append(content(Versions(spark, self.path).read()))  # a reader while the new files lie there
        raise RuntimeError("lost")

    monkeypatch.setattr(Versions, "_commit", late)
    for change in (lambda: t.upsert(rows(spark, DAYS, 9), ["entity", "d"]), lambda: t.replace(rows(spark, DAYS[:1], 9)), t.reset):
        with pytest.raises(RuntimeError):
            change()
    monkeypatch.setattr(Versions, "_commit", real)
    assert seen == [was] * 3 and content(t.read()) == was and t.versions() == [1]
    t.upsert(rows(spark, DAYS, 9), ["entity", "d"])  # the same again succeeds
    assert {r[2] for r in content(t.read())} == {9.0}


def test_reset_keeps_a_backup_and_clean_drops_it(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    t.replace(rows(spark, DAYS, 1))
    was = content(t.read())
    t.reset()
    assert content(t.read()) == [] and content(t.read(version=1)) == was
    t.rollback(1)
    assert content(t.read()) == was and t.versions() == [1, 2, 3]
    t.replace(rows(spark, DAYS[:2], 5))
    s = t.stats()
    assert s["dates"] == 5 and s["files"] == 5 and s["bytes"] > 0 and s["latest"] == "2024-01-05" and s["version"] == 4
    assert t.clean(1) == 2 and t.versions() == [4]
    assert sorted(r[2] for r in content(t.read())) == [1.0] * 9 + [5.0] * 6


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    base = t.replace(rows(spark, DAYS[:1], 1))
    t.drop(DAYS[0])
    with pytest.raises(Exception, match="(?i)exist"):
        t._commit(base, "late", base.schema, base.parts)
    assert t.manifest().what == "drop"


def test_compaction_of_dates_with_many_files(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    base = t.replace(rows(spark, DAYS, 1))
    rows(spark, [DAYS[0]], 7).repartition(3).write.parquet(f"{tmp_path}/t/data/more/_part=2024-01-01")
    t._commit(base, "append", base.schema, {**base.parts, "2024-01-01": [*base.parts["2024-01-01"], "data/more/_part=2024-01-01"]})
    was = content(t.read())
    assert t.stats()["files"] > 5
    t.compact()
    assert content(t.read()) == was and t.stats()["files"] == 5 and t.compact().version == t.manifest().version
    assert t.read().where(F.col("d") == DAYS[0]).count() == 6
