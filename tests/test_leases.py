"""Two writers and a killed run on one table of months."""

import pytest

from sigspark.sources.leases import Busy, Fenced, Lease, copy_by_month, months_to_do, read_months, write_month

SCHEMA = "date string, x long"


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def rows(spark, months):
    return spark.createDataFrame([(f"{m}-{d:02d}", d) for m in months for d in (1, 2)], SCHEMA).selectExpr("date", "x")


def got(spark, path):
    return sorted((r.month, r.date, r.x) for r in read_months(spark, path, SCHEMA).collect())


def want(months):
    return sorted((m, f"{m}-{d:02d}", d) for m in months for d in (1, 2))


MONTHS = ["2001-01", "2001-02", "2001-03"]


def test_only_one_writer_holds_the_lease(spark, tmp_path):
    path, clock = f"file://{tmp_path}/t", Clock()
    first = Lease(spark, path, 60, clock)
    with pytest.raises(Busy):
        Lease(spark, path, 60, clock)
    clock.now += 50
    first.renew()
    clock.now += 50
    with pytest.raises(Busy):
        Lease(spark, path, 60, clock)
    first.release()
    assert Lease(spark, path, 60, clock).number == first.number + 1


def test_a_writer_that_lost_its_lease_is_fenced_off(spark, tmp_path):
    path, clock = f"file://{tmp_path}/t", Clock()
    slow = Lease(spark, path, 60, clock)
    write_month(rows(spark, MONTHS[:1]), path, MONTHS[0], slow)
    clock.now += 61
    with pytest.raises(Fenced):
        slow.renew()
    next_ = Lease(spark, path, 60, clock)
    for lost in (slow.check, slow.renew, slow.release, lambda: write_month(rows(spark, MONTHS[1:2]), path, MONTHS[1], slow)):
        with pytest.raises(Fenced):
            lost()
    write_month(rows(spark, MONTHS[1:2]), path, MONTHS[1], next_)
    # had the slow one marked its month in the moment between looking and marking, the higher number would still be read
    rows(spark, ["1999-01"]).write.parquet(f"{path}/rows/month={MONTHS[1]}/lease={slow.number}")
    slow.files.write(f"_done/{MONTHS[1]}.{slow.number}", "", True)
    assert got(spark, path) == want(MONTHS[:2])


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    path, clock = f"file://{tmp_path}/t", Clock()
    killed = Lease(spark, path, 60, clock)
    write_month(rows(spark, MONTHS[:1]), path, MONTHS[0], killed)
    rows(spark, MONTHS[1:2]).limit(1).write.parquet(f"{path}/rows/month={MONTHS[1]}/lease={killed.number}")  # died before the marker
    assert got(spark, path) == want(MONTHS[:1]) and months_to_do(spark, path, MONTHS) == MONTHS[1:]
    clock.now += 61
    lease = Lease(spark, path, 60, clock)
    assert copy_by_month(rows(spark, MONTHS), path, lease) == MONTHS[1:]
    assert got(spark, path) == want(MONTHS) and copy_by_month(rows(spark, MONTHS), path, lease) == []


def test_a_taker_that_died_while_writing_holds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    dead = Lease(spark, path, 60, Clock())
    dead.files.write(f"_lease/{dead.number:012d}", "", True)
    assert Lease(spark, path, 60, Clock()).number == dead.number + 1
    assert read_months(spark, f"{path}-none", SCHEMA).count() == 0
