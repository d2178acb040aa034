"""Rollup files, ingest plan and month replacement on real files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vintagekit import config as C
from vintagekit.operators import campaign as CP
from vintagekit.operators import features as FE
from vintagekit.session import staging_root
from vintagekit.sources import mart_store as S

#: The order in which the exporting job writes its columns.
ORDER = list(C.ROLLUP_DIMENSIONS) + ["volume", "responders", "expected_responses", "expected_responses_xpm", "GRR", "Boards", "NRR"]
VALUES = {"Prospect_type": "Prospecting", "vs_band": "640-700", "annual_fee": 25.0, "volume": 100, "responders": 10, "expected_responses": 9.5,
          "expected_responses_xpm": 8.25, "GRR": 0.1, "Boards": 20, "NRR": 0.2}


def put(folder, month, columns=ORDER, rows=1, **values):
    all_ = {c: 1 for c in ORDER} | VALUES | values
    lines = [",".join(columns)] + [",".join(str(all_[{x.lower(): x for x in ORDER}[c.lower()]]) for c in columns)] * rows
    (folder / f"exp_{month}_rollup.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    return d


def test_columns_are_bound_by_name(spark, folder):
    put(folder, "JAN25")                                                          # the source's own order
    put(folder, "FEB25", [c.upper() for c in ORDER])                              # upper case
    put(folder, "MAR25", [c for c in reversed(ORDER) if c != "expected_responses_xpm"])  # no XPM, other order
    got = {r.campaign_month: r for r in S.read_rollup_csv(spark, str(folder)).collect()}
    assert set(got) == {"2025-01", "2025-02", "2025-03"}
    for r in got.values():
        assert (r.volume, r.responders, r.Boards, r.expected_responses, r.vs_band) == (100, 10, 20, 9.5, "640-700")
        assert not hasattr(r, "GRR")
    assert got["2025-01"].expected_responses_xpm == got["2025-02"].expected_responses_xpm == 8.25
    assert got["2025-03"].expected_responses_xpm is None and got["2025-03"].source_file == "exp_MAR25_rollup.csv"


def test_a_missing_required_column_raises(spark, folder):
    put(folder, "JAN25", [c for c in ORDER if c != "Boards"])
    with pytest.raises(ValueError, match="Boards"):
        S.read_rollup_csv(spark, str(folder))


def plan(spark, months, as_of=dt.date(2025, 9, 15), force=False):
    """months: (month, file day or None, partition day or None)."""
    files = spark.createDataFrame([(m, dt.datetime(2025, 1, f)) for m, f, _ in months], "campaign_month string, file_time timestamp")
    parts = spark.createDataFrame([(m, dt.datetime(2025, 1, p)) for m, _, p in months if p], "campaign_month string, partition_time timestamp")
    return {r.campaign_month: r.action for r in S.ingest_plan(files, parts, as_of, force).collect()}


def test_plan_boundaries(spark):
    got = plan(spark, [("2023-09", 2, 1), ("2023-10", 2, 2), ("2023-11", 3, 2), ("2025-06", 1, 2), ("2025-07", 1, 2), ("2025-09", 1, 2),
                       ("2025-11", 1, 2), ("2025-05", 1, None)])
    assert got == {"2023-09": "frozen", "2023-10": "skip", "2023-11": "replace", "2025-06": "skip", "2025-07": "replace",
                   "2025-09": "replace", "2025-11": "skip", "2025-05": "add"}
    assert plan(spark, [("2023-09", 2, 1), ("2025-06", 1, 2)], force=True) == {"2023-09": "frozen", "2025-06": "replace"}


def test_ingest_keeps_a_bad_month_out(spark, folder, tmp_path):
    mart, log = str(tmp_path / "mart"), str(tmp_path / "log")
    put(folder, "JAN25", rows=2)
    put(folder, "FEB25")
    first = {r.campaign_month: r for r in S.run_ingest(spark, str(folder), mart, dt.date(2025, 3, 1), log_path=log).collect()}
    assert {k: r.status for k, r in first.items()} == {"2025-01": "added", "2025-02": "added"}
    assert first["2025-01"].total_volume == 200 and first["2025-01"].total_expected_responses == 19.0
    put(folder, "JAN25", responders=1000)            # fails
    put(folder, "FEB25", volume=500)                 # replaces
    put(folder, "MAR25", [c for c in ORDER if c != "volume"])
    (folder / "exp_APR25_rollup.csv").write_text("")
    (folder / "notes.csv").write_text("volume\n1\n")
    (folder / "exp_2025_rollup.csv").write_text("volume\n1\n")
    second = {r.campaign_month: r for r in S.run_ingest(spark, str(folder), mart, dt.date(2025, 3, 1), log_path=log).collect()}
    assert {k: r.status for k, r in second.items()} == {"2025-01": "failed", "2025-02": "replaced", "2025-03": "failed", "2025-04": "failed",
                                                        None: "ignored"}
    assert second["2025-01"].message == "responders exceed volume" and "volume" in second["2025-03"].message
    stored = {r.campaign_month: (r.n, r.v) for r in S.read_mart(spark, mart).groupBy("campaign_month").agg(
        F.count("*").alias("n"), F.sum("volume").alias("v")).collect()}
    assert stored == {"2025-01": (2, 200), "2025-02": (1, 500)}
    rows = spark.read.parquet(log)
    assert rows.count() == 6 and set(rows.columns) >= {"source_modified_time", "loaded_time", "total_expected_responses_xpm", "message"}
    assert {r.status: r.files for r in S.ingest_summary(spark.createDataFrame(list(second.values()))).collect()} == {
        "added": 0, "replaced": 1, "skipped": 0, "frozen": 0, "failed": 3}


def test_file_without_rows_is_empty_and_replace_twice_is_once(spark, folder, tmp_path):
    mart = str(tmp_path / "mart")
    put(folder, "JAN25", rows=0)
    out = S.run_ingest(spark, str(folder), mart, dt.date(2025, 3, 1)).collect()
    assert [(r.status, r.message) for r in out] == [("failed", "rollup is empty")]
    put(folder, "JAN25", rows=3)
    rows = S.read_rollup_csv(spark, str(folder))
    for _ in range(2):
        S.replace_months(rows, mart)
        assert S.read_mart(spark, mart).count() == 3
    assert S.mart_status(spark, mart).first().latest_month == "2025-01"


def text(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def outcome(rows):
    return {r.file_name: (r.status, r.message, r.total_volume) for r in rows.collect()}


def line(**values):
    all_ = {c: 1 for c in ORDER} | VALUES | values
    return ",".join(str(all_[c]) for c in ORDER)


def test_every_file_stands_for_itself(spark, folder, tmp_path):
    mart, head = str(tmp_path / "mart"), ",".join(ORDER)
    put(folder, "JAN25", rows=3)
    text(folder, "exp_FEB25_rollup.csv", [head, line(), line(volume='"1 000"'), line(volume="x", Boards="y"), line(Boards="")])
    text(folder, "exp_MAR25_rollup.csv", [head.replace("GRR", "Volume"), line()])
    text(folder, "exp_APR25_rollup.csv", [head.replace("Boards", "Bords"), line()])
    (folder / "exp_MAY25_rollup.csv").write_text("")
    text(folder, "exp_JUN25_rollup.csv", [head, line(), line() + ",7", "a,b"])
    text(folder, "exp_JUL25_rollup.csv", [head, line(volume="250.0", scorecard="?", vs_band="")])  # flags are read permissively
    text(folder, "exp_2025_rollup.csv", [head, line()])
    (folder / "exp_AUG25_rollup.csv").mkdir()
    got = outcome(S.run_ingest(spark, str(folder), mart, dt.date(2025, 9, 1)))
    assert got == {
        "exp_JAN25_rollup.csv": ("added", "", 300),
        "exp_FEB25_rollup.csv": ("failed", "2 values of volume are no numbers; 1 values of Boards are no numbers", 200),
        "exp_MAR25_rollup.csv": ("failed", "repeated columns: volume", None),
        "exp_APR25_rollup.csv": ("failed", "missing required columns: Boards", None),
        "exp_MAY25_rollup.csv": ("failed", "the file is empty", None),
        "exp_JUN25_rollup.csv": ("failed", "2 broken lines", 200),
        "exp_JUL25_rollup.csv": ("added", "", 250),
        "exp_2025_rollup.csv": ("ignored", "the name gives no month", None)}
    stored = {r.campaign_month: r for r in S.read_mart(spark, mart).collect()}
    assert set(stored) == {"2025-01", "2025-07"} and stored["2025-07"].vs_band == C.LOWEST_BAND and stored["2025-07"].scorecard is None


def test_the_newest_file_of_a_month_is_loaded(spark, folder, tmp_path):
    import os
    mart = str(tmp_path / "mart")
    put(folder, "JAN25", volume=700)
    (folder / "exp_JAN25_rollup.csv").rename(folder / "exp_jan25_rollup.CSV")
    put(folder, "JAN25")
    for name, at in (("exp_jan25_rollup.CSV", 2_000_000_000), ("exp_JAN25_rollup.csv", 1_900_000_000)):
        os.utime(folder / name, (at, at))
    got = outcome(S.run_ingest(spark, str(folder), mart, dt.date(2025, 3, 1)))
    assert got == {"exp_jan25_rollup.CSV": ("added", "", 700),
                   "exp_JAN25_rollup.csv": ("skipped", "a newer file of the month is there", None)}
    assert S.read_mart(spark, mart).first().volume == 700


def test_a_file_that_breaks_the_job_breaks_its_month_only(spark, folder, tmp_path, monkeypatch):
    mart = str(tmp_path / "mart")
    for m in ("JAN25", "FEB25", "MAR25"):
        put(folder, m)
    read = S.read_rollup_files

    def breaking(spark, paths):
        rows, faults = read(spark, paths)
        bad = F.col("source_file") == "exp_FEB25_rollup.csv"
        return rows.withColumn("volume", F.when(bad, F.raise_error(F.lit("unreadable block")).cast("long")).otherwise(F.col("volume"))), faults

    monkeypatch.setattr(S, "read_rollup_files", breaking)
    got = outcome(S.run_ingest(spark, str(folder), mart, dt.date(2025, 6, 1)))
    assert {k: v[0] for k, v in got.items()} == {"exp_JAN25_rollup.csv": "added", "exp_FEB25_rollup.csv": "failed", "exp_MAR25_rollup.csv": "added"}
    assert got["exp_FEB25_rollup.csv"][1].startswith("cannot be loaded")
    assert [r.campaign_month for r in S.mart_months(spark, mart).collect()] == ["2025-01", "2025-03"]


class Died(Exception):
    pass


def dying(step, value):
    def on_step(s, v):
        if (s, v) == (step, value):
            raise Died
    return on_step


def volumes(spark, mart):
    return {r.campaign_month: r.v for r in S.read_mart(spark, mart).groupBy("campaign_month").agg(F.sum("volume").alias("v")).collect()}


@pytest.mark.parametrize("step, value, seen", [
    ("staged", "", {"2025-01": 100, "2025-02": 100}), ("moved", "2025-01", {"2025-01": 100, "2025-02": 100}),
    ("published", "2025-01", {"2025-01": 500, "2025-02": 100}), ("moved", "2025-02", {"2025-01": 500, "2025-02": 100}),
    ("published", "2025-02", {"2025-01": 500, "2025-02": 500})])
def test_a_dead_writer_leaves_a_readable_mart(spark, folder, tmp_path, step, value, seen):
    from vintagekit.sources import publish as P
    mart = str(tmp_path / "mart")
    for m in ("JAN25", "FEB25"):
        put(folder, m)
    S.replace_months(S.read_rollup_csv(spark, str(folder)), mart)
    for m in ("JAN25", "FEB25"):
        put(folder, m, volume=500)
    new = S.read_rollup_csv(spark, str(folder))
    with pytest.raises(Died):
        S.replace_months(new, mart, on_step=dying(step, value))
    assert volumes(spark, mart) == seen                                            # a reader of the open publication
    assert [r.campaign_month for r in S.mart_months(spark, mart).collect()] == ["2025-01", "2025-02"]
    P.recover(spark, mart, S.KEY)
    assert volumes(spark, mart) == seen and sorted(p.name for p in (tmp_path / "mart").iterdir() if p.name[0] == "_") == []
    S.replace_months(new, mart)
    assert volumes(spark, mart) == {"2025-01": 500, "2025-02": 500}


def test_stale_temporary_months_are_not_listed_and_go(spark, folder, tmp_path):
    mart = tmp_path / "mart"
    put(folder, "JAN25")
    rows = S.read_rollup_csv(spark, str(folder))
    S.replace_months(rows, str(mart))
    stale = mart / "campaign_month=2025-02__tmp"
    stale.mkdir()
    (stale / "part-0.parquet").write_bytes(next((mart / "campaign_month=2025-01").glob("*.parquet")).read_bytes())
    (mart / "campaign_month=2025-03").mkdir()                                      # no files
    assert [r.campaign_month for r in S.mart_months(spark, str(mart)).collect()] == ["2025-01"]
    assert set(volumes(spark, str(mart))) == {"2025-01"} and S.mart_status(spark, str(mart)).first().months == 1
    S.replace_months(rows, str(mart))
    assert not stale.exists()


def test_input_is_read_once_and_empty_months_are_refused(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    mart = str(tmp_path / "mart")
    kinds = {"Prospect_type": "string", "vs_band": "string", "annual_fee": "double", "expected_responses": "double", "expected_responses_xpm": "double"}
    cols = [c for c in ORDER if c not in C.DROP_RATE_COLUMNS]
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in cols) + ", load_month string"
    row = tuple(({c: 1 for c in ORDER} | VALUES)[c] for c in cols)
    df = spark.createDataFrame([(*row, m) for m in ("2025-01", "2025-02") for _ in range(50)], schema)
    expected = spark.createDataFrame([("2025-01",), ("2025-02",), ("2025-03",)], "load_month string")
    got = {r.campaign_month: (r.ok, r.errors) for r in S.replace_months(df.mapInArrow(count, df.schema), mart, expected).collect()}
    assert got == {"2025-01": (True, ""), "2025-02": (True, ""), "2025-03": (False, "rollup is empty")}
    assert seen.value == 100
    assert set(S.read_mart(spark, mart).columns) == {*cols, "campaign_month"}      # nothing of the staging is left in the rows


def test_a_cluster_needs_a_shared_folder():
    assert staging_root("yarn", "hdfs:///shared", "/tmp/x") == "hdfs:///shared"
    assert staging_root("local[4]", None, "/tmp/x") == "/tmp/x/checkpoints"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            staging_root(master, None, "/tmp/x")


# --- campaign edges ---------------------------------------------------------------------------

MAIL = ("CAMPAIGN_DATE date, CAMPFLAG1 string, endmark string, SCORE_VANTAGE_VALUE_V3 string, TRM10_Score string, EXP_RESPONSE_SCORE string, "
        "OFFER_CODE_FIRST_7 string, RESERVATION_SEQUENCE string, TM12_3BR string, ENCRYPTED_PIN string")


def test_missing_reservation_parts_are_blank(spark):
    day = dt.date(2025, 1, 5)
    rows = [(day, "V", None, "700", "0.01", None, "P001001", None, "1", "a"), (day, "V", None, "x", "0.01", None, "P002001", None, "1", "b"),
            (day, "V", None, "700", "0.01", None, None, "000000009", "1", "c"), (day, "V", None, "700", "0.01", None, "P001001", "000000009", "1", "d"),
            (day, "V", "S", "700", "0.01", None, "P001001", "000000008", "1", "e")]
    mail = CP.first_mail_row(CP.mailfile(spark.createDataFrame(rows, MAIL)))
    got = {r.ENCRYPTED_PIN: (r.ReservationNumber, r.vantage3) for r in mail.collect()}
    assert got == {"a": ("P001001", 700.0), "b": ("P002001", None), "c": ("000000009", 700.0), "d": ("P001001000000009", 700.0)}


def test_a_program_code_with_two_fees_raises(spark):
    mail = spark.createDataFrame([(dt.date(2025, 1, 1), "R1", "P001001")], "campaign_month date, ReservationNumber string, OFFER_CODE_FIRST_7 string")
    apps = spark.createDataFrame([], "campaign_month date, RESERVATION_NUMBER string, AppRcvDate date, BoardDate date, FraudDecline_dm int, GrossResponse_dm int, NetResponse_dm int")
    fees = spark.createDataFrame([("P001", 25.0), ("P001", 50.0)], "ProgramCode string, finalcombinedaf double")
    with pytest.raises(Exception, match="two fees"):
        CP.response_join(mail, apps, fees).collect()
    assert CP.response_join(mail, apps, fees.limit(1)).first().annual_fee == 25.0


def test_feature_edges(spark):
    names = [a for a in FE.ATTRIBUTES]
    rows = [{n: None for n in names}, {n: 0.0 for n in names},
            {n: 25.0 for n in names} | {"ALL7120": 995.0, "BCC5120": 999999999.0, "BCC5830": 15.0, "BCC5421": 999999999.0, "REV3511": 98.0, "IQT9510": 9999.0}]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} double" for n in names))
    null, zero, codes = FE.woe_transforms(FE.engineered_features(df)).collect()
    assert null.BCC5120tr == 9.0 and null.BCC5830tr == 9.0                         # a missing amount is low
    assert zero.iqbt_16ratio == -1.0 and zero.iqt_1315ratio == -1.0                # a zero denominator
    assert codes.ALL7120tr == 230.0 and codes.BCC5120tr == 25000.0 and codes.rev3511_cap == 3.0 and codes.iqt9510_impcap == 8.0
    assert codes.BCC5830tr == 20.0 and codes.bcc5421_impcap == -1.0                # 15 rounds away from zero
    assert codes.Full_delinq == 750.0 * round(codes.Full_delinq_min / 750.0) or codes.Full_delinq_min <= 1000


def test_model_lists_are_whole_and_missing_names_raise(spark):
    df = spark.createDataFrame([(1.0,)], "vantage3 double")
    with pytest.raises(ValueError, match="TM12_3RR"):
        FE.feature_select(df, FE.KEEP_LISTS[1])
    assert [len(FE.KEEP_LISTS[k]) for k in (1, 2, 3, 4)] == [38, 41, 50, 35] and len(set(FE.ATTRIBUTES)) == 112
