import os

from kelpline import session


def test_what_was_made_is_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    df = session.materialize(spark.range(5).toDF("n"), "made")
    path = session._MADE[0].removeprefix("file://").removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    session.job_dir(spark, "never-written")
    assert session.clean_up() == 1 and not os.path.exists(path) and not session._MADE and session.clean_up() == 0
