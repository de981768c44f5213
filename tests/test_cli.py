"""Command-line runner over the registry."""

import tempfile

from rentscope.__main__ import main
from tests.conftest import SF001


def test_list_and_run(spark, capsys):
    assert main(["list"]) == 0
    names = capsys.readouterr().out.split("\n")
    assert "kpi_summary" in names and "churn_scores" in names and "churn_report_refitted  (model)" in names
    out = tempfile.mkdtemp(prefix="rentscope-cli-") + "/geo"
    assert main(["run", "geo_top_n", SF001, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 15
