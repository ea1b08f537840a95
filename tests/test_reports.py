import pytest
from pyspark.sql import functions as F

from helixflow import cli, config, reports


def test_config_layers(tmp_path):
    assert config.load().panels["ho"].snp_floor == 30_000
    (tmp_path / "c.yaml").write_text("blocks: 20\npanels:\n  ho: {snp_floor: 5}\n  new: {prefix: /x}\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.blocks, c.panels["ho"].snp_floor, c.panels["ho"].snps_col, c.panels["new"].prefix) == (20, 5, "snps_ho", "/x")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s/{i}", float(i)) for i in range(30)], "id bigint, name string, z double")
    top = reports.extremes(df, "z", "id", 3)
    assert sorted(r["id"] for r in top.collect()) == [0, 1, 2, 27, 28, 29]
    names = reports.write_candidates(top, "name", str(tmp_path / "c"))
    assert len(names) == 7 and (tmp_path / "c" / "s_29.md").exists()
    reports.write_html({"A <b>": top, "gone": None}, str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text()
    assert "A &lt;b&gt;" in page and "gone" not in page
    reports.write_json(df.filter("id = 1").select("id", F.struct("z").alias("s")), str(tmp_path / "s.json"))
    assert '"z": 1.0' in (tmp_path / "s.json").read_text()
    with pytest.raises(ValueError):
        reports.rows(df, 5)


def test_explanations(spark):
    rows = [
        (2.5, 200_000, "AG", "0.02 [0.011,0.03]", "Han-o", ["few sites", "pseudo-haploid capture", "contamination"], ["outlier of its group", "ancestry with more of it"]),
        (-3.0, 300_000, "DG", "[0.01,0.03]", "Levant_PPN", [], ["admixture with less of it"]),
        (3.0, None, None, None, None, [], ["chance, as far as known"]),
        (None, 5, "SG", "n/a", "Steppe", ["few sites"], ["chance, as far as known"]),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "z double, n bigint, kind string, cont string, grp string").coalesce(1)
    c = F.col
    got = df.select(reports.technical(c("n"), c("kind"), c("cont")).alias("t"), reports.biological(c("z"), c("grp")).alias("b")).collect()
    assert [(r["t"], r["b"]) for r in got] == [r[5:] for r in rows]


def test_cli_lists_queries(capsys):
    assert cli.main(["list"]) == 0 and "dstat_jackknife" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "x"]) == 2
