import numpy as np
import pytest
from pyspark.sql import functions as F

from helixflow import synthetic
from helixflow.operators import jackknife, segments
from helixflow.sources import packed, profiles, text


def dosages(n_ind, n_snp, seed=0):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (n_ind, n_snp))
    return np.where(rng.random(g.shape) < 0.15, -1, g).astype(np.int8)


def matrix(df, inds, snps):
    got = {(r["ind_idx"], r["geno_row"]): r["g"] for r in df.collect()}
    return np.array([[-1 if got[i, s] is None else got[i, s] for s in snps] for i in inds])


@pytest.mark.parametrize("transposed", [True, False])
def test_round_trip_and_selection(spark, tmp_path, transposed):
    g = dosages(9, 27)
    path = str(tmp_path / "x.geno")
    packed.write_packed(path, g, transposed)
    assert (matrix(packed.genotypes(spark, path, 9, 27), range(9), range(27)) == g).all()
    inds, snps = [8, 2, 0, 7], [5, 0, 26, 3, 11]
    some = packed.genotypes(spark, path, 9, 27, inds=inds, snps=snps, records=3)
    assert some.count() == 20
    assert (matrix(some, inds, snps) == g[np.ix_(inds, snps)]).all()


@pytest.mark.parametrize("transposed", [True, False])
def test_filters_of_one_table_do_not_mix(spark, tmp_path, transposed):
    g = dosages(40, 90, 3)
    path = str(tmp_path / "x.geno")
    packed.write_packed(path, g, transposed)
    every = packed.genotypes(spark, path, 40, 90)
    some = every.filter("geno_row >= 17 and geno_row < 60 and ind_idx in (3, 39, 8) and g is not null")
    assert sorted((r["ind_idx"], r["geno_row"], r["g"]) for r in some.collect()) == [(i, j, g[i, j]) for i in (3, 8, 39) for j in range(17, 60) if g[i, j] >= 0]
    assert every.filter("geno_row = 5 and ind_idx > 36").count() == 3
    assert every.filter("geno_row > 200").count() == every.filter("ind_idx < 0").count() == 0
    assert every.filter("geno_row = 1 or ind_idx = 2").count() == 40 + 90 - 1
    both = every.filter("ind_idx = 3").alias("a").join(every.filter("ind_idx = 8").alias("b"), "geno_row")
    assert both.count() == 90


@pytest.mark.parametrize("transposed", [True, False])
def test_bytes_read_fall_with_the_selection(tmp_path, monkeypatch, transposed):
    g = dosages(24, 60000, 5) if transposed else dosages(60000, 24, 5)
    n_ind, n_snp = g.shape
    path, count = str(tmp_path / "x.geno"), []
    packed.write_packed(path, g, transposed)

    class Counting:
        def __init__(self, *a):
            self.f = open(*a)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            count.append(n)
            return self.f.read(n)

    def read(records, calls):
        inds, snps = (records, calls) if transposed else (calls, records)
        reader = packed.PackedReader({"path": path, "n_ind": n_ind, "n_snp": n_snp, "inds": inds, "snps": snps})
        monkeypatch.setattr(packed, "open", Counting, raising=False)
        count.clear()
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
        monkeypatch.undo()
        return rows, sum(count)

    rows, whole = read("2,7", None)
    assert len(rows) == 2 * 60000 and whole == 2 * 15000
    rows, part = read("2,7", "400-799")
    assert len(rows) == 800 and part == 2 * 100
    rows, two = read("7,2", "1,59999")
    want = {(i, j): v for i in (2, 7) for j in (1, 59999) for v in [g[i, j] if transposed else g[j, i]]}
    got = {((i, s) if transposed else (s, i)): -1 if v is None else v for s, i, v in rows}
    assert got == want and two == 4
    assert read("", "1")[0] == read("1", "")[0] == []
    assert packed.runs([3, 4, 5, 9, 1, 2]) == "3-5,9,1-2" and packed.runs([]) == ""


def test_profile_store(spark, tmp_path):
    prefix = synthetic.write_panel(str(tmp_path), 600, 0.05, missing=0.1)
    panel = packed.Panel(spark, prefix)
    store = profiles.ProfileStore(spark, str(tmp_path / "store"))
    spec = {"a": {"pops": ["Altai", "Mbuti"]}, "7": {"pops": ["Test"]}, "c": {"pops": ["Chimp"]}}
    asked = []

    def work(members):
        asked.append(sorted(r[0] for r in members.select("cohort").distinct().collect()))
        from helixflow.operators.frequency import allele_frequency

        return allele_frequency(panel.calls(members), "geno_row", "cohort")

    def rows(df):
        return sorted((r["cohort"], r["geno_row"], r["p"], r["n"]) for r in df.collect() if r["p"] is not None)

    assert store.load().count() == store.info().count() == 0
    assert store.update(panel.members(spec), work, "v1") == ["7", "a", "c"]
    assert rows(store.load()) == rows(panel.frequencies(spec))
    assert store.update(panel.members(spec), work, "v1") == [] and len(asked) == 1
    spec["a"]["pops"].append("Vindija")
    assert store.update(panel.members({"a": spec["a"]}), work, "v1") == ["a"] and asked[-1] == ["a"]
    assert rows(store.load()) == rows(panel.frequencies(spec))
    assert rows(store.load(["7"])) == rows(panel.frequencies({"7": spec["7"]}))
    assert {r["cohort"]: r["sites"] for r in store.info().collect()} == {k: len(rows(store.load([k]))) for k in spec}
    # a new panel makes all of them stale; profiles without their info are not served
    stale = profiles.digests(panel.members(spec), "v2")
    store._write(panel.frequencies(spec).join(stale, "cohort").select("geno_row", "p", F.col("n").cast("bigint").alias("n"), "digest", "cohort"), "profiles")
    assert store.load().count() == 0
    assert store.update(panel.members(spec), work, "v2") == ["7", "a", "c"]
    assert rows(store.load()) == rows(panel.frequencies(spec))
    # a cohort without calls keeps no old rows
    assert store.update(panel.members({"c": spec["c"]}), lambda m: work(m).limit(0), "v3") == ["c"]
    assert rows(store.load(["c"])) == [] and rows(store.load(["a"])) != []


def test_archaic_segments(spark, tmp_path):
    (tmp_path / "d.txt").write_text("chrom start end length state mean_prob\n1 100 2000 1900 Archaic 0.9\n1 2000 9000 7000 Human 0.99\n2 5 x 1 archaic_B nan?\n")
    got = text.archaic_segments(spark, str(tmp_path / "d.txt")).orderBy("chrom").collect()
    assert [tuple(r[c] for c in ("chrom", "start", "end", "state", "prob")) for r in got] == [("1", 100, 2000, "Archaic", 0.9), ("2", 5, None, "archaic_B", None)]
    (tmp_path / "e.txt").write_text("chr begin stop state\n3 1 2 Archaic\n")
    got = text.archaic_segments(spark, str(tmp_path / "e.txt")).collect()
    assert [(r["chrom"], r["start"], r["end"], r["prob"]) for r in got] == [("3", 1, 2, None)]


def test_lengths_and_sources_of_decoded_segments(spark, tmp_path):
    head = "CHR START END LENGTH STATE Altai_SNPs shared_with_denisova"
    (tmp_path / "a.txt").write_text(head + "\n1 0 5 60000000 Archaic 6 1\n1 7 9 20000000 Human 50 50\n2 0 1 10000000 archaic 2 1\n2 1\n2 3 4 x archaic 0 0\n")
    got = text.archaic_segments(spark, str(tmp_path / "a.txt"))
    assert sorted((r["cm"] is None, r["cm"]) for r in got.collect()) == [(False, 13.0), (False, 78.0), (True, None)]
    shares = {r["source"]: (r["total"], round(r["pct"], 6)) for r in segments.source_shares(got, list(text.ARCHAICS)).collect()}
    assert shares == {"altai": (8.0, 80.0), "denisova": (2.0, 20.0)}
    ages = segments.implied_ages(got, [], "cm").collect()
    assert [(round(r["age_longest"], 6), round(r["age_top3"], 6)) for r in ages] == [(round(100 / 78, 6), round(100 / 45.5, 6))]
    (tmp_path / "b.txt").write_text("chrom start end cm\n1 0 2000000 3.5\n1 0 9 nan\n")
    assert sorted(str(r["cm"]) for r in text.archaic_segments(spark, str(tmp_path / "b.txt")).collect()) == ["3.5", "None"]
    (tmp_path / "c.txt").write_text("chrom start end state\n")
    assert text.archaic_segments(spark, str(tmp_path / "c.txt")).collect() == []


@pytest.mark.parametrize("single", [True, False])
def test_tables_as_text(spark, tmp_path, single):
    rows = [(1, 'a "b", c', 0.1), (2, "two\nlines", None), (3, None, -1e300), (4, "", 2.0)]
    df = spark.createDataFrame(rows, "id bigint, name string, v double").repartition(3)
    text.write_table(df, str(tmp_path / "p"), str(tmp_path / "c"), single)
    assert single == (len(list((tmp_path / "c").glob("*.csv"))) == 1)
    got = text.read_table(spark, str(tmp_path / "c"), "v double, id int, name string")
    assert got.columns == ["v", "id", "name"]
    assert sorted((r["id"], r["name"], r["v"]) for r in got.collect()) == [(i, n or None, v) for i, n, v in rows]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == rows


def test_bad_files(tmp_path):
    path = str(tmp_path / "x.geno")
    packed.write_packed(path, dosages(6, 13), True)
    with pytest.raises(ValueError):
        packed.layout(path, 6, 999)
    packed.write_packed(path, dosages(6, 13), False)
    with pytest.raises(ValueError):
        packed.layout(path, 999, 13)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        packed.layout(path, 6, 13)
    with open(path, "wb") as f:
        f.write(bytes(200))
    with pytest.raises(ValueError):
        packed.layout(path, 6, 13)


def test_synthetic_panel_recovers_alpha(spark, tmp_path):
    prefix = synthetic.write_panel(str(tmp_path), 12000, 0.05, missing=0.02)
    panel = packed.Panel(spark, prefix)
    assert (panel.n_ind, panel.n_snp) == (30, 12000)
    spec = {p.lower(): {"pops": [p]} for p in ("Altai", "Vindija", "Denisova", "Chimp", "Mbuti", "Test", "AltaiEcho")}
    freq = panel.frequencies(spec).groupBy("geno_row").pivot("cohort", list(spec)).agg(F.first("p"))
    w = jackknife.assign_blocks(panel.snp, "geno_row").select("geno_row", "blk").join(freq, "geno_row")
    c = F.col
    stats = [jackknife.f4_ratio(x, c("altai"), c("chimp"), c(x), c("mbuti"), c("vindija")) for x in ("test", "altaiecho")]
    stats.append(jackknife.dstat("nea", c("test"), c("mbuti"), c("altai"), c("chimp")))
    r = jackknife.jackknife(w, stats, []).first()
    assert 0 < r["theta_test"] < 0.15
    assert 0.6 < r["theta_altaiecho"] < 1.4 and r["z_altaiecho"] > 5
    assert r["theta_nea"] > 0


def test_members_last_id_wins_and_unknown_is_ignored(spark, tmp_path):
    packed.write_ind(str(tmp_path / "p.ind"), [("a", "M", "X"), ("b", "F", "X"), ("a", "U", "Y")])
    packed.write_snp(str(tmp_path / "p.snp"), [("rs1", 1, 0.0, 5, "A", "G"), ("rs2", "X", 0.1, 6, "A", "G")])
    panel = packed.Panel(spark, str(tmp_path / "p"))
    rows = panel.members({"c": {"ids": ["a", "nobody"], "pops": ["X"]}}).collect()
    assert sorted(r["ind_idx"] for r in rows) == [0, 1, 2]
    assert [r["name"] for r in panel.snp.collect()] == ["rs1"]


def test_plink_bytes(spark, tmp_path):
    rows = [(0, i, g) for i, g in enumerate([2, 1, 0, None, 2])]
    calls = spark.createDataFrame(rows, "geno_row bigint, ind_idx bigint, g int")
    snp = spark.createDataFrame([(0, "rs", "1", 0.0, 7, "A", "G")], "geno_row bigint, name string, chrom string, gpos double, pos bigint, a1 string, a2 string")
    ind = spark.createDataFrame([(i, f"i{i}", "M", "P") for i in range(5)], "ind_idx bigint, id string, sex string, pop string")
    packed.write_plink(str(tmp_path / "o"), calls, snp, ind, 5)
    assert (tmp_path / "o.bed").read_bytes() == bytes([0x6C, 0x1B, 0x01, 0b01111000, 0b00000000])
    assert (tmp_path / "o.fam").read_text().splitlines()[0] == "P\ti0\t0\t0\t1\t-9"


def test_character_rows(spark, tmp_path):
    calls = spark.createDataFrame([(0, 0, 2), (0, 1, None), (1, 0, None), (1, 1, None)], "geno_row bigint, ind_idx bigint, g int")
    rows = packed.character_rows(calls, 2).collect()
    assert [(r["geno_row"], r["value"]) for r in rows] == [(0, "29")]
    (tmp_path / "m.geno").write_text("29\n01\n")
    got = packed.read_character_rows(spark, str(tmp_path / "m.geno")).orderBy("geno_row", "ind_idx").collect()
    assert [r["g"] for r in got] == [2, None, 0, 1]


def test_metadata_headers(spark, tmp_path):
    head = ["Genetic ID (long)", "Group ID", "Political Entity", "Lat.", "Long.", "Date mean in BP [x]", "SNPs hit on autosomal targets (1240k snpset)", "ASSESSMENT"]
    rows = [["I1", "G", "Italy", "41.5", "12", "1,500", "300000", "PASS"], ["I2", "G", "", "..", "n/a", "", "x", "CRITICAL"]]
    (tmp_path / "a.anno").write_text("\n".join("\t".join(r) for r in [head, *rows]))
    a, b = text.metadata(spark, str(tmp_path / "a.anno")).orderBy("genetic_id").collect()
    assert (a["genetic_id"], a["date_bp"], a["snps_1240k"], a["lat"]) == ("I1", 1500.0, 300000.0, 41.5)
    assert b["lat"] is None and b["lon"] is None and b["country"] is None and b["snps_1240k"] is None and b["y_hap"] is None


def test_consumer_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text('# x\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tag\n"rs2","2","200","C"\nrs3\tX\t3\tAA\nrs4\t3\tzz\tAA\nrs5\t4\t5\tAAA\n')
    rows = text.consumer_genotypes(spark, str(tmp_path / "c.txt")).orderBy("line_no").collect()
    assert [(r["chrom"], r["pos"], r["geno"]) for r in rows] == [("1", 100, "AG"), ("2", 200, "CC")]


def test_resumable_append(spark, tmp_path):
    path = str(tmp_path / "out")
    work = lambda df: df.withColumn("v", F.col("id") * 2)
    assert text.append_new(work, spark.range(5), path, "id") == 5
    assert text.append_new(work, spark.range(8), path, "id") == 3
    assert text.append_new(work, spark.range(8), path, "id") == 0
    assert spark.read.parquet(path).count() == 8
