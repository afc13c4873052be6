from millrace import runs


def test_runs_side_by_side(spark, tmp_path, capsys):
    table = str(tmp_path / "hits")
    spark.createDataFrame([(1, 0, 5), (2, 3, 6), (3, 3, 5)], "WatchID long, AdvEngineID short, UserID long").write.parquet(table)
    good, bad, part = (str(tmp_path / n) for n in ("good", "bad", "part"))
    assert runs.main(["keep", "--input", table, "--folder", good, "--queries", "0,1,4,12"]) == 1  # query 12 lacks its column
    times = runs.read_times(spark, good)
    assert times["12"] == "NA" and all(times[q].isdigit() for q in ("0", "1", "4"))
    other = spark.read.parquet(table).filter("WatchID < 3")
    other.write.parquet(str(tmp_path / "less"))
    assert runs.main(["keep", "--input", str(tmp_path / "less"), "--folder", bad, "--queries", "0,4,12"]) == 1
    assert runs.main(["keep", "--input", table, "--folder", part, "--queries", "1"]) == 0
    got = {q: cells for q, *cells in runs.compare(spark, [good, bad, part], expected=good)}
    assert list(got) == ["0", "1", "4", "12"]
    assert got["0"][1] == "WA" and got["0"][0].isdigit() and got["0"][2] == "" and got["12"] == ["NA", "NA", ""]
    assert got["4"][1].isdigit() and got["1"][0].isdigit() and got["1"][2].isdigit()
    assert all(c != "WA" for _, *cells in runs.compare(spark, [good, bad]) for c in cells)
    capsys.readouterr()
    assert runs.main(["compare", good, bad, "--expected", good, "--markdown", str(tmp_path / "t.md")]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == f"query,{good},{bad}" and lines[1].startswith("0,") and lines[1].endswith(",WA")
    assert (tmp_path / "t.md").read_text().splitlines()[-1] == "| 12 | NA | NA |"
    assert runs.main(["compare", str(tmp_path / "none")]) == 1
