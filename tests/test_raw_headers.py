"""Headers of raw files, found in one job."""

from __future__ import annotations

from ridelens.sources import raw


def test_headers_are_those_the_reader_finds(spark, tmp_path):
    texts = {"a.csv": 'x,"y, z",x\n1,2,3\n', "b.csv": "only\n", "c.csv": "p,,q\n1,2,3\n", "d.csv": "x,y\n" + "1,2\n" * 200_000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    for name in ("a b+c%.csv", "é.csv"):
        (tmp_path / name).write_text("u,v\n1,2\n")
        texts[name] = ""
    paths = [f"{scheme}{tmp_path}/{name}" for scheme, name in zip(["file:", ""] * 3, texts, strict=True)]
    found = raw.csv_schemas(spark, paths)
    assert found == {p: spark.read.option("header", True).csv(p).schema for p in paths}


def test_number_of_jobs_does_not_grow_with_files(spark, tmp_path):
    def jobs(n: int) -> int:
        group = f"headers-{n}"
        for i in range(n):
            (tmp_path / f"{n}-{i}.csv").write_text(f"a,b{i % 3}\n1,2\n")
        spark.sparkContext.setJobGroup(group, "headers")
        raw.csv_schemas(spark, [f"file:{tmp_path}/{n}-{i}.csv" for i in range(n)])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(3) == jobs(25) == 1


def test_empty_files_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("x\n1\n")
    batches = raw.batches(spark, [f"file:{tmp_path}/{n}" for n in ("a.csv", "b.csv")])
    assert [(b.format, len(b.paths)) for b in batches] == [("csv", 1)]
