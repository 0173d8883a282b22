"""Parser, order, modes, publishing, resume and the named queries against their SQL."""

import dataclasses
import json
import os
import sys
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from sortwright import cli
from sortwright.functions.records import parse
from sortwright.job import job_root, run_sort
from sortwright.model import GeneratorOptions, InvalidMode, LineMode, SortOptions, TempPolicy
from sortwright.operators.modes import apply_mode
from sortwright.operators.sorting import with_position
from sortwright.plans.catalogue import ORACLES, QUERIES
from sortwright.sources import runs
from sortwright.sources.generate import generate, records
from sortwright.sources.lines import numbered_lines, read_lines

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()

VALID = {
    "1. Apple": (1, "Apple"), "415. Apple": (415, "Apple"), "1.  leading spaces": (1, "leading spaces"), "0. Zero": (0, "Zero"),
    "18446744073709551615. Max": (2**64 - 1, "Max"), "1.2. Apple": (1, "2. Apple"), "5.": (5, ""), "1.5": (1, "5"), " 7 . x ": (7, "x "),
    "007. bond": (7, "bond"), "0" * 60 + "1. z": (1, "z"), "　3 . t": (3, "t"), "1. a\rb": (1, "a\rb"),
}
INVALID = ["", "   ", "No dot here", ".NoDotAtStart", "abc. Text", "-1. Negative", "+1. x", "1e3. x", "1 2. x", "18446744073709551616. x", "9" * 45 + ". x", "١. x", "​1. x"]


def test_grammar(spark):
    got = {r["line"]: r for r in parse(spark.createDataFrame([(x,) for x in [*VALID, *INVALID]], "line string")).collect()}
    for line, (number, text) in VALID.items():
        assert (int(got[line]["number"]), got[line]["text"], got[line]["ok"]) == (number, text, True), line
    assert not any(got[x]["ok"] for x in INVALID)


def test_order_is_bytewise(spark):
    texts = ["", "Z", "a", "a b", "aa", "z", "é", "￮", "\U0001f600"]
    df = spark.createDataFrame([(t, n) for n in (999, 1) for t in reversed(texts)], "text string, number long").select("text", F.col("number").cast("decimal(20,0)").alias("number"))
    got = [(r["text"], int(r["number"])) for r in with_position(df).orderBy("pos").collect()]
    assert got == [(t, n) for t in texts for n in (1, 999)]
    rows = with_position(records(spark, 5000, 50)).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, 5001))
    assert rows == sorted(rows, key=lambda r: (r["text"].encode(), r["number"]))


def test_modes(spark):
    parsed = parse(spark.createDataFrame([("1. a",), ("bad",), ("2. b",)], "line string"))
    assert apply_mode(parsed, InvalidMode.SKIP)[0].count() == 2
    assert [r["line"] for r in apply_mode(parsed, InvalidMode.LOG)[1].collect()] == ["bad"]
    with pytest.raises(Exception, match="invalid line"):
        apply_mode(parsed, InvalidMode.STRICT)[0].collect()
    with pytest.raises(Exception, match="limit"):
        apply_mode(parsed, InvalidMode.SKIP, 0)[0].collect()


def test_lines(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_bytes(b"\xef\xbb\xbf1. a\r\n2. b\r\r\n3. c\rd\n\n4. \xff\xc3\x28\nlast\r")
    assert [r["line"] for r in read_lines(spark, str(p)).collect()] == ["1. a", "2. b\r", "3. c\rd", "", "4. ��(", "last"]
    assert read_lines(spark, str(p), LineMode.UNIVERSAL).count() > 6


def test_every_line_once_whatever_the_splits(spark, tmp_path):
    lines = [f"{i}. {'é' * (i % 23)}{'x' * (i * 7 % 300)}" for i in range(3000)]
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, (sep, mode) in enumerate([("\n", LineMode.LF), ("\r\n", LineMode.LF), ("\r\n", LineMode.UNIVERSAL), ("\n", LineMode.UNIVERSAL)]):
        path = tmp_path / f"{k}.txt"
        path.write_bytes(sep.join(lines).encode())
        try:
            spark.conf.set(name, "1009")
            read = read_lines(spark, str(path), mode)
            assert read.rdd.getNumPartitions() > 100
            assert sorted(r["line"] for r in read.collect()) == sorted(lines)
            assert [r["line"] for r in numbered_lines(spark, str(path), mode).orderBy("pos").collect()] == lines
        finally:
            spark.conf.set(name, before)


GOLDEN = ["1. Apple", "415. Apple", "2. Banana is yellow", "32. Cherry is the best", "30432. Something something something"]


def _job(tmp_path, lines, **more):
    (tmp_path / "in.txt").write_text("".join(x + "\n" for x in lines))
    return SortOptions(str(tmp_path / "in.txt"), str(tmp_path / "out.txt"), str(tmp_path / "tmp"), **more)


def test_golden_sort(spark, tmp_path):
    options = _job(tmp_path, [GOLDEN[i] for i in (1, 4, 0, 3, 2)], metrics_path=str(tmp_path / "m.json"))
    metrics = run_sort(spark, options)
    assert (tmp_path / "out.txt").read_text().splitlines() == GOLDEN
    assert metrics["ValidLines"] == metrics["RecordsMerged"] == 5 and os.path.exists(tmp_path / "m.json")
    assert metrics["OutputBytesWritten"] == os.path.getsize(tmp_path / "out.txt")
    with pytest.raises(FileExistsError):
        run_sort(spark, _job(tmp_path, GOLDEN, overwrite_output=False))


def test_empty_input(spark, tmp_path):
    assert run_sort(spark, _job(tmp_path, []))["ValidLines"] == 0
    assert (tmp_path / "out.txt").read_text() == ""


def test_strict_failure_is_not_resumed(spark, tmp_path):
    for _ in range(2):
        with pytest.raises(Exception, match="invalid line"):
            run_sort(spark, _job(tmp_path, ["1. a", "bad"]))
        assert not (tmp_path / "out.txt").exists()


def test_failures_tell_and_leave_nothing(spark, tmp_path):
    (tmp_path / "out.txt").write_text("old")
    options = _job(tmp_path, ["1. a", "bad", "2. b", "worse"], metrics_path=str(tmp_path / "m.json"))
    with pytest.raises(ValueError, match="2 invalid lines, such as: bad"):
        run_sort(spark, options)
    told = json.loads((tmp_path / "m.json").read_text())
    assert (told["ValidLines"], told["InvalidLines"], told["OutputBytesWritten"], told["PeakManagedMemoryBytes"]) == (2, 2, None, None)
    assert (tmp_path / "out.txt").read_text() == "old" and not (tmp_path / "out.txt.tmp").exists()
    (tmp_path / "m.json").unlink()
    with pytest.raises(FileNotFoundError):
        run_sort(spark, dataclasses.replace(options, input_path=str(tmp_path / "none")))
    with pytest.raises(FileExistsError):
        run_sort(spark, dataclasses.replace(options, overwrite_output=False))
    assert not (tmp_path / "m.json").exists()  # both are refused before any work


def test_a_gone_input_resumes_only_with_the_same_options(spark, tmp_path):
    lines = ["2. b", "bad", "1. a"]
    options = _job(tmp_path, lines, temp_policy=TempPolicy.KEEP_ALL, delete_input=True, invalid_mode=InvalidMode.SKIP)
    run_sort(spark, options)
    with pytest.raises(FileNotFoundError):
        run_sort(spark, dataclasses.replace(options, invalid_mode=InvalidMode.STRICT))
    run_sort(spark, options)
    assert (tmp_path / "out.txt").read_text() == "1. a\n2. b\n"


def test_sort_of_many_parts(spark, tmp_path):
    """Hot texts, repeated records, a third of all lines one record: parts follow each other in order."""
    made = records(spark, 160_000, 40, 3)
    hot = spark.range(80_000).select(F.lit("7. the same").alias("value"))
    path, out = str(tmp_path / "in"), tmp_path / "out.txt"
    made.select(F.concat(F.col("number").cast("string"), F.lit(". "), F.col("text")).alias("value")).unionByName(hot).write.text(path)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        run_sort(spark, SortOptions(path, str(tmp_path / "parts"), str(tmp_path / "tmp"), chunk_size_mb=1, single_file=False))
        run_sort(spark, SortOptions(path, str(out), str(tmp_path / "tmp"), chunk_size_mb=1))
        ranked = with_position(parse(read_lines(spark, path)).select("number", "text"))
        assert "SinglePartition" not in ranked._jdf.queryExecution().toString()
        assert ranked.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (240_000, 1, 240_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    lines = [x for f in sorted((tmp_path / "in").glob("part-*")) for x in f.read_text().splitlines()]
    want = sorted(lines, key=lambda x: (x.split(". ", 1)[1].encode(), int(x.split(".", 1)[0])))
    parts = [f.read_text().splitlines() for f in sorted((tmp_path / "parts").glob("part-*"))]
    assert len(want) == 240_000 and len(parts) >= 8 and max(map(len, parts)) < 80_000
    assert [x for p in parts for x in p] == want and out.read_text().splitlines() == want


def test_log_mode_keeps_input_order(spark, tmp_path):
    metrics = run_sort(spark, _job(tmp_path, ["z", "2. b", "y", "1. b", "x"], invalid_mode=InvalidMode.LOG, invalid_log=str(tmp_path / "bad")))
    assert (metrics["ValidLines"], metrics["InvalidLines"]) == (2, 3)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["z", "y", "x"]


def test_resume_after_ingest(spark, tmp_path):
    options = _job(tmp_path, GOLDEN, temp_policy=TempPolicy.KEEP_ALL, delete_input=True)
    run_sort(spark, options)
    assert not (tmp_path / "in.txt").exists()
    (tmp_path / "out.txt").unlink()
    run_sort(spark, options)
    assert (tmp_path / "out.txt").read_text().splitlines() == GOLDEN
    changed = _job(tmp_path, ["9. new"], temp_policy=TempPolicy.KEEP_ALL)
    run_sort(spark, changed)
    assert (tmp_path / "out.txt").read_text() == "9. new\n"


@pytest.mark.parametrize("named", ["/shared/run", "file:///shared/run/"])
def test_a_cluster_takes_temp_folders_below_the_shared_one(spark, named):
    # What a session of a standalone cluster tells; paths alone are looked at.
    sc = spark.sparkContext
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", _jvm=sc._jvm, _jsc=sc._jsc, getConf=lambda: {"spark.checkpoint.dir": named}))
    root = lambda temp: job_root(cluster, SortOptions("in", "out", temp))
    assert root("/shared/run/job/temp") == "/shared/run/job/temp/sortwright-job"
    assert root(None) == f"{named.rstrip('/')}/tmp-sort/sortwright-job"
    for other in ("/tmp/x", "/shared/runs", "./tmp-sort"):
        with pytest.raises(ValueError, match="scheme"):
            root(other)


def test_runs():
    assert len(runs.encode_record(12345, "Hello World")) == 21
    rows = [(2**64 - 1, "x" * 90), (1, "")]
    assert list(runs.read_run(runs.write_run(rows))) == rows
    with pytest.raises(ValueError):
        list(runs.read_run(b"BADMAGIC____"))


def test_read_runs(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(runs.write_run([(2**64 - 1, "b"), (1, "a")]))
    assert sorted((int(r["number"]), r["text"]) for r in runs.read_runs(spark, str(tmp_path)).collect()) == [(1, "a"), (2**64 - 1, "b")]


def test_write_runs(spark, tmp_path):
    made = records(spark, 4000, 30).repartition(3)
    assert runs.write_runs(made, str(tmp_path / "runs")) == 3
    files = sorted((tmp_path / "runs").glob("*.bin"))
    files[0].rename(files[0].with_suffix(".BIN"))
    (tmp_path / "runs" / "other.txt").write_text("no run")
    for f in (tmp_path / "runs").glob("*.[bB]*"):
        own = list(runs.read_run(f.read_bytes()))
        assert own == sorted(own, key=lambda r: (r[1].encode(), r[0]))
    back = runs.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.select("number", "text").collect()))


def test_generator(spark, tmp_path):
    n = generate(spark, GeneratorOptions(str(tmp_path / "g"), 1, 100))
    lines = parse(read_lines(spark, str(tmp_path / "g")))
    row = lines.agg(F.count("number"), F.countDistinct("text"), F.max(F.length("text")), F.max("number"), F.sum(F.octet_length("line") + 1)).first()
    assert row[0] == n and row[1] <= 100 and row[2] <= 100 and row[3] < 10**18 and row[4] >= 1 << 20
    assert records(spark, 50).repartition(7).orderBy("number").collect() == records(spark, 50).orderBy("number").collect()


def test_command_line(spark, tmp_path):
    assert cli.main(["generate", str(tmp_path / "g"), "1", "50"]) == 0
    assert cli.main(["sort", str(tmp_path / "g"), str(tmp_path / "s.txt"), "--temp-dir", str(tmp_path / "t"), "--metrics-path", str(tmp_path / "m.json")]) == 0
    assert json.loads((tmp_path / "m.json").read_text())["ValidLines"] == len((tmp_path / "s.txt").read_text().splitlines())
    assert cli.main([]) == 0 and cli.main(["sort"]) == 1
    assert cli.main(["sort", str(tmp_path / "none"), str(tmp_path / "out")]) == 2


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(str(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, want.fetchall())


def test_entry_module():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
