"""The sort job: ingest, order, publish; resumable after a committed ingest."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .functions.records import parse
from .model import InvalidMode, SortOptions, TempPolicy
from .operators import checkpoint
from .operators.metrics import ingest_metrics
from .operators.modes import apply_mode
from .operators.publish import fs_of, publish, publish_folder, write_staging, write_text
from .operators.sorting import sort_records
from .sources.lines import read_lines
from .staging import shared_root

#: Counts that a run has not measured are null in its metrics.
METRICS = "InputBytesRead OutputBytesWritten ValidLines InvalidLines ChunkFilesCreated MergePassesCompleted RecordsMerged PeakManagedMemoryBytes".split()


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@contextmanager
def _split_size(spark: SparkSession, megabytes: int):
    """Input splits of that size, for the time of a job."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{megabytes}m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _is_shared(spark: SparkSession, path) -> bool:
    """Whether a qualified path is the folder that the cluster names as shared, or lies below it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        return False
    fs, top = fs_of(spark, named)
    return f"{path}/".startswith(f"{fs.makeQualified(top)}/")


def job_root(spark: SparkSession, options: SortOptions) -> str:
    """The folder of a job's checkpoint, which driver and executors must share.

    Without a ``temp_dir`` it lies in the working folder of a local session and below
    ``spark.checkpoint.dir`` on a cluster. There a path of no file system is refused, unless
    it lies below that folder, which is shared whether it is named with a scheme or without.
    """
    local = spark.sparkContext.master.startswith("local")
    base = options.temp_dir or ("./tmp-sort" if local else f"{shared_root(spark)}/tmp-sort")
    fs, path = fs_of(spark, base)
    if not local and fs.getUri().getScheme() == "file" and ":" not in base and not _is_shared(spark, fs.makeQualified(path)):
        raise ValueError("on a cluster temp_dir names a folder that all executors share, with its scheme")
    return f"{base.rstrip('/')}/sortwright-job"


def probe(spark: SparkSession, options: SortOptions, resumable: bool) -> None:
    """Refuse, before any work, what can't end well: no input, an output that must stay or can't be written."""
    fs, path = fs_of(spark, options.input_path)
    if not resumable and not fs.globStatus(path):
        raise FileNotFoundError(options.input_path)
    fs, target = fs_of(spark, options.output_path)
    if fs.exists(target) and not options.overwrite_output:
        raise FileExistsError(options.output_path)
    if options.single_file and fs.exists(target) and fs.getFileStatus(target).isDirectory():
        raise IsADirectoryError(options.output_path)
    for where in filter(None, (options.output_path, options.invalid_log, options.metrics_path)):
        fs, path = fs_of(spark, where)
        path = fs.makeQualified(path)
        trial = fs_of(spark, f"{path.getParent()}/.probe-{uuid.uuid4().hex}")[1]
        fs.create(trial, True).close()
        fs.delete(trial, False)


def _ingest(spark: SparkSession, options: SortOptions, root: str, key: str, seen: Observation, known: dict) -> dict:
    """Parse once into a checkpoint of records; counts come from that write.

    In strict mode the lines are counted to the end, so that the error can tell how
    many are no records; nothing is committed then.
    """
    logging = options.invalid_mode is InvalidMode.LOG
    parsed = parse(read_lines(spark, options.input_path, options.line_mode, with_place=logging))
    parsed = parsed.observe(seen, *ingest_metrics(), F.min(F.when(~F.col("ok"), F.col("line"))).alias("bad"))
    if logging:
        parsed.write.mode("overwrite").partitionBy("ok").parquet(f"{root}/lines")
        lines = spark.read.parquet(f"{root}/lines").withColumn("ok", F.col("ok").cast("boolean"))
        records, rejects = apply_mode(lines, InvalidMode.LOG, options.max_text_bytes)
        records.write.mode("overwrite").parquet(f"{root}/records")
        rejects.orderBy("file", "block", "row").select("line").write.mode("overwrite").option("lineSep", "\n").text(f"{root}/rejects")
        publish(spark, f"{root}/rejects", options.invalid_log)
        fs, lines_path = fs_of(spark, f"{root}/lines")
        fs.delete(lines_path, True)
    else:
        apply_mode(parsed, InvalidMode.SKIP, options.max_text_bytes)[0].write.mode("overwrite").parquet(f"{root}/records")
    got = seen.get
    known.update({k: int(got[k]) for k in ("InputBytesRead", "ValidLines", "InvalidLines")})
    if options.invalid_mode is InvalidMode.STRICT and known["InvalidLines"]:
        raise ValueError(f"{known['InvalidLines']} invalid lines, such as: {got['bad']}")
    known["ChunkFilesCreated"] = spark.read.parquet(f"{root}/records").rdd.getNumPartitions() if known["ValidLines"] else 0
    state = {"stage": "ingested", "fingerprint": key, "shape": checkpoint.shape(options), "input": options.input_path, "output": options.output_path, "updated": _now(), "metrics": dict(known)}
    checkpoint.save(spark, root, state)
    return state


def _found(spark: SparkSession, options: SortOptions, root: str):
    """A committed ingest of this input, or where the input is gone of these paths and options."""
    fs, path = fs_of(spark, options.input_path)
    if fs.globStatus(path):
        return checkpoint.load(spark, root, checkpoint.fingerprint(spark, options))
    found = checkpoint.load(spark, root, None)
    same = found and [found[1]["input"], found[1]["output"], found[1].get("shape")] == [options.input_path, options.output_path, checkpoint.shape(options)]
    return found if same else None


def run_sort(spark: SparkSession, options: SortOptions) -> dict:
    """Sort the input file into one output file, or a folder of ordered parts; returns the metrics it also writes.

    Metrics are written on failure too, with null for what was not reached. Merge
    passes and managed memory are always null: the engine's exchange has no such passes,
    and memory is what Spark's own task metrics report.
    """
    options.validate()
    started, root = _now(), job_root(spark, options)
    fs, root_path = fs_of(spark, root)
    found = _found(spark, options, root) if options.resume else None
    probe(spark, options, bool(found))
    done, metrics = False, dict.fromkeys(METRICS)
    try:
        with _split_size(spark, options.chunk_size_mb):
            if not found:
                fs.delete(root_path, True)
                spark.sparkContext.setJobDescription("ingest")
                state = _ingest(spark, options, root, checkpoint.fingerprint(spark, options), Observation("ingest"), metrics)
                records = spark.read.schema("number decimal(20,0), text string").parquet(f"{root}/records")
            else:
                records, state = found
            metrics |= state["metrics"]
            if options.delete_input:
                fs_of(spark, options.input_path)[0].delete(fs_of(spark, options.input_path)[1], True)
            spark.sparkContext.setJobDescription("sort and write")
            written = Observation("sorted")
            write_staging(sort_records(records).observe(written, F.count(F.lit(1)).alias("rows")), f"{root}/sorted")
            metrics["RecordsMerged"] = int(written.get["rows"])
            if metrics["RecordsMerged"] != metrics["ValidLines"]:
                raise RuntimeError(f"{metrics['RecordsMerged']} records written, {metrics['ValidLines']} read")
            put = publish if options.single_file else publish_folder
            metrics["OutputBytesWritten"] = put(spark, f"{root}/sorted", options.output_path, options.overwrite_output)
            done = True
    finally:
        metrics |= {"StartedUtc": started, "UpdatedUtc": _now()}
        spark.sparkContext.setJobDescription(None)
        if options.metrics_path:
            write_text(spark, options.metrics_path, json.dumps(metrics, indent=2))
        if options.temp_policy is TempPolicy.DELETE_ALWAYS or done and options.temp_policy is TempPolicy.DELETE_ON_SUCCESS:
            fs.delete(root_path, True)
    return metrics
