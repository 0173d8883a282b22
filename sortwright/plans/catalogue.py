"""Named queries over the driver tables, and the SQL that each must equal.

A driver compares rows without their order, so the order is a column: pos.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import encoded_size, memory_estimate, parse, render
from ..job import run_sort
from ..model import GeneratorOptions, InvalidMode, LineMode, SortOptions, TempPolicy
from ..operators.metrics import summary
from ..operators.modes import apply_mode
from ..operators.publish import fs_of
from ..operators.sorting import head, merge_sorted, sort_records, tail, union_all, with_position
from ..sources.generate import generate
from ..sources.lines import clean_line, file_sizes, numbered_lines, read_lines
from ..sources.runs import read_runs, write_runs
from ..staging import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame, number: Column, text: Column) -> DataFrame:
    return df.select(number.cast("decimal(20,0)").alias("number"), text.alias("text"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = _table(spark, sf_dir, "events"), F.col("event_id")
    good = F.concat(key.cast("string"), F.lit(". "), F.col("event_type"))
    line = F.when(key % 7 == 0, F.concat(F.lit("-"), good)).when(key % 11 == 0, F.concat(key.cast("string"), F.lit(" "), F.col("event_type"))).otherwise(good)
    return e.select(line.alias("line"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return _records(p, F.col("p_partkey"), F.col("p_name"))


def sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.col("p_name")).alias("line"))
    return with_position(apply_mode(parse(p), InvalidMode.STRICT)[0])


def parse_mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_mode(parse(_mixed(spark, sf_dir)), InvalidMode.SKIP)[0]


def line_validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_mixed(spark, sf_dir)).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_mode(parse(_mixed(spark, sf_dir)), InvalidMode.LOG)[1].select("line")


def utf8_byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return with_position(_records(d, F.col("doc_id"), F.col("text"))).select(F.col("number"), "pos")


def encoded_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy(encoded_size(F.col("text")).alias("bytes")).agg(F.count(F.lit(1)).alias("n"))


def format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    line = F.concat(F.lit("  00"), F.col("p_partkey").cast("string"), F.lit(" .   "), F.col("p_name"), F.lit(" "))
    good = parse(p.select(line.alias("line")))
    return good.where("ok").select(render(F.col("number"), F.col("text")).alias("line"))


def first_dot_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit(". "), F.col("c_name"))
    return parse(c.select(line.alias("line"))).where("ok").select("number", "text")


def uint64_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    number = F.lit("9223372036854775807").cast("decimal(20,0)") + F.col("o_orderkey").cast("decimal(20,0)")
    return with_position(_records(o, number, F.col("o_orderpriority")))


def number_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return with_position(_records(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_returnflag")))


def head_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head(_parts(spark, sf_dir))


def tail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail(_parts(spark, sf_dir))


def _shards(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    names = [("orders", "o_orderkey", "o_orderpriority"), ("customer", "c_custkey", "c_mktsegment"), ("part", "p_partkey", "p_name"), ("events", "event_id", "event_type")]
    return [sort_records(_records(_table(spark, sf_dir, t), F.col(n), F.col(x))) for t, n, x in names]


def merge_sorted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files of four tables as one: the merged file's lines in their order."""
    path = new_path(spark, "merged")
    merged = merge_sorted(_shards(spark, sf_dir))
    merged.select(render(F.col("number"), F.col("text")).alias("value")).write.text(path)
    return numbered_lines(spark, path)


def bag_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(union_all(_shards(spark, sf_dir)))


def duplicates_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _records(_table(spark, sf_dir, "events"), F.col("event_id") % 50, F.col("event_type"))
    return merge_sorted([e]).groupBy("text", "number").agg(F.count(F.lit(1)).alias("n"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(parse(_mixed(spark, sf_dir)))


def crlf_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    line = F.concat(F.col("event_id").cast("string"), F.lit(". "), F.col("event_type"), F.lit("\r"))
    return e.select(clean_line(line).alias("line"))


#: The white space that is trimmed around the number and before the text, then code points that look like it and are kept.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NO_SPACES = [0x200B, 0xFEFF, 0x180E, 0x1C]


def white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each white-space code point around the number, the dot and the text, and others that are none."""
    marks = F.array(*(F.lit(chr(c)) for c in SPACES + NO_SPACES))
    e, n = _table(spark, sf_dir, "events"), len(SPACES + NO_SPACES)
    mark = F.element_at(marks, (F.col("event_id") % n + 1).cast("int"))
    line = F.concat(mark, F.col("event_id").cast("string"), mark, F.lit("."), mark, F.col("event_type"), mark)
    return parse(e.select("event_id", line.alias("line"))).select("event_id", "number", "text", "ok")


def parser_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers beyond 64 bits, long runs of zeros, signs, exponents, other digits, no text."""
    key = F.col("event_id").cast("string")
    lit = F.lit
    forms = [
        F.concat(key, lit(".")), F.concat(key, lit(".5")), F.concat(F.repeat(lit("0"), lit(60)), key, lit(". z")), F.concat(lit("+"), key, lit(". x")), F.concat(key, lit("e3. x")),
        F.concat(lit("1844674407370955161"), (F.col("event_id") % 10).cast("string"), lit(". x")), F.concat(F.repeat(lit("9"), lit(45)), lit(". x")), F.concat(key, lit(" 2. x")),
        lit("\u0661. x"), F.concat(lit("."), key), F.concat(key, lit(". a . b.")), lit(""), lit("   "),
    ]
    line = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    return parse(_table(spark, sf_dir, "events").select("event_id", line.alias("line"))).select("event_id", "number", "text", "ok")


def memory_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", memory_estimate(F.col("text")).alias("bytes"))


def _lines_file(spark: SparkSession, lines: DataFrame, sep: str = "\n") -> str:
    path = new_path(spark, "input")
    lines.select(F.col("line").alias("value")).write.option("lineSep", sep).text(path)
    return path


def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose lines end with LF, every third with CR LF."""
    line = F.concat("line", F.when(F.crc32(F.col("line").cast("binary")) % 3 == 0, F.lit("\r")).otherwise(F.lit("")))
    return read_lines(spark, _lines_file(spark, _mixed(spark, sf_dir).select(line.alias("line"))))


def lines_of_any_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of lines that end with CR only, with CR LF and with LF, read with universal newlines."""
    mixed = _mixed(spark, sf_dir)
    return union_all([read_lines(spark, _lines_file(spark, mixed, sep), LineMode.UNIVERSAL) for sep in ("\r", "\r\n", "\n")])


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_sizes(spark, _lines_file(spark, _mixed(spark, sf_dir))).agg(F.sum("bytes").alias("bytes"))


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through binary run files and back."""
    path = new_path(spark, "runs")
    write_runs(_records(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source")), path)
    return read_runs(spark, path)


def _sorted_file(spark: SparkSession, lines: DataFrame, **options) -> tuple[SortOptions, dict]:
    base = new_path(spark, "job")
    fs, path = fs_of(spark, base)
    fs.mkdirs(path)
    made = SortOptions(_lines_file(spark, lines), f"{base}/sorted.txt", f"{base}/temp", chunk_size_mb=1, metrics_path=f"{base}/metrics.json", **options)
    return made, run_sort(spark, made)


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select(F.concat((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.lit(". "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("line"))


def sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: lines of a file in the order of the file that it publishes."""
    return numbered_lines(spark, _sorted_file(spark, _line_items(spark, sf_dir))[0].output_path)


def sorted_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job with its parts left as they are: files follow each other by name."""
    return numbered_lines(spark, _sorted_file(spark, _line_items(spark, sf_dir), single_file=False)[0].output_path)


def rejected_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's log of lines that are no records, in input order."""
    lines = _mixed(spark, sf_dir).coalesce(1).sortWithinPartitions("line")
    log = f"{new_path(spark, 'log')}.txt"
    _sorted_file(spark, lines, invalid_mode=InvalidMode.LOG, invalid_log=log)
    return numbered_lines(spark, log)


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job writes about itself."""
    made, _ = _sorted_file(spark, _mixed(spark, sf_dir), invalid_mode=InvalidMode.SKIP)
    names = ["InputBytesRead", "OutputBytesWritten", "ValidLines", "InvalidLines", "RecordsMerged"]
    return spark.read.option("multiLine", True).json(made.metrics_path).select(*(F.col(n).cast("long") for n in names))


def resumed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose input is gone, resumed from the ingest that an earlier one committed."""
    lines = _table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.col("p_name")).alias("line"))
    made, _ = _sorted_file(spark, lines, temp_policy=TempPolicy.KEEP_ALL, delete_input=True)
    fs, path = fs_of(spark, made.output_path)
    fs.delete(path, False)
    run_sort(spark, made)
    return numbered_lines(spark, made.output_path)


def generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated file keeps its bounds."""
    path = new_path(spark, "generated")
    rows = generate(spark, GeneratorOptions(path, 2, 500, 7))
    made = parse(read_lines(spark, path))
    return made.agg(
        (F.count(F.lit(1)) == rows).alias("all_rows"), F.bool_and("ok").alias("all_records"), (F.max("number") < 10**18).alias("numbers"), (F.max(F.char_length("text")) <= 100).alias("lengths"),
        (F.countDistinct("text") <= 500).alias("texts"), (F.sum(F.octet_length("line") + 1) >= 2 << 20).alias("size"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        sort_rank, parse_mixed_lines, line_validity_counts, rejected_lines, utf8_byte_order, encoded_size_histogram, format_round_trip, first_dot_rule,
        uint64_boundary, number_tiebreak, head_records, tail_records, merge_sorted_parts, bag_of_parts, duplicates_preserved, metrics_summary, crlf_normalised,
        white_space, parser_edges, memory_estimates, lines_of_files, lines_of_any_ending, file_bytes, run_files, sorted_file, sorted_folder, rejected_log, job_metrics, resumed_sort, generated_lines,
    )
}

_MIXED = """SELECT CASE WHEN event_id % 7 = 0 THEN '-' || event_id || '. ' || event_type
 WHEN event_id % 11 = 0 THEN event_id || ' ' || event_type ELSE event_id || '. ' || event_type END AS line FROM events"""
#: Parsing by the place of the first dot, trimming by a list of characters, and a test of digits: no pattern.
_TRIMMED = " || ".join(f"chr({c})" for c in SPACES)
_PARSED = f"""SELECT * EXCLUDE (digits, rest, number), number, CASE WHEN number IS NOT NULL THEN rest END AS text FROM (
 SELECT *, CASE WHEN digits <> '' AND translate(digits, '0123456789', '') = '' AND length(ltrim(digits, '0')) <= 20
   AND CAST('0' || ltrim(digits, '0') AS HUGEINT) <= 18446744073709551615 THEN CAST(CAST('0' || ltrim(digits, '0') AS HUGEINT) AS DECIMAL(20,0)) END AS number FROM (
 SELECT *, CASE WHEN strpos(line, '.') > 0 THEN trim(substr(line, 1, strpos(line, '.') - 1), {_TRIMMED}) ELSE '' END AS digits,
  ltrim(substr(line, strpos(line, '.') + 1), {_TRIMMED}) AS rest FROM lines))"""
_MARKS = "[" + ", ".join(f"chr({c})" for c in SPACES + NO_SPACES) + "]"
_WHITE = f"""SELECT event_id, mark || event_id || mark || '.' || mark || event_type || mark AS line FROM
 (SELECT *, {_MARKS}[CAST(event_id % {len(SPACES + NO_SPACES)} + 1 AS INT)] AS mark FROM events)"""
_EDGES = """SELECT event_id, CASE event_id % 13 WHEN 0 THEN event_id || '.' WHEN 1 THEN event_id || '.5' WHEN 2 THEN repeat('0', 60) || event_id || '. z'
 WHEN 3 THEN '+' || event_id || '. x' WHEN 4 THEN event_id || 'e3. x' WHEN 5 THEN '1844674407370955161' || (event_id % 10) || '. x' WHEN 6 THEN repeat('9', 45) || '. x'
 WHEN 7 THEN event_id || ' 2. x' WHEN 8 THEN chr(1633) || '. x' WHEN 9 THEN '.' || event_id WHEN 10 THEN event_id || '. a . b.' WHEN 11 THEN '' ELSE '   ' END AS line FROM events"""
_FOUR = """SELECT o_orderkey AS n, o_orderpriority AS t FROM orders UNION ALL SELECT c_custkey, c_mktsegment FROM customer
 UNION ALL SELECT p_partkey, p_name FROM part UNION ALL SELECT event_id, event_type FROM events"""
_ITEMS = "SELECT l_orderkey * 10 + l_linenumber AS n, l_returnflag || ' ' || l_linestatus AS t FROM lineitem"


def _in_order(source: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY t, n) AS pos, n || '. ' || t AS line FROM ({source})"


def _ranked(number: str, text: str, source: str) -> str:
    return f"""SELECT CAST({number} AS DECIMAL(20,0)) AS number, {text} AS text,
 row_number() OVER (ORDER BY {text}, {number}) AS pos FROM {source}"""


ORACLES: dict[str, str] = {
    "sort_rank": _ranked("p_partkey", "p_name", "part"),
    "parse_mixed_lines": f"WITH lines AS ({_MIXED}) SELECT number, text FROM ({_PARSED}) WHERE number IS NOT NULL",
    "line_validity_counts": f"WITH lines AS ({_MIXED}) SELECT number IS NOT NULL AS ok, count(*) AS n FROM ({_PARSED}) GROUP BY 1",
    "rejected_lines": f"WITH lines AS ({_MIXED}) SELECT line FROM ({_PARSED}) WHERE number IS NULL",
    "utf8_byte_order": "SELECT CAST(doc_id AS DECIMAL(20,0)) AS number, row_number() OVER (ORDER BY text, doc_id) AS pos FROM documents",
    "encoded_size_histogram": "SELECT CAST(10 + octet_length(encode(text)) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY 1",
    "format_round_trip": "SELECT p_partkey || '. ' || p_name || ' ' AS line FROM part",
    "first_dot_rule": "SELECT CAST(c_custkey AS DECIMAL(20,0)) AS number, c_nationkey || '. ' || c_name AS text FROM customer",
    "uint64_boundary": _ranked("(CAST(9223372036854775807 AS HUGEINT) + o_orderkey)", "o_orderpriority", "orders"),
    "number_tiebreak": _ranked("(l_orderkey * 10 + l_linenumber)", "l_returnflag", "lineitem"),
    "head_records": "SELECT CAST(p_partkey AS DECIMAL(20,0)) AS number, p_name AS text FROM part ORDER BY p_name, p_partkey LIMIT 5",
    "tail_records": "SELECT CAST(p_partkey AS DECIMAL(20,0)) AS number, p_name AS text FROM part ORDER BY p_name DESC, p_partkey DESC LIMIT 5",
    "merge_sorted_parts": _in_order(_FOUR),
    "bag_of_parts": _ranked("n", "t", f"({_FOUR})"),
    "white_space": f"WITH lines AS ({_WHITE}) SELECT event_id, number, text, number IS NOT NULL AS ok FROM ({_PARSED})",
    "parser_edges": f"WITH lines AS ({_EDGES}) SELECT event_id, number, text, number IS NOT NULL AS ok FROM ({_PARSED})",
    "memory_estimates": "SELECT doc_id, CAST(octet_length(encode(text)) + 96 AS BIGINT) AS bytes FROM documents",
    "lines_of_files": _MIXED,
    "lines_of_any_ending": f"WITH lines AS ({_MIXED}) SELECT line FROM lines UNION ALL SELECT line FROM lines UNION ALL SELECT line FROM lines",
    "file_bytes": f"SELECT CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM ({_MIXED})",
    "run_files": "SELECT CAST(doc_id AS DECIMAL(20,0)) AS number, source AS text FROM documents",
    "sorted_file": _in_order(_ITEMS),
    "sorted_folder": _in_order(_ITEMS),
    "rejected_log": f"WITH lines AS ({_MIXED}) SELECT row_number() OVER (ORDER BY line) AS pos, line FROM ({_PARSED}) WHERE number IS NULL",
    "job_metrics": f"""WITH lines AS ({_MIXED}), parsed AS ({_PARSED}) SELECT CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS InputBytesRead,
 CAST(sum(CASE WHEN number IS NOT NULL THEN octet_length(encode(number || '. ' || text)) + 1 END) AS BIGINT) AS OutputBytesWritten,
 count(number) AS ValidLines, count(*) - count(number) AS InvalidLines, count(number) AS RecordsMerged FROM parsed""",
    "resumed_sort": _in_order("SELECT p_partkey AS n, p_name AS t FROM part"),
    "generated_lines": "SELECT true AS all_rows, true AS all_records, true AS numbers, true AS lengths, true AS texts, true AS size",
    "duplicates_preserved": "SELECT event_type AS text, CAST(event_id % 50 AS DECIMAL(20,0)) AS number, count(*) AS n FROM events GROUP BY 1, 2",
    "metrics_summary": f"""WITH lines AS ({_MIXED}), parsed AS ({_PARSED}) SELECT
 CAST(count(number) AS BIGINT) AS valid_lines, CAST(count(*) - count(number) AS BIGINT) AS invalid_lines,
 CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS input_bytes,
 CAST(sum(CASE WHEN number IS NOT NULL THEN octet_length(encode(number || '. ' || text)) + 1 END) AS BIGINT) AS output_bytes FROM parsed""",
    "crlf_normalised": "SELECT event_id || '. ' || event_type AS line FROM events",
}
