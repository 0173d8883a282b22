"""The record model, the options of a sort and of a generated file."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import types as T

UINT64_MAX = 18446744073709551615
NUMBER = T.DecimalType(20, 0)
RECORD = T.StructType([T.StructField("number", NUMBER, False), T.StructField("text", T.StringType(), False)])


class InvalidMode(enum.Enum):
    """What happens to a line that is no record."""

    STRICT = "strict"
    SKIP = "skip"
    LOG = "log"


class LineMode(enum.Enum):
    """Which terminators end a line: only LF (with one CR before it), or LF, CRLF and CR."""

    LF = "lf"
    UNIVERSAL = "universal"


class TempPolicy(enum.Enum):
    KEEP_ALL = "keep"
    DELETE_ON_SUCCESS = "on-success"
    DELETE_ALWAYS = "always"


@dataclass(frozen=True)
class SortOptions:
    input_path: str
    output_path: str
    temp_dir: str | None = None
    invalid_mode: InvalidMode = InvalidMode.STRICT
    invalid_log: str | None = None
    metrics_path: str | None = None
    line_mode: LineMode = LineMode.LF
    temp_policy: TempPolicy = TempPolicy.DELETE_ON_SUCCESS
    overwrite_output: bool = True
    resume: bool = True
    delete_input: bool = False
    max_text_bytes: int | None = None
    chunk_size_mb: int = 512
    single_file: bool = True

    def validate(self) -> None:
        if not self.input_path or not self.output_path:
            raise ValueError("input and output paths are required")
        if self.input_path == self.output_path:
            raise ValueError("input and output must differ")
        if self.chunk_size_mb <= 0:
            raise ValueError("the chunk size must be positive")
        if self.invalid_mode is InvalidMode.LOG and not self.invalid_log:
            raise ValueError("log mode needs a path for invalid lines")


@dataclass(frozen=True)
class GeneratorOptions:
    output_path: str
    target_mb: int
    distinct_texts: int = 10_000
    seed: int = 12345
