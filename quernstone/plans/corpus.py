"""Source files of eight kinds, one a part, told alike in Spark and SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

#: Names in the templates and what they stand for; %j% is a Python file's part that another one imports.
NAMES = {"k": "p_partkey", "j": "((p_partkey * 5 + 24) % 200)", "size": "p_size", "word": "replace(p_name, ' ', '_')"}
PY = '''"""Part %k%."""
import os, json.decoder
from typing import Optional
from lib.m%j% import make_%j% as made
from . import near

LIMIT = %size%
Name = Optional[str]


class Shape%k%(BaseModel):
    side: int = %size%
    label: str = Field(default="%word%")

    async def area(self, scale: float = 1.0, *rest, unit="m", **more) -> float:  # size
        return self.grow(scale)


def make_%k%(items, /, key=None):
    return sum(made(i) for i in items)  # uses numpy


def use_%k%(x):
    return os.path.join("numpy", make_%k%(x))
'''
TS = """// first
import React, { useState, useMemo } from 'react';
import { Box } from '@/ui/Box';
import { x } from './near%size%';
import { y } from './near%size%';
export const Card%k% = (props: Props): Item => {
  return null; /* note */
};
export interface Props%k% { a: string }
export { Box, helper };
export default function Main%k%(a: number) { return a; }
class Inner { size(): number { return 1; } }
"""
GO = "package main\n// add\nfunc Add%k%(a int, b int) int {\n\treturn a + b\n}\ntype Pair%k% struct {\n}\n"
RS = '// add\npub fn add%k%(a: i32) -> i32 {\n    a // "no # mark"\n}\nstruct Pair%k% {\n}\n'
JAVA = 'public class P%k% {\n    /* text */\n    public int size(int a) {\n        return "// %word%".length(); // %size%\n    }\n}\n'
RB = "module M%k%\n  def size(a)\n    a # note\n  end\nend\n"
KINDS = [("lib/m%k%.py", PY), ("web/p%k%.tsx", TS), ("pkg/add%k%.go", GO), ("src/%word%/p%k%.rs", RS), ("java/P%k%.java", JAVA), ("app/m%k%.rb", RB), ("docs/%word%/p%k%.md", "# not code %word%"), ("web/page%k%.tsx", "export default Page%k%\n# x\n\n\n\n\nend")]
BROKEN = "p_partkey % 56 = 0"


def said(template: str) -> str:
    """A template as an expression that both engines read."""
    parts = [NAMES[p[1:-1]] if p[:1] == "%" else f"chr({ord(p)})" if p in "\n\t'" else f"'{p}'" for p in re.split(r"(%\w+%|[\n\t'])", template) if p]
    return f"concat('', {', '.join(parts)})"


def _chosen(i: int) -> str:
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN {said(kind[i])}" for n, kind in enumerate(KINDS)) + " END"


_PATH, _TEXT = _chosen(0), f"CASE WHEN {BROKEN} THEN {said('def broken(:' + chr(10))} ELSE {_chosen(1)} END"
FILES_SQL = f"(SELECT p_partkey, p_name, p_size, {_PATH} AS path, {_TEXT} AS text FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a source file for each part; of eight kinds by its key, some Python ones broken.

    Parts are a few bytes each and lie in few row groups, but their files take long to read as code: they are dealt to all cores.
    """
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text"))


def rows_sql(kinds: dict[int, list[str]], values: str = "signature") -> str:
    """path, pos, one text each: a list of texts for files of each kind (broken ones have none), in order."""
    lists = "CASE " + f"WHEN {BROKEN} THEN CAST([] AS VARCHAR[]) " + " ".join(f"WHEN p_partkey % 8 = {n} THEN [{', '.join(map(said, texts))}]" for n, texts in kinds.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    return f"(SELECT p_partkey, path, CAST(i - 1 AS INTEGER) AS pos, x[i] AS {values} FROM (SELECT p_partkey, path, {lists} AS x, unnest(range(1, len({lists}) + 1)) AS i FROM {FILES_SQL}))"
