"""The filter expression language, compiled to a Column.

Operators from the loosest to the tightest: && || == != < <= > >= =~ ~~ & | + - * /, each chain grouped from the right,
~ before a literal or a bracket. White space is dropped everywhere. Missing values: a comparison with one missing side
is false, with both missing it is missing; ~ of missing is true; && with a false left and || with a true left don't look
to the right, else a missing operand makes the result missing; a record is kept if the result is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stranda.functions.alleles import CLUMPED, INDEL, MNP, SNP, SV, VNTR

LEVELS = ("&&", "||", "==", "!=", "<", "<=", ">", ">=", "=~", "~~", "&", "|", "+", "-", "*", "/")
SCAN = ("&&", "||", "==", "!=", "<=", ">=", "=~", "~~", "<", ">", "&", "|", "+", "-", "*", "/")
CONSTANTS = {"SNP": SNP, "MNP": MNP, "INDEL": INDEL, "CLUMPED": CLUMPED, "VNTR": VNTR, "SV": SV}


class FilterError(ValueError):
    """The expression can't be read, or names what the data doesn't have."""


@dataclass(frozen=True)
class Value:
    """A compiled part: its column and its type, one of bool, bits, int, float, string."""

    col: Column
    kind: str


def _outer(text: str) -> list[tuple[int, str]]:
    """Place and spelling of each operator outside brackets and quotes."""
    found, depth, i, operand = [], 0, 0, False
    while i < len(text):
        c = text[i]
        if c == "'":
            i = text.find("'", i + 1)
            if i < 0:
                raise FilterError(f"a quote stays open in {text}")
            operand = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            operand = True
            if depth < 0:
                raise FilterError(f"a bracket too many in {text}")
        elif depth == 0:
            op = next((o for o in SCAN if text.startswith(o, i)), None)
            if op and (operand or op not in ("-", "+", "~~")):
                found.append((i, op))
                i += len(op)
                operand = False
                continue
            operand = operand or c != "~"
        i += 1
    if depth:
        raise FilterError(f"a bracket stays open in {text}")
    return found


class Compiler:
    """info_types gives the type of each INFO tag (flag, int, float, string); columns names the columns of a record."""

    def __init__(self, info_types: dict[str, str] | None = None, columns: dict[str, str] | None = None):
        self.info_types = info_types or {}
        self.columns = {"qual": "qual", "ref": "ref", "alts": "alts", "filters": "filters", "info": "info", "vtype": "vtype", "alleles": "alleles", "contains_n": "contains_n"} | (columns or {})

    def compile(self, expression: str) -> Column:
        """True for the records to keep, never null."""
        text = re.sub(r"\s+", "", expression)
        if not text:
            return F.lit(True)
        return F.coalesce(self._truth(self._part(text), expression), F.lit(False))

    @staticmethod
    def _truth(value: Value, text: str) -> Column:
        """A condition's column; the bits that & and | leave are true where one is set."""
        if value.kind == "bits":
            return value.col != 0
        if value.kind != "bool":
            raise FilterError(f"{text} is no condition")
        return value.col

    def _part(self, text: str) -> Value:
        operators = _outer(text)
        if operators:
            at, op = min(operators, key=lambda x: (LEVELS.index(x[1]), x[0]))
            if not text[:at] or not text[at + len(op) :]:
                raise FilterError(f"{op} lacks a side in {text}")
            return self._binary(op, self._part(text[:at]), self._part(text[at + len(op) :]))
        if text.startswith("~"):
            return Value(F.coalesce(~self._truth(self._part(text[1:]), text), F.lit(True)), "bool")
        if text.startswith("(") and text.endswith(")"):
            return self._part(text[1:-1])
        return self._atom(text)

    def _binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            x, y, stop = self._truth(a, op), self._truth(b, op), F.lit(op == "||")
            both = (x & y) if op == "&&" else (x | y)
            return Value(F.when(x == stop, stop).when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).otherwise(both), "bool")
        if op in ("=~", "~~"):
            if b.kind != "string":
                raise FilterError(f"{op} needs a pattern in quotes")
            hit = F.regexp_like(a.col.cast("string"), b.col)
            return Value(F.when(a.col.isNull(), F.lit(False)).otherwise(hit if op == "=~" else ~hit), "bool")
        numbers = {"int", "float", "bool", "bits"}
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if (a.kind == "string") != (b.kind == "string"):
                raise FilterError(f"{op} between {a.kind} and {b.kind}")
            x, y = (v.col.cast("int") if v.kind == "bool" else v.col for v in (a, b))
            result = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return Value(F.when(x.isNull() & y.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(result, F.lit(False))), "bool")
        if a.kind not in numbers or b.kind not in numbers:
            raise FilterError(f"{op} between {a.kind} and {b.kind}")
        if op in ("&", "|"):
            bits = a.col.cast("int").bitwiseAND(b.col.cast("int")) if op == "&" else a.col.cast("int").bitwiseOR(b.col.cast("int"))
            return Value(bits, "bits")
        x, y = a.col, b.col
        if op == "/":
            return Value(x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)), "float")
        kind = "float" if "float" in (a.kind, b.kind) else "int"
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)

    def _atom(self, text: str) -> Value:
        c = {k: F.col(v) for k, v in self.columns.items()}
        if text.startswith("'") and text.endswith("'") and len(text) > 1:
            return Value(F.lit(text[1:-1]), "string")
        if re.fullmatch(r"-?\d+", text):
            return Value(F.lit(int(text)), "int")
        if re.fullmatch(r"-?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?", text):
            return Value(F.lit(float(text)), "float")
        if text == "QUAL":
            return Value(c["qual"].cast("double"), "float")
        if text == "REF":
            return Value(c["ref"], "string")
        if text == "ALT":
            return Value(F.concat_ws(",", c["alts"]), "string")
        if text == "PASS":
            return Value(F.coalesce(F.array_contains(c["filters"], "PASS"), F.lit(False)), "bool")
        if text == "N_FILTER":
            return Value(F.size(F.coalesce(c["filters"], F.array().cast("array<string>"))), "int")
        if text.startswith("FILTER."):
            return Value(F.coalesce(F.array_contains(c["filters"], text[7:]), F.lit(False)), "bool")
        if text == "VTYPE":
            return Value(c["vtype"], "int")
        if text == "N_ALLELE":
            return Value(F.size(F.coalesce(c["alts"], F.array().cast("array<string>"))) + 1, "int")
        if text in ("DLEN", "LEN"):
            dlen = F.get(c["alleles"], F.lit(0))["dlen"]
            return Value(dlen if text == "DLEN" else F.abs(dlen), "int")
        if text == "VARIANT_CONTAINS_N":
            return Value(c["contains_n"], "bool")
        if text.startswith("INFO."):
            tag, _, index = text[5:].partition("[")
            kind = self.info_types.get(tag)
            if kind is None:
                raise FilterError(f"no INFO tag {tag}")
            raw = F.element_at(c["info"], tag)
            if kind == "flag":
                return Value(F.coalesce(F.map_contains_key(c["info"], tag), F.lit(False)), "bool")
            if index:
                raw = F.get(F.split(raw, ","), F.lit(int(index.rstrip("]")) - 1))
            elif kind in ("int", "float"):
                raw = F.get(F.split(raw, ","), F.lit(0))
            return Value(raw, "string") if kind == "string" else Value(raw.try_cast("int" if kind == "int" else "double"), kind)
        name = next((k for k in CONSTANTS if k.startswith(text)), None)
        if name:
            return Value(F.lit(CONSTANTS[name]), "int")
        raise FilterError(f"{text} is no field, constant or literal")


def compile_filter(expression: str, info_types: dict[str, str] | None = None, columns: dict[str, str] | None = None) -> Column:
    return Compiler(info_types, columns).compile(expression)


def compile_filters(expressions: str, files: int, **options) -> list[Column]:
    """One condition a file from a comma-separated list: a single one holds for all files, an empty list keeps all."""
    parts = expressions.split(",") if expressions else [""]
    if len(parts) == 1:
        parts *= files
    if len(parts) != files:
        raise FilterError(f"{len(parts)} filters for {files} files")
    return [compile_filter(p, **options) for p in parts]
