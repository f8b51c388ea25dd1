"""Reading dynamic JSON payloads.

The walks of unknown depth run as Arrow-batched functions: finding objects with their
fields, the value-free shape, the richness. What the fields mean is worked out JVM-side;
single values of other JSON columns are read from VARIANT.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text, or null when it does not parse."""
    return F.try_parse_json(text)


def first_key(value: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that is present, even when that value is null."""
    return F.coalesce(*[F.try_variant_get(value, f"$['{key}']", "variant") for key in keys])


def type_of(value: Column) -> Column:
    """Type name of a VARIANT value: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def is_number(type_name: Column) -> Column:
    return type_name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def with_scalars(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace VARIANT columns by ``<name>_type`` and ``<name>_text``.

    They become columns of their own so that later expressions refer to a value
    that was read once. The text is null for containers, booleans and nulls.
    """
    typed = df.select("*", *[type_of(F.col(name)).alias(f"{name}_type") for name in names])
    kept = [c for c in typed.columns if c not in names]
    texts = []
    for name in names:
        kind = F.col(f"{name}_type")
        text = F.try_variant_get(F.col(name), "$", "string")
        texts.append(F.when((kind == "STRING") | is_number(kind), text).alias(f"{name}_text"))
    return typed.select(*kept, *texts)


def is_given(name: str) -> Column:
    """The field is there and not null (on the columns of ``with_scalars``)."""
    return F.coalesce(F.col(f"{name}_type") != "VOID", F.lit(False))


# -- fields of found objects ---------------------------------------------------


class Listed(NamedTuple):
    """A list below an object: its names, what is read of each entry, and names of which one
    makes the object itself the only entry when there is no list."""

    names: Sequence[str]
    entry: Record
    alone: Sequence[str] = ()


class Record(NamedTuple):
    """What is read from a JSON object: the first present name of every field, and lists of further objects.

    Values of ``codes`` may be given inside an object, under one of ``CODE_KEYS``.
    """

    fields: dict[str, Sequence[str]]
    codes: Sequence[str] = ()
    lists: dict[str, Listed] = {}


# Names of a code inside an object.
CODE_KEYS = ("code", "airportCode", "airlineCode")
# Type names by the sign that a value carries; ``n`` is a number that Spark has to type.
_SIGNS = {"s": "STRING", "i": "BIGINT", "d": "DECIMAL", "o": "OBJECT", "a": "ARRAY", "b": "BOOLEAN", "v": "VOID"}
# A number that the parser of VARIANT values refuses.
_REFUSED = re.compile(r"[0-9]{1001}")


def _signed(value: object) -> str:
    """A sign for the type, then the text of a string or number, or the length of a list."""
    kind = type(value)  # the decoder makes no other types
    if kind is str:
        return "s" + value if value.isascii() else "s" + value.encode("utf-8", "replace").decode("utf-8")
    if kind is int:
        return f"{'i' if -(2**63) <= value < 2**63 else 'n'}{value!r}"
    if kind is float:
        text = repr(value)
        return f"n{text}" if "e" in text or text == "-0.0" else f"d{text.removesuffix('.0')}"
    if kind is list:
        return f"a{len(value)}"
    return "o" if kind is dict else "v" if value is None else "b"


def _code_in(value: object) -> str | None:
    """``_signed`` of a code that may be given inside an object."""
    if type(value) is dict:
        inner = next((n for n in CODE_KEYS if n in value), None)
        return None if inner is None else _signed(value[inner])
    return _signed(value)


def _signs(values: Sequence[object], coded: bool) -> pa.Array:
    """``_signed`` of a column of values; a column of one type is converted whole."""
    kinds = set(map(type, values))
    try:
        if kinds == {str}:
            return pc.binary_join_element_wise("s", pa.array(values, pa.string()), "")
        if kinds == {int}:
            return pc.binary_join_element_wise("i", pa.array(values, pa.int64()).cast(pa.string()), "")
    except (UnicodeError, OverflowError, pa.ArrowException):  # half a surrogate pair, a number beyond a long
        pass
    return pa.array(list(map(_code_in if coded else _signed, values)), pa.string())


def _offsets(sizes: Sequence[int | None], values: pa.Array) -> pa.Array:
    """Array of lists of these sizes; None is no list."""
    ends = np.cumsum([0, *[size or 0 for size in sizes]])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), values, mask=pa.array([size is None for size in sizes], pa.bool_()))


class _Plan(NamedTuple):
    """What is read of objects with the same names: their group, the values, and lists by number and name."""

    group: int
    values: Callable[[dict], tuple]
    lists: list[tuple[int, str | None, bool]]


class _Rows:
    """The kinds, fields and lists of JSON values, taken up one by one and given back as an array.

    Objects that name their fields alike form a group, whose values are converted column by column.
    """

    def __init__(self, spec: Record):
        self.spec = spec
        self.type = _arrow_type(_record_type(spec))
        self.below = [_Rows(x.entry) for x in spec.lists.values()]
        self._forget()
        self._clear()

    def _forget(self) -> None:
        # Which names count depends on the names of an object alone, and most objects share theirs with others.
        self.plans: dict[tuple[str, ...], _Plan] = {}
        self.groups: dict[tuple[str | None, ...], int] = {}

    def _clear(self) -> None:
        self.order: list[int] = []
        # Values that are no objects come first; of them only the sign is kept.
        self.rows: list[list] = [[] for _ in range(1 + len(self.groups))]
        self.sizes: list[list[int | None]] = [[] for _ in self.below]

    def _plan(self, node: dict) -> _Plan:
        chosen = tuple(next((n for n in names if n in node), None) for names in self.spec.fields.values())
        if (group := self.groups.get(chosen)) is None:
            group = self.groups[chosen] = len(self.rows)
            self.rows.append([])
        names = [name for name in chosen if name is not None]
        values = itemgetter(*names) if len(names) > 1 else lambda x: tuple([x[name] for name in names])
        lists = [
            (k, next((n for n in x.names if n in node), None), any(n in node for n in x.alone))
            for k, x in enumerate(self.spec.lists.values())
        ]
        return _Plan(group, values, lists)

    def add(self, node: object) -> None:
        if type(node) is not dict:
            sign = _signed(node)
            self.skip(sign if sign[0] in "idn" else sign[0])
            return
        if (plan := self.plans.get(keys := tuple(node))) is None:
            plan = self._plan(node)
            if len(keys) <= 100 and len(self.plans) < 1000:
                self.plans[keys] = plan
        group, values, lists = plan
        self.order.append(group)
        self.rows[group].append(values(node))
        for k, name, alone in lists:
            found = None if name is None else node[name]
            if type(found) is not list:
                found = [node] if alone else None
            self.sizes[k].append(None if found is None else len(found))
            if found:
                add = self.below[k].add
                for entry in found:
                    add(entry)

    def skip(self, sign: str | None) -> None:
        """A row without fields."""
        self.order.append(0)
        self.rows[0].append(sign)
        for sizes in self.sizes:
            sizes.append(None)

    def _part(self, chosen: Sequence[str | None], rows: list) -> pa.Array:
        given = iter(zip(*rows, strict=True))
        columns = [pa.array(["o"] * len(rows), pa.string())]
        for field, name in zip(self.spec.fields, chosen, strict=True):
            columns.append(
                pa.nulls(len(rows), pa.string()) if name is None else _signs(next(given), field in self.spec.codes))
        return pa.StructArray.from_arrays(columns, fields=list(self.type)[: len(columns)])

    def taken(self) -> pa.Array:
        """The rows taken up so far, in their order; the next ones begin anew."""
        size = 1 + len(self.spec.fields)
        nothing = [pa.nulls(len(self.rows[0]), pa.string())] * (size - 1)
        parts = [pa.StructArray.from_arrays(
            [pa.array(self.rows[0], pa.string()), *nothing], fields=list(self.type)[:size])]
        parts += [self._part(chosen, self.rows[k]) for chosen, k in self.groups.items() if self.rows[k]]
        places = np.empty(len(self.order), np.int64)
        places[np.argsort(self.order, kind="stable")] = np.arange(len(self.order))
        flat = pa.concat_arrays(parts).take(pa.array(places)).flatten()
        lists = [_offsets(sizes, rows.taken()) for sizes, rows in zip(self.sizes, self.below, strict=True)]
        if len(self.groups) > 1000:
            self._forget()
        self._clear()
        return pa.StructArray.from_arrays([*flat, *lists], fields=list(self.type))


def _record_type(spec: Record) -> T.StructType:
    texts = [T.StructField(name, T.StringType()) for name in ("kind", *spec.fields)]
    lists = [T.StructField(name, T.ArrayType(_record_type(x.entry))) for name, x in spec.lists.items()]
    return T.StructType([*texts, *lists])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return pa.string()


def with_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace fields of a ``Record`` by ``<name>_type`` and ``<name>_text``, as ``with_scalars`` does for VARIANT."""
    kept = [c for c in df.columns if c not in names]
    titles = F.array(*[F.lit(x) for x in _SIGNS.values()])
    columns = []
    for name in names:
        value = F.col(name)
        sign, rest = F.substring(value, 1, 1), F.substr(value, F.lit(2))
        other = parsed(F.when(value.startswith("n"), rest))
        columns += [
            F.when(value.startswith("n"), type_of(other)).otherwise(
                F.get(titles, F.instr(F.lit("".join(_SIGNS)), sign) - 1)).alias(f"{name}_type"),
            F.when(sign.isin("s", "i", "d"), rest).when(
                sign == "n", F.try_variant_get(other, "$", "string")).alias(f"{name}_text"),
        ]
    return df.select(*kept, *columns)


def list_size(name: str) -> Column:
    """Entries of a field of a ``Record`` that is a list."""
    return F.when(F.substring(name, 1, 1) == "a", F.substr(F.col(name), F.lit(2)).cast("bigint"))


# -- walks -----------------------------------------------------------------------


def _walk(root: object, accept) -> Iterator[tuple[str, object]]:
    """Accepted objects and lists in document order; nothing below an accepted one is looked at."""
    pending = [("$", "", root)]
    while pending:
        path, name, node = pending.pop()
        if accept(name, node):
            yield path, node
        elif isinstance(node, dict):
            pending.extend([(f"{path}.{k}", k, x) for k, x in node.items() if isinstance(x, (dict, list))][::-1])
        elif isinstance(node, list):
            pending.extend([(f"{path}[{i}]", "", x) for i, x in enumerate(node) if isinstance(x, (dict, list))][::-1])


def _objects(root: object) -> Iterator[dict]:
    """All objects in document order."""
    pending = [root]
    while pending:
        node = pending.pop()
        if type(node) is dict:
            yield node
            node = node.values()
        elif type(node) is not list:
            continue
        if below := [x for x in node if type(x) is dict or type(x) is list and x]:
            pending.extend(below[::-1])


def _code_of(node: dict, names: Sequence[str], length: int) -> str | None:
    """Code of the given length under the first present name of an object."""
    value = next((node[n] for n in names if n in node), None)
    if isinstance(value, dict):
        value = next((value[n] for n in CODE_KEYS if n in value), None)
    code = "" if value is None or isinstance(value, bool) else str(value).strip().upper()
    return code if len(code) == length else None


@cache
def _decoder() -> tuple[Callable[[str], object], list[str]]:
    """Reader of JSON texts, and the list of the numbers it met that may be refused."""
    odd: list[str] = []

    def fraction(text: str) -> float:
        if len(text) > 300 or "e" in text or "E" in text:
            odd.append(text)
        return float(text)

    def whole(text: str) -> int:
        if len(text) > 300:
            odd.append(text)
        return int(text)

    return json.JSONDecoder(
        parse_float=fraction, parse_int=whole, parse_constant=lambda x: odd.append(x) or float(x),
    ).decode, odd


def _refused(node: object) -> bool:
    """The node holds a number that no VARIANT value can hold."""
    try:
        return _REFUSED.search(json.dumps(node, allow_nan=False)) is not None
    except ValueError:
        return True


# Texts whose values are held in memory at once.
_AT_ONCE = 2000


def _searcher(accept, code_names: Sequence[str], spec: Record, whole_lists: bool):
    """Function over batches of JSON texts: accepted objects, or the entries of accepted lists, and their fields."""
    names = tuple(code_names)
    nameless = frozenset(names).isdisjoint
    record = _record_type(spec)
    kind = T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()), T.StructField("code", T.StringType()),
        T.StructField("found", T.ArrayType(record) if whole_lists else record)]))
    stored = _arrow_type(kind)

    def search(texts: list[str | None], rows: _Rows) -> pa.Array:
        counts, paths, codes, sizes = [], [], [], []
        decode, odd = _decoder()
        for text in texts:
            odd.clear()
            try:
                root = decode(text) if text is not None else None
            except ValueError:
                root = None
            hits = list(_walk(root, accept))
            counts.append(len(hits))
            if not hits:
                continue
            code = None
            for node in _objects(root):
                if not nameless(node) and (code := _code_of(node, names, 3)) is not None:
                    break
            for path, node in hits:
                paths.append(path)
                codes.append(code)
                refused = odd and _refused(node)
                if not whole_lists:
                    rows.skip(None) if refused else rows.add(node)
                    continue
                sizes.append(None if refused else len(node))
                for entry in () if refused else node:
                    rows.add(entry)
        found = _offsets(sizes, rows.taken()) if whole_lists else rows.taken()
        hits = [pa.array(paths, pa.string()), pa.array(codes, pa.string()), found]
        return _offsets(counts, pa.StructArray.from_arrays(hits, fields=list(stored.value_type)))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        rows = _Rows(spec)
        parts = [search(texts.slice(k, _AT_ONCE).to_pylist(), rows) for k in range(0, len(texts), _AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], stored)

    return run


def find_objects(text: Column, all_of: Sequence[Sequence[str]], code_names: Sequence[str], spec: Record) -> Column:
    """Objects at any depth that hold a key of every group, in document order: path, fields (``found``), and
    the first three-letter code that the payload has under ``code_names``."""
    apart = [frozenset(group).isdisjoint for group in all_of]
    return _searcher(
        lambda _, node: isinstance(node, dict) and not any(test(node) for test in apart), code_names, spec, False,
    )(text)


def find_lists(text: Column, list_names: Sequence[str], code_names: Sequence[str], spec: Record) -> Column:
    """As ``find_objects``, for the entries of the lists stored under one of ``list_names``."""
    wanted = frozenset(list_names)
    return _searcher(lambda name, node: name in wanted and isinstance(node, list), code_names, spec, True)(text)


def _kind(value: object) -> str:
    for name, types in (("object", dict), ("list", list), ("boolean", bool), ("string", str)):
        if isinstance(value, types):
            return name
    return "null" if value is None else "number"


def _places(root: object) -> set[str]:
    """``kind /path`` of every place of a JSON value; all items of a list share the place ``[]``."""
    found, pending = set(), [("", root)]
    while pending:
        path, value = pending.pop()
        found.add(f"{_kind(value)} {path}")
        if isinstance(value, dict):
            pending += [(f"{path}/{_escaped(key)}", child) for key, child in value.items()]
        elif isinstance(value, list):
            pending += [(f"{path}/[]", child) for child in value]
    return found


def _escaped(key: str) -> str:
    for code, sign in enumerate("~/[\n"):
        key = key.replace(sign, f"~{code}")
    return key


# Names (first group), texts (second group: their quote) and numbers of a valid JSON text. A number of more digits
# stays, as Python may refuse it.
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_LEAVES = re.compile(
    rf'({_STRING}[ \t\n\r]*+:)|(?=(")){_STRING}|'
    r'(?<![^\[:, \t\n\r])-?(?:0|[1-9][0-9]{0,299})(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![^\],} \t\n\r])')
# Stands behind every leaf.
_MARK = "\x00"


def _described(text: str) -> str | None:
    try:
        return "\n".join(sorted(_places(json.loads(text))))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def payload_shape(texts: pd.Series) -> pd.Series:
    """Value-free description of each JSON text: its places and their kinds, one per line, sorted.

    Null and broken texts give null. Texts that differ only in the values of their leaves have one shape (or are
    broken alike), which is worked out once in a batch.
    """
    known: dict[str, str | None] = {}

    def describe(text: str | None) -> str | None:
        if text is None or _MARK in text:
            return None if text is None else _described(text)
        bare = _LEAVES.sub(rf"\1\2{_MARK}", text)
        if bare not in known:
            if len(known) == 1000:
                known.clear()
            known[bare] = _described(text)
        return known[bare]

    return texts.map(describe)


def shape_fingerprint(text: Column) -> Column:
    """SHA-256 of the shape of a JSON text."""
    return F.sha2(payload_shape(text), 256)


def _richness(root: object) -> int:
    level, total = [root], 0
    for _ in range(9):  # nine levels, the root included
        objects = [node for node in level if isinstance(node, dict)]
        lists = [node for node in level if isinstance(node, list)]
        total += len(objects) + 16 * sum(map(len, lists))
        level = [child for node in objects for child in node.values()]
        level += [child for node in lists for child in node[:64]]
    return total


@F.pandas_udf(T.LongType())
def payload_richness(texts: pd.Series) -> pd.Series:
    """How much structure a JSON text holds: objects count 1, list items 16."""

    def measure(text: str | None) -> int:
        try:
            return 0 if text is None else _richness(json.loads(text))
        except ValueError:
            return 0

    return texts.map(measure).astype("int64")


def _unescaped(key: Column) -> Column:
    for code, sign in reversed(list(enumerate("~/[\n"))):
        key = F.replace(key, F.lit(f"~{code}"), F.lit(sign))
    return key


def top_level_fields(shape: Column, most: int = 40) -> Column:
    """Sorted top-level keys of a stored shape, cut to ``most`` names of 120 characters.

    The cuts belong to the contract of the field list.
    """
    places = F.transform(F.split(shape, "\n"), lambda x: F.regexp_extract(x, "^[a-z]+ /([^/]*)$", 1))
    keys = F.filter(places, lambda k: (k != "") & (k != "[]"))
    keys = F.transform(keys, _unescaped)
    return F.slice(F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.substring(k, 1, 120)))), 1, most)
